"""Edit projections: the edits of a source happen all or not at all; and which provider supports which operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splices import splice


def execute_edits(docs: DataFrame, edits: DataFrame, diagnostics: DataFrame, key: str, text: str, unit: str = "bytes") -> DataFrame:
    """(key, status, source, applied, n_diagnostics): the sources after their edits.

    A blocking diagnostic (key, edit, blocking), or an edit that leaves its text or
    overlaps another, rejects all edits of its source, which then stays as it is with
    none applied; other diagnostics are only counted.  ``applied`` has the numbers of
    the edits in their order.
    """
    said = diagnostics.groupBy(key).agg(F.coalesce(F.bool_or("blocking"), F.lit(False)).alias("blocked"), F.count(F.lit(1)).alias("n_diagnostics"))
    done, rejected = splice(docs, edits, key, text, unit)
    faults = rejected.groupBy(key).agg(F.count(F.lit(1)).alias("n_faults"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "edit"))), lambda e: e["edit"])
    listed = edits.groupBy(key).agg(order.alias("listed"))
    rows = docs.select(key, text).join(done, key).join(said, key, "left").join(faults, key, "left").join(listed, key, "left")
    bad = F.coalesce("blocked", F.lit(False)) | F.col("n_faults").isNotNull()
    none = F.array().cast("array<bigint>")
    return rows.select(
        key, F.when(bad, "rejected").otherwise("applied").alias("status"), F.when(bad, F.col(text)).otherwise(F.col("result")).alias("source"),
        F.when(bad, none).otherwise(F.coalesce(F.col("listed").cast("array<bigint>"), none)).alias("applied"), (F.coalesce("n_diagnostics", F.lit(0)) + F.coalesce("n_faults", F.lit(0))).alias("n_diagnostics"),
    )


def provider_matrix(providers: DataFrame, support: DataFrame, operations: list[str]) -> DataFrame:
    """(provider, operation, support): a row for every stated operation of every provider, ``none`` where nothing is known of it.

    ``providers``: provider; ``support``: provider, operation, support.  Support for
    operations that are not stated is left out.
    """
    cells = providers.select("provider").distinct().select("provider", F.explode(F.array(*[F.lit(o) for o in operations])).alias("operation"))
    known = support.groupBy("provider", "operation").agg(F.max("support").alias("support"))
    return cells.join(known, ["provider", "operation"], "left").withColumn("support", F.coalesce("support", F.lit("none")))
