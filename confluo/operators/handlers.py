"""Conflict handlers for many cases in one plan: every member takes the way of its case's handler, and one aggregation serves all.

``cases``: case, handler, policy; ``members``: case, side (base, left, right), pos, node,
signature, key, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The handlers, and what they say.
INSERTIONS, KEYED = "generic-independent-commutative-insertions", "generic-keyed-member-edit"
SAID = {
    "unsupported": "unsupported generic conflict handler",
    "ordered": "independent insertion handler requires a commutative parent",
    "united": "independent insertions into a commutative parent were unioned deterministically",
    "clash": "keyed member was edited differently on both sides",
    "edited": "independent keyed member edits were merged by key",
}
ITEM = "array<struct<node:string,signature:string,key:string,value:string>>"


def handled(cases: DataFrame, members: DataFrame) -> DataFrame:
    """(case, resolved, merged, diagnostic).

    Insertions: of equal signatures (a node without one stands for itself) the first by
    side and place stays.  Keyed edits: a key stays where it came first and takes the
    last value; a right edit that differs from a left one leaves the whole case unresolved.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("base", 0, "left", 1, "right", 2)]), F.col("side"))
    routed = members.join(cases.filter(F.col("handler").isin(INSERTIONS, KEYED)).select("case", "handler"), "case")
    at = F.struct(rank.alias("rank"), "pos")
    same = F.when(F.col("handler") == INSERTIONS, F.coalesce(F.nullif("signature", F.lit("")), F.col("node"))).otherwise(F.col("key"))
    left, right = F.col("side") == "left", F.col("side") == "right"
    item = F.struct("node", "signature", "key", "value")
    one = routed.groupBy("case", "handler", same.alias("same")).agg(
        F.min(at).alias("first"), F.min_by(item, at).alias("item"), F.max_by("value", at).alias("last"),
        F.max_by(F.when(left, F.col("value")), F.when(left, at)).alias("left_value"), F.count_if(left).alias("lefts"),
        F.min(F.when(right, F.col("value"))).alias("low"), F.max(F.when(right, F.col("value"))).alias("high"), F.count_if(right).alias("rights"),
    )
    clash = (F.col("handler") == KEYED) & (F.col("lefts") > 0) & (F.col("rights") > 0) & ~(F.col("low").eqNullSafe(F.col("left_value")) & F.col("high").eqNullSafe(F.col("left_value")))
    kept = F.when(F.col("handler") == INSERTIONS, F.col("item")).otherwise(F.struct(F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("signature"), F.col("same").alias("key"), F.col("last").alias("value")))
    per = one.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", kept.alias("item")))), lambda x: x["item"]).cast(ITEM).alias("merged"), F.max(clash).alias("clash"))
    rows = cases.join(per, "case", "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
    said = (
        F.when(F.col("handler") == INSERTIONS, F.when(F.coalesce(F.col("policy") == "commutative", F.lit(False)), SAID["united"]).otherwise(SAID["ordered"]))
        .when(F.col("handler") == KEYED, F.when(F.col("clash"), SAID["clash"]).otherwise(SAID["edited"]))
        .otherwise(SAID["unsupported"])
    )
    resolved = F.col("diagnostic").isin(SAID["united"], SAID["edited"])
    merged = F.when(resolved, F.coalesce("merged", F.array().cast(ITEM)))
    return rows.withColumn("diagnostic", said).select("case", resolved.alias("resolved"), merged.alias("merged"), "diagnostic")
