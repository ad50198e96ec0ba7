"""Rules of a benchmark contract as violation rows: schemas, enums, references, required fields, order, eligibility, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, category) of every rule that a row breaks; a rule that is null is kept."""
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return rows.select(key, F.explode(broken).alias("category"))


def case_violations(cases: DataFrame, required: dict[str, list[str]], enums: dict[str, list[str]]) -> DataFrame:
    """Of cases (case_id, schema, operation, capabilities, parent_id, and fields): what each breaks.

    Schemas have major version 1, enum columns hold known names, capabilities are
    sorted without repeats, an operation's fields are there, a parent is a case, ids are
    unique.  Cases without an id are left out.
    """
    cases = cases.filter("case_id IS NOT NULL")
    lacks = [(F.col("operation") == name) & reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fields]) for name, fields in required.items()]
    rules = {
        "schema": ~F.col("schema").rlike(r"^[a-z_]+\.v1(\.[0-9]+)?$"),
        **{f"enum_{c}": ~F.col(c).isin(*names) for c, names in enums.items()},
        "unsorted_capabilities": F.col("capabilities") != F.array_sort(F.array_distinct("capabilities")),
        "missing_field": reduce(lambda a, b: a | b, lacks, F.lit(False)),
    }
    # only cases that have a parent are dealt by it: those without one would all meet in one task
    lost = cases.filter("parent_id IS NOT NULL").select("case_id", "parent_id").join(dealt(cases.select(F.col("case_id").alias("parent_id"))), "parent_id", "left_anti")
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = cases.select("case_id").join(dealt(twice), "case_id", "left_semi")
    found = [violations(cases, "case_id", rules), *[df.select("case_id", F.lit(name).alias("category")) for name, df in (("unknown_parent", lost), ("repeated_id", repeated))]]
    return reduce(DataFrame.unionByName, found)


def result_violations(results: DataFrame, cases: DataFrame, adapters: DataFrame) -> DataFrame:
    """Of results (result_id, case_id, adapter, outcome, eligible): unknown references, and eligibility that is not the case's without excluded outcomes."""
    c = cases.groupBy("case_id").agg(F.bool_or("case_eligible").alias("_case"))
    a = adapters.select("adapter", F.lit(True).alias("_adapter")).distinct()
    joined = results.join(c, "case_id", "left").join(a, "adapter", "left")
    wanted = F.col("_case") & ~F.col("outcome").isin("unsupported", "excluded_ambiguous")
    return violations(joined, "result_id", {"unknown_case": F.col("_case").isNull(), "unknown_adapter": F.col("_adapter").isNull(), "eligibility": F.col("eligible") != wanted})


def report_cover(results: DataFrame, reported: DataFrame) -> DataFrame:
    """Ids that only one of results and report has, or that the report repeats."""
    r = results.select("result_id", F.lit(True).alias("_r")).distinct()
    p = reported.groupBy("result_id").agg(F.count(F.lit(1)).alias("_p"))
    both = r.join(p, "result_id", "full_outer")
    category = F.when(F.col("_p").isNull(), "not_reported").when(F.col("_r").isNull(), "no_result").when(F.col("_p") > 1, "repeated")
    return both.select("result_id", category.alias("category")).filter("category IS NOT NULL")
