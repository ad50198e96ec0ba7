"""Change sets, review groups, conformance roll-ups, promotion and contract rules, as aggregates and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inconsistencies(changes: DataFrame) -> DataFrame:
    """Rows (rank, class_id, change_id, detector, severity) of the four detectors.

    ``changes``: change_id, kind, class_id, content_hash.  Every move is a warning;
    per class: several inserts with different hashes, a delete beside a content
    change, several content changes with different hashes are errors.
    """
    per = changes.groupBy("class_id").agg(
        F.count_if(F.col("kind") == "insert").alias("inserts"),
        F.count_distinct(F.when(F.col("kind") == "insert", F.col("content_hash"))).alias("insert_hashes"),
        F.count_if(F.col("kind") == "delete").alias("deletes"),
        F.count_if(F.col("kind") == "content_change").alias("edits"),
        F.count_distinct(F.when(F.col("kind") == "content_change", F.col("content_hash"))).alias("edit_hashes"),
    )
    moves = changes.filter("kind = 'move'").select(F.lit(0).alias("rank"), "class_id", "change_id", F.lit("move").alias("detector"), F.lit("warning").alias("severity"))
    rules = [("duplicate_insert", (F.col("inserts") > 1) & (F.col("insert_hashes") > 1)), ("delete_edit", (F.col("deletes") > 0) & (F.col("edits") > 0)), ("content_conflict", (F.col("edits") > 1) & (F.col("edit_hashes") > 1))]
    found = F.explode(F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(i + 1).alias("rank"), F.lit(name).alias("detector"))) for i, (name, rule) in enumerate(rules)]))).alias("f")
    errors = per.select("class_id", found).select("f.rank", "class_id", F.lit(None).cast("bigint").alias("change_id"), "f.detector", F.lit("error").alias("severity"))
    return moves.unionByName(errors)


def outcome(found: DataFrame, keys: list[str]) -> DataFrame:
    """blocked_by_inconsistency where any error was found, else mergeable."""
    return found.groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("outcome", F.when(F.col("errors") > 0, "blocked_by_inconsistency").otherwise("mergeable"))


def review_groups(cases: DataFrame, group: str, position: str, case: str, first: list[str]) -> DataFrame:
    """One row a group: position of its first case, that case's fields, and the case ids in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, case))), lambda x: x[case])
    return cases.groupBy(group).agg(F.min(position).alias("first_position"), *[F.min_by(c, position).alias(c) for c in first], ordered.alias("case_ids"))


def review_progress(cases: DataFrame, resolved: DataFrame, group: str, case: str) -> DataFrame:
    """Resolved and pending cases of each group; complete when nothing is pending."""
    marked = cases.join(resolved.select(case).distinct().withColumn("_done", F.lit(1)), case, "left")
    return marked.groupBy(group).agg(F.count("_done").alias("resolved"), F.count_if(F.col("_done").isNull()).alias("pending")).withColumn("complete", F.col("pending") == 0)


def select_cases(cases: DataFrame, profiles: DataFrame, family: str) -> DataFrame:
    """Selected or skipped, with the messages of the requirements that the family's profile does not meet."""
    joined = cases.join(profiles, family, "left")
    messages = F.array_compact(
        F.array(
            F.when(F.col("backend").isNotNull() & ~F.coalesce(F.array_contains("backends", F.col("backend")), F.lit(False)), "backend"),
            F.when(F.col("dialect").isNotNull() & ~F.coalesce(F.array_contains("dialects", F.col("dialect")), F.lit(False)), "dialect"),
            F.when(F.size(F.array_except(F.coalesce("policies", F.array().cast("array<string>")), F.coalesce("supported", F.array().cast("array<string>")))) > 0, "policy"),
        )
    )
    return joined.withColumn("messages", F.array_join(messages, ",")).withColumn("status", F.when(F.col("messages") == "", "selected").otherwise("skipped"))


def roll_up(results: DataFrame, keys: list[str], outcome_column: str = "outcome") -> DataFrame:
    """total, passed, failed, skipped per key; other outcomes count in the total only."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(outcome_column) == o).alias(o) for o in ("passed", "failed", "skipped")])


#: Ranks of promotion states.
RANKS = {"experimental": 1, "available": 2, "recommended": 3, "default": 4}


def status_rank(status: Column) -> Column:
    return reduce(lambda c, s: F.when(status == s, RANKS[s]).otherwise(c), RANKS, F.lit(0))


def blocking_reasons(fixtures: Column, formatting: Column, fallbacks: Column, unresolved: Column, least: int, allowed: int, threshold: float = 0.95) -> Column:
    """Gates of a promotion that a profile's report does not pass, comma-joined."""
    gates = [(fixtures < least, "insufficient_fixtures"), (formatting < threshold, "formatting_below_threshold"), (fallbacks > allowed, "too_many_fallbacks"), (unresolved > 0, "unresolved_conflicts")]
    return F.array_join(F.array_compact(F.array(*[F.when(bad, name) for bad, name in gates])), ",")


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def within_limits(counts: Column, limits: dict[str, int]) -> Column:
    """All predicates hold; an empty specification is an error."""
    tests = {"exactly": lambda n: counts == n, "at_least": lambda n: counts >= n, "at_most": lambda n: counts <= n, "none_or_one": lambda n: counts <= 1, "==": lambda n: counts == n, "!=": lambda n: counts != n, "<=": lambda n: counts <= n, ">=": lambda n: counts >= n, "<": lambda n: counts < n, ">": lambda n: counts > n}
    if not limits:
        raise ValueError("a limit needs a constraint")
    return reduce(lambda a, b: a & b, [tests[k](n) for k, n in limits.items()])


def opened(kind: Column, version: Column, payload: Column, wanted: str) -> Column:
    """Struct (ok, error, payload) of an envelope; its kind is checked before its version."""
    error = F.when(~kind.eqNullSafe(F.lit(wanted)), "kind_mismatch").when(~version.eqNullSafe(F.lit(1)), "unsupported_version")
    return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), payload).alias("payload"))
