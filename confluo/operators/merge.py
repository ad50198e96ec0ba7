"""Keyed merges of two or three revisions, as joins with a decision for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt_by_size


def three_way_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key of any revision: value_base, value_ours, value_theirs and a presence flag for each.

    A flag tells an absent key from one whose value is null.
    """
    out = None
    for name, side in (("base", base), ("ours", ours), ("theirs", theirs)):
        part = side.select(*keys, F.col(value).alias(f"value_{name}"), F.lit(True).alias(f"has_{name}"))
        out = part if out is None else out.join(part, keys, "full_outer")
    return out.withColumns({f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in ("base", "ours", "theirs")})


def same(a: str, b: str) -> Column:
    """Both absent, or both present with equal values; null is a value."""
    return (F.col(f"has_{a}") == F.col(f"has_{b}")) & F.col(f"value_{a}").eqNullSafe(F.col(f"value_{b}"))


def decide(rows: DataFrame) -> DataFrame:
    """``rows`` with decision: ours, theirs, drop, add_add, delete_edit or edit_edit; and the kept value.

    Equality of the two sides is tested first, then equality of one side with the base.
    """
    b, o, t = (F.col(f"has_{n}") for n in ("base", "ours", "theirs"))
    decision = (
        F.when(same("ours", "theirs"), F.when(o, "ours").otherwise("drop"))
        .when(same("base", "ours"), F.when(t, "theirs").otherwise("drop"))
        .when(same("base", "theirs"), F.when(o, "ours").otherwise("drop"))
        .when(~b, "add_add")
        .when(~o | ~t, "delete_edit")
        .otherwise("edit_edit")
    )
    out = rows.withColumn("decision", decision)
    from_theirs = (F.col("decision") == "theirs") | ((F.col("decision") == "delete_edit") & ~o)
    return out.withColumns({"kept": F.col("decision") != "drop", "value": F.when(from_theirs, F.col("value_theirs")).when(F.col("decision") != "drop", F.col("value_ours"))})


CONFLICTS = ["add_add", "delete_edit", "edit_edit"]


def change_kind(side: str) -> Column:
    """added, deleted, edited or unchanged against the base."""
    b, s = F.col("has_base"), F.col(f"has_{side}")
    return F.when(~b & s, "added").when(b & ~s, "deleted").when(b & s & ~same("base", side), "edited").otherwise("unchanged")


def match_two_way(template: DataFrame, destination: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with status matched, template_only or destination_only."""
    t = template.select(*keys, F.lit(True).alias("_t")).distinct()
    d = destination.select(*keys, F.lit(True).alias("_d")).distinct()
    status = F.when(F.col("_t") & F.col("_d"), "matched").when(F.col("_t"), "template_only").otherwise("destination_only")
    return t.join(d, keys, "full_outer").select(*keys, status.alias("status"))


def merge_two_way(template: DataFrame, destination: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Destination wins where both have a key, the template fills gaps; ``source`` names the side."""
    t = template.select(*keys, F.col(value).alias("_t"), F.lit(True).alias("_in_t"))
    d = destination.select(*keys, F.col(value).alias("_d"), F.lit(True).alias("_in_d"))
    wins = F.col("_in_d").isNotNull()
    return t.join(d, keys, "full_outer").select(*keys, F.when(wins, F.col("_d")).otherwise(F.col("_t")).alias(value), F.when(wins, "destination").otherwise("template").alias("source"))


def append_missing(template: DataFrame, destination: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All of the destination in order, then the template's rows whose key it lacks; ``part`` and ``order`` give the order."""
    extra = template.join(destination.select(*keys).distinct(), keys, "left_anti")
    columns = destination.columns
    return destination.select(*columns, F.lit(0).alias("part")).unionByName(extra.select(*columns, F.lit(1).alias("part")))


def set_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Three-way set algebra: (base ∩ ours ∩ theirs) ∪ (ours − base) ∪ (theirs − base); rows of a side may repeat."""
    marked = None
    for name, side in (("base", base), ("ours", ours), ("theirs", theirs)):
        part = side.select(*keys, *[F.lit(n == name).alias(n) for n in ("base", "ours", "theirs")])
        marked = part if marked is None else marked.unionByName(part)
    flags = dealt_by_size(marked, *keys).groupBy(*keys).agg(*[F.max(n).alias(n) for n in ("base", "ours", "theirs")])
    return flags.filter(F.when(F.col("base"), F.col("ours") & F.col("theirs")).otherwise(F.col("ours") | F.col("theirs"))).select(*keys)


def ordered_union(sides: list[DataFrame], keys: list[str], signature: str, position: str) -> DataFrame:
    """Union of the sides in turn; of rows with one signature the first by side and position stays."""
    every = None
    for rank, side in enumerate(sides):
        part = side.withColumn("side_rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(*keys, signature).agg(F.min(F.struct("side_rank", position)).alias("_first"))
    return best.select(*keys, signature, F.col("_first.side_rank").alias("side_rank"), F.col(f"_first.{position}").alias(position))


def keyed_member_edits(base: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upsert left, then right; a conflict where the left list has the key with another value."""
    joined = base.select(*keys, F.col(value).alias("_b")).join(left.select(*keys, F.col(value).alias("_l"), F.lit(True).alias("_in_l")), keys, "full_outer").join(
        right.select(*keys, F.col(value).alias("_r"), F.lit(True).alias("_in_r")), keys, "full_outer"
    )
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    merged = F.when(F.col("_in_r").isNotNull(), F.col("_r")).when(F.col("_in_l").isNotNull(), F.col("_l")).otherwise(F.col("_b"))
    return joined.select(*keys, merged.alias(value), (both & ~F.col("_l").eqNullSafe(F.col("_r"))).alias("conflict"))


def comment_delta(rows: DataFrame) -> DataFrame:
    """Three-way choice on a nullable comment, null standing for no comment: outcome and comment."""
    b, o, t = F.col("value_base"), F.col("value_ours"), F.col("value_theirs")
    outcome = F.when(o.eqNullSafe(t), "same").when(b.eqNullSafe(o), "theirs").when(b.eqNullSafe(t), "ours").otherwise("conflict")
    return rows.withColumn("outcome", outcome).withColumn("comment", F.when(F.col("outcome") == "theirs", t).otherwise(o))


def aligned_line_merge(base: Column, ours: Column, theirs: Column) -> Column:
    """Line by line three-way merge of texts of one line count; null where the counts or any line disagree."""
    b, o, t = (F.split(x, "\n") for x in (base, ours, theirs))
    lines = F.transform(F.arrays_zip(b.alias("b"), o.alias("o"), t.alias("t")), lambda x: F.when(x["o"] == x["t"], x["o"]).when(x["b"] == x["o"], x["t"]).when(x["b"] == x["t"], x["o"]))
    fits = (F.size(b) == F.size(o)) & (F.size(b) == F.size(t)) & ~F.exists(lines, lambda x: x.isNull())
    return F.when(fits, F.array_join(lines, "\n"))


def archive_plan(rows: DataFrame) -> DataFrame:
    """Decision for each archive member of three revisions, the first rule that holds.

    ``rows`` are three_way_rows of a member's fingerprint, with ``unsafe`` and ``family``.
    "add" and "delete" look at the two new revisions only.
    """
    ours, theirs = F.col("has_ours"), F.col("has_theirs")
    decision = (
        F.when(F.col("unsafe"), "reject")
        .when(~ours & theirs, "add")
        .when(ours & ~theirs, "delete")
        .when(same("ours", "theirs"), "preserve")
        .when(F.col("family").isNotNull(), "delegate")
        .when(~same("base", "ours") & ~same("base", "theirs"), "conflict")
        .otherwise("rewrite")
    )
    return rows.filter(ours | theirs).withColumn("decision", decision)


def merge_nested_keys(template: DataFrame, destination: DataFrame, doc: str, path: str, value: str) -> DataFrame:
    """(doc, path, value, source): tables of nested keys merged at every depth, the destination winning.

    A row is a leaf; ``path`` is the array of keys that lead to it.  A template leaf stays
    unless the destination has that leaf, a leaf above it (a value where the template has
    a table), or a leaf below it (a table where the template has a value).
    """
    above = lambda leaf: F.transform(F.sequence(F.lit(1), F.size(leaf)), lambda n: F.slice(leaf, F.lit(1), n))
    # every prefix of a destination leaf is taken for template leaves there; whole leaves are for those below
    taken = destination.select(doc, F.explode(above(F.col(path))).alias(path)).distinct()
    whole = destination.select(doc, F.col(path).alias("_above")).distinct()
    rest = template.join(taken, [doc, path], "left_anti")
    below = rest.select(doc, path, F.explode(above(F.col(path))).alias("_above")).join(whole, [doc, "_above"], "left_semi").select(doc, path).distinct()
    kept = rest.join(below, [doc, path], "left_anti")
    return destination.select(doc, path, value, F.lit("destination").alias("source")).unionByName(kept.select(doc, path, value, F.lit("template").alias("source")))
