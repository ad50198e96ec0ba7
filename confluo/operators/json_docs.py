"""JSON documents as rows: owners at every depth, and merges of two or three revisions that recurse into objects.

The revisions of a document are read in one pass, all depths together, as one row a
pointer with what its parent is; so decisions are columns, and the one shuffle is the
ordered aggregation that puts a document's text together, however deep it is.  Objects
keep the order of their members, numbers keep their text, and of a name that an object
repeats the last value counts, at the place of the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_nodes import json_nodes, json_sides
from ..sources.tables import dealt

CONFLICTS = ("add_add", "delete_edit", "edit_edit")
PIECE = "struct<order:array<bigint>,depth:int,open:boolean,label:string,value:string>"


def owners(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, owner_kind, match_key) of every member and element at every depth; elements have an empty match key.

    Rows whose text is no JSON have no owners.
    """
    found = json_nodes(rows, [key], column, wanted=("path", "parent", "name")).filter("parent IS NOT NULL")
    return found.select(key, "path", F.when(F.col("name").isNull(), "element").otherwise("member").alias("owner_kind"), F.coalesce("name", F.lit("")).alias("match_key"))


def _assembled(rows: DataFrame, key: str, *said: Column) -> DataFrame:
    """(key, text) from reached rows with order, open, label and value, and what is ``said`` of all; values of rows neither open nor with one are left out."""
    kept = F.col("open") | F.col("value").isNotNull()
    piece = F.struct("order", F.size("order").alias("depth"), "open", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("value", F.lit("")).alias("value"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(kept, piece))).cast(f"array<{PIECE}>").alias("parts"), *said)
    parts = F.col("parts")

    def text(p: Column, i: Column) -> Column:
        inside = p["depth"] + F.when(p["open"], 1).otherwise(0)
        comma = F.when((i > 0) & (F.get(parts, i - 1)["depth"] >= p["depth"]), ",").otherwise("")
        following = F.coalesce(F.get(parts, i + 1)["depth"], F.lit(0))
        return F.concat(comma, p["label"], F.when(p["open"], "{").otherwise(p["value"]), F.repeat(F.lit("}"), F.greatest(inside - F.greatest(following, F.lit(1)), F.lit(0)) + F.when(i == F.size(parts) - 1, F.least(inside, F.lit(1))).otherwise(0)))

    return grouped.select(key, *[c for c in grouped.columns if c not in (key, "parts")], F.array_join(F.transform(parts, text), "").alias("text"))


def merge_two(template: DataFrame, destination: DataFrame, key: str, column: str) -> DataFrame:
    """(key, merged, diagnostic): objects merged member by member at every depth, the destination winning elsewhere.

    Template members come first, in their order; arrays are taken whole.  A destination
    that parses without its trailing commas only is merged so, as ``fallback_applied``; any
    other text that does not parse gives no merge but ``template_parse_error`` or ``destination_parse_error``.
    Null texts do not parse; a document of one side only is left out.
    """
    pairs = template.select(key, F.coalesce(F.col(column), F.lit("")).alias("t")).join(dealt(destination.select(key, F.coalesce(F.col(column), F.lit("")).alias("d"))), key)
    rows = json_sides(pairs, [key], ["t", "d"], lenient=("d",), wanted=("kind", "value"))
    both = F.coalesce((F.col("t_kind") == "object") & (F.col("d_kind") == "object"), F.lit(False))
    rows = rows.filter("parent IS NULL OR held").withColumns({"open": both, "value": F.coalesce("d_value", "t_value")})
    said = F.when(F.col("parent").isNull(), F.when(F.col("t_kind").isNull(), "template_parse_error").when(F.col("d_kind").isNull(), "destination_parse_error").when(F.col("repaired"), "fallback_applied"))
    whole = _assembled(rows.withColumn("said", said), key, F.max("said").alias("diagnostic"))
    return whole.select(key, "diagnostic", F.when(F.coalesce(~F.col("diagnostic").endswith("parse_error"), F.lit(True)), F.col("text")).alias("merged"))


def decide_three(sides: DataFrame, key: str) -> DataFrame:
    """Reached values of base, ours and theirs with ``decision``: ours, theirs, open, a conflict, or parse_error at a root."""
    names = ("ours", "theirs", "base")
    rows = json_sides(sides, [key], list(names)).filter("parent IS NULL OR (held AND apart)")
    digest = {n: F.col(f"{n}_digest") for n in names}
    same = lambda a, b: digest[a].eqNullSafe(digest[b])
    objects = reduce(lambda p, q: p & q, [F.coalesce(F.col(f"{n}_kind") == "object", F.lit(False)) for n in names])
    there = {n: F.col(f"{n}_digest").isNotNull() for n in names}
    decision = (
        F.when(F.col("wrong"), "parse_error")
        .when(same("ours", "theirs"), "ours")
        .when(same("base", "ours"), "theirs")
        .when(same("base", "theirs"), "ours")
        .when(objects, "open")
        .when(~there["base"], "add_add")
        .when(~there["ours"] | ~there["theirs"], "delete_edit")
        .otherwise("edit_edit")
    )
    return rows.withColumn("decision", decision).withColumn("open", F.col("decision") == "open")


def merged_three(rows: DataFrame, key: str) -> DataFrame:
    """(key, merged) of decided values; documents with a side that does not parse have none."""
    gone = F.col("decision").eqNullSafe("delete_edit") & F.col("ours_value").isNull()
    value = F.when((F.col("decision") == "theirs") | gone, F.col("theirs_value")).otherwise(F.col("ours_value"))
    valued = rows.filter("decision <> 'parse_error'").withColumn("value", F.when(~F.col("open"), value)).filter("open OR value IS NOT NULL")
    return _assembled(valued, key).withColumnRenamed("text", "merged")


def conflicts_three(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, category) of decided values in conflict."""
    return rows.filter(F.col("decision").isin(*CONFLICTS, "parse_error")).select(key, "path", F.col("decision").alias("category"))


def merge_three(sides: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, merged) and the conflicts (key, path, category) of base, ours and theirs, columns of JSON text.

    Objects on all three sides are merged member by member; elsewhere a change of one
    side is taken, and different changes conflict at that path with ours kept (theirs
    where ours has deleted).  A member whose type changed conflicts as a whole.
    Rows of which a side does not parse have a conflict ``parse_error`` and no merge;
    a null side is absent.
    """
    rows = decide_three(sides, key)
    return merged_three(rows, key), conflicts_three(rows, key)
