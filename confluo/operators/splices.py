"""Many replacements in one text, from rows of ranges: overlaps found by a running maximum, one ordered aggregation a text.

Ranges are half-open and count bytes of the UTF-8 text or lines from 0.  A range that
leaves its text or begins before the end of an earlier one is rejected, by name; a text
with a rejected range stays as it is, so edits of a text happen together or not at all.
Ranges that only touch do not overlap; several insertions at one place come in the order
of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import conflict_document
from .merge import aligned_line_merge

#: What a row of edits holds besides the key of its text.
EDIT = ("edit", "start", "end", "replacement")
PART = "struct<start:bigint,end:bigint,edit:bigint,replacement:string>"


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def judged(docs: DataFrame, edits: DataFrame, key: str, text: str, unit: str) -> DataFrame:
    """``edits`` (key and EDIT) with ``ahead``, the furthest end of the ranges before it, and ``rejected``, a category or null."""
    size = F.octet_length(text) if unit == "bytes" else F.size(text_lines(F.col(text)))
    sized = edits.select(key, *EDIT).join(docs.select(key, size.cast("long").alias("size")), key, "left")
    before = Window.partitionBy(key).orderBy("start", "end", "edit").rowsBetween(Window.unboundedPreceding, -1)
    reason = (
        F.when(F.col("size").isNull(), "no_text")
        .when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("start") > F.col("end")) | (F.col("end") > F.col("size")), "out_of_range")
        .when(F.col("start") < F.col("ahead"), "overlap")
    )
    return sized.withColumn("ahead", F.coalesce(F.max("end").over(before), F.lit(0).cast("long"))).withColumn("rejected", reason)


def _parts(judgement: DataFrame, key: str) -> DataFrame:
    """(key, parts) in order, for texts of which no edit is rejected."""
    part = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("edit").cast("long").alias("edit"), F.coalesce("replacement", F.lit("")).alias("replacement"))
    grouped = judgement.groupBy(key).agg(F.array_sort(F.collect_list(part)).cast(f"array<{PART}>").alias("parts"), F.count("rejected").alias("bad"))
    return grouped.filter("bad = 0").select(key, "parts")


def _ahead(parts: Column, i: Column) -> Column:
    """Where the part before number ``i`` ends."""
    return F.when(i > 0, F.get(parts, i - 1)["end"]).otherwise(F.lit(0).cast("long"))


def replaced_bytes(text: Column, parts: Column) -> Column:
    """A text with its parts (an array of PART in order, none within another) in place."""
    raw = text.cast("binary")
    piece = lambda start, end: F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    pieces = F.transform(parts, lambda p, i: F.concat(piece(_ahead(parts, i), p["start"]), p["replacement"]))
    return F.concat(F.array_join(pieces, ""), piece(F.element_at(parts, -1)["end"], F.octet_length(text).cast("long")))


def _lines(text: Column, parts: Column) -> Column:
    lines = text_lines(text)
    run = lambda start, end: F.slice(lines, (start + 1).cast("int"), (end - start).cast("int"))
    # an empty replacement takes its lines away
    new = lambda p: F.when(p["replacement"] == "", F.array().cast("array<string>")).otherwise(text_lines(p["replacement"]))
    pieces = F.flatten(F.transform(parts, lambda p, i: F.concat(run(_ahead(parts, i), p["start"]), new(p))))
    return F.array_join(F.concat(pieces, run(F.element_at(parts, -1)["end"], F.size(lines).cast("long"))), "\n")


def splice(docs: DataFrame, edits: DataFrame, key: str, text: str, unit: str = "bytes") -> tuple[DataFrame, DataFrame]:
    """(key, result, edited) of every text, and the rejected edits (key, edit, category).

    ``unit`` is bytes or lines; edits are in order of start, end and number.  A text is copied once, however many edits it has.
    A null text has no range and stays null.
    """
    judgement = judged(docs, edits, key, text, unit)
    joined = docs.select(key, text).join(_parts(judgement, key), key, "left")
    apply = replaced_bytes if unit == "bytes" else _lines
    result = F.when(F.col("parts").isNotNull(), apply(F.col(text), F.col("parts"))).otherwise(F.col(text))
    return joined.select(key, result.alias("result"), F.col("parts").isNotNull().alias("edited")), judgement.filter("rejected IS NOT NULL").select(key, "edit", F.col("rejected").alias("category"))


def line_offsets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, end): the bytes of each line, its line feed with it; null texts have no lines."""
    lines = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(text_lines(F.col(text))).alias("line", "body"), F.size(text_lines(F.col(text))).alias("n"))
    size = (F.octet_length("body") + F.when(F.col("line") < F.col("n") - 1, 1).otherwise(0)).cast("long")
    end = F.sum(size).over(Window.partitionBy(key).orderBy("line"))
    return lines.select(key, "line", (end - size).alias("start"), end.alias("end"))


def bytes_of_lines(text: Column, start: Column, end: Column) -> Column:
    """The half-open byte range of lines [start, end), line feeds with them; lines beyond the text are not counted."""
    lines = text_lines(text)
    n = F.size(lines)

    def ahead(count: Column) -> Column:
        held = F.least(F.greatest(count.cast("int"), F.lit(0)), n)
        body = F.aggregate(F.slice(lines, F.lit(1), held), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 1)
        return body - F.when((held == n) & (held > 0), 1).otherwise(0)

    first = ahead(start)
    return F.struct(first.alias("start"), F.greatest(first, ahead(F.greatest(start, end))).alias("end"))


def merge_regions(docs: DataFrame, regions: DataFrame, key: str, size: int = 7) -> tuple[DataFrame, DataFrame]:
    """Line by line merges of owned regions only, put in place in ``ours``.

    ``docs``: key, base, ours, theirs; ``regions``: key, owner, and the first and last
    line but one of the owner in each side (base_start, base_end, ...).  A region
    whose lines disagree becomes a conflict between marks there.  Gives (key, result,
    edited) and (key, owner, outcome), the outcome merged, conflict or rejected.
    """
    both = regions.join(docs.select(key, "base", "ours", "theirs"), key)
    for side in ("base", "ours", "theirs"):
        start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
        both = both.withColumn(f"{side}_text", F.array_join(F.slice(text_lines(F.col(side)), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")), "\n"))
    merged = aligned_line_merge(F.col("base_text"), F.col("ours_text"), F.col("theirs_text"))
    bare = {s: F.regexp_replace(f"{s}_text", r"\n+\z", "") for s in ("base", "ours", "theirs")}
    marked = conflict_document(bare["ours"], bare["base"], bare["theirs"], size)
    rows = both.withColumn("merged", merged).select(key, "owner", F.col("ours_start").cast("long").alias("start"), F.col("ours_end").cast("long").alias("end"), F.col("merged").isNotNull().alias("fits"), F.coalesce("merged", marked).alias("replacement"))
    rows = rows.withColumn("edit", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "owner")).cast("long"))
    result, rejected = splice(docs.select(key, "ours"), rows, key, "ours", "lines")
    outcome = F.when(F.col("category").isNotNull(), "rejected").when(F.col("fits"), "merged").otherwise("conflict")
    return result, rows.join(rejected, [key, "edit"], "left").select(key, "owner", outcome.alias("outcome"))
