"""Comment attachments, gap control, freeze directives and conflict regions, as joins and windows over line rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L


def gap_control(gaps: DataFrame, removed: DataFrame) -> DataFrame:
    """``gaps`` with controller, fallback and effective_controller: the first of both whose owner is not in ``removed``.

    ``gaps``: controller_side, before_owner, after_owner; ``removed``: owner.
    """
    side, before, after = F.col("controller_side"), F.col("before_owner"), F.col("after_owner")
    named = gaps.withColumns({"controller": L.gap_owner(side, before, after), "fallback": L.gap_fallback(side, before, after)})
    gone = removed.select("owner").distinct()
    for name in ("controller", "fallback"):
        named = named.join(gone.select(F.col("owner").alias(f"_{name}")), F.col(name) == F.col(f"_{name}"), "left")
    effective = F.coalesce(F.when(F.col("_controller").isNull(), F.col("controller")), F.when(F.col("_fallback").isNull(), F.col("fallback")))
    return named.withColumn("effective_controller", effective).drop("_controller", "_fallback")


def attachment_facts(attachments: DataFrame, regions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per owner: n_regions, n_gaps, empty, leading_owned, trailing_owned and frozen.

    ``attachments``: owner, leading_region, inline_region, trailing_region, orphans
    (array), leading_gap, trailing_gap.  ``regions``: region, floating, frozen.
    ``gaps``: gap, before_owner, after_owner, controller_side.  Regions count as
    often as they are named, gaps once; names without a row do not count.
    """
    named = F.array_compact(F.concat(F.array("leading_region", "inline_region", "trailing_region"), F.coalesce("orphans", F.array().cast("array<bigint>"))))
    used = attachments.select("owner", F.explode(named).alias("region")).join(regions, "region")
    counted = used.groupBy("owner").agg(F.count(F.lit(1)).alias("n_regions"), F.bool_or("frozen").alias("frozen"))
    both = attachments.select("owner", F.explode(F.array_compact(F.array("leading_gap", "trailing_gap"))).alias("gap")).join(gaps.select("gap"), "gap")
    n_gaps = both.groupBy("owner").agg(F.count_distinct("gap").alias("n_gaps"))
    out = attachments.join(counted, "owner", "left").join(n_gaps, "owner", "left")
    for end, other in (("leading", "after_owner"), ("trailing", "before_owner")):
        r = regions.select(F.col("region").alias("_region"), F.col("floating").alias("_floating"))
        g = gaps.select(F.col("gap").alias("_gap"), F.col(other).alias("_owner"), L.gap_owner(F.col("controller_side"), F.col("before_owner"), F.col("after_owner")).alias("_controller"))
        out = out.join(r, F.col(f"{end}_region") == F.col("_region"), "left").join(g, F.col(f"{end}_gap") == F.col("_gap"), "left")
        owned = F.col("_floating") & (F.col("_owner") == F.col("owner")) & (F.col("_controller") == F.col("owner"))
        out = out.withColumn(f"{end}_owned", F.coalesce(owned, F.lit(False))).drop("_region", "_floating", "_gap", "_owner", "_controller")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("owner", zero("n_regions"), zero("n_gaps"), (F.coalesce("n_regions", F.lit(0)) == 0).alias("empty"), "leading_owned", "trailing_owned", F.coalesce("frozen", F.lit(False)).alias("frozen"))


#: What opens and closes a comment of each style.
STYLES = {"hash_comment": ("#", ""), "c_style_line": ("//", ""), "html_comment": ("<!--", "-->"), "c_style_block": ("/*", "*/")}


def comment_content(line: Column, style: str) -> Column:
    """What a comment line says, trimmed; null for other lines."""
    start, end = STYLES[style]
    bare = F.trim(F.regexp_replace(line, r"\s", " "))
    inside = F.substring(bare, F.lit(len(start) + 1), F.length(bare) - len(start) - len(end))
    fits = F.startswith(bare, F.lit(start)) & (F.endswith(bare, F.lit(end)) if end else F.lit(True)) & (F.length(bare) >= len(start) + len(end))
    return F.when(fits, F.trim(inside))


def freeze_action(line: Column, token: str, style: str) -> Column:
    """Struct (action, reason) of a freeze or unfreeze marker; null for other lines."""
    said = comment_content(line, style)
    rest = F.trim(F.substring(said, F.lit(len(token) + 2), F.length(said)))
    marked = F.startswith(F.lower(said), F.lit(f"{token.lower()}:"))
    action = F.when(F.startswith(F.lower(rest), F.lit("unfreeze")), "unfreeze").when(F.startswith(F.lower(rest), F.lit("freeze")), "freeze")
    return F.when(marked & action.isNotNull(), F.struct(action.alias("action"), F.trim(F.substring(rest, F.length(action) + 1, F.length(rest))).alias("reason")))


def freeze_directives(lines: DataFrame, key: str, token: str, style: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, start_line, end_line, reason) and findings (key, line, category) of freeze markers.

    ``lines``: key, line (from 1), text.  A marker opens or closes whatever the one
    before it was; a text with any finding has no blocks.
    """
    order = Window.partitionBy(key).orderBy("line")
    named = lines.filter(F.contains(F.lower("text"), F.lit("freeze")))
    marks = named.withColumn("m", freeze_action(F.col("text"), token, style)).filter("m IS NOT NULL").select(key, "line", "m.action", "m.reason")
    marks = marks.withColumns({"before": F.lag("action").over(order), "after": F.lead("action").over(order), "end_line": F.lead("line").over(order)})
    wrong = (
        F.when((F.col("action") == "freeze") & (F.col("before") == "freeze"), "nested_freeze_open")
        .when((F.col("action") == "unfreeze") & (F.coalesce("before", F.lit("unfreeze")) == "unfreeze"), "unmatched_freeze_close")
    )
    # the first opening of the last run stays open
    opened = marks.filter("action = 'freeze' AND (before IS NULL OR before = 'unfreeze')").groupBy(key).agg(F.max("line").alias("line"))
    last = marks.groupBy(key).agg(F.max_by("action", "line").alias("last")).filter("last = 'freeze'").select(key)
    unclosed = opened.join(last, key).select(key, "line", F.lit("unclosed_freeze_open").alias("category"))
    findings = marks.withColumn("category", wrong).filter("category IS NOT NULL").select(key, "line", "category").unionByName(unclosed)
    # a text whose last marker opens has that finding; told where the markers are, so that lines are read once
    amiss = F.bool_or(wrong.isNotNull() | ((F.col("action") == "freeze") & F.col("after").isNull())).over(Window.partitionBy(key))
    blocks = marks.withColumn("amiss", amiss).filter("action = 'freeze' AND after = 'unfreeze' AND NOT amiss")
    return blocks.select(key, F.col("line").alias("start_line"), "end_line", "reason"), findings


def conflict_regions(lines: DataFrame, key: str, size: int = 7) -> DataFrame:
    """(key, start_line, separator_line, end_line) of closed conflict regions; a new start replaces an open one."""
    starts = lambda c: F.startswith(F.col("text"), F.lit(c * size))
    kind = F.when(starts("<"), "start").when(starts("="), "separator").when(starts(">"), "end")
    marks = lines.withColumn("kind", kind).filter("kind IS NOT NULL")
    part = marks.withColumn("part", F.count(F.when(F.col("kind") == "start", 1)).over(Window.partitionBy(key).orderBy("line"))).filter("part > 0")
    ends = part.groupBy(key, "part").agg(F.min(F.when(F.col("kind") == "start", F.col("line"))).alias("start_line"), F.min(F.when(F.col("kind") == "end", F.col("line"))).alias("end_line"), F.min(F.when(F.col("kind") == "separator", F.col("line"))).alias("separator"))
    return ends.filter("end_line IS NOT NULL").select(key, "start_line", F.when(F.col("separator") < F.col("end_line"), F.col("separator")).otherwise(0).alias("separator_line"), "end_line")
