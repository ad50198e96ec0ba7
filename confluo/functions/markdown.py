"""Owners of Markdown texts: ATX headings and code fences, with the lines they stand on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug, unix_lines

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*(`{3,}|~{3,})\s*(.*?)\s*$"
OWNER = "struct<kind:string,match_key:string,level:int,info:string,start:int,end:int>"
#: What every heading and every line that opens or closes a fence begins with; the fold leaves out all others.
MARKED = r"^(#{1,6}\s|\s*(```|~~~))"
STATE = f"struct<mark:string,owners:array<{OWNER}>>"


def owners(text: Column) -> Column:
    """Array of owners in order: kind, match_key (``h<level>:<slug>`` or ``fence:<info>``), level, info, start and end line from 0.

    A fence runs to a line of its own marker, at least as long, or to the end of the
    text; what is inside is neither heading nor fence.  A heading ends on its own line.
    """
    lines = F.split(unix_lines(text), "\n")
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: x["line"].rlike(MARKED))

    def step(state: Column, x: Column) -> Column:
        line, at, mark = x["line"], x["at"], state["mark"]
        bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        closes = F.startswith(bare, mark) & (F.replace(bare, F.substring(mark, 1, 1), F.lit("")) == "")
        heading = line.rlike(HEADING)
        level = F.length(F.regexp_extract(line, HEADING, 1))
        title = slug(F.trim(F.regexp_extract(line, HEADING, 2)))
        marker = F.regexp_extract(line, FENCE, 1)
        info = F.regexp_extract(F.regexp_extract(line, FENCE, 2), r"^(\S*)", 1)
        none = F.lit("").cast("string")
        as_heading = F.struct(F.lit("heading").alias("kind"), F.concat(F.lit("h"), level.cast("string"), F.lit(":"), title).alias("match_key"), level.alias("level"), none.alias("info"), at.alias("start"), at.alias("end"))
        as_fence = F.struct(F.lit("code_fence").alias("kind"), F.concat(F.lit("fence:"), F.when(info == "", "plain").otherwise(info)).alias("match_key"), F.lit(0).alias("level"), info.alias("info"), at.alias("start"), at.alias("end"))
        return (
            F.when((mark != "") & closes, F.struct(none.alias("mark"), _ended(state["owners"], at).alias("owners")))
            .when(mark != "", F.struct(mark.alias("mark"), state["owners"].alias("owners")))
            .when(heading, F.struct(none.alias("mark"), F.concat(state["owners"], F.array(as_heading)).alias("owners")))
            .when(marker != "", F.struct(marker.alias("mark"), F.concat(state["owners"], F.array(as_fence)).alias("owners")))
            .otherwise(state)
            .cast(STATE)
        )

    empty = F.struct(F.lit("").alias("mark"), F.array().cast(f"array<{OWNER}>").alias("owners")).cast(STATE)
    end = F.size(lines) - 1
    return F.aggregate(numbered, empty, step, lambda s: F.when(s["mark"] != "", _ended(s["owners"], end)).otherwise(s["owners"]))


def _ended(found: Column, at: Column) -> Column:
    """The owners with the last one ending at a line."""
    last = F.element_at(found, -1)
    closed = F.struct(last["kind"].alias("kind"), last["match_key"].alias("match_key"), last["level"].alias("level"), last["info"].alias("info"), last["start"].alias("start"), at.cast("int").alias("end"))
    return F.concat(F.slice(found, 1, F.size(found) - 1), F.array(closed)).cast(f"array<{OWNER}>")
