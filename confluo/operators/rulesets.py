"""Compact rulesets: a directive a line, read for all documents at once; directives, comments, ordered diagnostics, profiles.

What a line says about itself is a projection; what depends on earlier lines (a
directive that may stand once, a key that may stand once) is a window over the lines
of one document, and a directive that is missing a roll-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directives by how often they may stand, and the words that two of them take.
REQUIRED = ("format", "owners", "match", "read", "attach")
SINGLE = (*REQUIRED, "comment_style", "render", "render_strategy")
KEYED = ("backend", "node_role", "atomic", "child_group", "capability", "logical_owner", "repair", "surface", "delegate")
VALUES = {
    "read": ("source_augmented_portable_write", "native_read_portable_write", "native_mutation"),
    "attach": ("layout_only", "tracker_layout_merge", "augmenter_preferred_tracker_layout", "normalize_tracked_layout_merge"),
}
IDENTIFIER, WORD = r"^[A-Za-z][A-Za-z0-9_.-]*$", r"^[\x21\x24-\x7e]+$"


def quoted(word: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(word, r'(["\\])', r"\\$1"), F.lit('"'))


def _said(when: Column, *parts: str | Column) -> Column:
    return F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def directive_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, name, args, stop, accepted): lines from 1 that are neither empty nor comments.

    ``stop`` says why a line is no directive; only accepted ones count for later lines.
    """
    raw = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    line = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    words = raw.select(key, (F.col("at") + 1).alias("line"), line.alias("bare")).filter("bare <> '' AND NOT startswith(bare, '#')")
    words = words.withColumn("words", F.split("bare", r"(?U)\s+")).select(key, "line", F.element_at("words", 1).alias("name"), F.slice("words", F.lit(2), F.size("words")).alias("args"))
    name = F.col("name")
    stop = F.coalesce(
        _said(~name.rlike(IDENTIFIER), "invalid directive token ", quoted(name)),
        _said(~name.isin(*SINGLE, *KEYED), "unknown directive ", quoted(name)),
        _said(F.size("args") == 0, "directive ", quoted(name), " requires at least one argument"),
    )
    return words.withColumn("stop", stop).withColumn("accepted", F.col("stop").isNull())


def directive_comments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, comment)."""
    raw = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    return raw.select(key, (F.col("at") + 1).alias("line"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("comment")).filter("startswith(comment, '#')")


def ruleset_diagnostics(docs: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, rank, line, message) in order: by line and rule, then the directives that are missing (line 0).

    A directive that may stand once names the line of the one before it.
    """
    name, args = F.col("name"), F.col("args")
    first = F.get(args, F.lit(0))
    own = F.when((name == "child_group") & (F.size(args) > 1), F.concat_ws("\0", first, F.get(args, F.lit(1)))).otherwise(first)
    seen = Window.partitionBy(key, "name").orderBy("line")
    earlier = Window.partitionBy(key, "name", "own").orderBy("line")
    good = lines.filter("accepted").withColumn("own", own).withColumns({"before": F.lag("line").over(seen), "nth": F.row_number().over(earlier)})
    odd = F.filter(args, lambda a: ~(a.isin("true", "false") | a.rlike(IDENTIFIER) | a.rlike(WORD)))
    said = F.concat(
        F.transform(odd, lambda a: F.concat(F.lit("invalid argument token "), quoted(a))),
        F.array_compact(
            F.array(
                _said(name.isin(*SINGLE) & F.col("before").isNotNull(), "repeated singleton directive ", quoted(name), " first seen on line ", F.col("before").cast("string")),
                _said(name.isin(*KEYED) & (F.col("nth") > 1), "repeated ", quoted(name), " key ", quoted(first)),
                *[_said((name == d) & ~first.isin(*known), f"unknown {d} value ", quoted(first)) for d, known in VALUES.items()],
            )
        ),
    )
    by_line = good.select(key, "line", F.posexplode(said).alias("nth", "message")).unionByName(lines.filter("NOT accepted").select(key, "line", F.lit(0).alias("nth"), F.col("stop").alias("message")))
    there = good.filter(name.isin(*REQUIRED)).groupBy(key).agg(F.collect_set("name").alias("there"))
    lacking = F.transform(F.filter(F.array(*[F.lit(x) for x in REQUIRED]), lambda x: ~F.coalesce(F.array_contains("there", x), F.lit(False))), lambda x: F.concat(F.lit("missing required directive "), quoted(x)))
    missing = docs.select(key).join(there, key, "left").select(key, F.lit(0).alias("line"), F.posexplode(lacking).alias("nth", "message"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("line") == 0, "line", "nth"))
    return by_line.unionByName(missing).withColumn("rank", rank).select(key, "rank", "line", "message")


#: Directives that need more than one argument to declare something.
ARGUMENTS = dict.fromkeys(KEYED, 2) | {"child_group": 3}


def ruleset_profiles(lines: DataFrame, diagnostics: DataFrame, key: str) -> DataFrame:
    """(key, SINGLE, declared) of documents without diagnostics: the words of single directives, and (name, arguments) of the others in order."""
    fine = lines.filter("accepted").join(diagnostics.select(key).distinct(), key, "left_anti")
    words = [F.max(F.when(F.col("name") == d, F.get("args", F.lit(0)))).alias(d) for d in SINGLE]
    needed = F.create_map(*[F.lit(x) for pair in ARGUMENTS.items() for x in pair])
    kept = F.when(F.col("name").isin(*KEYED) & (F.size("args") >= F.try_element_at(needed, F.col("name"))), F.struct("line", "name", F.slice("args", F.lit(1), F.try_element_at(needed, F.col("name"))).alias("args")))
    declared = F.transform(F.array_sort(F.collect_list(kept)), lambda d: F.struct(d["name"].alias("name"), d["args"].alias("args")))
    return fine.groupBy(key).agg(*words, declared.alias("declared"))
