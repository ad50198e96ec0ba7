"""Nested documents merged from the leaves up: each accepted child by its own family's merge, then put into its parent, then the parent.

Children are fences of a Markdown document; a fence of Markdown holds children of its
own.  One step handles one depth of all documents, down to find the children and up to
merge them, so the number of steps is the deepest nesting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.layout import fence_family
from ..sources.tables import settled
from .json_docs import merge_two
from .nested import apply_outputs

#: Families of fences whose bodies are merged here; others are left as they are.
MERGED = ("markdown", "json")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def child_family(info: Column) -> Column:
    """As for any fence, and Markdown within Markdown."""
    return F.when(F.lower(info).isin("markdown", "md"), "markdown").otherwise(fence_family(info))


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")


def owned_sections(text: Column, lines: Column) -> Column:
    """Array of a text's owners in order: start, kind, nth (number among those of its kind), info, end, and stop, the line of the next owner."""

    def numbered(found: Column) -> Column:
        ended = F.transform(found, lambda o, i: F.struct(o["start"].alias("start"), o["kind"].alias("kind"), o["info"].alias("info"), o["end"].alias("end"), F.coalesce(F.get(found, i + 1)["start"], F.size(lines)).alias("stop")))
        of = lambda rows, kind: F.transform(F.filter(rows, lambda o: o["kind"] == kind), lambda o, i: F.struct(o["start"].alias("start"), o["kind"].alias("kind"), i.alias("nth"), o["info"].alias("info"), o["end"].alias("end"), o["stop"].alias("stop")))
        return once(ended, lambda rows: F.array_sort(F.concat(of(rows, "heading"), of(rows, "code_fence"))))

    return once(markdown.owners(F.coalesce(text, F.lit(""))), numbered)


def merge_markdown(pairs: DataFrame, key: str) -> DataFrame:
    """(key, merged) of key, template and destination: the destination's sections, then those of the template whose path it lacks.

    A section runs to the next heading or fence; what stands before the first is in none
    and goes.  Sections are parted by one empty line, and empty ones left out.  A path is a
    kind and a number from 0, so the destination lacks those of the numbers that follow its own.
    """
    body = lambda lines: lambda o: trimmed(F.array_join(F.slice(lines, o["start"] + 1, o["stop"] - o["start"]), "\n"))
    owned = lambda c, use: once(lines_of(F.col(c)), lambda lines: once(owned_sections(F.col(c), lines), lambda found: use(lines, found)))
    has = lambda found, kind: F.size(F.filter(found, lambda o: o["kind"] == kind))

    def further(headings: Column, fences: Column) -> Column:
        lacks = lambda o: o["nth"] >= F.when(o["kind"] == "heading", headings).otherwise(fences)
        return owned("template", lambda lines, found: F.transform(F.filter(found, lacks), body(lines)))

    both = owned("destination", lambda lines, found: F.struct(has(found, "heading").alias("headings"), has(found, "code_fence").alias("fences"), F.transform(found, body(lines)).alias("texts")))
    texts = once(both, lambda d: F.concat(d["texts"], further(d["headings"], d["fences"])))
    return pairs.select(key, F.concat(trimmed(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")), F.lit("\n")).alias("merged"))


def _fences(text: Column) -> Column:
    """Array of a text's fences in order: family, body, start, end."""
    body = lambda lines, o: F.array_join(F.slice(lines, o["start"] + 2, F.greatest(o["end"] - o["start"] - 1, F.lit(0))), "\n")
    one = lambda lines: lambda o: F.struct(child_family(o["info"]).alias("family"), body(lines, o).alias("body"), o["start"].alias("start"), o["end"].alias("end"))
    return once(lines_of(text), lambda lines: F.transform(F.filter(owned_sections(text, lines), lambda o: o["kind"] == "code_fence"), one(lines)))


def child_tree(pairs: DataFrame, key: str, accepted: DataFrame) -> list[DataFrame]:
    """A table per depth: node, parent, family, template, destination, and the lines of the fence in the parent.

    A node is named by the paths of the fences that lead to it, the document's key first.
    A child is a fence that both sides have under one path with one family, and that
    ``accepted`` (node) holds; what is not accepted is not looked into.
    """
    root = pairs.select(F.col(key).cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("markdown").alias("family"), "template", "destination", F.lit(0).alias("start"), F.lit(0).alias("end"))
    levels = [settled(root, "nested")]
    while True:
        above = levels[-1].filter("family = 'markdown'")
        pair = F.transform(_fences(F.col("destination")), lambda d, i: F.struct(F.concat(F.lit("/code_fence/"), i.cast("string")).alias("path"), d.alias("d"), F.get(F.col("_of_template"), i).alias("t")))
        both = above.withColumn("_of_template", _fences(F.col("template"))).select("node", F.explode(F.filter(pair, lambda p: (p["d"]["family"] == p["t"]["family"]) & p["d"]["family"].isin(*MERGED))).alias("p"))
        named = both.select(F.concat("node", "p.path").alias("node"), F.col("node").alias("parent"), "p.d.family", F.col("p.t.body").alias("template"), F.col("p.d.body").alias("destination"), "p.d.start", "p.d.end")
        below = settled(named.join(accepted.select("node"), "node", "left_semi"), "nested")
        if below.isEmpty():
            return levels
        levels.append(below)


def execute_nested(pairs: DataFrame, key: str, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, merged) of the documents, and of every node (node, family, depth, diagnostic).

    ``pairs``: key, template, destination.  A child whose merge fails leaves its parent's
    fence as it is and says so; its parent is merged all the same.
    """
    levels = child_tree(pairs, key, accepted)
    outputs, reports = None, []
    for depth in range(len(levels) - 1, -1, -1):
        rows = levels[depth]
        docs = rows.filter("family = 'markdown'")
        if outputs is not None:
            placed = levels[depth + 1].join(outputs.filter("merged IS NOT NULL"), "node").select(F.col("parent").alias("node"), "start", "end", F.col("merged").alias("output"))
            done = apply_outputs(docs.select("node", "destination"), placed, "node", "destination")
            docs = docs.drop("destination").join(done.withColumnRenamed("merged", "destination"), "node")
        texts = merge_markdown(docs.select("node", "template", "destination"), "node").withColumn("diagnostic", F.lit(None).cast("string"))
        data = rows.filter("family = 'json'")
        json = merge_two(data.select("node", F.col("template").alias("source")), data.select("node", F.col("destination").alias("source")), "node", "source").select("node", "merged", "diagnostic")
        outputs = settled(texts.unionByName(json) if depth else texts, "nested-outputs")
        reports.append(outputs.join(rows.select("node", "family"), "node").select("node", "family", F.lit(depth).alias("depth"), "diagnostic"))
    return outputs.select("node", "merged"), reduce(DataFrame.unionByName, reports)


