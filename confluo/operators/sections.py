"""Heading sections as a tree, and the upkeep of one section: its whole subtree replaced, or put in.

A section ends at the next heading of its level or a higher one, the next smaller value
over the levels; two windows over the headings alone find that end and the parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_of(line: Column) -> Column:
    """1 to 6 for a heading that says something, else 0."""
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.length(F.regexp_extract(bare, r"^(#{1,6}) ", 1))


def text_lines(text: Column) -> Column:
    """Lines without empty ones at the end; none of an empty text."""
    bare = F.regexp_replace(text, r"\n+\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n"))


def section_tree(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title, end, parent): lines from 0, ``end`` open; ``parent`` is the line of the heading above it, or null.

    Texts without heading have no rows.
    """
    lines = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(text_lines(F.col(text))).alias("line", "body"), F.size(text_lines(F.col(text))).alias("n"))
    heads = lines.withColumn("level", level_of(F.col("body"))).filter("level > 0")
    here = Window.partitionBy(key)
    after, before = (here.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("line").desc(), F.col("line")))
    # of the headings on one side the last seen of each bound; frames only grow, so both windows are linear
    ends = [F.when(F.col("level") == n, F.last(F.when(F.col("level") <= n, F.col("line")), ignorenulls=True).over(after)) for n in range(1, 7)]
    parents = [F.when(F.col("level") == n, F.last(F.when(F.col("level") < n, F.col("line")), ignorenulls=True).over(before)) for n in range(2, 7)]
    placed = heads.withColumn("end", F.coalesce(*ends, F.col("n"))).withColumn("parent", F.coalesce(*parents))
    title = F.regexp_replace(F.regexp_replace("body", r"^\s*#{1,6} ", ""), r"(?U)^\s+|\s+$", "")
    return placed.select(key, "line", "level", title.alias("title"), "end", "parent")


def section_paths(tree: DataFrame, key: str) -> DataFrame:
    """``tree`` with ``path``: the titles from the top, joined by slashes; six joins at most, since levels fall."""
    from functools import reduce

    out = tree.withColumns({"path": F.col("title"), "up": F.col("parent")})
    above = tree.select(key, F.col("line").alias("up"), F.col("title").alias("above"), F.col("parent").alias("next"))

    def step(rows: DataFrame, _: int) -> DataFrame:
        both = rows.join(above, [key, "up"], "left")
        return both.withColumns({"path": F.when(F.col("above").isNotNull(), F.concat("above", F.lit("/"), "path")).otherwise(F.col("path")), "up": F.col("next")}).drop("above", "next")

    return reduce(step, range(5), out).drop("up")


def upsert_sections(rows: DataFrame, text: str, heading: str, replacement: str, result: str, level: int = 2) -> DataFrame:
    """``rows`` with ``result``: the text with the first section of that heading and level replaced, subsections and all.

    Where there is none it is put in after the first paragraph.  A blank line is kept
    between the section and what stands around it; one line feed ends the text.
    Text after a section that was put in belongs to it until the next heading, as in any section.
    """
    none, lines, n = F.array().cast("array<string>"), F.col("_lines"), F.col("_n")

    def first(test, start: Column) -> Column:
        """The first line from ``start`` that the test holds for, else the number of lines."""
        found = F.array_position(F.transform(F.slice(lines, start + 1, F.greatest(n - start, F.lit(0))), test), True).cast("int")
        return F.when(found > 0, start + found - 1).otherwise(n)

    # a column for every step, so that no step is evaluated again for the next
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    steps = [
        {"_lines": text_lines(F.col(text))},
        {"_n": F.size("_lines"), "_at": F.array_position(bare, F.concat(F.lit("#" * level + " "), F.col(heading))).cast("int") - 1},
        {"_end": F.when(F.col("_at") >= 0, first(lambda x: (level_of(x) > 0) & (level_of(x) <= level), F.col("_at") + 1)), "_body": F.when(F.coalesce(level_of(F.get(lines, F.lit(0))), F.lit(0)) == 1, first(lambda x: x != "", F.lit(1))).otherwise(0)},
        {"_blank": first(lambda x: x == "", F.col("_body"))},
        {"_place": F.when(F.col("_at") >= 0, F.col("_at")).otherwise(first(lambda x: x != "", F.col("_blank")))},
        {"_resume": F.coalesce("_end", "_place")},
    ]
    out = rows
    for step in steps:
        out = out.withColumns(step)
    gap = lambda line: F.when(F.coalesce(line != "", F.lit(False)), F.array(F.lit(""))).otherwise(none)
    run = lambda start, stop: F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))
    ahead = F.when(F.col("_at") >= 0, none).otherwise(gap(F.get(lines, F.col("_place") - 1)))
    whole = F.concat(run(F.lit(0), F.col("_place")), ahead, F.split(replacement, "\n"), gap(F.get(lines, F.col("_resume"))), run(F.col("_resume"), n))
    return out.withColumn(result, F.concat(F.array_join(whole, "\n"), F.lit("\n"))).drop(*[c for step in steps for c in step])


#: Languages of a family in their order, and what they are called.
LANGUAGES = {"go": "Go", "ruby": "Ruby", "rust": "Rust", "typescript": "TypeScript"}
#: A family: heading, description, its own language, and for each language where its package is and what installs it.
FAMILY = "struct<heading:string,description:string,own:string,own_root:string,own_manager:string,others:map<string,struct<root:string,manager:string>>>"


def label_of(language: Column) -> Column:
    out = language
    for name, label in LANGUAGES.items():
        out = F.when(language == name, label).otherwise(out)
    return out


def family_tokens(family: Column, prefix: str = "SM") -> Column:
    """A map from token keys to values: the family's own, and those of the other languages, numbered in their order."""
    own = family["own"]
    others = F.filter(F.array(*[F.lit(x) for x in LANGUAGES]), lambda x: x != F.coalesce(own, F.lit("")))
    pair = lambda name, value: F.struct(F.concat(F.lit(f"{prefix}|"), name).alias("key"), F.coalesce(value, F.lit("")).alias("value"))
    named = F.array(
        pair(F.lit("SELF_LANG"), label_of(own)), pair(F.lit("SELF_LANG_ID"), own), pair(F.lit("FAMILY_SECTION_HEADING"), family["heading"]),
        pair(F.lit("FAMILY_DESCRIPTION"), family["description"]), pair(F.lit("SELF_PACKAGE_ROOT"), family["own_root"]), pair(F.lit("SELF_PACKAGE_MANAGER"), family["own_manager"]),
    )

    def numbered(x: Column, i: Column) -> Column:
        name, entry = F.concat(F.lit("IMP_LANG"), (i + 1).cast("string")), F.try_element_at(family["others"], x)
        ends = {"": label_of(x), "_ID": x, "_PACKAGE_ROOT": entry["root"], "_PACKAGE_MANAGER": entry["manager"]}
        return F.array(*[pair(F.concat(name, F.lit(end)), value) for end, value in ends.items()])

    return F.map_from_entries(F.concat(named, F.flatten(F.transform(others, numbered))))


def resolved(content: Column, tokens: Column) -> Column:
    """Tokens in braces replaced by a row's own map, keys in their order; unknown ones stay."""
    return F.aggregate(F.array_sort(F.map_entries(tokens)), content, lambda c, e: F.replace(c, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def family_readmes(rows: DataFrame, text: str, family: str, name: str, summary: str, partial: str, result: str) -> DataFrame:
    """``rows`` with ``result``: readmes with the family's section brought up to date; one that is missing (null) begins with name and summary."""
    section = F.regexp_replace(resolved(F.lit(partial), family_tokens(F.col(family))), r"\n+\z", "")
    base = F.coalesce(text, F.concat(F.lit("# "), F.col(name), F.lit("\n\n"), F.col(summary), F.lit("\n")))
    ready = rows.withColumns({"_base": base, "_section": section, "_heading": F.coalesce(F.col(family)["heading"], F.lit(""))})
    return upsert_sections(ready, "_base", "_heading", "_section", result).drop("_base", "_section", "_heading")
