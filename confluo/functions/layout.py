"""Column expressions over comment regions, layout gaps, byte ranges, edit spans and archive paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a region's content that its signature keeps.
SIGNATURE_BYTES = 121


def region_facts(nodes: Column, kind: Column, token: str) -> Column:
    """Of a region's nodes (line, text, normalized): first and last line (0 without nodes), text, content, signature, freeze actions.

    The signature's content is cut after SIGNATURE_BYTES bytes, so it is binary.
    """
    lines = F.transform(nodes, lambda n: n["line"])
    content = F.array_join(F.transform(nodes, lambda n: n["normalized"]), "\n")
    mark = f"{token.lower()}:"
    has = lambda n, what: F.contains(F.lower(n["text"]), F.lit(mark + what))
    actions = F.array_compact(F.transform(nodes, lambda n: F.when(has(n, "freeze"), "freeze").when(has(n, "unfreeze"), "unfreeze")))
    return F.struct(
        F.coalesce(F.array_min(lines), F.lit(0)).alias("start_line"),
        F.greatest(F.coalesce(F.array_max(lines), F.lit(0)), F.lit(0)).alias("end_line"),
        F.array_join(F.transform(nodes, lambda n: n["text"]), "\n").alias("text"),
        content.alias("content"),
        F.struct(kind.alias("kind"), F.substring(content.cast("binary"), 1, SIGNATURE_BYTES).alias("content")).alias("signature"),
        (actions if token else F.lit(None).cast("array<string>")).alias("freeze_actions"),
    )


def gap_owner(side: Column, before: Column, after: Column) -> Column:
    """The owner on a side of a gap; null for any other side."""
    return F.when(side == "before", before).when(side == "after", after)


def gap_fallback(side: Column, before: Column, after: Column) -> Column:
    """The owner on the other side."""
    return F.when(side == "before", after).when(side == "after", before)


def blank_lines(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) == ""))


def range_valid(start: Column, end: Column) -> Column:
    return (start >= 0) & (start <= end)


def range_length(start: Column, end: Column) -> Column:
    """Length of a half-open range, 0 if it is invalid."""
    return F.when(range_valid(start, end), end - start).otherwise(0)


def range_has_byte(start: Column, end: Column, at: Column) -> Column:
    return range_valid(start, end) & (start <= at) & (at < end)


def range_has_range(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return range_valid(start, end) & range_valid(other_start, other_end) & (start <= other_start) & (other_end <= end)


def byte_slice(source: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text; null where the range is invalid or leaves it."""
    raw = source.cast("binary")
    return F.when(range_valid(start, end) & (end <= F.octet_length(raw)), F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")))


def point_offset(source: Column, row: Column, column: Column) -> Column:
    """Byte offset of a (row, byte column) point; the end of a line and of the text count, all else is null."""
    lines = F.split(source, "\n")
    line = F.try_element_at(lines, (row + 1).cast("int"))
    ahead = F.when(row == 0, 0).otherwise(F.octet_length(F.array_join(F.slice(lines, 1, row.cast("int")), "\n")) + 1)
    return F.when((row >= 0) & (column >= 0) & (row < F.size(lines)), F.when(column <= F.octet_length(line), ahead + column))


def clean_path(path: Column) -> Column:
    """A member path with slashes, without empty, ``.`` and resolved ``..`` segments; a directory keeps its slash, ``.`` is empty."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = F.startswith(forward, F.lit("/"))
    none = F.array().cast("array<string>")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc)
        .when((x == "..") & F.coalesce(F.when(F.size(acc) > 0, up(acc)), F.lit(False)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((x == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(x)))
    )
    joined = F.array_join(F.aggregate(F.split(forward, "/"), none, step), "/")
    whole = F.concat(F.when(rooted, "/").otherwise(""), joined)
    return F.when((whole != "") & (whole != "/") & F.endswith(forward, F.lit("/")), F.concat(whole, F.lit("/"))).otherwise(whole)


def escapes_root(path: Column) -> Column:
    """Absolute, or above the archive's root after cleaning."""
    clean = clean_path(path)
    return F.startswith(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")) | (clean == "..") | F.startswith(clean, F.lit("../"))


def signing_sensitive(path: Column) -> Column:
    return F.upper(path).rlike(r"^META-INF/.*\.(RSA|DSA|EC|SF)$")


#: Suffixes of members that another family merges, and names of compression methods.
FAMILIES = {".json": "json", ".md": "markdown", ".markdown": "markdown", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml"}
METHODS = {0: "stored", 8: "deflated"}
#: Families of code fences by info string.
FENCES = {"ts": "typescript", "typescript": "typescript", "rust": "rust", "rs": "rust", "go": "go", "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def nested_family(path: Column) -> Column:
    return reduce(lambda c, s: F.when(F.endswith(F.lower(path), F.lit(s)), FAMILIES[s]).otherwise(c), FAMILIES, F.lit(""))


def fence_family(info: Column) -> Column:
    return reduce(lambda c, s: F.when(F.lower(info) == s, FENCES[s]).otherwise(c), FENCES, F.lit(""))


def fence_dialect(info: Column, family: Column) -> Column:
    return F.when((family == "json") & (F.lower(info) == "jsonc"), "jsonc").when(family.isin(*FENCES.values()), family).otherwise("")
