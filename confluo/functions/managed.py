"""Column expressions over maintained texts: blocks between markers, headings, changelogs, blank lines, licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _line_of(lines: Column, marker: str, after: Column) -> Column:
    """Place (from 0) of the first line at or after a place that is the marker; null if there is none."""
    at = F.array_position(F.slice(lines, after + 1, F.greatest(F.size(lines) - after, F.lit(0))), marker)
    return F.when(at > 0, after + at.cast("int") - 1)


def replacement_lines(replacement: Column) -> Column:
    return F.split(F.regexp_replace(replacement, r"\n\z", ""), "\n")


def between_markers(content: Column, opens: str, closes: str, replacement: Column, fallback: Column) -> Column:
    """The lines from one marker to the next replaced, markers included; ``fallback`` where either is missing."""
    lines = F.split(content, "\n")
    first = _line_of(lines, opens, F.lit(0))
    last = _line_of(lines, closes, first + 1)
    parts = F.concat(F.slice(lines, F.lit(1), first), replacement_lines(replacement), F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0))))
    return F.when(last.isNotNull(), F.array_join(parts, "\n")).otherwise(fallback)


def trimmed_end(content: Column) -> Column:
    return F.regexp_replace(content, r"\n+\z", "")


def markdown_block(content: Column, marker: str, replacement: Column) -> Column:
    """A block between HTML comments, appended after a blank line where the markers are missing."""
    return between_markers(content, f"<!-- {marker}:start -->", f"<!-- {marker}:end -->", replacement, F.concat(trimmed_end(content), F.lit("\n\n"), replacement, F.lit("\n")))


def text_block(content: Column, opens: str, closes: str, replacement: Column) -> Column:
    """A block between marker lines, appended where they are missing."""
    bare = trimmed_end(content)
    return between_markers(content, opens, closes, replacement, F.when(bare == "", replacement).otherwise(F.concat(bare, F.lit("\n"), replacement)))


def titled(content: Column, name: Column) -> Column:
    """The first level-one heading named anew, or put before the text."""
    lines, heading = F.split(content, "\n"), F.concat(F.lit("# "), name)
    at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("# "))), True).cast("int")
    new = F.concat(F.slice(lines, F.lit(1), at - 1), F.array(heading), F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))
    return F.when(at > 0, F.array_join(new, "\n")).otherwise(F.concat(heading, F.lit("\n\n"), content))


def ended(content: Column) -> Column:
    return F.when(F.endswith(content, F.lit("\n")), content).otherwise(F.concat(content, F.lit("\n")))


def collapsed(content: Column) -> Column:
    """Runs of empty lines as one, none at the end."""
    return trimmed_end(F.regexp_replace(content, r"\n{3,}", "\n\n"))


#: Fixed value: the section of a changelog without one for what is not released.
UNRELEASED = "\n## [Unreleased]\n\n### Added\n\n### Changed\n\n### Fixed\n"


def changelog(content: Column) -> Column:
    """A changelog with a title and a section for unreleased changes before its first section."""
    text = F.when(F.startswith(content, F.lit("# ")), content).otherwise(F.concat(F.lit("# Changelog\n\n"), content))
    lines = F.split(text, "\n")
    has = F.exists(lines, lambda x: F.lower(x).rlike(r"^## (\[unreleased\]|unreleased)"))
    at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("## "))), True).cast("int")
    place = F.when(at > 0, at - 1).otherwise(F.size(lines))
    section = F.split(F.lit(UNRELEASED), "\n")
    whole = F.array_join(F.concat(F.slice(lines, F.lit(1), place), section, F.slice(lines, place + 1, F.greatest(F.size(lines) - place, F.lit(0)))), "\n")
    return ended(F.when(has, text).otherwise(collapsed(F.regexp_replace(whole, r"^\n{2,}", "\n"))))


def heading_key(value: Column) -> Column:
    """A heading for comparison: lower case, without a leading sign before further words."""
    bare = F.trim(F.regexp_replace(value, r"\s+", " "))
    words = F.split(bare, " ")
    signed = (F.size(words) > 1) & ~F.element_at(words, 1).rlike("^[A-Za-z0-9]")
    return F.lower(F.when(signed, F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " ")).otherwise(F.trim(value)))


def known_or_unknown(value: Column) -> Column:
    return F.when(F.trim(value) == "", "unknown").otherwise(value)


def licence_paragraph(name: Column) -> Column:
    return F.when(name == "MIT", "This project is made available under the terms of the MIT License.").otherwise(F.concat(F.lit("This project is made available under the following license expression: "), name, F.lit(".")))


def repository_url(module_path: Column) -> Column:
    parts = F.split(module_path, "/")
    return F.when((F.size(parts) >= 3) & (F.element_at(parts, 1) == "github.com"), F.concat(F.lit("https://"), F.array_join(F.slice(parts, 1, 3), "/"))).otherwise("")
