"""Column expressions over names, labels and profiles: defaults, aliases, safety rules, families of profile values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_engine(engine: Column) -> Column:
    return F.when(engine == "experimental_merge_ir", engine).otherwise("owner_path")


def language(name: Column, path: Column) -> Column:
    """A driver's language: by alias, else by the path's suffix, else text."""
    low = F.lower(F.trim(name))
    by_name = F.when(low.isin("go", "golang"), "go").when(low == "json", "json").when(low.isin("jsonc", "json with comments"), "jsonc").when(low.isin("plain", "text", "plaintext", "text/plain"), "text")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.coalesce(by_name, F.when(suffix == ".go", "go").when(suffix == ".json", "json").when(suffix == ".jsonc", "jsonc").otherwise("text"))


def merge_language(name: Column, path: Column) -> Column:
    """A three-way merge's language: two aliases, then the path's suffix, else the name as given."""
    low, at = F.lower(F.trim(name)), F.lower(path)
    return F.when(low.isin("go", "golang"), "go").when(low == "json", "json").when(F.endswith(at, F.lit(".go")), "go").when(F.endswith(at, F.lit(".json")), "json").otherwise(low)


def render_policy(policy: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(policy), F.lit("")), F.lit("canonical"))


def fallback_policy(policy: Column) -> Column:
    name = F.trim(policy)
    return F.when(name == "", "none").when(name == "full-file", "full_file").otherwise(name)


def fallback_reason(categories: Column) -> Column:
    return F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit("structured_merge_failed"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def valid_extractor(name: Column) -> Column:
    return name.rlike(r"^(text$|field:|kind:|custom:)")


def safe_language(name: Column) -> Column:
    return (F.octet_length(name) <= 64) & name.rlike(r"^[a-z][a-z0-9_]*\z")


def safe_symbol(name: Column) -> Column:
    return (F.octet_length(name) <= 256) & name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")


def quality_excluded(outcome: Column) -> Column:
    return outcome.isin("unsupported", "excluded_ambiguous")


def is_default_dialect(dialects: Column, dialect: Column) -> Column:
    return F.coalesce(F.try_element_at(dialects, F.lit(1)) == dialect, F.lit(False))


#: Families of the values that a profile may name.
START_BOUNDARIES = {"owner_start": "structural_owner", "comment_region_start": "comment_anchor"}
END_BOUNDARIES = {"owner_end": "structural_owner", "owner_end_plus_trailing_gap": "gap_extension"}
PAYLOADS = {"structural_owner_body": "owner_body", "comment_owned_body": "comment_owned", "section_branch": "section_branch"}
RESOLUTIONS = {"append_fallback": "append", "anchor_after_statement": "anchored"}
RESOLUTION_SOURCES = {"none": "implicit", "callable": "callable", "selector": "selector"}
ANCHORS = {"none": "none", "statement_end_plus_following_gap": "gap_preserving_statement"}
OPERATIONS = {"replace": "rewrite", "delete": "removal", "insert": "insertion", "move": "relocation"}
REQUIREMENTS = ("none", "optional", "required")
REPLACEMENTS = ("none", "explicit_text", "captured_text_or_explicit")


def family_of(value: Column, families: dict[str, str]) -> Column:
    """A value's family, ``unknown`` if it has none."""
    return reduce(lambda c, k: F.when(value == k, families[k]).otherwise(c), families, F.lit("unknown"))


def match_report(start: Column, end: Column, payload: Column) -> Column:
    first, last, body = family_of(start, START_BOUNDARIES), family_of(end, END_BOUNDARIES), family_of(payload, PAYLOADS)
    return F.struct(
        first.alias("start_family"), last.alias("end_family"), body.alias("payload_family"), start.isin(*START_BOUNDARIES).alias("known_start"), end.isin(*END_BOUNDARIES).alias("known_end"), payload.isin(*PAYLOADS).alias("known_payload"),
        ((first == "comment_anchor") | (body == "comment_owned")).alias("comment_anchored"), (last == "gap_extension").alias("gap_extended"),
    )


def operation_report(kind: Column, source: Column, destination: Column, replacement: Column) -> Column:
    return F.struct(
        family_of(kind, OPERATIONS).alias("operation_family"), kind.isin(*OPERATIONS).alias("known_kind"), source.isin(*REQUIREMENTS).alias("known_source"), destination.isin(*REQUIREMENTS).alias("known_destination"),
        replacement.isin(*REPLACEMENTS).alias("known_replacement"), (source != "none").alias("selects_source"), (source == "required").alias("requires_source"), (destination != "none").alias("supports_destination"),
        (destination == "required").alias("requires_destination"), (replacement == "explicit_text").alias("explicit_replacement"), (replacement == "captured_text_or_explicit").alias("may_reuse"),
    )


def destination_report(kind: Column, source: Column, anchor: Column) -> Column:
    family = family_of(kind, RESOLUTIONS)
    return F.struct(
        family.alias("resolution_family"), family_of(source, RESOLUTION_SOURCES).alias("source_family"), family_of(anchor, ANCHORS).alias("anchor_family"), kind.isin(*RESOLUTIONS).alias("known_kind"), source.isin(*RESOLUTION_SOURCES).alias("known_source"),
        anchor.isin(*ANCHORS).alias("known_anchor"), (kind == "append_fallback").alias("append_fallback"), (family == "anchored").alias("anchored"),
    )
