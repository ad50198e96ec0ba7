"""Contracts as one JSON document each: rules that look at the raw form beside the typed one, and the canonical summary.

A document is parsed once into a variant; its sections are exploded, and a rule asks
the variant whether a member is there and what it is, which a typed row can't tell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What history references have and name, and the outcomes that no score counts.
HISTORY = ("slice", "corpus_id", "manifest", "case_id", "merge_commit")
SLICE, CORPUS = 1021, "diagnostics/slice-1021-reviewed-git-history-corpus/manifest.json"
EXCLUDED = ("unsupported", "excluded_ambiguous")


def parsed(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v): the documents as variants, null where they are no JSON."""
    return docs.select(key, F.try_parse_json(F.col(column)).alias("v"))


def _section(rows: DataFrame, key: str, path: str) -> DataFrame:
    """(key, pos, value) of an array of the documents."""
    part = rows.select(key, F.try_variant_get("v", path, "variant").alias("part"))
    return part.sparkSession.sql(f"SELECT `{key}`, pos AS pos, value AS value FROM {{part}}, LATERAL variant_explode(part)", part=part)


def _kind(value: Column) -> Column:
    """Object, array, string and so on; null where there is nothing."""
    name = F.schema_of_variant(value)
    return F.when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array").otherwise(F.lower(name))


def _at(value: str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _listed(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return rows.select(key, "subject", F.explode(broken).alias("category"))


def record_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, subject, category) of raw records: inline content must be a string, its bytes and digest exact.

    ``subject`` is a result's id.  A record that is no object, or has no inline content, is fine.
    """
    results = _section(rows, key, "$.case_results").select(key, _at("value", "id", "string").alias("subject"), _at("value", "raw").alias("raw"), _kind(_at("value", "score_eligible")).alias("eligible"))
    whole = _listed(results, key, {"raw_not_object": ~_kind(F.col("raw")).eqNullSafe(F.lit("object")), "eligibility_missing": F.col("eligible").isNull()})
    records = results.filter(_kind(F.col("raw")) == "object").sparkSession.sql(f"SELECT `{key}`, subject, key AS name, value AS value FROM {{r}}, LATERAL variant_explode(raw)", r=results.filter(_kind(F.col("raw")) == "object"))
    inline = records.filter(_kind(F.col("value")) == "object").withColumns({"inline": _at("value", "inline"), "bytes": _at("value", "bytes", "double"), "said": _at("value", "sha256", "string")}).filter("inline IS NOT NULL")
    text = F.when(_kind(F.col("inline")) == "string", F.try_variant_get("inline", "$", "string"))
    exact = inline.withColumn("text", text)
    rules = {
        "inline_not_string": F.col("text").isNull(),
        "bytes_not_exact": F.col("text").isNotNull() & ~F.col("bytes").eqNullSafe(F.octet_length("text").cast("double")),
        "digest_not_exact": F.col("text").isNotNull() & ~F.col("said").eqNullSafe(F.sha2("text", 256)),
    }
    return whole.unionByName(_listed(exact, key, rules))


def history_violations(rows: DataFrame, key: str, operation: str = "history_replay") -> DataFrame:
    """(key, subject, category) of cases that replay history: the reference is an object with its members, names the corpus, and nothing is inline beside it."""
    cases = _section(rows, key, "$.cases").filter(_at("value", "operation", "string") == operation)
    seen = cases.select(key, _at("value", "id", "string").alias("subject"), _at("value", "history_reference").alias("h"), _at("value", "inputs").isNotNull().alias("inputs"))
    there = _kind(F.col("h")).eqNullSafe(F.lit("object"))
    lacks = reduce(lambda a, b: a | b, [_at("h", name).isNull() for name in HISTORY])
    rules = {
        "history_not_object": ~there,
        "history_member_missing": there & lacks,
        "history_slice": there & ~lacks & ~_at("h", "slice", "bigint").eqNullSafe(F.lit(SLICE)),
        "history_manifest": there & ~lacks & ~_at("h", "manifest", "string").eqNullSafe(F.lit(CORPUS)),
        "history_inline": F.col("inputs"),
    }
    return _listed(seen, key, rules)


def canonical_summaries(docs: DataFrame, rows: DataFrame, violations: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each document without violations: counts, sorted ids and categories, the safety gate, and the document's digest."""
    fine = rows.filter("v IS NOT NULL").join(violations.select(key).distinct(), key, "left_anti")
    results = _section(fine, key, "$.case_results").select(key, _at("value", "id", "string").alias("result_id"), _at("value", "outcome", "string").alias("outcome"), F.coalesce(_at("value", "score_eligible", "boolean"), F.lit(False)).alias("eligible"))
    excluded, harmful = F.col("outcome").isin(*EXCLUDED), F.col("eligible") & (F.col("outcome") == "false_auto_merge")
    ids = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("result_id"))))
    per = results.groupBy(key).agg(F.count(F.lit(1)).alias("results"), ids(F.col("eligible")).alias("eligible_ids"), ids(excluded).alias("excluded_ids"), F.count_if(harmful).alias("false_auto_merges"))
    cases = _section(fine, key, "$.cases").groupBy(key).agg(F.count(F.lit(1)).alias("cases"))
    reasons = fine.select(key, F.try_variant_get("v", "$.run_manifest.selection.explanation", "map<string,variant>").alias("m"), (F.try_variant_get("v", "$.run_manifest.base_adapter", "variant").isNotNull().cast("int") + 1).alias("adapters"), F.size(F.try_variant_get("v", "$.run_manifest.selection.selected_case_ids", "array<variant>")).alias("selected"))
    out = reasons.join(cases, key, "left").join(per, key, "left").join(docs.select(key, F.sha2(F.col(column), 256).alias("digest")), key)
    none = F.array().cast("array<string>")
    return out.select(
        key, "adapters", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("results", F.lit(0)).alias("results"), "selected", F.coalesce("eligible_ids", none).alias("eligible_ids"), F.coalesce("excluded_ids", none).alias("excluded_ids"),
        F.coalesce("false_auto_merges", F.lit(0)).alias("false_auto_merges"), F.when(F.col("false_auto_merges") > 0, "fail").otherwise("pass").alias("gate"), F.array_sort(F.map_keys("m")).alias("reasons"), "digest",
    )


def membership_violations(rows: DataFrame, key: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """(key, subject, category) of members whose value the document's own lists do not hold.

    ``fields``: section (an array of objects with ids), member, and the list under
    ``contract``.  A member that is missing is held against the list as an empty text; a
    list that is missing holds nothing.
    """
    found = None
    for section, member, listed in fields:
        lists = rows.select(key, F.coalesce(F.try_variant_get("v", f"$.contract.{listed}", "array<string>"), F.array().cast("array<string>")).alias("known"))
        part = _section(rows, key, f"$.{section}").select(key, _at("value", "id", "string").alias("subject"), F.coalesce(_at("value", member, "string"), F.lit("")).alias("said"))
        bad = part.join(lists, key).filter(~F.array_contains("known", F.col("said"))).select(key, "subject", F.lit(f"{member}_not_in_{listed}").alias("category"))
        found = bad if found is None else found.unionByName(bad)
    return found
