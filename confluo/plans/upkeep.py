"""Queries over maintained texts and contract rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import managed
from ..operators import contracts
from ..sources.tables import table


def _texts(spark, sf_dir):
    """Documents with or without a title, a managed block, sections and runs of empty lines, by number."""
    k = F.col("doc_id")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    text = F.concat(
        F.when(k % 2 == 0, "# Old\n").otherwise(""), digest,
        F.when(k % 3 == 0, "\n<!-- m:start -->\nstale\n<!-- m:end -->\nafter").when(k % 3 == 1, "\n<!-- m:start -->\nopen").otherwise(""),
        F.when(k % 5 == 0, "\n\n\n\n## 1.0\nx").when(k % 5 == 1, "\n## Unreleased\n").when(k % 5 == 2, "\n\n").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), text.alias("text"))


def managed_blocks(spark, sf_dir):
    t = _texts(spark, sf_dir)
    block = F.concat(F.lit("<!-- m:start -->\nid "), F.col("doc_id").cast("string"), F.lit("\n<!-- m:end -->"))
    return t.select("doc_id", managed.markdown_block(F.col("text"), "m", block).alias("markdown"), managed.text_block(F.col("text"), "<!-- m:start -->", "<!-- m:end -->", block).alias("plain"), managed.titled(F.col("text"), F.lit("New")).alias("titled"))


def changelogs(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", managed.changelog(F.col("text")).alias("changelog"))


TEXTS_SQL = """
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, CASE WHEN doc_id % 2 = 0 THEN '# Old|' ELSE '' END AS h,
  CASE doc_id % 3 WHEN 0 THEN '|<!-- m:start -->|stale|<!-- m:end -->|after' WHEN 1 THEN '|<!-- m:start -->|open' ELSE '' END AS b, CASE doc_id % 5 WHEN 0 THEN '||||## 1.0|x' WHEN 1 THEN '|## Unreleased|' WHEN 2 THEN '||' ELSE '' END AS s FROM documents),
t AS (SELECT *, h || digest || b || s AS text, '<!-- m:start -->|id ' || doc_id || '|<!-- m:end -->' AS new FROM d)
"""
BLOCKS_SQL = TEXTS_SQL + """
SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN h || digest || '|' || new || '|after' || s ELSE rtrim(text, '|') || '||' || new || '|' END, '|', chr(10)) AS markdown,
  replace(CASE WHEN doc_id % 3 = 0 THEN h || digest || '|' || new || '|after' || s ELSE rtrim(text, '|') || '|' || new END, '|', chr(10)) AS plain,
  replace(CASE WHEN doc_id % 2 = 0 THEN '# New|' || digest || b || s ELSE '# New||' || text END, '|', chr(10)) AS titled FROM t
"""
CHANGELOG_SQL = TEXTS_SQL + """
, c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '# Changelog||' || text END AS text, CASE WHEN doc_id % 2 = 0 THEN h ELSE '# Changelog||' END || digest || b AS head FROM t),
u AS (SELECT '|## [Unreleased]||### Added||### Changed||### Fixed|' AS u)
SELECT doc_id, replace(CASE doc_id % 5 WHEN 1 THEN text WHEN 0 THEN head || '|' || u || '|## 1.0|x|' ELSE rtrim(head, '|') || CASE WHEN doc_id % 5 = 2 THEN '|' ELSE '' END || CASE WHEN doc_id % 5 = 2 THEN '' ELSE '|' END || u END, '|', chr(10)) AS changelog FROM c, u
"""


def _marked(spark, sf_dir):
    """Whole documents, some of whose lines are a title, markers or version headings by number."""
    k = F.col("doc_id")

    def line(x, i):
        return (
            F.when((i == 0) & (k % 2 == 0), F.concat(F.lit("# "), x)).when((i == 1) & (k % 3 < 2), "<!-- m:start -->").when((i == 4) & (k % 3 == 0), "<!-- m:end -->")
            .when((i == 2) & (k % 5 == 0), F.concat(F.lit("## "), x)).when((i == 3) & (k % 5 == 1), "## unreleased things").when((i > 4) & (i % 7 < 3), "").otherwise(x)
        )

    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def managed_texts(spark, sf_dir):
    """Blocks kept up to date in whole documents, and their titles."""
    block = F.concat(F.lit("<!-- m:start -->\nid "), F.col("doc_id").cast("string"), F.lit("\n<!-- m:end -->"))
    made = {"markdown": managed.markdown_block(F.col("text"), "m", block), "plain": managed.text_block(F.col("text"), "<!-- m:start -->", "<!-- m:end -->", block), "titled": managed.titled(F.col("text"), F.lit("New"))}
    return _marked(spark, sf_dir).select("doc_id", *[F.md5(c.cast("binary")).alias(name) for name, c in made.items()])


def changelog_texts(spark, sf_dir):
    """Whole documents as changelogs."""
    return _marked(spark, sf_dir).select("doc_id", F.md5(managed.changelog(F.col("text")).cast("binary")).alias("changelog"))


MARKED_SQL = r"""
WITH r AS (SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT k, i, CASE WHEN i = 0 AND k % 2 = 0 THEN '# ' || raw WHEN i = 1 AND k % 3 < 2 THEN '<!-- m:start -->' WHEN i = 4 AND k % 3 = 0 THEN '<!-- m:end -->' WHEN i = 2 AND k % 5 = 0 THEN '## ' || raw WHEN i = 3 AND k % 5 = 1 THEN '## unreleased things' WHEN i > 4 AND i % 7 < 3 THEN '' ELSE raw END AS x FROM r),
t AS (SELECT k, string_agg(x, chr(10) ORDER BY i) AS text, max(i) + 1 AS n, min(i) FILTER (x = '<!-- m:start -->') AS a, min(i) FILTER (x = '<!-- m:end -->') AS b, min(i) FILTER (starts_with(x, '# ')) AS title, min(i) FILTER (starts_with(x, '## ')) AS section,
  bool_or(regexp_matches(lower(x), '^## (\[unreleased\]|unreleased)')) AS open_, '<!-- m:start -->' || chr(10) || 'id ' || k || chr(10) || '<!-- m:end -->' AS block FROM l GROUP BY k),
c AS (SELECT t.*, (SELECT string_agg(x || chr(10), '' ORDER BY i) FROM l WHERE l.k = t.k AND i < a) AS head, (SELECT string_agg(chr(10) || x, '' ORDER BY i) FROM l WHERE l.k = t.k AND i > b) AS tail,
  (SELECT string_agg(x || chr(10), '' ORDER BY i) FROM l WHERE l.k = t.k AND i < title) AS above, (SELECT string_agg(chr(10) || x, '' ORDER BY i) FROM l WHERE l.k = t.k AND i > title) AS under,
  (SELECT string_agg(x, chr(10) ORDER BY i) FROM l WHERE l.k = t.k AND i < coalesce(section, n)) AS before, (SELECT string_agg(x, chr(10) ORDER BY i) FROM l WHERE l.k = t.k AND i >= section) AS after FROM t)
"""


def heading_keys(spark, sf_dir):
    """Headings, licences and addresses made of part names."""
    k, name = F.col("p_partkey"), F.col("p_name")
    value = F.when(k % 4 == 0, F.concat(F.lit("  🌻  "), name)).when(k % 4 == 1, F.concat(F.lit("*"), name)).when(k % 4 == 2, F.lit("§")).otherwise(F.concat(name, F.lit(" ")))
    module = F.when(k % 3 == 0, F.concat(F.lit("github.com/o/p"), k.cast("string"), F.lit("/sub"))).when(k % 3 == 1, "github.com/o").otherwise("example.com/o/p")
    return table(spark, sf_dir, "part").select(k, managed.heading_key(value).alias("heading"), managed.known_or_unknown(F.when(k % 2 == 0, " ").otherwise(name)).alias("known"), managed.licence_paragraph(F.when(k % 5 == 0, "MIT").otherwise("BSD")).alias("licence"), managed.repository_url(module).alias("url"))


HEADINGS_SQL = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN CASE WHEN contains(p_name, ' ') THEN lower(substr(p_name, instr(p_name, ' ') + 1)) ELSE '*' || lower(p_name) END WHEN 2 THEN '§' ELSE lower(p_name) END AS heading,
  CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE p_name END AS known,
  CASE WHEN p_partkey % 5 = 0 THEN 'This project is made available under the terms of the MIT License.' ELSE 'This project is made available under the following license expression: BSD.' END AS licence,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://github.com/o/p' || p_partkey ELSE '' END AS url FROM part
"""


def _cases(spark, sf_dir):
    """Orders as cases, with faults by number."""
    k = F.col("o_orderkey")
    capability = F.when(k % 7 == 0, F.array(F.lit("b"), F.lit("a"))).when(k % 7 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "orders").select(
        F.when(k % 50 == 0, F.lit(-1).cast("bigint")).otherwise(k).alias("case_id"), F.when(k % 11 == 0, "contract.v2").otherwise("contract.v1.3").alias("schema"), F.element_at(F.array(F.lit("merge"), F.lit("diff"), F.lit("guess")), (k % 3 + 1).cast("int")).alias("operation"),
        capability.alias("capabilities"), F.when(k % 4 == 0, k * 2).alias("parent_id"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("base"),
        (F.col("o_orderstatus") == "F").alias("case_eligible"),
    )


def contract_cases(spark, sf_dir):
    return contracts.case_violations(_cases(spark, sf_dir), {"merge": ["base"]}, {"operation": ["merge", "diff"]})


CASES_SQL = """
WITH c AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_orderkey END AS case_id, o_orderkey AS k, o_orderstatus = 'F' AS eligible FROM orders)
"""


def contract_results(spark, sf_dir):
    """Order lines as results of cases, some with outcomes that don't count or eligibility that is wrong."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    outcome = F.when(n == 3, "unsupported").when(n == 5, "excluded_ambiguous").otherwise("merged")
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), "o_orderstatus"), F.col("o") == k)
    eligible = F.when(n == 7, F.lit(True)).otherwise((F.col("o_orderstatus") == "F") & ~outcome.isin("unsupported", "excluded_ambiguous"))
    results = l.select((k * 10 + n).alias("result_id"), k.alias("case_id"), (F.col("l_suppkey") % 30).alias("adapter"), outcome.alias("outcome"), eligible.alias("eligible"))
    return contracts.result_violations(results, _cases(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("adapter")))


RESULTS_SQL = CASES_SQL + """
, r AS (SELECT l_orderkey * 10 + l_linenumber AS result_id, l_orderkey % 50 = 0 AS lost, l_suppkey % 30 >= 25 AS foreign_, o_orderstatus = 'F' AS e, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT result_id, 'unknown_case' AS category FROM r WHERE lost UNION ALL SELECT result_id, 'unknown_adapter' FROM r WHERE foreign_ UNION ALL SELECT result_id, 'eligibility' FROM r WHERE NOT lost AND n = 7 AND NOT e
"""


def report_cover(spark, sf_dir):
    """Labels as results, documents as the report's ids, some of them twice."""
    reported = table(spark, sf_dir, "documents").select(F.explode(F.when(F.col("doc_id") % 9 == 0, F.array("doc_id", "doc_id")).otherwise(F.array("doc_id"))).alias("result_id"))
    return contracts.report_cover(table(spark, sf_dir, "labels").select((F.col("doc_id") + 3).alias("result_id")), reported)


QUERIES = {f.__name__: f for f in (managed_blocks, changelogs, managed_texts, changelog_texts, heading_keys, contract_cases, contract_results, report_cover)}
ORACLE_SQL = {
    "managed_blocks": BLOCKS_SQL,
    "changelogs": CHANGELOG_SQL,
    "managed_texts": MARKED_SQL
    + """SELECT k AS doc_id, md5(CASE WHEN b > a THEN coalesce(head, '') || block || coalesce(tail, '') ELSE rtrim(text, chr(10)) || chr(10) || chr(10) || block || chr(10) END) AS markdown,
      md5(CASE WHEN b > a THEN coalesce(head, '') || block || coalesce(tail, '') WHEN rtrim(text, chr(10)) = '' THEN block ELSE rtrim(text, chr(10)) || chr(10) || block END) AS plain,
      md5(CASE WHEN title IS NULL THEN '# New' || chr(10) || chr(10) || text ELSE coalesce(above, '') || '# New' || coalesce(under, '') END) AS titled FROM c""",
    "changelog_texts": MARKED_SQL
    + r""", u AS (SELECT *, starts_with(text, '# ') AS own, chr(10) || '## [Unreleased]' || chr(10) || chr(10) || '### Added' || chr(10) || chr(10) || '### Changed' || chr(10) || chr(10) || '### Fixed' || chr(10) AS todo FROM c),
    w AS (SELECT *, CASE WHEN own THEN '' ELSE '# Changelog' || chr(10) || chr(10) END || coalesce(before || chr(10), '') || todo || coalesce(chr(10) || after, '') AS whole FROM u),
    m AS (SELECT k, CASE WHEN open_ THEN CASE WHEN own THEN '' ELSE '# Changelog' || chr(10) || chr(10) END || text ELSE rtrim(regexp_replace(regexp_replace(whole, '^\n{2,}', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) END AS text FROM w)
    SELECT k AS doc_id, md5(CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END) AS changelog FROM m""",
    "heading_keys": HEADINGS_SQL,
    "contract_cases": CASES_SQL
    + "SELECT case_id, unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'schema' END, CASE WHEN k % 3 = 2 THEN 'enum_operation' END, CASE WHEN k % 7 < 2 THEN 'unsorted_capabilities' END, CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN 'missing_field' END, CASE WHEN k % 4 = 0 AND k * 2 NOT IN (SELECT case_id FROM c) THEN 'unknown_parent' END, CASE WHEN case_id IN (SELECT case_id FROM c GROUP BY 1 HAVING count(*) > 1) THEN 'repeated_id' END], lambda x: x IS NOT NULL)) AS category FROM c",
    "contract_results": RESULTS_SQL,
    "report_cover": "WITH r AS (SELECT DISTINCT doc_id + 3 AS result_id FROM labels) SELECT coalesce(r.result_id, d.doc_id) AS result_id, CASE WHEN d.doc_id IS NULL THEN 'not_reported' WHEN r.result_id IS NULL THEN 'no_result' ELSE 'repeated' END AS category FROM r FULL OUTER JOIN documents d ON d.doc_id = r.result_id WHERE d.doc_id IS NULL OR r.result_id IS NULL OR d.doc_id % 9 = 0",
}
