"""Queries over documents in documents: Markdown with JSON and Markdown in it, merged from the leaves up, and Markdown merges of real text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested_trees
from ..sources.tables import table


def _pairs(spark, sf_dir):
    """A document's first line among a title, a JSON fence and a Markdown fence that holds a JSON fence; the template has further sections and members.

    Some inner JSON does not parse, and some templates name another family.
    """
    d = table(spark, sf_dir, "documents")
    k, line = F.col("doc_id"), F.concat(F.lit("line: "), F.coalesce(F.substring_index("text", "\n", 1), F.lit("")), F.lit(" end"))
    s = lambda c: c.cast("string")
    deep = F.concat(F.lit('{"x": {"y": '), s(k), F.when(k % 7 == 3, "").otherwise("}"), F.lit(", \"v\": 1.50}"))
    destination = F.concat(F.lit("lost\n# Title\n\n"), line, F.lit('\n\n```json\n{"k": '), s(F.col("n_chars")), F.lit("}\n```\n\n````markdown\n# inner\n\n"), line, F.lit("\n\n```json\n"), deep, F.lit("\n```\n````\nafter\n"))
    family = F.when(k % 11 == 4, "yaml").otherwise("json")
    template = F.concat(F.lit("# Title\n\n```"), family, F.lit('\n{"k": 0, "lang": "'), F.coalesce("lang", F.lit("")), F.lit('"}\n```\n\n````md\n## other\n\n```json\n{"x": {"z": 1}}\n```\n\n## more\n\nadded\n````\n\n\n## Tail\n\nof template\n'))
    return d.select("doc_id", template.alias("template"), destination.alias("destination"))


def _accepted(spark, sf_dir):
    """Of each document some of the children, by number."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    paths = F.array(F.when(k % 2 == 0, "/code_fence/0"), F.when(k % 3 != 0, "/code_fence/1"), F.when(k % 5 != 0, "/code_fence/1/code_fence/0"), F.when(k % 4 == 0, "/code_fence/9"))
    return d.select(F.explode(F.transform(F.array_compact(paths), lambda p: F.concat(k.cast("string"), p))).alias("node"))


def nested_tree_merges(spark, sf_dir):
    """Three depths of documents, merged from the leaves up."""
    done, _ = nested_trees.execute_nested(_pairs(spark, sf_dir), "doc_id", _accepted(spark, sf_dir))
    return done.select(F.col("node").cast("bigint").alias("doc_id"), "merged")


def nested_tree_reports(spark, sf_dir):
    """Every node that was merged, its depth, and why not if it was not."""
    return nested_trees.execute_nested(_pairs(spark, sf_dir), "doc_id", _accepted(spark, sf_dir))[1]


def markdown_merges(spark, sf_dir):
    """Documents' own text, some of its lines headings, merged with a template of sections that it has or lacks."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + F.col("doc_id")) % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    template = F.lit("## one\n\n1\n\n## two\n\n2\n## three\n# \n## four\n4\n```txt\n5\n```\n")
    done = nested_trees.merge_markdown(d.select("doc_id", template.alias("template"), F.array_join(lines, "\n").alias("destination")), "doc_id")
    return done.select("doc_id", F.md5(F.col("merged").cast("binary")).alias("digest"))


TREES_SQL = r"""
WITH d AS (SELECT doc_id AS k, n_chars AS n, coalesce(lang, '') AS lang, 'line: ' || replace(coalesce(string_split(text, chr(10))[1], ''), '|', chr(1)) || ' end' AS line FROM documents),
a AS (SELECT *, k % 2 = 0 AND k % 11 <> 4 AS outer_json, k % 3 <> 0 AS inner_md, k % 3 <> 0 AND k % 5 <> 0 AS deep, k % 7 = 3 AS broken FROM d),
j AS (SELECT *, '{"x": {"y": ' || k || CASE WHEN broken THEN '' ELSE '}' END || ', "v": 1.50}' AS raw, '{"x":{"z":1,"y":' || k || '},"v":1.50}' AS merged_deep FROM a),
m AS (SELECT *, '# inner||' || line || '||```json|' || CASE WHEN deep AND NOT broken THEN merged_deep ELSE raw END || '|```' || CASE WHEN inner_md THEN '||## more||added' ELSE '' END AS inside FROM j),
o AS (SELECT *, '# Title||' || line || '||```json|' || CASE WHEN outer_json THEN '{"k":' || n || ',"lang":"' || lang || '"}' ELSE '{"k": ' || n || '}' END || '|```||````markdown|' || inside || '|````|after||## Tail||of template|' AS t FROM m)
"""
QUERIES = {f.__name__: f for f in (nested_tree_merges, nested_tree_reports, markdown_merges)}
ORACLE_SQL = {
    "nested_tree_merges": TREES_SQL + "SELECT k AS doc_id, replace(replace(t, '|', chr(10)), chr(1), '|') AS merged FROM o",
    "nested_tree_reports": TREES_SQL
    + """SELECT k::VARCHAR AS node, 'markdown' AS family, 0 AS depth, NULL::VARCHAR AS diagnostic FROM o UNION ALL SELECT k || '/code_fence/0', 'json', 1, NULL FROM o WHERE outer_json
    UNION ALL SELECT k || '/code_fence/1', 'markdown', 1, NULL FROM o WHERE inner_md UNION ALL SELECT k || '/code_fence/1/code_fence/0', 'json', 2, CASE WHEN broken THEN 'destination_parse_error' END FROM o WHERE deep""",
    "markdown_merges": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
h AS (SELECT doc_id, i, (i + doc_id) % 3 = 0 AND regexp_matches('## ' || x, '^(#{1,6})\s+(.+?)\s*#*\s*$') AS head, CASE WHEN (i + doc_id) % 3 = 0 THEN '## ' || x ELSE x END AS x FROM r),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM h),
p AS (SELECT doc_id, nth, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS t FROM s WHERE nth > 0 GROUP BY doc_id, nth),
n AS (SELECT doc_id, coalesce((SELECT max(nth) FROM p WHERE p.doc_id = d.doc_id), 0) AS n FROM d),
q AS (SELECT doc_id, 0 AS rank, nth AS at_, t FROM p WHERE t <> '' UNION ALL SELECT doc_id, 1, v.i, replace(v.t, '|', chr(10)) FROM n, (VALUES (1, '## one||1'), (2, '## two||2'), (3, '## three|#'), (4, '## four|4'), (99, '```txt|5|```')) v(i, t) WHERE v.i > n.n)
SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY rank, at_) || chr(10)) AS digest FROM q GROUP BY doc_id""",
}
