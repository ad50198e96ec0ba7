"""Queries over the template pipeline: documents give paths by their number, and contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import templates
from ..sources.tables import table

NAMES = ["README.md.example", "Gemfile", "config/settings.yml.example", "package.json", ".env.local.no-osc.example", f"{templates.PROJECT_SPEC}.example", templates.OMITTED, "bin/run.sh", "lib/tool.rb.example", "tsconfig.jsonc", "pyproject.toml", "notes.txt"]
REPLACEMENTS = {"KJ|NAME": "demo", "KJ|AUTHOR:EMAIL": "a@b.example"}


def _templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("page_id", F.col("doc_id"))
    k = (F.col("page_id") % len(NAMES)).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), k + 1)
    folder = F.when(k.isin(4, 5, 6), "").otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/")))
    token = F.when(F.col("doc_id") % 3 == 0, "{KJ|NAME} {bad} ").when(F.col("doc_id") % 7 == 0, "{KJ|AUTHOR:EMAIL} {KJ|OTHER} ").otherwise("")
    return docs.select("page_id", F.concat(folder, name).alias("template_source_path"), F.concat(token, F.coalesce("text", F.lit(""))).alias("template_content"))


def _overrides(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), F.when(F.col("page_id") % 12 == 11, "notes.txt").when(F.col("page_id") % 12 == 7, "bin/run.sh").otherwise("package.json"))
    strategy = F.when(F.col("page_id") % 12 == 11, "keep_destination").when(F.col("page_id") % 12 == 7, "raw_copy").otherwise("accept_template")
    return pages.filter("page_id % 12 IN (3, 7, 11)").select(F.col("page_id").alias("pos"), path.alias("path"), strategy.alias("strategy"))


def _destination(spark, sf_dir):
    """Every second target exists, every fourth with the content it would get."""
    t = _templates(spark, sf_dir).filter("page_id % 2 = 0").withColumn("path", templates.logical_path(F.col("template_source_path")))
    content = F.when(F.col("page_id") % 4 == 0, T.resolve_tokens(F.col("template_content"), REPLACEMENTS)).otherwise("old")
    return t.groupBy("path").agg(F.min_by(content, "page_id").alias("content"))


def _planned(spark, sf_dir):
    return templates.plan(_templates(spark, sf_dir), _overrides(spark, sf_dir), "demo")


def _executable(spark, sf_dir):
    rows = templates.with_state(_planned(spark, sf_dir), _destination(spark, sf_dir))
    return templates.executable(templates.prepared(templates.with_tokens(rows, REPLACEMENTS), REPLACEMENTS))


def template_classify(spark, sf_dir):
    return _planned(spark, sf_dir).select("page_id", "file_type", "family", "dialect")


def template_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select("page_id", "logical_path", "destination_path", "strategy", "action")


def template_state(spark, sf_dir):
    return templates.with_state(_planned(spark, sf_dir), _destination(spark, sf_dir)).select("page_id", "destination_exists", "write_action")


def token_keys(spark, sf_dir):
    return _templates(spark, sf_dir).select("page_id", F.array_join(T.token_keys(F.col("template_content")), ",").alias("token_keys"))


def unresolved_tokens(spark, sf_dir):
    return templates.with_tokens(_planned(spark, sf_dir), REPLACEMENTS).select("page_id", F.array_join("unresolved", ",").alias("unresolved"), "blocked")


def resolve_tokens(spark, sf_dir):
    rows = templates.prepared(templates.with_tokens(_planned(spark, sf_dir), REPLACEMENTS), REPLACEMENTS)
    return rows.select("page_id", "preparation", F.md5(F.col("prepared_content").cast("binary")).alias("digest"))


def template_execution(spark, sf_dir):
    return _executable(spark, sf_dir).select("page_id", "execution", "ready")


def template_report(spark, sf_dir):
    return templates.run_status(_executable(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def template_converge(spark, sf_dir):
    return templates.pending(_executable(spark, sf_dir)).select("page_id", "execution")


def required_families(spark, sf_dir):
    """Families that merging needs, and whether the default adapters (markdown, toml, ruby) have them."""
    rows = _executable(spark, sf_dir).filter("execution = 'merge_prepared'").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("available", F.col("family").isin("markdown", "toml", "ruby"))


_NAMES = ", ".join(f"'{n}'" for n in NAMES)
TREE_SQL = f"""
WITH t AS (SELECT page_id, CASE WHEN page_id % 12 IN (4, 5, 6) THEN '' ELSE 'p' || page_id || '/' END || [{_NAMES}][page_id % 12 + 1] AS src,
   CASE WHEN doc_id % 3 = 0 THEN '{{KJ|NAME}} {{bad}} ' WHEN doc_id % 7 = 0 THEN '{{KJ|AUTHOR:EMAIL}} {{KJ|OTHER}} ' ELSE '' END || coalesce(text, '') AS content FROM (SELECT doc_id AS page_id FROM documents) JOIN documents ON page_id = doc_id),
l AS (SELECT *, regexp_replace(src, '(\\.no-osc)?\\.example$', '') AS lp FROM t),
p AS (SELECT *, CASE lp WHEN '{templates.OMITTED}' THEN NULL WHEN '.env.local' THEN '.env.local.example' WHEN 'gem.gemspec' THEN 'demo.gemspec' ELSE lp END AS dp,
   CASE page_id % 12 WHEN 11 THEN 'keep_destination' WHEN 7 THEN 'raw_copy' WHEN 3 THEN 'accept_template' ELSE 'merge' END AS strategy,
   replace(replace(content, '{{KJ|AUTHOR:EMAIL}}', 'a@b.example'), '{{KJ|NAME}}', 'demo') AS resolved FROM l),
k AS (SELECT *, CASE page_id % 12 WHEN 0 THEN 'markdown' WHEN 1 THEN 'gemfile' WHEN 2 THEN 'yaml' WHEN 3 THEN 'json' WHEN 4 THEN 'dotenv' WHEN 5 THEN 'gemspec' WHEN 6 THEN 'yaml' WHEN 7 THEN 'bash' WHEN 8 THEN 'ruby' WHEN 9 THEN 'json' WHEN 10 THEN 'toml' ELSE 'text' END AS file_type,
   list_distinct(list_filter(regexp_extract_all(content, '\\{{([^}}]*)\\}}', 1), lambda x: regexp_matches(x, '^[A-Za-z0-9_]+\\|[A-Za-z0-9_]+(:[A-Za-z0-9_]+)*$'))) AS keys FROM p),
f AS (SELECT *, CASE file_type WHEN 'gemfile' THEN 'ruby' WHEN 'gemspec' THEN 'ruby' ELSE file_type END AS family,
   dp IS NOT NULL AND strategy NOT IN ('keep_destination', 'raw_copy') AS req, list_filter(keys, lambda x: x NOT IN ('KJ|NAME', 'KJ|AUTHOR:EMAIL')) AS unres FROM k),
d AS (SELECT lp AS path, arg_min(CASE WHEN page_id % 4 = 0 THEN resolved ELSE 'old' END, page_id) AS old FROM p WHERE page_id % 2 = 0 GROUP BY lp),
s AS (SELECT f.*, d.path IS NOT NULL AS there, old, req AND len(unres) > 0 AS blocked, CASE WHEN dp IS NULL THEN 'omit' WHEN strategy = 'keep_destination' THEN 'keep' WHEN d.path IS NOT NULL THEN 'update' ELSE 'create' END AS write_action FROM f LEFT JOIN d ON dp = path),
e AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN req AND len(keys) > 0 THEN 'resolve_tokens' ELSE 'pass_through' END AS preparation,
   CASE WHEN blocked THEN NULL WHEN req AND len(keys) > 0 THEN resolved ELSE content END AS prep,
   CASE WHEN blocked THEN 'blocked' WHEN dp IS NULL THEN 'omit' WHEN write_action = 'keep' THEN 'keep' WHEN strategy = 'raw_copy' THEN 'raw_copy' WHEN strategy = 'accept_template' THEN 'write_prepared' ELSE 'merge_prepared' END AS execution FROM s)
"""

QUERIES = {f.__name__: f for f in (template_classify, template_plan, template_state, token_keys, unresolved_tokens, resolve_tokens, template_execution, template_report, template_converge, required_families)}
ORACLE_SQL = {
    "template_classify": TREE_SQL + "SELECT page_id, file_type, family, CASE WHEN page_id % 12 = 9 THEN 'jsonc' ELSE family END AS dialect FROM f",
    "template_plan": TREE_SQL + "SELECT page_id, lp AS logical_path, dp AS destination_path, strategy, CASE WHEN dp IS NULL THEN 'omit' ELSE strategy END AS action FROM p",
    "template_state": TREE_SQL + "SELECT page_id, there AS destination_exists, write_action FROM s",
    "token_keys": TREE_SQL + "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'KJ|NAME' WHEN page_id % 7 = 0 THEN 'KJ|AUTHOR:EMAIL,KJ|OTHER' ELSE '' END AS token_keys FROM k",
    "unresolved_tokens": TREE_SQL + "SELECT page_id, array_to_string(unres, ',') AS unresolved, req AND len(unres) > 0 AS blocked FROM f",
    "resolve_tokens": TREE_SQL + "SELECT page_id, preparation, md5(prep) AS digest FROM e",
    "template_execution": TREE_SQL + "SELECT page_id, execution, execution NOT IN ('blocked', 'omit', 'keep') AS ready FROM e",
    "template_report": TREE_SQL + "SELECT CASE WHEN execution = 'omit' THEN 'omitted' WHEN execution = 'blocked' THEN 'blocked' WHEN execution = 'keep' OR old IS NOT DISTINCT FROM prep THEN 'kept' WHEN there THEN 'updated' ELSE 'created' END AS status, count(*) AS n FROM e GROUP BY 1",
    "template_converge": TREE_SQL + "SELECT page_id, execution FROM e WHERE blocked OR (execution NOT IN ('blocked', 'omit', 'keep') AND old IS DISTINCT FROM prep)",
    "required_families": TREE_SQL + "SELECT family, count(*) AS n, family IN ('markdown', 'toml', 'ruby') AS available FROM e WHERE execution = 'merge_prepared' GROUP BY family",
}
