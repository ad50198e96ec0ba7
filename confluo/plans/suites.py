"""Queries over suites as rows, adapters of runs, batches of operations, and reports of renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import suites
from ..sources.tables import table


def suite_selectors(spark, sf_dir):
    """Parts as suites of brands: their order, and the definition that a selector stands for."""
    k = F.col("p_partkey")
    kind, variant = F.concat(F.lit("k"), (k % 3).cast("string")), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("v"), (k % 4).cast("string")))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("manifest"), k.alias("pos"), kind.alias("kind"), F.substring_index("p_name", " ", 1).alias("grammar"), variant.alias("variant"), F.array(F.lit("a"), F.lit("b")).alias("roles"))
    return suites.selectors(rows).select("manifest", "pos", "rank", "first", "descriptor")


def planned_engines(spark, sf_dir):
    """The engine of each context: its own, or the plan's default by region."""
    k = F.col("n_nationkey")
    own = F.when(k % 3 == 0, "experimental_merge_ir").when(k % 3 == 1, "")
    default = F.when(k % 4 == 0, "experimental_merge_ir").when(k % 4 == 1, "guess").when(k % 4 == 2, "")
    return suites.with_engine(table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(k.alias("n"), own.alias("engine"), default.alias("fallback"))), F.col("c_nationkey") == F.col("n")), "engine", F.col("fallback")).select("c_custkey", "engine")


def _results(spark, sf_dir):
    """Order lines as cases of orders, some skipped by selection, some never run."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    key = k * 10 + n
    skipped = F.col("l_suppkey") % 5 == 0
    cases = table(spark, sf_dir, "lineitem").select(key.alias("id"), k.alias("suite"), n.alias("pos"), F.col("l_partkey").alias("case"), F.when(skipped, "skipped").otherwise("selected").alias("status"), F.when(skipped, "backend").otherwise("").alias("messages"))
    outcome = F.when(F.col("l_quantity") > 40, "failed").otherwise("passed")
    ran = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 4").groupBy(key.alias("id")).agg(F.max(outcome).alias("outcome"), F.max("l_returnflag").alias("said"))
    return suites.run_cases(cases, ran, "id")


def suite_case_rows(spark, sf_dir):
    """What became of every case."""
    return _results(spark, sf_dir).groupBy("suite", "pos", "case", "outcome", "said").agg(F.count(F.lit(1)).alias("n"))


def suite_case_reports(spark, sf_dir):
    """One report a suite: its cases in order, and counts."""
    found = suites.suite_reports(_results(spark, sf_dir), "suite", "pos", "case")
    return found.select("suite", F.array_join(F.transform("results", lambda x: F.concat(x["outcome"], F.lit(":"), x["said"])), ",").alias("results"), "total", "passed", "failed", "skipped")


def suite_envelopes(spark, sf_dir):
    """Totals of the suites of each customer."""
    found = suites.suite_reports(_results(spark, sf_dir), "suite", "pos", "case").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("suite"), F.col("o_custkey").alias("manifest")), "suite")
    return suites.report_envelope(found, ["manifest"])


def adapter_readiness(spark, sf_dir):
    """Families that the runs of suppliers need and have: by the lines they ship, and by their own number."""
    family = lambda c: F.concat(F.lit("f"), c.cast("string"))
    need = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_suppkey").alias("run"), family(F.col("l_partkey") % 4).alias("family"))
    have = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.explode(F.transform(F.sequence(F.lit(0), F.col("s_suppkey") % 6), lambda x: family(x))).alias("family"))
    done = suites.adapter_capabilities(need, have, "run")
    return done.select("run", *[F.array_join(c, ",").alias(c) for c in ("required", "registered", "missing")], "ready")


def operation_batches(spark, sf_dir):
    """Orders as batches, their lines as operations with the report of each."""
    kind = F.element_at(F.array(*[F.lit(o) for o in (*labels.OPERATIONS, "wrap")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    report = labels.operation_report(kind, F.lit("required"), F.lit("none"), F.lit("explicit_text"))["operation_family"]
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    found = suites.batch_operations(table(spark, sf_dir, "lineitem").select("l_orderkey", order.alias("at"), kind.alias("kind"), report.alias("report")), "l_orderkey", "at")
    return found.select("l_orderkey", "operation_count", F.array_join("operation_kinds", ",").alias("operation_kinds"), F.array_join("operation_profiles", ",").alias("operation_profiles"))


def render_reports(spark, sf_dir):
    """What the rendering of each order's merge reports, with its secondary metrics."""
    k = F.col("o_orderkey")
    language = F.when(k % 3 == 0, "json").when(k % 3 == 1, "go").otherwise("text")
    report = suites.render_report(language, F.when(k % 2 == 0, "owned_region_conflict_markers").otherwise(""), labels.render_policy(F.when(k % 5 == 0, "  ").otherwise("minimal")), F.when(k % 7 == 0, "dst"), F.when(k % 7 == 0, "lib/dst"))
    metrics = suites.secondary_metrics(k % 4 != 0, F.when(k % 6 == 0, (k % 10) / 10))
    conflict = suites.comment_conflict(F.lit("edit_edit"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("/"), k.cast("string"))), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", report.alias("r"), metrics.alias("m"), conflict.alias("c")).select("o_orderkey", "r.strategy", "r.backend", "r.parser", "m.retention", "m.diagnostic", "c.path", "c.message")


def text_facts(spark, sf_dir):
    """Lines of documents that are not blank, and checksums read from their digests."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    said = F.when(F.col("doc_id") % 3 == 0, F.substring(digest, 1, 8)).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(digest, 1, 3), F.lit("-"))).otherwise("none")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(suites.non_empty_lines(F.col("text"))).alias("n_lines"), suites.crc32_of(F.when(F.col("doc_id") % 3 == 2, "zz").otherwise(said)).alias("crc32"))


RESULTS_SQL = """
WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(CASE WHEN l_quantity > 40 THEN 'failed' ELSE 'passed' END) AS outcome, max(l_returnflag) AS said FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1),
c AS (SELECT l_orderkey AS suite, l_linenumber AS pos, l_partkey AS "case", CASE WHEN l_suppkey % 5 = 0 THEN 'skipped' ELSE coalesce(x.outcome, 'skipped') END AS outcome, CASE WHEN l_suppkey % 5 = 0 THEN 'backend' ELSE coalesce(x.said, 'not run') END AS said FROM lineitem LEFT JOIN x ON x.id = l_orderkey * 10 + l_linenumber),
s AS (SELECT suite, string_agg(outcome || ':' || said, ',' ORDER BY pos, "case", outcome, said) AS results, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM c GROUP BY suite)
"""
QUERIES = {f.__name__: f for f in (suite_selectors, planned_engines, suite_case_rows, suite_case_reports, suite_envelopes, adapter_readiness, operation_batches, render_reports, text_facts)}
ORACLE_SQL = {
    "suite_selectors": """
WITH p AS (SELECT p_brand AS manifest, p_partkey AS pos, 'k' || p_partkey % 3 AS kind, string_split(p_name, ' ')[1] AS grammar, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'v' || p_partkey % 4 END AS variant FROM part)
SELECT manifest, pos, row_number() OVER (PARTITION BY manifest ORDER BY kind, grammar, variant, pos)::INT AS "rank", row_number() OVER (PARTITION BY manifest, kind, grammar, variant ORDER BY pos) = 1 AS "first",
  '{"kind":"' || kind || '","subject":{"grammar":"' || grammar || '"' || CASE WHEN variant = '' THEN '' ELSE ',"variant":"' || variant || '"' END || '},"roles":["a","b"]}' AS descriptor FROM p""",
    "planned_engines": "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 OR c_nationkey % 4 = 0 THEN 'experimental_merge_ir' WHEN c_nationkey % 4 = 1 THEN 'owner_path' ELSE '' END AS engine FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "suite_case_rows": RESULTS_SQL + 'SELECT suite, pos, "case", outcome, said, count(*) AS n FROM c GROUP BY ALL',
    "suite_case_reports": RESULTS_SQL + "SELECT * FROM s",
    "suite_envelopes": RESULTS_SQL + "SELECT o_custkey AS manifest, count(*) AS suites, sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped FROM s JOIN orders ON o_orderkey = suite GROUP BY o_custkey",
    "adapter_readiness": """
WITH n AS (SELECT DISTINCT l_suppkey AS run, 'f' || l_partkey % 4 AS f FROM lineitem WHERE l_quantity > 30), h AS (SELECT s_suppkey AS run, 'f' || unnest(range(0, s_suppkey % 6 + 1)) AS f FROM supplier),
b AS (SELECT coalesce(n.run, h.run) AS run, coalesce(n.f, h.f) AS f, n.f IS NOT NULL AS need, h.f IS NOT NULL AS have FROM n FULL JOIN h ON n.run = h.run AND n.f = h.f)
SELECT run, coalesce(string_agg(f, ',' ORDER BY f) FILTER (need), '') AS required, coalesce(string_agg(f, ',' ORDER BY f) FILTER (have), '') AS registered, coalesce(string_agg(f, ',' ORDER BY f) FILTER (need AND NOT have), '') AS missing, count(*) FILTER (need AND NOT have) = 0 AS ready FROM b GROUP BY run""",
    "operation_batches": """
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['replace', 'delete', 'insert', 'move', 'wrap'][l_partkey % 5 + 1] AS kind, ['rewrite', 'removal', 'insertion', 'relocation', 'unknown'][l_partkey % 5 + 1] AS family FROM lineitem)
SELECT l_orderkey, count(*)::INT AS operation_count, string_agg(kind, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS operation_kinds, string_agg(family, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS operation_profiles FROM o GROUP BY l_orderkey""",
    "render_reports": f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'owned_region_conflict_markers' WHEN o_orderkey % 5 = 0 THEN 'canonical' ELSE 'minimal' END AS strategy,
  CASE WHEN o_orderkey % 7 = 0 THEN 'dst' ELSE ['native-json', 'go-parser', ''][o_orderkey % 3 + 1] END AS backend, CASE WHEN o_orderkey % 7 = 0 THEN 'lib/dst' ELSE ['standard-json', 'go/parser', ''][o_orderkey % 3 + 1] END AS parser,
  CASE WHEN o_orderkey % 6 = 0 THEN (o_orderkey % 10)::DOUBLE / 10 WHEN o_orderkey % 4 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS retention,
  CASE WHEN o_orderkey % 6 = 0 THEN '{suites.SAID["measured"]}' WHEN o_orderkey % 4 <> 0 THEN '{suites.SAID["merged"]}' ELSE '{suites.SAID["conflict"]}' END AS diagnostic,
  CASE WHEN o_orderkey % 8 = 0 THEN '/' ELSE '/' || o_orderkey END AS path, o_orderpriority AS message FROM orders""",
    "text_facts": """
WITH d AS (SELECT doc_id, text, md5(text) AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$')))::INT AS n_lines, CASE doc_id % 3 WHEN 0 THEN ('0x' || m[1:8])::BIGINT WHEN 1 THEN ('0x' || m[1:3])::BIGINT ELSE 0 END AS crc32 FROM d""",
}
