"""Queries over contracts as documents, made of customers with their orders and lines, and over profiles of backends, made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backend_profiles, contract_docs
from ..sources.tables import settled, table


def _documents(spark, sf_dir):
    """A customer's orders as cases and their lines as results; every third customer's hold faults by number."""
    s = lambda c: c.cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k, n, c = F.col("l_orderkey"), F.col("l_linenumber"), F.col("o_custkey")
    bad = c % 3 == 0
    text = F.concat("l_returnflag", "l_linestatus")
    record = lambda inline, size, digest: cat('{"stdout":{"inline":', inline, ',"bytes":', size, ',"sha256":"', digest, '"},"note":7}')
    good = record(cat('"', text, '"'), "2", F.sha2(text, 256))
    raw = F.when(~bad | n.isin(1, 6), good).when(n == 2, "[]").when(n == 3, record(F.lit("5"), "2", F.sha2(text, 256))).when(n == 4, record(cat('"', text, '"'), "3", F.sha2(text, 256))).when(n == 5, record(cat('"', text, '"'), "2", F.lit("00"))).otherwise('{"log":{"bytes":1}}')
    outcome = F.element_at(F.array(F.lit("merged"), F.lit("unsupported"), F.lit("conflict"), F.lit("false_auto_merge")), (F.col("l_partkey") % 4 + 1).cast("int"))
    eligible = F.when(bad & (n == 7), "").otherwise(cat(',"score_eligible":', F.when(F.col("l_suppkey") % 2 == 0, "true").otherwise("false")))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == k)
    results = lines.select(c.alias("contract"), cat('{"id":"r', s(k * 10 + n), '","outcome":"', outcome, '"', eligible, ',"raw":', raw, "}").alias("item")).groupBy("contract").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("results"))
    o = F.col("o_orderkey")
    reference = F.element_at(
        F.array(*[F.lit(x) for x in (f'{{"slice":1021,"corpus_id":"c","manifest":"{contract_docs.CORPUS}","case_id":"x","merge_commit":"m"}}', "7", '{"slice":1021,"corpus_id":"c","manifest":"m","case_id":"x"}', f'{{"slice":5,"corpus_id":"c","manifest":"{contract_docs.CORPUS}","case_id":"x","merge_commit":"m"}}', '{"slice":1021,"corpus_id":"c","manifest":"m","case_id":"x","merge_commit":"m"}')]),
        F.when(F.col("o_custkey") % 3 == 0, o % 5 + 1).otherwise(1).cast("int"),
    )
    inputs = F.when((F.col("o_custkey") % 3 == 0) & (o % 3 == 0), ',"inputs":{"base":"x"}').otherwise("")
    case = cat('{"id":"', s(o), '","operation":"', F.when(o % 4 == 0, "history_replay").otherwise("merge3"), '","history_reference":', reference, inputs, "}")
    cases = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contract"), case.alias("item"), s(o).alias("id")).groupBy("contract").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("cases"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    m = F.col("contract")
    base = F.when(m % 2 == 0, ',"base_adapter":{"id":"b"}').otherwise("")
    why = F.when(m % 4 == 0, '{"size":1,"age":2}').otherwise('{"risk":null,"Kind":[]}')
    whole = cat('{"run_manifest":{"selection":{"selected_case_ids":[', F.col("ids"), '],"explanation":', why, "}", base, '},"contract":{"operations":["merge3"', F.when(m % 6 == 0, "").otherwise(',"history_replay"'), "]", F.when(m % 5 == 0, "").otherwise(',"outcomes":["merged","unsupported","conflict"]'), '},"cases":[', F.col("cases"), '],"case_results":[', F.coalesce("results", F.lit("")), "]}")
    return cases.join(results, "contract", "left").select("contract", whole.alias("source"))


def contract_records(spark, sf_dir):
    """Raw records whose inline content, bytes or digest is wrong."""
    docs = settled(_documents(spark, sf_dir), "contracts")
    return contract_docs.record_violations(contract_docs.parsed(docs, "contract", "source"), "contract")


def contract_histories(spark, sf_dir):
    return contract_docs.history_violations(contract_docs.parsed(_documents(spark, sf_dir), "contract", "source"), "contract")


def contract_summaries(spark, sf_dir):
    """The summary of each contract that breaks no rule; the documents are made once and read by each rule."""
    docs = settled(_documents(spark, sf_dir), "contracts")
    rows = contract_docs.parsed(docs, "contract", "source")
    wrong = contract_docs.record_violations(rows, "contract").unionByName(contract_docs.history_violations(rows, "contract"))
    done = contract_docs.canonical_summaries(docs, rows, wrong, "contract", "source")
    listed = lambda c: F.array_join(c, ",").alias(c)
    return done.select("contract", "adapters", "cases", "results", "selected", listed("eligible_ids"), listed("excluded_ids"), "false_auto_merges", "gate", listed("reasons"))


def contract_memberships(spark, sf_dir):
    """Operations and outcomes that a contract's own lists do not hold."""
    rows = contract_docs.parsed(_documents(spark, sf_dir), "contract", "source")
    return contract_docs.membership_violations(rows, "contract", [("cases", "operation", "operations"), ("case_results", "outcome", "outcomes")])


DOCS_SQL = """
WITH l AS (SELECT o_custkey AS c, l_orderkey AS k, l_linenumber AS n, o_custkey % 3 = 0 AS bad, 'r' || (l_orderkey * 10 + l_linenumber) AS id, ['merged', 'unsupported', 'conflict', 'false_auto_merge'][l_partkey % 4 + 1] AS outcome, l_suppkey % 2 = 0 AS eligible FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
h AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 5 AS f, o_orderkey % 3 = 0 AS inputs FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 3 = 0),
r AS (SELECT c AS contract, id AS subject, CASE n WHEN 2 THEN 'raw_not_object' WHEN 3 THEN 'inline_not_string' WHEN 4 THEN 'bytes_not_exact' WHEN 5 THEN 'digest_not_exact' WHEN 7 THEN 'eligibility_missing' END AS category FROM l WHERE bad AND n IN (2, 3, 4, 5, 7)),
v AS (SELECT c AS contract, k::VARCHAR AS subject, ['history_not_object', 'history_member_missing', 'history_slice', 'history_manifest'][f] AS category FROM h WHERE f > 0 UNION ALL SELECT c, k::VARCHAR, 'history_inline' FROM h WHERE inputs)
"""


def _profiles(spark, sf_dir):
    """Parts as profiles: words of their names as roles, kinds and fields, faults by number; and inventories."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    extractor = F.when(k % 3 == 0, F.concat(F.lit("field:"), first)).when(k % 3 == 1, "text").otherwise("guess")
    signatures = F.array(F.struct(F.when(k % 5 == 0, "").otherwise(first).alias("name"), last.alias("selector"), extractor.alias("extractor")), F.struct(first.alias("name"), F.when(k % 7 == 0, "").otherwise(first).alias("selector"), F.lit("kind:x").alias("extractor")))
    groups = F.when(k % 4 == 0, F.array(first, last, first)).otherwise(F.array(F.lit("g")))
    profiles = table(spark, sf_dir, "part").select(
        k.alias("profile"), F.array(F.lit("token"), F.when(k % 6 == 0, last).otherwise("comment")).alias("roles"), signatures.alias("signatures"), groups.alias("groups"),
        F.array(F.struct(first.alias("selector"), F.lit("g").alias("child_group"))).alias("parents"), F.array(last, F.when(k % 8 == 0, "").otherwise("leaf")).alias("atomics"),
        F.array(F.struct(F.lit("leaf").alias("selector"), F.when(k % 9 == 0, "").otherwise("trail").alias("strategy"))).alias("attachments"), F.col("p_brand").alias("family"),
    )
    inventories = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(k.alias("profile"), F.when(k % 4 == 0, "exhaustive").when(k % 10 == 0, "").otherwise("partial").alias("inventory"), F.array(F.lit("leaf"), last).alias("kinds"), F.when(k % 12 == 0, F.array(last)).otherwise(F.array().cast("array<string>")).alias("fields"))
    return profiles, inventories


def profile_violations(spark, sf_dir):
    return backend_profiles.validate_profiles(*_profiles(spark, sf_dir))


def profile_policies(spark, sf_dir):
    """Gates that a profile states itself, inherits from its family (brand), or from all."""
    profiles, _ = _profiles(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    null = lambda t: F.lit(None).cast(t)
    own = part.filter("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("scope"), (F.col("p_partkey") % 50).alias("fixtures"), null("double").alias("formatting"), F.when(F.col("p_partkey") % 20 == 0, 3).cast("bigint").alias("fallbacks"))
    brands = part.groupBy(F.col("p_brand").alias("scope")).agg(F.count(F.lit(1)).alias("fixtures")).filter("fixtures % 2 = 0").select("scope", "fixtures", F.lit(0.9).alias("formatting"), null("bigint").alias("fallbacks"))
    rest = spark.range(1).select(F.lit("*").alias("scope"), F.lit(16).cast("bigint").alias("fixtures"), F.lit(0.95).alias("formatting"), F.lit(2).cast("bigint").alias("fallbacks"))
    scopes = spark.range(3).select(F.element_at(F.array(F.lit("profile"), F.lit("family"), F.lit("all")), (F.col("id") + 1).cast("int")).alias("kind"), F.col("id").alias("rank"))
    return backend_profiles.resolve_policy(profiles, own.unionByName(brands).unionByName(rest), scopes)


PROFILES_SQL = """
WITH p AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS l FROM part),
s AS (SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE f END AS n1, CASE WHEN k % 7 = 0 THEN '' ELSE f END AS s2, CASE k % 3 WHEN 0 THEN 'field:' || f WHEN 1 THEN 'text' ELSE 'guess' END AS x, ['leaf', l] AS kinds, CASE WHEN k % 4 = 0 THEN 'error' ELSE 'warning' END AS sev, k % 2 = 0 AND NOT (k % 10 = 0 AND k % 4 <> 0) AS inv FROM p),
m AS (
  SELECT k, 1 AS o, 'error' AS severity, 'invalid node role ' || l AS message FROM s WHERE k % 6 = 0 AND l NOT IN ('structural', 'token', 'trivia', 'comment', 'delimiter', 'separator', 'virtual', 'error', 'opaque')
  UNION ALL SELECT k, 2, 'error', 'signature name is required' FROM s WHERE n1 = ''
  UNION ALL SELECT k, 3, 'error', 'unsupported signature extractor guess' FROM s WHERE x = 'guess'
  UNION ALL SELECT k, 4, 'error', 'duplicate signature name ' || f FROM s WHERE n1 = f
  UNION ALL SELECT k, 5, 'error', 'signature selector is required' FROM s WHERE s2 = ''
  UNION ALL SELECT k, 6, 'error', 'duplicate child group name ' || l FROM s WHERE k % 4 = 0 AND l = f
  UNION ALL SELECT k, 7, 'error', 'duplicate child group name ' || f FROM s WHERE k % 4 = 0
  UNION ALL SELECT k, 8, 'error', 'commutative parent ' || f || ' references unknown child group g' FROM s WHERE k % 4 = 0 AND f <> 'g' AND l <> 'g'
  UNION ALL SELECT k, 9, 'error', 'atomic node selector is required' FROM s WHERE k % 8 = 0
  UNION ALL SELECT k, 10, 'error', 'comment attachment strategy is required' FROM s WHERE k % 9 = 0
  UNION ALL SELECT k, 12, sev, 'unknown signature field ' || f FROM s WHERE inv AND k % 12 = 0 AND f <> l
  UNION ALL SELECT k, 13, sev, 'unknown signature selector ' || f FROM s WHERE inv AND s2 <> '' AND f <> l AND f <> 'leaf'
  UNION ALL SELECT k, 14, sev, 'unknown commutative parent selector ' || f FROM s WHERE inv AND f <> l AND f <> 'leaf')
"""
QUERIES = {f.__name__: f for f in (contract_records, contract_histories, contract_memberships, contract_summaries, profile_violations, profile_policies)}
ORACLE_SQL = {
    "contract_records": DOCS_SQL + "SELECT * FROM r",
    "contract_histories": DOCS_SQL + "SELECT * FROM v",
    "contract_memberships": DOCS_SQL
    + """SELECT o_custkey AS contract, o_orderkey::VARCHAR AS subject, 'operation_not_in_operations' AS category FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 6 = 0
      UNION ALL SELECT c, id, 'outcome_not_in_outcomes' FROM l WHERE c % 5 = 0 OR outcome = 'false_auto_merge'""",
    "contract_summaries": DOCS_SQL
    + """, ok AS (SELECT o_custkey AS c, count(*) AS cases FROM orders WHERE o_custkey NOT IN (SELECT contract FROM r UNION SELECT contract FROM v) GROUP BY o_custkey),
    a AS (SELECT c, count(*) AS results, string_agg(id, ',' ORDER BY id) FILTER (eligible) AS e, string_agg(id, ',' ORDER BY id) FILTER (outcome = 'unsupported') AS x, count(*) FILTER (eligible AND outcome = 'false_auto_merge') AS f FROM l WHERE NOT (bad AND n = 7) GROUP BY c)
    SELECT ok.c AS contract, 1 + (ok.c % 2 = 0)::INT AS adapters, cases, coalesce(results, 0) AS results, cases::INT AS selected, coalesce(e, '') AS eligible_ids, coalesce(x, '') AS excluded_ids, coalesce(f, 0) AS false_auto_merges, CASE WHEN f > 0 THEN 'fail' ELSE 'pass' END AS gate,
      CASE WHEN ok.c % 4 = 0 THEN 'age,size' ELSE 'Kind,risk' END AS reasons FROM ok LEFT JOIN a ON a.c = ok.c""",
    "profile_violations": PROFILES_SQL + 'SELECT k AS profile, (row_number() OVER (PARTITION BY k ORDER BY o) - 1)::INT AS "rank", severity, message FROM m',
    "profile_policies": """
WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) % 2 = 0)
SELECT p_partkey AS profile, CASE WHEN p_partkey % 10 = 0 THEN 'profile' WHEN n IS NOT NULL THEN 'family' ELSE 'all' END AS policy_scope, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 50 ELSE coalesce(n, 16) END AS fixtures,
  CASE WHEN n IS NOT NULL THEN 0.9 ELSE 0.95 END::DOUBLE AS formatting, CASE WHEN p_partkey % 20 = 0 THEN 3 ELSE 2 END::BIGINT AS fallbacks FROM part LEFT JOIN b ON b.p_brand = part.p_brand""",
}
