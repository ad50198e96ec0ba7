"""Queries over reviews of manifests: customers as manifests, their orders as suites and as decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests
from ..sources.tables import table


def _tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m, k = F.col("o_custkey"), F.col("o_orderkey")
    fam = lambda n: F.concat(F.lit("f"), n.cast("string"))
    roles = F.when(k % 11 == 0, F.array(F.lit("analysis"), F.lit("lost"), F.lit("merge"))).otherwise(F.array(F.lit("analysis"), F.lit("merge")))
    suites = o.select(m.alias("manifest"), k.alias("pos"), k.alias("suite"), fam(k % 5).alias("family"), roles.alias("roles"))
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("manifest"), F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("n"))
    entries = pairs.select("manifest", fam(F.col("n")).alias("family"), F.posexplode(F.array(F.lit("analysis"), F.lit("merge"), F.lit("merge"))).alias("pos", "role"), "n").filter("NOT (role = 'merge' AND n = 3 AND manifest % 4 = 0)")
    entries = entries.withColumn("entry", F.concat("family", F.lit("/"), "role", F.col("pos").cast("string"))).drop("n")
    contexts = pairs.filter("(manifest + n) % 3 = 0").select("manifest", fam(F.col("n")).alias("family"))
    profiles = pairs.filter("(manifest + n) % 7 <> 0").select("manifest", fam(F.col("n")).alias("family"))
    options = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("manifest"), (F.col("c_custkey") % 5 != 0).alias("explicit"))
    action = F.when(k % 4 == 0, manifests.ACCEPT).otherwise(manifests.PROVIDE)
    provided = F.when(k % 4 == 2, "f9").when(k % 4 == 3, fam((k + m) % 6))
    decisions = o.select(m.alias("manifest"), k.alias("pos"), manifests.request_id(fam((k + m) % 6)).alias("request_id"), action.alias("action"), provided.alias("provided"))
    now = manifests.replay_contexts(suites, options)
    replays = now.filter("manifest % 13 <> 0").withColumn("explicit", F.when(F.col("manifest") % 17 == 0, ~F.col("explicit")).otherwise(F.col("explicit")))
    outcome = F.element_at(F.array(*[F.lit(x) for x in manifests.OUTCOMES]), ((F.col("manifest") + F.col("n")) % 3 + 1).cast("int"))
    outcomes = pairs.filter("n <> 4").select("manifest", fam(F.col("n")).alias("family"), F.lit("merge").alias("role"), outcome.alias("outcome"))
    return suites, entries, contexts, profiles, options, replays, decisions, outcomes


def _part(name):
    def query(spark, sf_dir):
        return manifests.review(*_tables(spark, sf_dir))[name]

    query.__name__ = f"manifest_{name}"
    return query


def manifest_replay_contexts(spark, sf_dir):
    suites, _, _, _, options, _, _, _ = _tables(spark, sf_dir)
    found = manifests.replay_contexts(suites, options)
    return found.select("manifest", "surface", F.array_join("families", ",").alias("families"), "explicit")


def _chain(spark, sf_dir):
    """Open requests, and decisions made one after the other; the third of some manifests was made for another state, and some have one for no request."""
    suites, _, contexts, profiles, options, _, _, _ = _tables(spark, sf_dir)
    requests = manifests.open_requests(suites, contexts, profiles, options)
    per = requests.groupBy("manifest").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "family"))), lambda x: x["family"]).alias("open"))
    steps = per.select("manifest", "open", F.posexplode("open").alias("at", "family"))
    rest = F.array_join(F.transform(F.slice("open", F.col("at") + 1, F.size("open")), lambda x: F.concat(F.lit("family_context:"), x)), ",")
    state = F.md5(F.when((F.col("manifest") % 4 == 0) & (F.col("at") == 2), "gone").otherwise(rest).cast("binary"))
    own = steps.select("manifest", (F.col("at") * 2).cast("bigint").alias("pos"), manifests.request_id(F.col("family")).alias("request_id"), F.when(F.col("at") % 2 == 0, manifests.ACCEPT).otherwise(manifests.PROVIDE).alias("action"), F.when(F.col("at") % 2 == 1, F.col("family")).alias("provided"), state.alias("state"))
    # for a request of another name, and a second one for the same request
    more = own.filter("pos = 0 AND manifest % 3 = 0").withColumns({"pos": F.lit(1).cast("bigint"), "request_id": F.lit("family_context:f9")})
    twice = own.filter("pos = 0 AND manifest % 3 = 1").withColumn("pos", F.lit(99).cast("bigint"))
    return requests, own.unionByName(more).unionByName(twice)


def manifest_fixed_point(spark, sf_dir):
    """What becomes of every decision of a chain, and in which round."""
    _, applied, rejected = manifests.replay_to_fixed_point(*_chain(spark, sf_dir))
    return applied.select("manifest", "pos", "request_id", F.lit("applied").alias("outcome"), "round").unionByName(rejected.select("manifest", "pos", "request_id", F.col("reason").alias("outcome"), F.lit(-1).alias("round")))


def manifest_left_open(spark, sf_dir):
    """Requests without an answer when nothing changes any more."""
    return manifests.replay_to_fixed_point(*_chain(spark, sf_dir))[0].select("manifest", "request_id")


TABLES_SQL = """
WITH s AS (SELECT o_custkey AS m, o_orderkey AS k, o_orderkey % 5 AS n FROM orders),
fam AS (SELECT m, n, min(k) AS place FROM s GROUP BY m, n),
st AS (SELECT m, n, place, (m + n) % 3 = 0 AS has, (m + n) % 7 <> 0 AS may, m % 5 <> 0 AS explicit, m % 13 <> 0 AND m % 17 <> 0 AS fits FROM fam),
dec AS (SELECT o_custkey AS m, o_orderkey AS pos, (o_orderkey + o_custkey) % 6 AS n, o_orderkey % 4 AS a FROM orders),
ok AS (SELECT dec.*, has IS NOT NULL AND NOT has AND may AND explicit AS known, m % 13 <> 0 AND m % 17 <> 0 AS fits FROM dec LEFT JOIN (SELECT m, n, has, may, explicit FROM st) USING (m, n)),
first AS (SELECT m, n, min(pos) AS pos, arg_min(a, pos) AS a FROM ok WHERE known AND fits GROUP BY m, n),
res AS (SELECT st.*, first.pos, first.a, CASE WHEN has THEN 'explicit' WHEN may AND (NOT explicit OR a = 0) THEN 'default' WHEN may AND a = 3 THEN 'provided' ELSE 'none' END AS context FROM st LEFT JOIN first USING (m, n)),
suite AS (SELECT s.m, s.k, s.n, s.k % 11 = 0 OR (s.n = 3 AND s.m % 4 = 0) AS hole FROM s JOIN res USING (m, n) WHERE context <> 'none'),
rep AS (SELECT m, k, 2 AS total, (n <> 4 AND (m + n) % 3 = 0)::INT AS passed, (n <> 4 AND (m + n) % 3 = 1)::INT AS failed, 1 + (n = 4 OR (m + n) % 3 = 2)::INT AS skipped FROM suite WHERE NOT hole)
"""
CHAIN_SQL = TABLES_SQL + """
, op AS (SELECT m, n, row_number() OVER (PARTITION BY m ORDER BY place) - 1 AS turn FROM st WHERE NOT has AND may AND explicit),
d AS (SELECT m, turn * 2 AS pos, 'family_context:f' || n AS id, m % 4 = 0 AND turn >= 2 AS stale, turn FROM op)
"""
QUERIES = {f.__name__: f for f in (*[_part(n) for n in ("requests", "applied", "diagnostics", "reports", "summary")], manifest_replay_contexts, manifest_fixed_point, manifest_left_open)}
ORACLE_SQL = {
    "manifest_requests": TABLES_SQL + "SELECT m AS manifest, 'f' || n AS family, 'family_context:f' || n AS request_id FROM res WHERE context = 'none' AND may AND explicit",
    "manifest_applied": TABLES_SQL + "SELECT m AS manifest, pos, 'family_context:f' || n AS request_id, CASE WHEN a = 0 THEN 'accept_default_context' ELSE 'provide_explicit_context' END AS action FROM res WHERE NOT has AND a IN (0, 3)",
    "manifest_diagnostics": TABLES_SQL
    + """SELECT m AS manifest, 'family' AS about, 'f' || n AS subject, CASE WHEN context = 'default' THEN 'assumed_default' ELSE 'configuration_error' END AS category,
       CASE WHEN context = 'default' THEN '' WHEN NOT may THEN 'no_default' WHEN a = 1 THEN 'missing_required_payload' WHEN a = 2 THEN 'family_mismatch' ELSE 'missing_explicit_context' END AS reason FROM res WHERE context IN ('default', 'none')
     UNION ALL SELECT m, 'suite', k::VARCHAR, 'configuration_error', 'missing roles: ' || concat_ws(', ', CASE WHEN k % 11 = 0 THEN 'lost' END, CASE WHEN n = 3 AND m % 4 = 0 THEN 'merge' END) FROM suite WHERE hole
     UNION ALL SELECT DISTINCT m, 'decision', '', 'replay_rejected', CASE WHEN m % 13 = 0 THEN 'no_replay_context' ELSE 'replay_context_mismatch' END FROM dec WHERE m % 13 = 0 OR m % 17 = 0
     UNION ALL SELECT m, 'decision', 'family_context:f' || n, 'replay_rejected', 'request_not_found' FROM ok WHERE fits AND NOT known""",
    "manifest_reports": TABLES_SQL + "SELECT m AS manifest, k AS suite, total::BIGINT AS total, passed::BIGINT AS passed, failed::BIGINT AS failed, skipped::BIGINT AS skipped FROM rep",
    "manifest_summary": TABLES_SQL
    + "SELECT c_custkey AS manifest, count(k) AS suites, coalesce(sum(total), 0)::BIGINT AS total, coalesce(sum(passed), 0)::BIGINT AS passed, coalesce(sum(failed), 0)::BIGINT AS failed, coalesce(sum(skipped), 0)::BIGINT AS skipped FROM customer LEFT JOIN rep ON m = c_custkey GROUP BY c_custkey",
    "manifest_replay_contexts": TABLES_SQL
    + "SELECT c_custkey AS manifest, 'conformance_manifest' AS surface, coalesce(string_agg('f' || n, ',' ORDER BY place), '') AS families, c_custkey % 5 <> 0 AS explicit FROM customer LEFT JOIN fam ON m = c_custkey GROUP BY c_custkey",
    "manifest_fixed_point": CHAIN_SQL
    + """SELECT m AS manifest, pos, id AS request_id, CASE WHEN stale THEN 'stale_context' ELSE 'applied' END AS outcome, CASE WHEN stale THEN -1 ELSE turn END::INT AS round FROM d
     UNION ALL SELECT m, 1, 'family_context:f9', 'request_not_found', -1 FROM d WHERE pos = 0 AND m % 3 = 0 UNION ALL SELECT m, 99, id, 'not_settled', -1 FROM d WHERE pos = 0 AND m % 3 = 1""",
    "manifest_left_open": CHAIN_SQL + "SELECT m AS manifest, id AS request_id FROM d WHERE stale",
}
