"""Queries over change sets, reviews, conformance, promotion, contracts, ranges and envelopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review
from ..sources.tables import table



def _changes(spark, sf_dir):
    """Events as changes: class by user, kind by number, hash of the properties."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "insert").when(k == 1, "delete").when(k == 2, "content_change").otherwise("move")
    return e.select(F.col("event_id").alias("change_id"), kind.alias("kind"), F.col("user_id").alias("class_id"), F.md5(F.col("props").cast("binary")).alias("content_hash"), F.to_date("ts").alias("day"), (F.col("event_id") % 2).alias("side"))


CHANGES_SQL = """
WITH c AS (SELECT event_id AS change_id, user_id AS class_id, md5(props) AS h, CAST(ts AS DATE) AS day, event_id % 2 AS side,
                  CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' WHEN 2 THEN 'content_change' ELSE 'move' END AS kind FROM events)
"""
DETECT_SQL = """
, p AS (SELECT {keys}class_id, count(*) FILTER (WHERE kind = 'insert') AS i, count(DISTINCT CASE WHEN kind = 'insert' THEN h END) AS ih, count(*) FILTER (WHERE kind = 'delete') AS d,
               count(*) FILTER (WHERE kind = 'content_change') AS e, count(DISTINCT CASE WHEN kind = 'content_change' THEN h END) AS eh FROM c GROUP BY ALL),
f AS (SELECT {keys}0 AS rank, class_id, change_id, 'move' AS detector, 'warning' AS severity FROM c WHERE kind = 'move'
      UNION ALL SELECT {keys}1, class_id, NULL, 'duplicate_insert', 'error' FROM p WHERE i > 1 AND ih > 1
      UNION ALL SELECT {keys}2, class_id, NULL, 'delete_edit', 'error' FROM p WHERE d > 0 AND e > 0
      UNION ALL SELECT {keys}3, class_id, NULL, 'content_conflict', 'error' FROM p WHERE e > 1 AND eh > 1)
"""


def raw_merge_inconsistencies(spark, sf_dir):
    return review.inconsistencies(_changes(spark, sf_dir))


def mergeir_outcome(spark, sf_dir):
    """Per side, the classes' findings and the outcome."""
    c = _changes(spark, sf_dir)
    sides = [review.inconsistencies(c.filter(f"side = {s}")).withColumn("side", F.lit(s).cast("bigint")) for s in (0, 1)]
    return review.outcome(sides[0].unionByName(sides[1]), ["side"])


def decision_source_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 3).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def freeze_blocks(spark, sf_dir):
    """Turns of the assistant open and close frozen blocks in turn; an odd last marker leaves one open."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    marks = turns.select("conv_id", "turn", F.row_number().over(w).alias("k"), F.lead("turn").over(w).alias("end_turn"))
    return marks.filter("k % 2 = 1").select("conv_id", F.col("turn").alias("start_turn"), "end_turn", F.col("end_turn").isNull().alias("unclosed"))


FREEZE_SQL = """
WITH m AS (SELECT conv_id, turn, row_number() OVER w AS k, lead(turn) OVER w AS e FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT conv_id, turn AS start_turn, e AS end_turn, e IS NULL AS unclosed FROM m WHERE k % 2 = 1)
"""


def line_in_block(spark, sf_dir):
    """The first closed block that holds each turn."""
    blocks = freeze_blocks(spark, sf_dir).filter("not unclosed")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    inside = turns.join(blocks, "conv_id").filter("turn BETWEEN start_turn AND end_turn")
    return turns.join(inside.groupBy("conv_id", "turn").agg(F.min("start_turn").alias("block_start")), ["conv_id", "turn"], "left")


def range_overlap(spark, sf_dir):
    """Pairs of an order's lines whose quantity ranges overlap, and whether the first holds the second."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity") + F.col("l_linenumber") * 3).cast("long").alias("b"))
    r = l.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("a").alias("x"), F.col("b").alias("y"))
    both = l.join(r, "l_orderkey").filter("l_linenumber < other AND a < y AND x < b")
    return both.select("l_orderkey", "l_linenumber", "other", ((F.col("a") <= F.col("x")) & (F.col("y") <= F.col("b"))).alias("contains"))


def limits(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("allowed", review.within_limits(F.col("n"), {"at_least": 2, "<": 6, "!=": 4}))


def _cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("operation"))


def review_groups(spark, sf_dir):
    g = review.review_groups(_cases(spark, sf_dir), "group_id", "position", "case_id", ["operation"])
    return g.select("group_id", "first_position", "operation", F.array_join(F.col("case_ids").cast("array<string>"), ",").alias("case_ids"))


def _resolved(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' OR o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("case_id"))


def review_progress(spark, sf_dir):
    return review.review_progress(_cases(spark, sf_dir), _resolved(spark, sf_dir), "group_id", "case_id")


PROGRESS_SQL = """
WITH p AS (SELECT o_custkey AS group_id, count(*) FILTER (WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0) AS resolved, count(*) FILTER (WHERE NOT (o_orderstatus = 'F' OR o_orderkey % 3 = 0)) AS pending FROM orders GROUP BY 1)
"""


def review_ready(spark, sf_dir):
    """Customers all of whose orders are resolved; one without orders is ready too."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))
    return c.join(review_progress(spark, sf_dir).filter("not complete"), "group_id", "left_anti")


def review_accepted(spark, sf_dir):
    """Groups with an apply decision: a customer with an urgent order."""
    decisions = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("group_id"))
    return _cases(spark, sf_dir).select("group_id").distinct().join(decisions, "group_id", "left_semi")


def _profiles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("family", (F.col("s_suppkey") % 7).cast("int"))
    return s.groupBy("family").agg(F.collect_set((F.col("s_nationkey") % 5).cast("string")).alias("backends"), F.collect_set((F.col("s_nationkey") % 11).cast("string")).alias("dialects"), F.collect_set((F.col("s_suppkey") % 6).cast("string")).alias("supported"))


def _selected(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    cases = part.select("p_partkey", (key % 8).cast("int").alias("family"), F.when(key % 3 == 0, (key % 5).cast("string")).alias("backend"), F.when(key % 4 == 0, (key % 13).cast("string")).alias("dialect"), F.array((key % 6).cast("string")).alias("policies"))
    return review.select_cases(cases, _profiles(spark, sf_dir), "family")


def conformance_select(spark, sf_dir):
    return _selected(spark, sf_dir).select("p_partkey", "family", "status", "messages")


SELECT_SQL = """
WITH pr AS (SELECT (s_suppkey % 7)::INT AS family, list(DISTINCT (s_nationkey % 5)::VARCHAR) AS backends, list(DISTINCT (s_nationkey % 11)::VARCHAR) AS dialects, list(DISTINCT (s_suppkey % 6)::VARCHAR) AS supported FROM supplier GROUP BY 1),
m AS (SELECT p_partkey, (p_partkey % 8)::INT AS family,
  CASE WHEN p_partkey % 3 = 0 AND NOT coalesce(list_contains(backends, (p_partkey % 5)::VARCHAR), false) THEN 'backend' END AS a,
  CASE WHEN p_partkey % 4 = 0 AND NOT coalesce(list_contains(dialects, (p_partkey % 13)::VARCHAR), false) THEN 'dialect' END AS b,
  CASE WHEN NOT coalesce(list_contains(supported, (p_partkey % 6)::VARCHAR), false) THEN 'policy' END AS c
  FROM part LEFT JOIN pr ON (p_partkey % 8)::INT = pr.family),
s AS (SELECT p_partkey, family, concat_ws(',', a, b, c) AS messages, CASE WHEN concat_ws(',', a, b, c) = '' THEN 'selected' ELSE 'skipped' END AS status FROM m)
"""


def conformance_plan(spark, sf_dir):
    """Roles of each family against its entries; roles without an entry are missing."""
    part = table(spark, sf_dir, "part")
    entries = part.groupBy((F.col("p_partkey") % 8).cast("int").alias("family"), F.col("p_brand").alias("role")).agg(F.min("p_partkey").alias("entry"))
    families = part.select((F.col("p_partkey") % 8).cast("int").alias("family")).distinct()
    roles = part.select(F.col("p_brand").alias("role")).distinct()
    wanted = families.withColumn("_k", F.lit(1)).join(roles.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return wanted.join(entries, ["family", "role"], "left").groupBy("family").agg(F.count("entry").alias("planned"), F.count_if(F.col("entry").isNull()).alias("missing"))


def conformance_rollup(spark, sf_dir):
    """Outcomes by family: skipped cases stay skipped, others pass by size."""
    results = _selected(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    outcome = F.when(F.col("status") == "skipped", "skipped").when(F.col("p_size") % 5 == 0, "failed").when(F.col("p_size") % 7 == 0, "unknown").otherwise("passed")
    return review.roll_up(results.withColumn("outcome", outcome), ["family"])


def _reports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("fixtures"), F.round(F.avg("quality"), 9).alias("formatting"), F.sum("toxic").alias("fallbacks"), F.count_if(F.col("quality") + F.col("toxic") == 0).alias("unresolved"))


def profile_promotion(spark, sf_dir):
    reasons = review.blocking_reasons(F.col("fixtures"), F.col("formatting"), F.col("fallbacks"), F.col("unresolved"), 12, 2, 0.8)
    return _reports(spark, sf_dir).select("source", reasons.alias("reasons")).withColumn("status", F.when(F.col("reasons") == "", "recommended").otherwise("available"))


PROMOTION_SQL = """
WITH r AS (SELECT source, count(*) AS fixtures, round(avg(quality), 9) AS formatting, sum(toxic) AS fallbacks, count(*) FILTER (WHERE quality + toxic = 0) AS unresolved FROM documents JOIN labels USING (doc_id) GROUP BY source),
p AS (SELECT source, concat_ws(',', CASE WHEN fixtures < 12 THEN 'insufficient_fixtures' END, CASE WHEN formatting < 0.8 THEN 'formatting_below_threshold' END,
      CASE WHEN fallbacks > 2 THEN 'too_many_fallbacks' END, CASE WHEN unresolved > 0 THEN 'unresolved_conflicts' END) AS reasons FROM r),
s AS (SELECT source, reasons, CASE WHEN reasons = '' THEN 'recommended' ELSE 'available' END AS status FROM p)
"""


def profile_selection(spark, sf_dir):
    """Whether a source's state reaches a minimum; advisory requirements always allow."""
    p = profile_promotion(spark, sf_dir)
    k = F.pmod(F.regexp_replace("source", "[^0-9]", "").cast("int"), F.lit(4))
    least = F.when(k == 0, "experimental").when(k == 1, "available").when(k == 2, "recommended").otherwise("default")
    reached = review.status_rank(F.col("status")) >= review.status_rank(least)
    return p.select("source", least.alias("minimum"), "status", reached.alias("reached"), (reached | (k == 3)).alias("allowed"))


def contract_dangling(spark, sf_dir):
    """Results that name no case: documents are named by ten times their id, users by theirs."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 10).alias("case_id"))
    named = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("case_id"))
    return review.dangling(named, "case_id", docs, "case_id").select("event_id", "case_id")


def contract_duplicates(spark, sf_dir):
    return review.duplicates(table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")), ["digest"])


def contract_counts(spark, sf_dir):
    """Declared counts (documents by source) against recomputed ones of labelled documents, where they differ."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    declared = d.groupBy("source").agg(F.count(F.lit(1)).alias("declared"))
    counted = d.join(l, "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("counted"))
    both = declared.join(counted, "source", "full_outer").na.fill(0, ["declared", "counted"])
    return both.filter("declared != counted")


def contract_eligibility(spark, sf_dir):
    """Eligible results: of an eligible case, with an outcome that quality counts."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = l.join(d.select("doc_id", "lang"), "doc_id")
    eligible = (F.col("lang") != "fr") & ~((F.col("quality") == 0) & (F.col("toxic") == 0))
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("results"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & (F.col("toxic") == 1)).alias("false_auto_merges"))


def contract_grouped(spark, sf_dir):
    """Cases by partition, empty partitions too: languages, and one that no document has."""
    langs = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([("en",), ("de",), ("fr",), ("es",), ("holdout",)], "partition string")
    return known.join(langs, "partition", "left").na.fill(0, ["n"])


def inline_hash(spark, sf_dir):
    """Items whose text breaks its byte limit or declared digest."""
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text")
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    size = F.octet_length("text")
    declared = F.when(F.col("id") % 9 == 0, F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    rows = b.unionByName(d).withColumns({"too_long": size > 4096, "digest_mismatch": declared != F.sha2(F.col("text").cast("binary"), 256)})
    return rows.filter("too_long OR digest_mismatch").select("kind", "id", "too_long", "digest_mismatch")


def availability(spark, sf_dir):
    """Backends (users) by their checks (events): unknown without one, unavailable if any required one fails."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("checks"), F.bool_or((F.col("event_id") % 3 == 0) & (F.col("value") < 20)).alias("failed"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).unionByName(per.select("user_id")).distinct()
    return users.join(per, "user_id", "left").select("user_id", F.when(F.col("checks").isNull(), "unknown").when(F.col("failed"), "unavailable").otherwise("available").alias("status"))


def provider_status(spark, sf_dir):
    """The worst severity of a user's events: blocked, warning or clean."""
    rank = F.max(F.when(F.col("value") > 90, 2).when(F.col("value") > 60, 1).otherwise(0)).alias("r")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rank).select("user_id", F.element_at(F.array(F.lit("clean"), F.lit("warning"), F.lit("blocked")), F.col("r") + 1).alias("status"))


def envelope_import(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "other").otherwise("review_replay_bundle")
    version = F.when(F.col("event_id") % 7 == 0, F.lit(2)).otherwise(F.lit(1))
    return e.select("event_id", review.opened(kind, version, F.col("props"), "review_replay_bundle").alias("x")).select("event_id", "x.*")


QUERIES = {f.__name__: f for f in (raw_merge_inconsistencies, mergeir_outcome, decision_source_summary, freeze_blocks, line_in_block, range_overlap, limits, review_groups, review_progress, review_ready, review_accepted, conformance_select, conformance_plan, conformance_rollup, profile_promotion, profile_selection, contract_dangling, contract_duplicates, contract_counts, contract_eligibility, contract_grouped, inline_hash, availability, provider_status, envelope_import)}
ORACLE_SQL = {
    "raw_merge_inconsistencies": CHANGES_SQL + DETECT_SQL.format(keys="") + "SELECT * FROM f",
    "mergeir_outcome": CHANGES_SQL + DETECT_SQL.format(keys="side, ") + "SELECT side, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'blocked_by_inconsistency' ELSE 'mergeable' END AS outcome FROM f GROUP BY side",
    "decision_source_summary": "SELECT event_type, event_id % 3 AS source, count(*) AS n FROM events GROUP BY ALL",
    "freeze_blocks": FREEZE_SQL + "SELECT * FROM b",
    "line_in_block": FREEZE_SQL + "SELECT c.conv_id, c.turn, min(start_turn) AS block_start FROM conversations c LEFT JOIN b ON b.conv_id = c.conv_id AND NOT unclosed AND c.turn BETWEEN start_turn AND end_turn GROUP BY ALL",
    "range_overlap": "WITH l AS (SELECT l_orderkey, l_linenumber, trunc(l_quantity)::BIGINT AS a, trunc(l_quantity + l_linenumber * 3)::BIGINT AS b FROM lineitem) SELECT l.l_orderkey, l.l_linenumber, r.l_linenumber AS other, l.a <= r.a AND r.b <= l.b AS contains FROM l JOIN l r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber < r.l_linenumber AND l.a < r.b AND r.a < l.b",
    "limits": "SELECT l_orderkey, count(*) AS n, count(*) >= 2 AND count(*) < 6 AND count(*) <> 4 AS allowed FROM lineitem GROUP BY 1",
    "review_groups": "SELECT o_custkey AS group_id, min(o_orderkey) AS first_position, arg_min(o_orderpriority, o_orderkey) AS operation, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS case_ids FROM orders GROUP BY 1",
    "review_progress": PROGRESS_SQL + "SELECT *, pending = 0 AS complete FROM p",
    "review_ready": PROGRESS_SQL + "SELECT c_custkey AS group_id FROM customer WHERE c_custkey NOT IN (SELECT group_id FROM p WHERE pending > 0)",
    "review_accepted": "SELECT DISTINCT o_custkey AS group_id FROM orders WHERE o_orderpriority = '1-URGENT'",
    "conformance_select": SELECT_SQL + "SELECT p_partkey, family, status, messages FROM s",
    "conformance_plan": "WITH f AS (SELECT DISTINCT (p_partkey % 8)::INT AS family FROM part), r AS (SELECT DISTINCT p_brand AS role FROM part), e AS (SELECT DISTINCT (p_partkey % 8)::INT AS family, p_brand AS role, 1 AS x FROM part) SELECT family, count(x) AS planned, count(*) FILTER (WHERE x IS NULL) AS missing FROM f CROSS JOIN r LEFT JOIN e USING (family, role) GROUP BY family",
    "conformance_rollup": SELECT_SQL + ", o AS (SELECT family, CASE WHEN status = 'skipped' THEN 'skipped' WHEN p_size % 5 = 0 THEN 'failed' WHEN p_size % 7 = 0 THEN 'unknown' ELSE 'passed' END AS o FROM s JOIN part USING (p_partkey)) SELECT family, count(*) AS total, count(*) FILTER (WHERE o = 'passed') AS passed, count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o = 'skipped') AS skipped FROM o GROUP BY family",
    "profile_promotion": PROMOTION_SQL + "SELECT * FROM s",
    "profile_selection": PROMOTION_SQL + ", k AS (SELECT *, regexp_replace(source, '[^0-9]', '', 'g')::INT % 4 AS k FROM s) SELECT source, ['experimental', 'available', 'recommended', 'default'][k + 1] AS minimum, status, CASE status WHEN 'recommended' THEN 3 ELSE 2 END >= k + 1 AS reached, CASE status WHEN 'recommended' THEN 3 ELSE 2 END >= k + 1 OR k = 3 AS allowed FROM k",
    "contract_dangling": "SELECT event_id, user_id AS case_id FROM events WHERE user_id NOT IN (SELECT doc_id * 10 FROM documents)",
    "contract_duplicates": "SELECT md5(coalesce(text, '')) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "contract_counts": "WITH a AS (SELECT source, count(*) AS declared FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS counted FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT source, coalesce(declared, 0) AS declared, coalesce(counted, 0) AS counted FROM a FULL OUTER JOIN b USING (source) WHERE coalesce(declared, 0) <> coalesce(counted, 0)",
    "contract_eligibility": "SELECT lang, count(*) AS results, count(*) FILTER (WHERE lang <> 'fr' AND NOT (quality = 0 AND toxic = 0)) AS eligible, count(*) FILTER (WHERE lang <> 'fr' AND NOT (quality = 0 AND toxic = 0) AND toxic = 1) AS false_auto_merges FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "contract_grouped": "SELECT p AS partition, count(doc_id) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('holdout')) v(p) LEFT JOIN documents ON coalesce(lang, 'none') = p GROUP BY p",
    "inline_hash": "WITH r AS (SELECT 'benchmark' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'document', doc_id, text FROM documents) SELECT kind, id, strlen(text) > 4096 AS too_long, id % 9 = 0 AS digest_mismatch FROM r WHERE strlen(text) > 4096 OR id % 9 = 0",
    "availability": "WITH p AS (SELECT user_id, count(*) AS n, bool_or(event_id % 3 = 0 AND value < 20) AS f FROM events GROUP BY 1), u AS (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM p) SELECT user_id, CASE WHEN n IS NULL THEN 'unknown' WHEN f THEN 'unavailable' ELSE 'available' END AS status FROM u LEFT JOIN p USING (user_id)",
    "provider_status": "SELECT user_id, ['clean', 'warning', 'blocked'][max(CASE WHEN value > 90 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END) + 1] AS status FROM events GROUP BY 1",
    "envelope_import": "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS ok, CASE WHEN event_id % 5 = 0 THEN 'kind_mismatch' WHEN event_id % 7 = 0 THEN 'unsupported_version' END AS error, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN props END AS payload FROM events",
}
