"""Queries over keyed merges.  Three revisions of orders come from the key's remainder by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources.tables import table

#: Remainders of the order key that a revision lacks, and the mark it adds in others.
LACKS = {"base": [10, 11, 12, 13], "ours": [5, 7, 8, 11], "theirs": [6, 7, 9, 10]}
MARKS = {"base": {}, "ours": {1: "#o", 3: "#x", 4: "#o", 9: "#o", 13: "#o"}, "theirs": {2: "#t", 3: "#x", 4: "#t", 8: "#t", 13: "#t"}}


def revision(orders: DataFrame, side: str, value: str = "o_orderpriority") -> DataFrame:
    b = F.col("o_orderkey") % 20
    mark = F.lit("")
    for remainder, text in MARKS[side].items():
        mark = F.when(b == remainder, text).otherwise(mark)
    return orders.filter(~b.isin(LACKS[side])).select("o_orderkey", F.concat(F.col(value), mark).alias("value"))


def _revision_sql(side: str) -> str:
    cases = " ".join(f"WHEN {r} THEN '{t}'" for r, t in MARKS[side].items())
    mark = f"CASE o_orderkey % 20 {cases} ELSE '' END" if cases else "''"
    return f"SELECT o_orderkey, o_orderpriority || {mark} AS v FROM orders WHERE o_orderkey % 20 NOT IN ({', '.join(map(str, LACKS[side]))})"


ROWS_SQL = f"""
WITH b AS ({_revision_sql("base")}), o AS ({_revision_sql("ours")}), t AS ({_revision_sql("theirs")}),
r AS (SELECT coalesce(b.o_orderkey, o.o_orderkey, t.o_orderkey) AS o_orderkey, b.v AS bv, o.v AS ov, t.v AS tv,
             b.o_orderkey IS NOT NULL AS hb, o.o_orderkey IS NOT NULL AS ho, t.o_orderkey IS NOT NULL AS ht
      FROM b FULL OUTER JOIN o ON b.o_orderkey = o.o_orderkey FULL OUTER JOIN t ON coalesce(b.o_orderkey, o.o_orderkey) = t.o_orderkey),
d AS (SELECT *, CASE WHEN ho = ht AND ov IS NOT DISTINCT FROM tv THEN CASE WHEN ho THEN 'ours' ELSE 'drop' END
        WHEN hb = ho AND bv IS NOT DISTINCT FROM ov THEN CASE WHEN ht THEN 'theirs' ELSE 'drop' END
        WHEN hb = ht AND bv IS NOT DISTINCT FROM tv THEN CASE WHEN ho THEN 'ours' ELSE 'drop' END
        WHEN NOT hb THEN 'add_add' WHEN NOT ho OR NOT ht THEN 'delete_edit' ELSE 'edit_edit' END AS decision FROM r)
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return merge.three_way_rows(*[revision(orders, s) for s in ("base", "ours", "theirs")], ["o_orderkey"], "value")


def merge3_orders_decisions(spark, sf_dir):
    return merge.decide(_rows(spark, sf_dir)).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def merge3_orders_conflicts(spark, sf_dir):
    return merge.decide(_rows(spark, sf_dir)).filter(F.col("decision").isin(merge.CONFLICTS)).select("o_orderkey", F.col("decision").alias("category"))


def merge3_orders_result(spark, sf_dir):
    return merge.decide(_rows(spark, sf_dir)).filter("kept").select("o_orderkey", "value")


COLUMNS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def merge3_columns(spark, sf_dir):
    """The recursion into sub-keys: each order is an object of three members, merged member by member."""
    orders = table(spark, sf_dir, "orders")
    long = orders.select("o_orderkey", F.explode(F.create_map(*[x for c in COLUMNS for x in (F.lit(c), F.md5(F.concat_ws("/", F.lit(c), "o_orderstatus", "o_orderpriority").cast("binary")))])).alias("member", "value"))
    b, pick = F.col("o_orderkey") % 20, F.length("member") % 3
    side = lambda mark, at: long.select("o_orderkey", "member", F.when((b.isin(at)) & (pick == (b % 3)), F.concat("value", F.lit(mark))).otherwise(F.col("value")).alias("value"))
    rows = merge.three_way_rows(long, side("#o", [1, 4, 13]), side("#t", [2, 4, 13]), ["o_orderkey", "member"], "value")
    return merge.decide(rows).groupBy("member", "decision").agg(F.count(F.lit(1)).alias("n"))


MERGE3_COLUMNS_SQL = """
WITH l AS (SELECT o_orderkey, m AS member, md5(m || '/' || o_orderstatus || '/' || o_orderpriority) AS v
           FROM orders, (VALUES ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) t(m)),
s AS (SELECT *, v || CASE WHEN o_orderkey % 20 IN (1, 4, 13) AND length(member) % 3 = o_orderkey % 20 % 3 THEN '#o' ELSE '' END AS ov,
             v || CASE WHEN o_orderkey % 20 IN (2, 4, 13) AND length(member) % 3 = o_orderkey % 20 % 3 THEN '#t' ELSE '' END AS tv FROM l)
SELECT member, CASE WHEN ov = tv THEN 'ours' WHEN v = ov THEN 'theirs' WHEN v = tv THEN 'ours' ELSE 'edit_edit' END AS decision, count(*) AS n FROM s GROUP BY ALL
"""


def classify_changes(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("o_orderkey", merge.change_kind("ours").alias("ours_change"), merge.change_kind("theirs").alias("theirs_change"))
    return rows.filter("ours_change != 'unchanged' OR theirs_change != 'unchanged'")


CLASSIFY_SQL = ROWS_SQL + """
, c AS (SELECT o_orderkey,
   CASE WHEN NOT hb AND ho THEN 'added' WHEN hb AND NOT ho THEN 'deleted' WHEN hb AND ho AND bv IS DISTINCT FROM ov THEN 'edited' ELSE 'unchanged' END AS ours_change,
   CASE WHEN NOT hb AND ht THEN 'added' WHEN hb AND NOT ht THEN 'deleted' WHEN hb AND ht AND bv IS DISTINCT FROM tv THEN 'edited' ELSE 'unchanged' END AS theirs_change FROM r)
SELECT * FROM c WHERE ours_change <> 'unchanged' OR theirs_change <> 'unchanged'
"""


def comment_delta(spark, sf_dir):
    return merge.comment_delta(_rows(spark, sf_dir)).select("o_orderkey", "outcome", "comment")


COMMENT_SQL = ROWS_SQL + """
, c AS (SELECT o_orderkey, ov, tv, CASE WHEN ov IS NOT DISTINCT FROM tv THEN 'same' WHEN bv IS NOT DISTINCT FROM ov THEN 'theirs'
                                        WHEN bv IS NOT DISTINCT FROM tv THEN 'ours' ELSE 'conflict' END AS outcome FROM r)
SELECT o_orderkey, outcome, CASE WHEN outcome = 'theirs' THEN tv ELSE ov END AS comment FROM c
"""


def import_set_merge(spark, sf_dir):
    """Parts of each order are its imports; a revision lacks some lines."""
    items = table(spark, sf_dir, "lineitem")
    side = lambda r: items.filter((F.col("l_partkey") + F.col("l_linenumber")) % 5 != r).select("l_orderkey", "l_partkey")
    return merge.set_merge(side(0), side(1), side(2), ["l_orderkey", "l_partkey"])


IMPORT_SQL = """
WITH i AS (SELECT l_orderkey, l_partkey, (l_partkey + l_linenumber) % 5 AS m FROM lineitem),
f AS (SELECT l_orderkey, l_partkey, bool_or(m <> 0) AS b, bool_or(m <> 1) AS o, bool_or(m <> 2) AS t FROM i GROUP BY ALL)
SELECT l_orderkey, l_partkey FROM f WHERE CASE WHEN b THEN o AND t ELSE o OR t END
"""


def owner_match_2way(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path")
    return merge.match_two_way(part.filter("p_partkey % 3 != 0").select(path), part.filter("p_partkey % 5 != 0").select(path), ["path"])


OWNER_SQL = """
SELECT '/' || p_brand || '/' || p_partkey AS path,
       CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'matched' WHEN p_partkey % 3 <> 0 THEN 'template_only' ELSE 'destination_only' END AS status
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0
"""


def merge2_destination_wins(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    template = part.filter("p_partkey % 3 != 0").select("p_partkey", F.col("p_name").alias("value"))
    destination = part.filter("p_partkey % 5 != 0").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("value"))
    return merge.merge_two_way(template, destination, ["p_partkey"], "value")


MERGE2_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 7 <> 0 THEN p_type END ELSE p_name END AS value,
       CASE WHEN p_partkey % 5 <> 0 THEN 'destination' ELSE 'template' END AS source
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0
"""


def append_missing(spark, sf_dir):
    """Suppliers are a document's sections, customers of the same nation and number the template's."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("path"), F.col("s_name").alias("text"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("path"), F.col("c_name").alias("text"))
    return merge.append_missing(c, s, ["nation", "path"], "path")


APPEND_SQL = """
SELECT s_nationkey AS nation, s_suppkey AS path, s_name AS text, 0 AS part FROM supplier
UNION ALL SELECT c_nationkey, c_custkey, c_name, 1 FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey)
"""


def commutative_union(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", "l_returnflag", "l_linestatus", "l_suppkey").alias("signature"), "l_linenumber")
    return merge.ordered_union([items.filter(f"l_linenumber % 3 = {r}") for r in (1, 2, 0)], ["l_orderkey"], "signature", "l_linenumber")


UNION_SQL = """
WITH i AS (SELECT l_orderkey, l_returnflag || '-' || l_linestatus || '-' || l_suppkey AS signature, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 2 ELSE l_linenumber % 3 - 1 END AS side_rank FROM lineitem)
SELECT l_orderkey, signature, side_rank::INT AS side_rank, l_linenumber FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey, signature ORDER BY side_rank, l_linenumber) = 1
"""


def keyed_member_edits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.col("o_orderpriority")
    base = o.select("o_orderkey", v.alias("value"))
    left = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.concat(v, F.lit("#l")).alias("value"))
    right = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(v, F.lit("#l"))).otherwise(F.concat(v, F.lit("#r"))).alias("value"))
    return merge.keyed_member_edits(base, left, right, ["o_orderkey"], "value")


KEYED_SQL = """
SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN '#l' ELSE '#r' END WHEN o_orderkey % 3 = 0 THEN '#l' ELSE '' END AS value,
       o_orderkey % 12 = 0 AND o_orderkey % 5 <> 0 AS conflict FROM orders
"""


def zip_plan(spark, sf_dir):
    """Orders as archive members: status F is signed content, priorities 1 and 2 have a family."""
    orders = table(spark, sf_dir, "orders")
    extra = orders.select("o_orderkey", ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 == 0)).alias("unsafe"), F.when(F.col("o_orderpriority") < "3", "json").alias("family"))
    return merge.archive_plan(_rows(spark, sf_dir).join(extra, "o_orderkey")).select("o_orderkey", "decision")


ZIP_SQL = ROWS_SQL + """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'reject' WHEN NOT ho AND ht THEN 'add' WHEN ho AND NOT ht THEN 'delete'
  WHEN ov IS NOT DISTINCT FROM tv THEN 'preserve' WHEN o_orderpriority < '3' THEN 'delegate'
  WHEN NOT (hb = ho AND bv IS NOT DISTINCT FROM ov) AND NOT (hb = ht AND bv IS NOT DISTINCT FROM tv) THEN 'conflict' ELSE 'rewrite' END AS decision
FROM r JOIN orders USING (o_orderkey) WHERE ho OR ht
"""


def aligned_line_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    lines = F.split("text", "\n")
    edit = lambda mark, at: F.array_join(F.transform(lines, lambda x, i: F.when((i + F.col("doc_id")) % 4 == at, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
    ours = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nmore"))).otherwise(edit("#o", 1))
    theirs = F.when(F.col("doc_id") % 5 == 0, edit("#t", 1)).otherwise(edit("#t", 2))
    merged = docs.select("doc_id", merge.aligned_line_merge(F.col("text"), ours, theirs).alias("merged"))
    return merged.select("doc_id", F.col("merged").isNotNull().alias("ok"), F.md5(F.col("merged").cast("binary")).alias("digest"))


ALIGNED_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, b, list_transform(b, lambda x, i: CASE WHEN (i - 1 + doc_id) % 4 = 1 THEN x || '#o' WHEN doc_id % 5 <> 0 AND (i - 1 + doc_id) % 4 = 2 THEN x || '#t' ELSE x END) AS m,
   doc_id % 3 <> 0 AND NOT (doc_id % 5 = 0 AND len(list_filter(b, lambda x, i: (i - 1 + doc_id) % 4 = 1)) > 0) AS ok FROM l)
SELECT doc_id, ok, CASE WHEN ok THEN md5(array_to_string(m, chr(10))) END AS digest FROM e
"""



def nested_key_merge(spark, sf_dir):
    """Order lines as nested keys of their orders: the even parts as template, the odd suppliers as destination, at depths that clash."""
    n = F.col("l_linenumber")
    key = lambda c, by: F.concat(F.lit(by), c.cast("string"))
    l = table(spark, sf_dir, "lineitem")
    template = l.groupBy("l_orderkey", F.when(n % 3 == 0, F.array(key(n, "k"))).when(n % 3 == 1, F.array(key(n, "k"), F.lit("a"))).otherwise(F.array(F.lit("t"), key(n, "k"), F.lit("b"))).alias("path")).agg(F.max("l_returnflag").alias("value"))
    m = F.col("l_linenumber") + 1
    destination = l.filter("l_suppkey % 2 = 1").groupBy("l_orderkey", F.when(m % 3 == 0, F.array(key(m, "k"), F.lit("c"))).when(m % 3 == 1, F.array(key(m, "k"))).when(m == 2, F.array(F.lit("t"), F.lit("k2"), F.lit("b"))).otherwise(F.array(F.lit("t"), F.lit("k5"))).alias("path")).agg(F.max("l_linestatus").alias("value"))
    done = merge.merge_nested_keys(template, destination, "l_orderkey", "path", "value")
    return done.select("l_orderkey", F.array_join("path", "/").alias("path"), "value", "source")


NESTED_SQL = """
WITH t AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'k' || l_linenumber WHEN 1 THEN 'k' || l_linenumber || '/a' ELSE 't/k' || l_linenumber || '/b' END AS path, max(l_returnflag) AS value FROM lineitem GROUP BY ALL),
d AS (SELECT l_orderkey, CASE WHEN (l_linenumber + 1) % 3 = 0 THEN 'k' || (l_linenumber + 1) || '/c' WHEN (l_linenumber + 1) % 3 = 1 THEN 'k' || (l_linenumber + 1) WHEN l_linenumber = 1 THEN 't/k2/b' ELSE 't/k5' END AS path, max(l_linestatus) AS value FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY ALL)
SELECT *, 'destination' AS source FROM d UNION ALL SELECT *, 'template' FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.l_orderkey = t.l_orderkey AND (d.path = t.path OR starts_with(d.path, t.path || '/') OR starts_with(t.path, d.path || '/')))
"""

QUERIES = {f.__name__: f for f in (merge3_orders_decisions, merge3_orders_conflicts, merge3_orders_result, merge3_columns, classify_changes, comment_delta, import_set_merge, owner_match_2way, merge2_destination_wins, append_missing, commutative_union, keyed_member_edits, zip_plan, aligned_line_merge, nested_key_merge)}
ORACLE_SQL = {
    "nested_key_merge": NESTED_SQL,
    "merge3_orders_decisions": ROWS_SQL + "SELECT decision, count(*) AS n FROM d GROUP BY decision",
    "merge3_orders_conflicts": ROWS_SQL + "SELECT o_orderkey, decision AS category FROM d WHERE decision IN ('add_add', 'delete_edit', 'edit_edit')",
    "merge3_orders_result": ROWS_SQL + "SELECT o_orderkey, CASE WHEN decision = 'theirs' OR (decision = 'delete_edit' AND NOT ho) THEN tv ELSE ov END AS value FROM d WHERE decision <> 'drop'",
    "merge3_columns": MERGE3_COLUMNS_SQL,
    "classify_changes": CLASSIFY_SQL,
    "comment_delta": COMMENT_SQL,
    "import_set_merge": IMPORT_SQL,
    "owner_match_2way": OWNER_SQL,
    "merge2_destination_wins": MERGE2_SQL,
    "append_missing": APPEND_SQL,
    "commutative_union": UNION_SQL,
    "keyed_member_edits": KEYED_SQL,
    "zip_plan": ZIP_SQL,
    "aligned_line_merge": ALIGNED_SQL,
}
