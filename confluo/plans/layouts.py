"""Queries over comment regions, layout gaps, attachments, ranges, fragments, archive members and line markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..operators import layout
from ..sources.tables import table


def comment_regions(spark, sf_dir):
    """A conversation is a region, its turns are the nodes; some carry freeze markers of the token ``keep``."""
    t = F.col("turn")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(t % 5 == 1, " Keep:Freeze").when(t % 5 == 3, " keep:unfreeze").otherwise(""))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct(t.cast("bigint").alias("line"), text.alias("text"), F.trim(F.lower("role")).alias("normalized")).alias("n"))
    regions = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    f = regions.select("conv_id", L.region_facts(F.col("nodes"), F.when(F.col("conv_id") % 2 == 0, "leading").otherwise("trailing"), "KEEP").alias("f"))
    return f.select("conv_id", "f.start_line", "f.end_line", F.md5(F.col("f.text").cast("binary")).alias("text"), "f.content", F.col("f.signature.kind").alias("kind"), F.hex("f.signature.content").alias("signature"), F.array_join("f.freeze_actions", ",").alias("actions"))


REGIONS_SQL = """
WITH n AS (SELECT conv_id, turn::BIGINT AS line, coalesce(text, '') || CASE turn % 5 WHEN 1 THEN ' Keep:Freeze' WHEN 3 THEN ' keep:unfreeze' ELSE '' END AS text, lower(role) AS c FROM conversations)
SELECT conv_id, min(line) AS start_line, max(line) AS end_line, md5(string_agg(text, chr(10) ORDER BY line)) AS text, string_agg(c, chr(10) ORDER BY line) AS content,
       CASE conv_id % 2 WHEN 0 THEN 'leading' ELSE 'trailing' END AS kind, upper(hex(substr(string_agg(c, chr(10) ORDER BY line), 1, 121))) AS signature,
       coalesce(string_agg(CASE WHEN contains(lower(text), 'keep:freeze') THEN 'freeze' WHEN contains(lower(text), 'keep:unfreeze') THEN 'unfreeze' END, ',' ORDER BY line), '') AS actions
FROM n GROUP BY conv_id
"""


def _gaps(spark, sf_dir):
    """Order lines as gaps between a supplier and a part."""
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return l.select(
        "l_orderkey", "l_linenumber", F.when(n % 4 != 0, F.col("l_suppkey")).alias("before_owner"), F.when(n % 5 != 0, F.col("l_partkey")).alias("after_owner"),
        F.when(n % 3 == 0, "before").when(n % 3 == 1, "after").otherwise("none").alias("controller_side"), n.cast("bigint").alias("start_line"), (n + F.col("l_quantity").cast("int") % 7).cast("bigint").alias("end_line"),
        F.array(F.lit(""), F.lit(" \t"), F.col("l_returnflag")).alias("lines"),
    )


def layout_gaps(spark, sf_dir):
    removed = table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("owner"))
    g = layout.gap_control(_gaps(spark, sf_dir), removed)
    yes = lambda c, o: F.coalesce(F.col(c) == F.col(o), F.lit(False))
    return g.select(
        "l_orderkey", "l_linenumber", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), L.blank_lines(F.col("lines")).cast("long").alias("n_blank"), "controller", "fallback", "effective_controller",
        F.coalesce(F.col("after_owner") == F.col("l_orderkey"), F.lit(False)).alias("leads"), F.coalesce(F.col("before_owner") == F.col("l_orderkey"), F.lit(False)).alias("trails"), yes("controller", "l_orderkey").alias("controls"),
    )


GAPS_SQL = """
WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN l_suppkey END AS b, CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey END AS a, l_linenumber % 3 AS s,
                  trunc(l_quantity)::BIGINT % 7 + 1 AS n_lines FROM lineitem),
c AS (SELECT *, CASE s WHEN 0 THEN b WHEN 1 THEN a END AS controller, CASE s WHEN 0 THEN a WHEN 1 THEN b END AS fallback FROM g),
r AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 3000)
SELECT l_orderkey, l_linenumber, n_lines, 2::BIGINT AS n_blank, controller, fallback,
       CASE WHEN controller NOT IN (SELECT k FROM r) THEN controller WHEN fallback NOT IN (SELECT k FROM r) THEN fallback END AS effective_controller,
       coalesce(a = l_orderkey, false) AS leads, coalesce(b = l_orderkey, false) AS trails, coalesce(controller = l_orderkey, false) AS controls
FROM c
"""


def comment_attachments(spark, sf_dir):
    """Orders as owners; regions and gaps are orders of certain states, named by key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    attachments = o.select(
        k.alias("owner"), k.alias("leading_region"), F.when(k % 2 == 0, k + 1).alias("inline_region"), F.when(k % 3 == 0, k).alias("trailing_region"), F.array(k, k + 7, k).alias("orphans"), k.alias("leading_gap"), F.when(k % 5 != 0, k).alias("trailing_gap"),
    )
    regions = o.filter("o_orderstatus != 'P'").select(k.alias("region"), (F.col("o_orderstatus") == "F").alias("floating"), F.startswith("o_orderpriority", F.lit("1")).alias("frozen"))
    gaps = o.filter("o_orderpriority != '5-LOW'").select(k.alias("gap"), F.when(k % 3 == 0, k).otherwise(k + 1).alias("before_owner"), F.when(k % 2 == 0, k).alias("after_owner"), F.when(k % 6 < 3, "after").otherwise("before").alias("controller_side"))
    return layout.attachment_facts(attachments, regions, gaps)


ATTACHMENTS_SQL = """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS floating, starts_with(o_orderpriority, '1') AS frozen FROM orders WHERE o_orderstatus <> 'P'),
g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS b, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS a, o_orderkey % 6 < 3 AS after FROM orders WHERE o_orderpriority <> '5-LOW'),
u AS (SELECT o_orderkey AS owner, unnest([o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END, o_orderkey, o_orderkey + 7, o_orderkey]) AS k FROM orders),
c AS (SELECT owner, count(*) AS n, bool_or(frozen) AS frozen FROM u JOIN r USING (k) GROUP BY owner)
SELECT o_orderkey AS owner, coalesce(c.n, 0) AS n_regions, CASE WHEN g.k IS NULL THEN 0 ELSE 1 END::BIGINT AS n_gaps, c.n IS NULL AS empty,
       coalesce(r.floating AND g.a = o_orderkey AND CASE WHEN g.after THEN g.a ELSE g.b END = o_orderkey, false) AS leading_owned,
       coalesce(o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND r.floating AND g.b = o_orderkey AND CASE WHEN g.after THEN g.a ELSE g.b END = o_orderkey, false) AS trailing_owned,
       coalesce(c.frozen, false) AS frozen
FROM orders LEFT JOIN c ON owner = o_orderkey LEFT JOIN r ON r.k = o_orderkey LEFT JOIN g ON g.k = o_orderkey
"""


def byte_ranges(spark, sf_dir):
    """Ranges from quantities, some of them invalid, against a range and a byte."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q - 5).alias("s"), (q - 8 + 3 * n).alias("e"), (q + n).alias("at"))
    s, e = F.col("s"), F.col("e")
    return r.select("l_orderkey", "l_linenumber", L.range_valid(s, e).alias("valid"), L.range_length(s, e).cast("long").alias("length"), L.range_has_byte(s, e, F.col("at")).alias("has_byte"), L.range_has_range(s, e, F.lit(10), F.lit(12)).alias("has_range"))


RANGES_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, trunc(l_quantity)::BIGINT - 5 AS s, trunc(l_quantity)::BIGINT - 8 + 3 * l_linenumber AS e, trunc(l_quantity)::BIGINT + l_linenumber AS spot FROM lineitem),
v AS (SELECT *, s >= 0 AND s <= e AS valid FROM r)
SELECT l_orderkey, l_linenumber, valid, CASE WHEN valid THEN e - s ELSE 0 END AS length, valid AND s <= spot AND spot < e AS has_byte, valid AND s <= 10 AND 12 <= e AS has_range FROM v
"""


def edit_spans(spark, sf_dir):
    """Each line's quantity range as an edit: old and new range, and by how many bytes the text grows."""
    start, old, new = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.col("l_suppkey") % 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start_byte"), (start + old).alias("old_end"), (start + new).alias("new_end"), (new - old).alias("delta"))


def source_fragments(spark, sf_dir):
    """Byte slices of documents; a range beyond the text has no fragment."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(k, "text", (k % 97).alias("s"), (k % 97 + k % 41 * 50).alias("e"))
    cut = d.select("doc_id", L.byte_slice(F.col("text"), F.col("s"), F.col("e")).alias("f"))
    return cut.select("doc_id", F.col("f").isNotNull().alias("available"), F.coalesce(F.octet_length("f"), F.lit(0)).cast("long").alias("n_bytes"), F.lower(F.hex("f")).alias("fragment"))


FRAGMENTS_SQL = """
WITH d AS (SELECT doc_id, encode(text) AS t, doc_id % 97 AS s, doc_id % 97 + doc_id % 41 * 50 AS e FROM documents WHERE text IS NOT NULL)
SELECT doc_id, e <= octet_length(t) AS available, CASE WHEN e <= octet_length(t) THEN e - s ELSE 0 END::BIGINT AS n_bytes,
       CASE WHEN e <= octet_length(t) THEN substr(lower(hex(t)), (2 * s + 1)::BIGINT, (2 * (e - s))::BIGINT) END AS fragment FROM d
"""


def point_offsets(spark, sf_dir):
    """Byte offset of one point of each document; points outside are null."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", (k % 6).alias("row"), (k % 83).alias("col"), L.point_offset(F.col("text"), k % 6, k % 83).cast("long").alias("offset"))


POINTS_SQL = """
WITH d AS (SELECT doc_id, doc_id % 6 AS row, doc_id % 83 AS col, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, row, col, CASE WHEN row < len(l) AND col <= strlen(l[row + 1]) THEN CASE WHEN row = 0 THEN 0 ELSE strlen(array_to_string(l[1:row], chr(10))) + 1 END + col END::BIGINT AS "offset" FROM d
"""


def _members(spark, sf_dir):
    """Pages as archive members, their paths written in several ways."""
    k, name = F.col("page_id"), F.concat(F.lit("m"), (F.col("page_id") % 50).cast("string"))
    path = (
        F.when(k % 9 == 0, F.concat(F.lit("../"), name, F.lit(".md")))
        .when(k % 9 == 1, F.concat(F.lit("a/./b//"), name, F.lit(".JSON")))
        .when(k % 9 == 2, F.concat(F.lit("a\\b\\"), name, F.lit(".json")))
        .when(k % 9 == 3, F.concat(F.lit("meta-inf/"), name, F.lit(".rsa")))
        .when(k % 9 == 4, F.concat(F.lit("/abs/"), name, F.lit(".yml")))
        .when(k % 9 == 5, F.concat(F.lit("x/../"), name, F.lit("/")))
        .when(k % 9 == 6, F.concat(F.lit("x/../../"), name, F.lit(".xml")))
        .when(k % 9 == 7, F.concat(F.lit("a/b/"), name, F.lit(".json")))
        .otherwise("./.")
    )
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def archive_members(spark, sf_dir):
    """Normalised path, family, schema path, and what makes a member unsafe."""
    m = _members(spark, sf_dir).withColumn("clean", L.clean_path(F.col("path")))
    unsafe = F.array_compact(F.array(F.when(L.escapes_root(F.col("path")), "path_traversal"), F.when(L.signing_sensitive(F.col("clean")), "signing_sensitive_member")))
    return m.select("page_id", "clean", L.nested_family(F.col("clean")).alias("family"), F.concat(F.lit("/entries/by_path/"), "clean").alias("schema_path"), F.array_join(unsafe, ",").alias("unsafe"))


def archive_collisions(spark, sf_dir):
    """Members whose normalised path the member before them has under another name."""
    from pyspark.sql import Window

    m = _members(spark, sf_dir).withColumn("clean", L.clean_path(F.col("path")))
    before = F.lag("path").over(Window.partitionBy("clean").orderBy("page_id"))
    return m.withColumn("previous", before).filter("previous != path").select("page_id", "clean", "previous")


MEMBERS_SQL = r"""
WITH n AS (SELECT page_id, page_id % 9 AS k, 'm' || page_id % 50 AS m FROM pages),
p AS (SELECT page_id, k, CASE k WHEN 0 THEN '../' || m || '.md' WHEN 1 THEN 'a/./b//' || m || '.JSON' WHEN 2 THEN 'a\b\' || m || '.json' WHEN 3 THEN 'meta-inf/' || m || '.rsa'
        WHEN 4 THEN '/abs/' || m || '.yml' WHEN 5 THEN 'x/../' || m || '/' WHEN 6 THEN 'x/../../' || m || '.xml' WHEN 7 THEN 'a/b/' || m || '.json' ELSE './.' END AS path,
      CASE k WHEN 0 THEN '../' || m || '.md' WHEN 1 THEN 'a/b/' || m || '.JSON' WHEN 2 THEN 'a/b/' || m || '.json' WHEN 3 THEN 'meta-inf/' || m || '.rsa'
        WHEN 4 THEN '/abs/' || m || '.yml' WHEN 5 THEN m || '/' WHEN 6 THEN '../' || m || '.xml' WHEN 7 THEN 'a/b/' || m || '.json' ELSE '' END AS clean FROM n)
"""


def fence_families(spark, sf_dir):
    """Family and dialect of the info strings of code fences."""
    names = ["ts", "TypeScript", "RS", "go", "JSONC", "json", "yml", "TOML", "ruby", ""]
    info = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 10 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", info.alias("info")).withColumn("family", L.fence_family(F.col("info")))
    return d.withColumn("dialect", L.fence_dialect(F.col("info"), F.col("family")))


def _marked_lines(spark, sf_dir):
    """Lines of documents, every seventh or so a freeze marker as an HTML comment."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    k = (F.col("doc_id") * 3 + F.col("i") * (F.col("doc_id") % 5 + 1)) % 11
    text = F.when(k == 2, "  <!-- Keep: FREEZE by hand -->").when(k == 6, "<!--keep:unfreeze-->").when(k == 8, "<!-- kept: freeze -->").otherwise(F.col("raw"))
    return d.select("doc_id", (F.col("i") + 1).alias("line"), text.alias("text"))


def freeze_directive_blocks(spark, sf_dir):
    blocks, _ = layout.freeze_directives(_marked_lines(spark, sf_dir), "doc_id", "keep", "html_comment")
    return blocks


def freeze_directive_findings(spark, sf_dir):
    _, findings = layout.freeze_directives(_marked_lines(spark, sf_dir), "doc_id", "keep", "html_comment")
    return findings


FREEZE_LINES_SQL = """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, line, CASE (doc_id * 3 + (line - 1) * (doc_id % 5 + 1)) % 11 WHEN 2 THEN 'freeze' WHEN 6 THEN 'unfreeze' END AS action FROM s),
m AS (SELECT *, lag(action) OVER w AS before, lead(action) OVER w AS after, lead(line) OVER w AS end_line FROM k WHERE action IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
l AS (SELECT doc_id FROM m GROUP BY 1 HAVING arg_max(action, line) = 'freeze'),
f AS (SELECT doc_id, line, 'nested_freeze_open' AS category FROM m WHERE action = 'freeze' AND before = 'freeze'
      UNION ALL SELECT doc_id, line, 'unmatched_freeze_close' FROM m WHERE action = 'unfreeze' AND (before IS NULL OR before = 'unfreeze')
      UNION ALL SELECT doc_id, max(line), 'unclosed_freeze_open' FROM m WHERE action = 'freeze' AND (before IS NULL OR before = 'unfreeze') AND doc_id IN (SELECT doc_id FROM l) GROUP BY 1)
"""


def conflict_regions(spark, sf_dir):
    """Documents with conflict markers among their lines, some without a start, a separator or an end."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    k = (F.col("doc_id") + F.col("i") * 2) % 9
    text = F.when(k == 1, "<<<<<<< ours").when(k == 5, "=======").when(k == 8, ">>>>>>> theirs").when(k == 3, "<<<<<< six").otherwise(F.col("raw"))
    return layout.conflict_regions(d.select("doc_id", (F.col("i") + 1).alias("line"), text.alias("text")), "doc_id")


CONFLICT_REGIONS_SQL = """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, line, (doc_id + (line - 1) * 2) % 9 AS k FROM s),
m AS (SELECT *, count(*) FILTER (WHERE k = 1) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM k WHERE k IN (1, 5, 8)),
g AS (SELECT doc_id, min(line) FILTER (WHERE k = 1) AS start_line, min(line) FILTER (WHERE k = 8) AS end_line, min(line) FILTER (WHERE k = 5) AS sep FROM m WHERE part > 0 GROUP BY doc_id, part)
SELECT doc_id, start_line, CASE WHEN sep < end_line THEN sep ELSE 0 END AS separator_line, end_line FROM g WHERE end_line IS NOT NULL
"""

QUERIES = {f.__name__: f for f in (comment_regions, layout_gaps, comment_attachments, byte_ranges, edit_spans, source_fragments, point_offsets, archive_members, archive_collisions, fence_families, freeze_directive_blocks, freeze_directive_findings, conflict_regions)}
ORACLE_SQL = {
    "comment_regions": REGIONS_SQL,
    "layout_gaps": GAPS_SQL,
    "comment_attachments": ATTACHMENTS_SQL,
    "byte_ranges": RANGES_SQL,
    "edit_spans": "SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS start_byte, (l_linenumber + trunc(l_quantity))::BIGINT AS old_end, (l_linenumber + l_suppkey % 50)::BIGINT AS new_end, (l_suppkey % 50 - trunc(l_quantity))::BIGINT AS delta FROM lineitem",
    "source_fragments": FRAGMENTS_SQL,
    "point_offsets": POINTS_SQL,
    "archive_members": MEMBERS_SQL + "SELECT page_id, clean, CASE WHEN k IN (1, 2, 7) THEN 'json' WHEN k = 0 THEN 'markdown' WHEN k = 4 THEN 'yaml' WHEN k = 6 THEN 'xml' ELSE '' END AS family, '/entries/by_path/' || clean AS schema_path, CASE WHEN k IN (0, 4, 6) THEN 'path_traversal' WHEN k = 3 THEN 'signing_sensitive_member' ELSE '' END AS unsafe FROM p",
    "archive_collisions": MEMBERS_SQL + "SELECT page_id, clean, previous FROM (SELECT *, lag(path) OVER (PARTITION BY clean ORDER BY page_id) AS previous FROM p) WHERE previous <> path",
    "fence_families": "WITH d AS (SELECT doc_id, ['ts', 'TypeScript', 'RS', 'go', 'JSONC', 'json', 'yml', 'TOML', 'ruby', ''][doc_id % 10 + 1] AS info, ['typescript', 'typescript', 'rust', 'go', 'json', 'json', 'yaml', 'toml', '', ''][doc_id % 10 + 1] AS family FROM documents) SELECT *, CASE WHEN info = 'JSONC' THEN 'jsonc' ELSE family END AS dialect FROM d",
    "freeze_directive_blocks": FREEZE_LINES_SQL + "SELECT doc_id, line::INT AS start_line, end_line::INT AS end_line, 'by hand' AS reason FROM m WHERE action = 'freeze' AND after = 'unfreeze' AND doc_id NOT IN (SELECT doc_id FROM f)",
    "freeze_directive_findings": FREEZE_LINES_SQL + "SELECT doc_id, line::INT AS line, category FROM f",
    "conflict_regions": CONFLICT_REGIONS_SQL,
}
