"""Queries over text functions and block matching.  Texts in ASCII where the SQL engine's functions need it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks
from ..sources.tables import table



def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


BLOCKS_SQL = r"""
WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+', ''), '\s+$', ''), chr(10) || chr(10)),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS bs FROM d)
"""


def text_normalize(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.normalized(F.col("text")).alias("n"))
    return d.select("doc_id", F.octet_length("n").cast("long").alias("n_bytes"), F.md5(F.col("n").cast("binary")).alias("digest"))


def text_blocks(spark, sf_dir):
    return blocks.block_rows(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5(F.col("normalized").cast("binary")).alias("digest"), F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte"))


TEXT_BLOCKS_SQL = BLOCKS_SQL + """
, e AS (SELECT doc_id, unnest(bs) AS x, generate_subscripts(bs, 1) - 1 AS idx FROM b),
s AS (SELECT *, coalesce(sum(strlen(x) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM e)
SELECT doc_id, idx::BIGINT AS idx, md5(x) AS digest, start_byte, start_byte + strlen(x) AS end_byte FROM s
"""


def token_set(spark, sf_dir):
    tokens = _docs(spark, sf_dir).select("doc_id", T.token_set(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


TOKEN_SET_SQL = r"""
WITH t AS (SELECT doc_id, list_sort(list_filter(list_distinct(regexp_split_to_array(text, '\s+')), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t
"""


def _neighbours(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other")).join(d, "doc_id")


def block_jaccard(spark, sf_dir):
    d = _docs(spark, sf_dir)
    scores = blocks.block_scores(d.select((F.col("doc_id") + 1).alias("doc_id"), "text"), d, "doc_id", "text")
    return scores.select("doc_id", F.round("score", 9).alias("score"))


BLOCK_JACCARD_SQL = BLOCKS_SQL + r"""
, p AS (SELECT r.doc_id, l.bs AS l, r.bs AS r FROM b l JOIN b r ON l.doc_id + 1 = r.doc_id),
e AS (SELECT doc_id, greatest(len(l), len(r)) AS n, unnest(range(1, greatest(len(l), len(r)) + 1)) AS i, l, r FROM p),
j AS (SELECT doc_id, n, i, list_distinct(string_split(l[i], ' ')) AS x, list_distinct(string_split(r[i], ' ')) AS y FROM e)
SELECT doc_id, round(sum(CASE WHEN x IS NULL OR y IS NULL THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END) / max(n), 9) AS score FROM j GROUP BY doc_id
"""


def levenshtein_sim(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(T.string_similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


def length_similarity(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", F.round(T.length_similarity(F.col("other"), F.col("text")), 9).alias("similarity"))


def position_similarity(spark, sf_dir):
    """Of each line and the line of its number in the order before."""
    items = table(spark, sf_dir, "lineitem")
    totals = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    both = items.join(totals, "l_orderkey").select("l_orderkey", "l_linenumber", "n", (F.col("l_linenumber") - 1).alias("i"), ((F.col("l_linenumber") * 3 - 1) % F.col("n")).alias("j"))
    return both.select("l_orderkey", "l_linenumber", F.round(T.position_similarity(F.col("i"), F.col("j"), F.col("n"), F.col("n")), 9).alias("similarity"))


def exact_block_match(spark, sf_dir):
    d = _docs(spark, sf_dir)
    template = blocks.block_rows(d.select((F.col("doc_id") + 1).alias("doc_id"), "text"), "doc_id", "text")
    pairs = blocks.exact_pairs(template, blocks.block_rows(d, "doc_id", "text"), "doc_id")
    return pairs.select("doc_id", F.col("template_idx").cast("long").alias("template_idx"), F.col("destination_idx").cast("long").alias("destination_idx"))


EXACT_SQL = BLOCKS_SQL + """
, e AS (SELECT doc_id, unnest(bs) AS x, generate_subscripts(bs, 1) - 1 AS idx FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY idx) AS k FROM e)
SELECT d.doc_id, t.idx::BIGINT AS template_idx, d.idx::BIGINT AS destination_idx FROM k t JOIN k d ON t.doc_id + 1 = d.doc_id AND t.x = d.x AND t.k = d.k
"""


def _matched(spark, sf_dir):
    """Each document against itself with every third block's first word changed."""
    d = _docs(spark, sf_dir).withColumn("bs", F.split("text", "\n\n"))
    changed = F.array_join(F.transform("bs", lambda b, i: F.when(i % 3 == 1, F.concat(F.lit("Changed "), b)).otherwise(b)), "\n\n")
    return blocks.match_texts(d.select("doc_id", T.blocks(F.col("text")).alias("template"), T.blocks(changed).alias("destination")), "doc_id")


def refined_block_match(spark, sf_dir):
    return blocks.matches_of(_matched(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 9))


def merge_text(spark, sf_dir):
    merged = blocks.merged_texts(_matched(spark, sf_dir), "doc_id")
    return merged.select("doc_id", F.octet_length("merged").alias("n_bytes"), F.md5(F.col("merged").cast("binary")).alias("digest"))


#: Every pair of left-over blocks scored, then each destination block in turn takes the best that is free.
MATCH_SQL = r"""
WITH RECURSIVE src AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS bs FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS i FROM src),
both_ AS (SELECT doc_id, i, 0 AS side, b FROM raw UNION ALL SELECT doc_id, i, 1, CASE WHEN i % 3 = 1 THEN 'Changed ' || b ELSE b END FROM raw),
clean AS (SELECT doc_id, side, i, trim(regexp_replace(b, '\s+', ' ', 'g')) AS x FROM both_),
idx AS (SELECT doc_id, side, x, row_number() OVER (PARTITION BY doc_id, side ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY doc_id, side) AS total FROM clean WHERE x <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side, x ORDER BY idx) AS k FROM idx),
ex AS (SELECT t.doc_id, t.idx AS t, d.idx AS d FROM k t JOIN k d ON t.side = 0 AND d.side = 1 AND t.doc_id = d.doc_id AND t.x = d.x AND t.k = d.k),
l AS (SELECT * FROM idx WHERE side = 0 AND (doc_id, idx) NOT IN (SELECT (doc_id, t) FROM ex)), r AS (SELECT * FROM idx WHERE side = 1 AND (doc_id, idx) NOT IN (SELECT (doc_id, d) FROM ex)),
p0 AS (SELECT l.doc_id, l.idx AS t, r.idx AS d, l.x AS a, r.x AS b, 0.15::DOUBLE * (least(strlen(l.x), strlen(r.x))::DOUBLE / greatest(strlen(l.x), strlen(r.x)))
  + 0.15::DOUBLE * (1 - abs(CASE WHEN l.total <= 1 THEN 0.5 ELSE l.idx::DOUBLE / (l.total - 1) END - CASE WHEN r.total <= 1 THEN 0.5 ELSE r.idx::DOUBLE / (r.total - 1) END)) AS fixed FROM l JOIN r ON l.doc_id = r.doc_id),
p1 AS (SELECT *, greatest(length(a), length(b)) AS longer FROM p0 WHERE 0.7::DOUBLE * (least(length(a), length(b))::DOUBLE / greatest(length(a), length(b))) + fixed >= 0.7 - 1e-9),
c AS MATERIALIZED (SELECT doc_id, t, d, score FROM (SELECT doc_id, t, d, 0.7::DOUBLE * (1 - levenshtein(a, b)::DOUBLE / longer) + fixed AS score FROM p1) WHERE score >= 0.7::DOUBLE),
o AS MATERIALIZED (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS step, list({'t': t, 's': score} ORDER BY score DESC, t) AS wanted FROM c GROUP BY doc_id, d),
g(doc_id, step, d, hit, taken) AS (SELECT DISTINCT doc_id, 0::BIGINT, NULL::BIGINT, NULL::STRUCT(t BIGINT, s DOUBLE), []::BIGINT[] FROM o UNION ALL
  SELECT n.doc_id, n.step, n.d, n.hit, CASE WHEN n.hit IS NULL THEN n.taken ELSE list_append(n.taken, n.hit.t) END FROM (SELECT o.doc_id, o.step, o.d, list_filter(o.wanted, lambda w: NOT list_contains(g.taken, w.t))[1] AS hit, g.taken FROM g JOIN o ON o.doc_id = g.doc_id AND o.step = g.step + 1) n),
m AS (SELECT doc_id, t AS template_idx, d AS destination_idx, 'exact' AS phase, 1.0::DOUBLE AS score FROM ex UNION ALL SELECT doc_id, hit.t, d, 'refined', round(hit.s, 9) FROM g WHERE hit IS NOT NULL)
"""


def slugify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return pages.select("page_id", T.slug(title).alias("slug")).unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug")))


SLUG_SQL = r"""
WITH v AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS v FROM pages UNION ALL SELECT p_partkey, p_name || ' / ' || p_brand FROM part)
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section') AS slug FROM v
"""


def json_pointer_escape(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat_ws("/", "p_name", F.concat(F.lit("~"), "p_type"))
    return part.select("p_partkey", T.pointer_join(F.lit("/parts"), name).alias("pointer"))


def conflict_documents(spark, sf_dir):
    """Conflict-marker documents of all orders, whose two sides differ."""
    o = table(spark, sf_dir, "orders")
    text = T.conflict_document(F.concat("o_orderpriority", F.lit("#o")), F.col("o_orderpriority"), F.concat("o_orderpriority", F.lit("#t")), 9)
    return o.select("o_orderkey", text.alias("document"))


def source_retention(spark, sf_dir):
    """Share of a document's non-blank lines whose trimmed text occurs in the document before it or in its own benchmark of first lines."""
    d = _docs(spark, sf_dir)
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).filter("line != ''")
    known = lines.select((F.col("doc_id") + 1).alias("doc_id"), "line").distinct().withColumn("kept", F.lit(1))
    flagged = lines.join(known, ["doc_id", "line"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("kept").alias("n_kept"), F.sum(F.octet_length("line")).alias("n_bytes"), F.sum(F.when(F.col("kept") == 1, F.octet_length("line")).otherwise(0)).alias("kept_bytes"))
    return flagged.select("doc_id", F.round(F.col("n_kept") / F.col("n_lines"), 9).alias("line_ratio"), F.round(F.col("kept_bytes") / F.col("n_bytes"), 9).alias("byte_ratio"))


RETENTION_SQL = """
WITH d AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT * FROM d WHERE line <> ''), k AS (SELECT DISTINCT doc_id + 1 AS doc_id, line FROM l),
f AS (SELECT l.doc_id, l.line, k.line IS NOT NULL AS kept FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.line = k.line),
r AS (SELECT doc_id, round(count(*) FILTER (WHERE kept)::DOUBLE / count(*), 9) AS line_ratio, round(sum(CASE WHEN kept THEN strlen(line) ELSE 0 END)::DOUBLE / sum(strlen(line)), 9) AS byte_ratio FROM f GROUP BY doc_id)
"""


def default_driver_eval(spark, sf_dir):
    """Score from the two ratios; a driver is eligible as default from 0.95 up."""
    r = source_retention(spark, sf_dir)
    score = F.round((F.col("line_ratio") + F.col("byte_ratio")) / 2, 6)
    return r.select("doc_id", score.alias("score"), (score >= 0.95).alias("eligible"), F.when(score >= 0.95, "").otherwise("formatting_below_threshold").alias("reason"))


QUERIES = {f.__name__: f for f in (text_normalize, text_blocks, token_set, block_jaccard, levenshtein_sim, length_similarity, position_similarity, exact_block_match, refined_block_match, merge_text, slugify, json_pointer_escape, conflict_documents, source_retention, default_driver_eval)}
ORACLE_SQL = {
    "text_normalize": BLOCKS_SQL + "SELECT doc_id, strlen(array_to_string(bs, chr(10) || chr(10))) AS n_bytes, md5(array_to_string(bs, chr(10) || chr(10))) AS digest FROM b",
    "text_blocks": TEXT_BLOCKS_SQL,
    "token_set": TOKEN_SET_SQL,
    "block_jaccard": BLOCK_JACCARD_SQL,
    "levenshtein_sim": "SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 1.0 WHEN p_name = '' OR p_type = '' THEN 0.0 ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 9) AS similarity FROM part",
    "length_similarity": "WITH d AS (SELECT doc_id, strlen(replace(text, chr(10), chr(10) || chr(10))) AS n FROM documents WHERE text IS NOT NULL) SELECT r.doc_id, round(CASE WHEN greatest(l.n, r.n) = 0 THEN 1.0 ELSE least(l.n, r.n)::DOUBLE / greatest(l.n, r.n) END, 9) AS similarity FROM d l JOIN d r ON l.doc_id + 1 = r.doc_id",
    "position_similarity": "WITH n AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), p AS (SELECT *, (l_linenumber * 3 - 1) % n AS j FROM n) SELECT l_orderkey, l_linenumber, round(1 - abs(CASE WHEN n <= 1 THEN 0.5 ELSE i::DOUBLE / (n - 1) END - CASE WHEN n <= 1 THEN 0.5 ELSE j::DOUBLE / (n - 1) END), 9) AS similarity FROM p",
    "exact_block_match": EXACT_SQL,
    "refined_block_match": MATCH_SQL + "SELECT doc_id, template_idx::INT AS template_idx, destination_idx::INT AS destination_idx, phase, score FROM m",
    "merge_text": MATCH_SQL
    + """, f AS (SELECT doc_id, 1 - side AS part, idx, x FROM idx WHERE side = 1 UNION ALL SELECT doc_id, 1, idx, x FROM idx WHERE side = 0 AND (doc_id, idx) NOT IN (SELECT (doc_id, template_idx) FROM m)),
      w AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY part, idx) AS t FROM f GROUP BY doc_id) SELECT doc_id, strlen(t)::INT AS n_bytes, md5(t) AS digest FROM w""",
    "slugify": SLUG_SQL,
    "json_pointer_escape": "SELECT p_partkey, '/parts/' || replace(replace(p_name || '/~' || p_type, '~', '~0'), '/', '~1') AS pointer FROM part",
    "conflict_documents": "SELECT o_orderkey, '<<<<<<<<< ours' || chr(10) || o_orderpriority || '#o' || chr(10) || '||||||||| base' || chr(10) || o_orderpriority || chr(10) || '=========' || chr(10) || o_orderpriority || '#t' || chr(10) || '>>>>>>>>> theirs' AS document FROM orders",
    "source_retention": RETENTION_SQL + "SELECT * FROM r",
    "default_driver_eval": RETENTION_SQL + "SELECT doc_id, round((line_ratio + byte_ratio) / 2, 6) AS score, round((line_ratio + byte_ratio) / 2, 6) >= 0.95 AS eligible, CASE WHEN round((line_ratio + byte_ratio) / 2, 6) >= 0.95 THEN '' ELSE 'formatting_below_threshold' END AS reason FROM r",
}
