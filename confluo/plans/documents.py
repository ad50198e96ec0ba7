"""Queries over JSON and Markdown documents: owners at every depth, recursive merges, sections and fences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import json_docs
from ..sources.tables import dealt, table

#: Stands for the event's id in a text.
ID = None


def _variant(spark, sf_dir, n: int, texts: list):
    """Events with one of several texts, by number; the texts hold the event's id."""
    k = F.col("event_id") % n
    choice = F.coalesce(*[F.when(k == i, F.concat(*[F.col("event_id").cast("string") if p is ID else F.lit(p) for p in parts])) for i, parts in enumerate(texts)])
    return table(spark, sf_dir, "events").select("event_id", choice.alias("source"))


def json_owners(spark, sf_dir):
    """Members and elements of documents that are nested, arrays, scalars or no JSON."""
    texts = [['{"b":{"x/y":[1,{"d":null}],"~k":{}},"a":', ID, "}"], ["[[", ID, "],[]]"], [ID], ['{"a":'], ['{"a":{"a":{"a":{"a":"', ID, '"}}}}']]
    return json_docs.owners(_variant(spark, sf_dir, 5, texts), "event_id", "source")


OWNERS_SQL = """
WITH o(k, path, owner_kind, match_key) AS (VALUES (0, '/a', 'member', 'a'), (0, '/b', 'member', 'b'), (0, '/b/x~1y', 'member', 'x/y'), (0, '/b/x~1y/0', 'element', ''), (0, '/b/x~1y/1', 'element', ''),
  (0, '/b/x~1y/1/d', 'member', 'd'), (0, '/b/~0k', 'member', '~k'), (1, '/0', 'element', ''), (1, '/0/0', 'element', ''), (1, '/1', 'element', ''),
  (4, '/a', 'member', 'a'), (4, '/a/a', 'member', 'a'), (4, '/a/a/a', 'member', 'a'), (4, '/a/a/a/a', 'member', 'a'))
SELECT event_id, path, owner_kind, match_key FROM events JOIN o ON event_id % 5 = k
"""


def json_two_way(spark, sf_dir):
    """Nested, empty, malformed and clashing documents, the destination winning."""
    template = [['{"meta":{"mode":"template","id":', ID, '},"list":[1,2],"only_t":true}'], ["{}"], ['{"a":1}'], ['{"a":{"x":1},"b":[1]}'], ["[1,2]"], ['{"alpha":1}']]
    destination = [['{"meta":{"enabled":true,"id":1', ID, '},"list":[3],"z":null}'], ["{ }"], ['{"a":'], ['{"a":5,"b":{"y":"', ID, '"}}'], ['{"k":', ID, "}"], ['{"beta":[",]",', ID, ",],}"]]
    return json_docs.merge_two(_variant(spark, sf_dir, 6, template), _variant(spark, sf_dir, 6, destination), "event_id", "source")


TWO_WAY_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'destination_parse_error' WHEN 5 THEN 'fallback_applied' END AS diagnostic,
  CASE event_id % 6 WHEN 0 THEN '{"meta":{"mode":"template","id":1' || event_id || ',"enabled":true},"list":[3],"only_t":true,"z":null}' WHEN 1 THEN '{}'
    WHEN 3 THEN '{"a":5,"b":{"y":"' || event_id || '"}}' WHEN 4 THEN '{"k":' || event_id || '}' WHEN 5 THEN '{"alpha":1,"beta":[",]",' || event_id || ']}' END AS merged FROM events
"""


def _three(spark, sf_dir):
    base = ['{"a":{"x":1,"y":{"p":"q"}},"b":[1,2],"c":"keep","d":4}']
    rest = ',"b":[1, 2],"c":"keep","d":4}'
    ours = [['{"a":{"x":', ID, ',"y":{"p":"q"}}' + rest], ['{"a":5' + rest], ['{"a":{"y":{"p":"q"},"x":1},"b":[1,2],"c":"keep"}'], ['{"n":[', ID, '],"a":{"x":1,"y":{"p":"q"}}' + rest], ['{"a":{"x":1,"y":{"p":"q"}},"b":[1,2],"d":4}'], base]
    theirs = [['{"a":{"x":1,"y":{"p":"T"}}' + rest], ['{"a":{"x":2,"y":{"p":"q"}}' + rest], ['{"a":{"x":1,"y":{"p":"q"}},"b":[1,2],"c":"keep","d":', ID, "}"], ['{"a":{"x":1,"y":{"p":"q"}},"n":0' + rest], base, ['{"a"']]
    sides = [_variant(spark, sf_dir, 6, texts).withColumnRenamed("source", name) for name, texts in (("base", [base] * 6), ("ours", ours), ("theirs", theirs))]
    return sides[0].join(dealt(sides[1]), "event_id").join(dealt(sides[2]), "event_id")


def json_three_way(spark, sf_dir):
    """Edits at different depths, a type change, a deletion against an edit, two additions, and a side that is no JSON."""
    return json_docs.merge_three(_three(spark, sf_dir), "event_id")[0]


def json_three_way_conflicts(spark, sf_dir):
    return json_docs.merge_three(_three(spark, sf_dir), "event_id")[1]


THREE_WAY_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"a":{"x":' || event_id || ',"y":{"p":"T"}},"b":[1,2],"c":"keep","d":4}' WHEN 1 THEN '{"a":5,"b":[1,2],"c":"keep","d":4}'
  WHEN 2 THEN '{"a":{"y":{"p":"q"},"x":1},"b":[1,2],"c":"keep","d":' || event_id || '}' WHEN 3 THEN '{"n":[' || event_id || '],"a":{"x":1,"y":{"p":"q"}},"b":[1,2],"c":"keep","d":4}'
  ELSE '{"a":{"x":1,"y":{"p":"q"}},"b":[1,2],"d":4}' END AS merged FROM events WHERE event_id % 6 <> 5
"""
THREE_CONFLICTS_SQL = """
SELECT event_id, ['/a', '/d', '/n', '', ''][event_id % 6] AS path, ['edit_edit', 'delete_edit', 'add_add', '', 'parse_error'][event_id % 6] AS category FROM events WHERE event_id % 6 IN (1, 2, 3, 5)
"""


def _markdown(spark, sf_dir):
    """Documents some of whose lines are headings or fences, open ones and fences within fences among them."""
    k = (F.col("doc_id") * 2 + F.col("i") * (F.col("doc_id") % 4 + 1)) % 17
    raw = F.col("raw")
    line = (
        F.when(k == 1, F.concat(F.lit("# "), raw)).when(k == 4, F.concat(F.lit("###   "), raw, F.lit(" ##  "))).when(k == 6, "```go fenced").when(k == 9, "  ```").when(k == 11, "~~~~").when(k == 13, "`````  ").when(k == 15, F.concat(F.lit("#"), raw)).otherwise(raw)
    )
    lines = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select("doc_id", F.struct("i", line.alias("line")).alias("l"))
    texts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return texts.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\r\n").alias("text"))


def _owners(spark, sf_dir):
    """One row an owner, with its path: its number among owners of its kind."""
    d = _markdown(spark, sf_dir)
    rows = d.select("doc_id", "text", F.posexplode(markdown.owners(F.col("text"))).alias("place", "o")).select("doc_id", "text", "place", "o.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("place")) - 1
    return rows.withColumn("path", F.concat(F.lit("/"), "kind", F.lit("/"), nth.cast("string")))


def markdown_owners(spark, sf_dir):
    return _owners(spark, sf_dir).select("doc_id", "path", F.col("kind").alias("owner_kind"), "match_key", "level", "info")


def markdown_fences(spark, sf_dir):
    """Start and end line of each fence."""
    return _owners(spark, sf_dir).filter("kind = 'code_fence'").select("doc_id", "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


def section_bounds(spark, sf_dir):
    """Sections run from an owner's line to the line before the next owner; what precedes the first owner is in none."""
    o = _owners(spark, sf_dir).withColumn("lines", F.split("text", "\r\n"))
    following = F.lead("start").over(Window.partitionBy("doc_id").orderBy("place"))
    s = o.withColumn("stop", F.coalesce(following, F.size("lines")))
    body = F.array_join(F.slice("lines", F.col("start") + 1, F.col("stop") - F.col("start")), "\n")
    return s.select("doc_id", "path", F.col("start").alias("start_line"), (F.col("stop") - 1).alias("end_line"), F.md5(F.regexp_replace(body, r"^\s+|\s+$", "").cast("binary")).alias("digest"))


MARKDOWN_SQL = r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, len(l) AS n, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM s),
k AS (SELECT *, (doc_id * 2 + (i - 1) * (doc_id % 4 + 1)) % 17 AS k FROM r),
c AS (SELECT doc_id, n, i, CASE k WHEN 1 THEN '# ' || raw WHEN 4 THEN '###   ' || raw || ' ##  ' WHEN 6 THEN '```go fenced' WHEN 9 THEN '  ```' WHEN 11 THEN '~~~~' WHEN 13 THEN '`````  ' WHEN 15 THEN '#' || raw ELSE raw END AS line FROM k),
t AS (SELECT *, trim(line) AS bare, regexp_matches(line, '^(#{1,6})\s+(.+?)\s*#*\s*$') AS head, regexp_extract(line, '^\s*(`{3,}|~{3,})\s*(.*?)\s*$', 1) AS fence FROM c),
f(doc_id, i, before, mark) AS (SELECT doc_id, 0::BIGINT, '', '' FROM s UNION ALL
  SELECT t.doc_id, t.i, f.mark, CASE WHEN f.mark <> '' AND starts_with(t.bare, f.mark) AND replace(t.bare, f.mark[1], '') = '' THEN '' WHEN f.mark <> '' THEN f.mark WHEN t.head THEN '' ELSE t.fence END
  FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
o AS (SELECT t.doc_id, t.i - 1 AS start, n, CASE WHEN head THEN 'heading' ELSE 'code_fence' END AS kind, line FROM t JOIN f USING (doc_id, i) WHERE before = '' AND (head OR fence <> '')),
p AS (SELECT *, '/' || kind || '/' || (row_number() OVER (PARTITION BY doc_id, kind ORDER BY start) - 1) AS path, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS stop,
        regexp_extract(regexp_extract(line, '^\s*(`{3,}|~{3,})\s*(.*?)\s*$', 2), '^(\S*)', 1) AS info, length(regexp_extract(line, '^(#{1,6})', 1)) AS level,
        regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS title FROM o)
"""

QUERIES = {f.__name__: f for f in (json_owners, json_two_way, json_three_way, json_three_way_conflicts, markdown_owners, markdown_fences, section_bounds)}
ORACLE_SQL = {
    "json_owners": OWNERS_SQL,
    "json_two_way": TWO_WAY_SQL,
    "json_three_way": THREE_WAY_SQL,
    "json_three_way_conflicts": THREE_CONFLICTS_SQL,
    "markdown_owners": MARKDOWN_SQL
    + "SELECT doc_id, path, kind AS owner_kind, CASE WHEN kind = 'heading' THEN level::INT ELSE 0 END AS level, CASE WHEN kind = 'heading' THEN '' ELSE info END AS info, CASE WHEN kind = 'heading' THEN 'h' || level || ':' || coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section') ELSE 'fence:' || CASE WHEN info = '' THEN 'plain' ELSE info END END AS match_key FROM p",
    "markdown_fences": MARKDOWN_SQL
    + "SELECT doc_id, path, start::INT AS start_line, coalesce((SELECT min(f.i) - 1 FROM f WHERE f.doc_id = p.doc_id AND f.i > start + 1 AND f.before <> '' AND f.mark = ''), n - 1)::INT AS end_line FROM p WHERE kind = 'code_fence'",
    "section_bounds": MARKDOWN_SQL
    + r"SELECT p.doc_id, path, start::INT AS start_line, (stop - 1)::INT AS end_line, md5(regexp_replace(string_agg(t.line, chr(10) ORDER BY t.i), '^\s+|\s+$', '', 'g')) AS digest FROM p JOIN t ON t.doc_id = p.doc_id AND t.i > start AND t.i <= stop GROUP BY ALL",
}
