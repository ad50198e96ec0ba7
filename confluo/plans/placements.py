"""Queries over the JSON of events: places of every value, and three-way conflicts shown where they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json_nodes import json_nodes
from ..operators import json_docs, placement
from ..sources.tables import table


def _sides(spark, sf_dir):
    """Event properties with members of other columns as base; edits of one side or of both by number.

    0: the type edited twice; 1: two places edited twice; 2: the list's element edited in
    one side, the number in the other; 3: a nested member deleted and edited; 4: a
    top-level member deleted and edited; 5: both sides alike; 6: a value of another type.
    """
    k = F.col("event_id") % 7
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    inner = F.regexp_extract("props", r"\{(.*)\}", 1)
    whole = lambda number, who, tags: text("{", number, ",\n  ", who, ',"tags": [', tags, ",2.50]\n}")
    who = lambda *name: text('"who": {"user":', user, ',\n "type": "', kind, *name, '"}')
    gone, off = text('"who": {"user":', user, "}"), text('"who": [', user, "]")
    more, other = F.regexp_replace(inner, r"(\d+)$", "7$1"), F.regexp_replace(inner, r"(\d+)$", "8$1")
    base = whole(inner, who(), "1")
    ours = F.when(k == 0, whole(inner, who(" é"), "1")).when(k == 1, whole(more, who("O"), "1")).when(k == 2, whole(inner, who(), "9")).when(k == 3, whole(inner, gone, "1")).when(k == 4, text("{", who(), ',"tags": [1,2.50]}')).when(k == 5, whole(more, who(), "1")).otherwise(whole(inner, off, "1"))
    theirs = F.when(k == 0, whole(inner, who(" t"), "1")).when(k == 1, whole(other, who("T"), "1")).when(k == 2, whole(more, who(), "1")).when(k == 3, whole(inner, who("T"), "1")).when(k == 4, whole(more, who(), "1")).when(k == 5, whole(more, who(), "1")).otherwise(whole(inner, who("x"), "1"))
    return table(spark, sf_dir, "events").select("event_id", base.alias("base"), ours.alias("ours"), theirs.alias("theirs"))


def json_places(spark, sf_dir):
    """Bytes and lines of every value of the base texts."""
    return json_nodes(_sides(spark, sf_dir), ["event_id"], "base", wanted=("path", "kind", "value", "start", "end", "line", "end_line"))


def json_conflict_places(spark, sf_dir):
    """Texts in conflict with the conflicts marked within their owners."""
    return placement.conflicted_sources(_sides(spark, sf_dir), "event_id", tool="merge")[0]


def json_owned_regions(spark, sf_dir):
    """The owner of each conflict, and its bytes and lines in the base text."""
    found = placement.conflicted_sources(_sides(spark, sf_dir), "event_id")[1]
    return found.select("event_id", "path", "owner_path", "region_kind", "base_start", "base_end", "first_line", "last_line")


def json_clean_merges(spark, sf_dir):
    """Merged texts of events without conflict."""
    return placement.conflicted_sources(_sides(spark, sf_dir), "event_id")[2]


def props_owners(spark, sf_dir):
    """Members of the events' own properties."""
    return json_docs.owners(table(spark, sf_dir, "events"), "event_id", "props")


def props_two_way(spark, sf_dir):
    """The properties of events as destination of a template with nested members of other columns."""
    e = table(spark, sf_dir, "events")
    template = e.select("event_id", F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"k":null,"at":{"type":"'), "event_type", F.lit('","n":1.50}}')).alias("source"))
    return json_docs.merge_two(template, e.select("event_id", F.col("props").alias("source")), "event_id", "source")


SIDES_SQL = r"""
WITH e AS (SELECT event_id, event_id % 7 AS c, user_id AS u, event_type AS t, regexp_extract(props, '\{(.*)\}', 1) AS p, regexp_replace(regexp_extract(props, '\{(.*)\}', 1), '(\d+)$', '7\1') AS q, regexp_replace(regexp_extract(props, '\{(.*)\}', 1), '(\d+)$', '8\1') AS q8 FROM events),
s AS (SELECT *, '"who": {"user":' || u || ',' || chr(10) || ' "type": "' || t AS w, ',"tags": [1,2.50]' || chr(10) || '}' AS tail, '{' || p || ',' || chr(10) || '  ' AS head FROM e)
"""
QUERIES = {f.__name__: f for f in (json_places, json_conflict_places, json_owned_regions, json_clean_merges, props_owners, props_two_way)}
ORACLE_SQL = {
    "json_places": SIDES_SQL
    + """, b AS (SELECT event_id, u, t, p, strlen(p) AS n, head || w || '"}' || tail AS src, regexp_extract(p, '\\d+$') AS num FROM s), l AS (SELECT *, strlen('"who": {"user":' || u) AS a, strlen(t) AS z FROM b),
m AS (SELECT *, n + 5 AS who, n + 5 + a + 1 + 1 + 1 AS typ FROM l)
SELECT event_id, '' AS path, 'object' AS kind, '{' || replace(p, '": ', '":') || ',"who":{"user":' || u || ',"type":"' || t || '"},"tags":[1,2.50]}' AS value, 0::BIGINT AS start, strlen(src)::BIGINT AS "end", 0::BIGINT AS line, 4::BIGINT AS end_line FROM m
UNION ALL SELECT event_id, '/k', 'number', num, 1, 1 + n, 0, 1 FROM m
UNION ALL SELECT event_id, '/who', 'object', '{"user":' || u || ',"type":"' || t || '"}', who, typ + 11 + z, 1, 3 FROM m
UNION ALL SELECT event_id, '/who/user', 'number', u::VARCHAR, who + 8, who + a, 1, 2 FROM m
UNION ALL SELECT event_id, '/who/type', 'string', '"' || t || '"', typ, typ + 10 + z, 2, 3 FROM m
UNION ALL SELECT event_id, '/tags', 'array', '[1,2.50]', typ + 12 + z, typ + 12 + z + 16, 2, 3 FROM m
UNION ALL SELECT event_id, '/tags/0', 'number', '1', typ + 12 + z + 9, typ + 12 + z + 10, 2, 3 FROM m
UNION ALL SELECT event_id, '/tags/1', 'number', '2.50', typ + 12 + z + 11, typ + 12 + z + 15, 2, 3 FROM m
""",
    "json_conflict_places": SIDES_SQL
    + r""", m AS (SELECT *, chr(10) || '||||||| base' || chr(10) AS bar, chr(10) || '=======' || chr(10) AS eq, '<<<<<<< ours' || chr(10) AS lt, chr(10) || '>>>>>>> theirs' AS gt, '"who": {"user":' || u AS user FROM s)
SELECT event_id, CASE WHEN c = 4 THEN 'full_file_conflict_markers' ELSE 'owned_region_conflict_markers' END AS strategy, CASE WHEN c = 1 THEN 2 ELSE 1 END::BIGINT AS conflicts,
  CASE c WHEN 0 THEN head || user || ',' || chr(10) || ' ' || lt || '"type": "' || t || ' é"' || bar || '"type": "' || t || '"' || eq || '"type": "' || t || ' t"' || gt || '}' || tail
    WHEN 1 THEN '{' || lt || q || bar || p || eq || q8 || gt || ',' || chr(10) || '  ' || user || ',' || chr(10) || ' ' || lt || '"type": "' || t || 'O"' || bar || '"type": "' || t || '"' || eq || '"type": "' || t || 'T"' || gt || '}' || tail
    WHEN 3 THEN head || lt || user || '}' || bar || w || '"}' || eq || w || 'T"}' || gt || tail
    WHEN 4 THEN '/* merge structured conflicts: 1 unresolved */' || chr(10) || lt || '{' || w || '"},"tags": [1,2.50]}' || bar || head || w || '"}' || tail || eq || '{' || q || ',' || chr(10) || '  ' || w || '"}' || tail || gt || chr(10)
    ELSE head || lt || '"who": [' || u || ']' || bar || w || '"}' || eq || w || 'x"}' || gt || tail END AS source FROM m WHERE c NOT IN (2, 5)
""",
    "json_owned_regions": SIDES_SQL
    + """, m AS (SELECT *, strlen(p) AS n, strlen('"who": {"user":' || u) AS a FROM s), r AS (
SELECT event_id, '/who/type' AS path, '/who/type' AS owner_path, n + 5 + a + 3 AS base_start, n + 5 + a + 3 + 10 + strlen(t) AS base_end, 2 AS first_line, 3 AS last_line FROM m WHERE c IN (0, 1)
UNION ALL SELECT event_id, '/k', '/k', 1, 1 + n, 0, 1 FROM m WHERE c = 1
UNION ALL SELECT event_id, CASE c WHEN 3 THEN '/who/type' ELSE '/who' END, '/who', n + 5, n + 5 + a + 3 + 11 + strlen(t), 1, 3 FROM m WHERE c IN (3, 6))
SELECT event_id, path, owner_path, 'node' AS region_kind, base_start::BIGINT AS base_start, base_end::BIGINT AS base_end, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line FROM r
""",
    "json_clean_merges": SIDES_SQL
    + """SELECT event_id, '{' || replace(q, '": ', '":') || ',"who":{"user":' || u || ',"type":"' || t || '"},"tags":' || CASE WHEN c = 2 THEN '[9,2.50]' ELSE '[1,2.50]' END || '}' AS merged FROM s WHERE c IN (2, 5)""",
    "props_owners": "SELECT event_id, '/' || unnest(json_keys(props)) AS path, 'member' AS owner_kind, unnest(json_keys(props)) AS match_key FROM events",
    "props_two_way": """SELECT event_id, NULL::VARCHAR AS diagnostic, '{"user":' || user_id || ',"k":' || coalesce(props->>'k', 'null') || ',"at":{"type":"' || event_type || '","n":1.50}}' AS merged FROM events""",
}
