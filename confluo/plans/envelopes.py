"""Queries over envelopes of every kind: events as payloads, written, and opened as their own or another kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import envelopes
from ..sources.tables import table

KINDS = list(envelopes.PAYLOADS)


def _written(spark, sf_dir):
    """Event properties in an envelope of a kind by number; some of another version, some not of a kind, some cut off."""
    k = F.col("event_id")
    kinds = F.array(*[F.lit(x) for x in KINDS])
    own = F.element_at(kinds, (k % len(KINDS) + 1).cast("int"))
    version = F.when(k % 7 == 0, k % 10).otherwise(1)
    beside = {name: F.when(k % 2 == 0, F.col("event_type")) for name in envelopes.BESIDE["structured_edit_request"][:2]}
    plain, more = envelopes.exported(own, F.col("props"), version=version), envelopes.exported(own, F.col("props"), beside, version)
    text = F.when(own == "structured_edit_request", more).otherwise(plain)
    wanted = F.when(k % 5 == 0, F.element_at(kinds, ((k + 1) % len(KINDS) + 1).cast("int"))).otherwise(own)
    return table(spark, sf_dir, "events").select("event_id", own.alias("kind"), wanted.alias("wanted"), F.when(k % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("source"))


def envelope_exports(spark, sf_dir):
    return _written(spark, sf_dir).select("event_id", "kind", "source")


def envelope_imports(spark, sf_dir):
    """Each envelope opened as the kind that is wanted: payload, or what is wrong with it."""
    return envelopes.imported(_written(spark, sf_dir), ["event_id"], "wanted", "source")


def envelope_kinds(spark, sf_dir):
    return envelopes.known_kinds(_written(spark, sf_dir).filter("event_id % 72 < 60"), "kind")


KINDS_SQL = f"""
WITH k(i, kind, member) AS (VALUES {", ".join(f"({i}, '{kind}', '{member}')" for i, (kind, member) in enumerate(envelopes.PAYLOADS.items()))}),
e AS (SELECT event_id, event_type, props, kind, member, event_id % 7 = 0 AND event_id % 10 <> 1 AS old, CASE WHEN event_id % 7 = 0 THEN event_id % 10 ELSE 1 END AS version, event_id % 11 = 0 AS cut FROM events JOIN k ON i = event_id % {len(KINDS)}),
w AS (SELECT *, '{{"kind":"' || kind || '","version":' || version || ',' || CASE WHEN kind = 'structured_edit_request' AND event_id % 2 = 0 THEN '"profile_id":"' || event_type || '","minimum_profile_status":"' || event_type || '",' ELSE '' END || '"' || member || '":' || props || '}}' AS text FROM e),
x AS (SELECT w.*, CASE WHEN event_id % 5 = 0 THEN k.kind ELSE w.kind END AS wanted FROM w JOIN k ON k.i = (event_id + 1) % {len(KINDS)}),
r AS (SELECT *, CASE WHEN cut OR wanted <> kind THEN 'kind_mismatch' WHEN old THEN 'unsupported_version' END AS category FROM x)
"""
QUERIES = {f.__name__: f for f in (envelope_exports, envelope_imports, envelope_kinds)}
ORACLE_SQL = {
    "envelope_exports": KINDS_SQL + "SELECT event_id, kind, CASE WHEN cut THEN substr(text, 1, 20) ELSE text END AS source FROM w",
    "envelope_imports": KINDS_SQL
    + """SELECT event_id, category IS NULL AS ok, category, CASE category WHEN 'kind_mismatch' THEN 'expected ' || wanted || ' envelope kind.' WHEN 'unsupported_version' THEN 'unsupported ' || wanted || ' envelope version ' || version || '.' END AS message,
      CASE WHEN category IS NULL THEN replace(props, '": ', '":') END AS payload FROM r""",
    "envelope_kinds": KINDS_SQL + "SELECT k.kind, count(e.kind) AS n FROM k LEFT JOIN e ON e.kind = k.kind AND event_id % 72 < 60 GROUP BY k.kind",
}
