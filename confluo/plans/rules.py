"""Queries over rulesets in the lines of documents, conflict handlers over orders, and edit projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import handlers, projections, rulesets
from ..sources.tables import table

#: What may stand before the words of a line, by number; a good ruleset when all of the first eight are there once.
HEADS = ("format json", "owners line_bound_statements", "match", "read native_mutation", "attach layout_only", "node_role", "# ", "child_group a b", "read imaginary", "mystery", "9x", "render", "attach", "  backend  kreutz", "atomic x true", "match stable_path")
GOOD = "format json\nowners line_bound_statements\n# kept\nmatch stable_path\n\nread native_mutation\nattach layout_only\n"


def _rules(spark, sf_dir):
    """Every other document: its first line's words as arguments under good directives; the others: directives before each line."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    head = lambda i: F.element_at(F.array(*[F.lit(h) for h in HEADS]), ((F.col("doc_id") * 5 + i * 7) % len(HEADS) + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.length(x) < 40, F.concat(head(i), F.lit(" "), F.regexp_replace(x, r"[^\x20-\x7e]", "#"))).otherwise(head(i)))
    first = F.split(F.regexp_replace(F.substring_index("text", "\n", 1), r"[^a-z ]", ""), " +")
    own = F.filter(F.array_distinct(F.slice(first, 1, 12)), lambda w: w != "")
    declared = F.array_join(F.transform(own, lambda w, i: F.concat(F.when(i % 3 == 0, "backend ").when(i % 3 == 1, "capability ").otherwise("child_group p "), w, F.when(i % 4 == 0, "").otherwise(" native"))), "\n")
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(GOOD), declared)).otherwise(F.array_join(lines, "\n")).alias("rules"))


def ruleset_diagnostics(spark, sf_dir):
    d = _rules(spark, sf_dir)
    return rulesets.ruleset_diagnostics(d, rulesets.directive_lines(d, "doc_id", "rules"), "doc_id")


def ruleset_profiles(spark, sf_dir):
    d = _rules(spark, sf_dir)
    lines = rulesets.directive_lines(d, "doc_id", "rules")
    found = rulesets.ruleset_profiles(lines, rulesets.ruleset_diagnostics(d, lines, "doc_id"), "doc_id")
    declared = F.array_join(F.transform("declared", lambda x: F.concat(x["name"], F.lit(":"), F.array_join(x["args"], ","))), ";")
    return found.select("doc_id", "format", "owners", "match", "read", "attach", declared.alias("declared"))


def ruleset_comments(spark, sf_dir):
    return rulesets.directive_comments(_rules(spark, sf_dir), "doc_id", "rules")


RULES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
hd AS (SELECT ['format json', 'owners line_bound_statements', 'match', 'read native_mutation', 'attach layout_only', 'node_role', '# ', 'child_group a b', 'read imaginary', 'mystery', '9x', 'render', 'attach', '  backend  kreutz', 'atomic x true', 'match stable_path'] AS heads),
r AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d WHERE doc_id % 2 = 1),
odd AS (SELECT doc_id, i + 1 AS line, heads[(doc_id * 5 + i * 7) % 16 + 1] || CASE WHEN length(x) < 40 THEN ' ' || regexp_replace(x, '[^\x20-\x7e]', '#', 'g') ELSE '' END AS raw FROM r, hd),
w0 AS (SELECT doc_id, string_split_regex(regexp_replace(l[1], '[^a-z ]', '', 'g'), ' +')[1:12] AS ws FROM d WHERE doc_id % 2 = 0),
w1 AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM w0),
w2 AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM (SELECT doc_id, w, min(n) AS n FROM w1 WHERE w <> '' GROUP BY doc_id, w)),
even AS (SELECT doc_id, 8 + i AS line, ['backend ', 'capability ', 'child_group p '][i % 3 + 1] || w || CASE WHEN i % 4 = 0 THEN '' ELSE ' native' END AS raw FROM w2
  UNION ALL SELECT doc_id, g.n, ['format json', 'owners line_bound_statements', '# kept', 'match stable_path', '', 'read native_mutation', 'attach layout_only'][g.n] FROM d, (SELECT unnest(range(1, 8)) AS n) g WHERE doc_id % 2 = 0),
t AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS bare FROM (SELECT * FROM odd UNION ALL SELECT * FROM even)),
p AS (SELECT doc_id, line, string_split_regex(bare, '\s+') AS ws FROM t WHERE bare <> '' AND NOT starts_with(bare, '#')),
n AS (SELECT doc_id, line, ws[1] AS name, ws[2:] AS args FROM p),
k AS (SELECT *, name IN ('format', 'owners', 'match', 'read', 'attach', 'comment_style', 'render', 'render_strategy') AS single, name IN ('backend', 'node_role', 'atomic', 'child_group', 'capability', 'logical_owner', 'repair', 'surface', 'delegate') AS keyed FROM n),
s AS (SELECT *, CASE WHEN NOT regexp_matches(name, '^[A-Za-z][A-Za-z0-9_.-]*$') THEN 'invalid directive token "' || name || '"' WHEN NOT single AND NOT keyed THEN 'unknown directive "' || name || '"' WHEN len(args) = 0 THEN 'directive "' || name || '" requires at least one argument' END AS stop FROM k),
a AS (SELECT *, CASE WHEN name = 'child_group' AND len(args) > 1 THEN args[1] || chr(0) || args[2] ELSE args[1] END AS own FROM s WHERE stop IS NULL),
g AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, name ORDER BY line) AS before, row_number() OVER (PARTITION BY doc_id, name, own ORDER BY line) AS nth FROM a),
m AS (SELECT doc_id, line, 0 AS o, stop AS message FROM s WHERE stop IS NOT NULL
  UNION ALL SELECT doc_id, line, j, 'invalid argument token "' || replace(replace(arg, '\', '\\'), '"', '\"') || '"' FROM (SELECT doc_id, line, unnest(args) AS arg, generate_subscripts(args, 1) AS j FROM g) WHERE arg NOT IN ('true', 'false') AND NOT regexp_matches(arg, '^[A-Za-z][A-Za-z0-9_.-]*$') AND NOT regexp_matches(arg, '^[\x21\x24-\x7e]+$')
  UNION ALL SELECT doc_id, line, 1000, 'repeated singleton directive "' || name || '" first seen on line ' || before FROM g WHERE single AND before IS NOT NULL
  UNION ALL SELECT doc_id, line, 1001, 'repeated "' || name || '" key "' || replace(replace(args[1], '\', '\\'), '"', '\"') || '"' FROM g WHERE keyed AND nth > 1
  UNION ALL SELECT doc_id, line, 1002, 'unknown ' || name || ' value "' || replace(replace(args[1], '\', '\\'), '"', '\"') || '"' FROM g WHERE (name = 'read' AND args[1] NOT IN ('source_augmented_portable_write', 'native_read_portable_write', 'native_mutation')) OR (name = 'attach' AND args[1] NOT IN ('layout_only', 'tracker_layout_merge', 'augmenter_preferred_tracker_layout', 'normalize_tracked_layout_merge'))
  UNION ALL SELECT doc_id, 0, 2000 + q.o, 'missing required directive "' || q.x || '"' FROM d, (VALUES (1, 'format'), (2, 'owners'), (3, 'match'), (4, 'read'), (5, 'attach')) q(o, x) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.name = q.x))
"""


def _cases(spark, sf_dir):
    k = F.col("o_orderkey")
    handler = F.when(k % 4 == 0, handlers.INSERTIONS).when(k % 4 == 3, "other").otherwise(handlers.KEYED)
    cases = table(spark, sf_dir, "orders").select(k.alias("case"), handler.alias("handler"), F.when(k % 12 == 0, "ordered").otherwise("commutative").alias("policy"))
    n = F.col("l_linenumber")
    members = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case"), F.element_at(F.array(F.lit("base"), F.lit("left"), F.lit("right")), (n % 3 + 1).cast("int")).alias("side"), (n.cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("pos"), n.cast("string").alias("node"),
        F.when(n == 1, "").otherwise(F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string"))).alias("signature"), F.concat(F.lit("k"), (F.col("l_suppkey") % 3).cast("string")).alias("key"), (F.col("l_quantity").cast("int") % 2).cast("string").alias("value"),
    )
    return cases, members


def conflict_handlers(spark, sf_dir):
    """Cases of both handlers and of an unknown one, in one plan."""
    done = handlers.handled(*_cases(spark, sf_dir))
    merged = F.array_join(F.transform("merged", lambda x: F.concat(F.coalesce(x["node"], F.lit("")), F.lit(":"), x["key"], F.lit("="), x["value"])), ",")
    return done.select("case", "resolved", merged.alias("merged"), "diagnostic")


HANDLERS_SQL = f"""
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 4 = 0 AS ins, o_orderkey % 4 IN (1, 2) AS edits, o_orderkey % 12 = 0 AS ordered FROM orders),
m AS (SELECT l_orderkey AS k, l_linenumber AS nr, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS n, l_linenumber % 3 AS side, CASE WHEN l_linenumber = 1 THEN l_linenumber::VARCHAR ELSE 's' || l_partkey % 3 END AS sig, 'k' || l_suppkey % 3 AS key, (l_quantity::INT % 2)::VARCHAR AS v FROM lineitem),
i AS (SELECT k, sig, min(struct_pack(s := side, n := n)) AS first, arg_min(nr::VARCHAR || ':' || key || '=' || v, struct_pack(s := side, n := n)) AS item FROM m GROUP BY k, sig),
e AS (SELECT k, key, min(struct_pack(s := side, n := n)) AS first, arg_max(v, struct_pack(s := side, n := n)) AS v, arg_max(v, n) FILTER (side = 1) AS l, min(v) FILTER (side = 2) AS lo, max(v) FILTER (side = 2) AS hi FROM m GROUP BY k, key),
x AS (SELECT k, string_agg(item, ',' ORDER BY first) AS merged FROM i GROUP BY k),
y AS (SELECT k, string_agg(':' || key || '=' || v, ',' ORDER BY first) AS merged, bool_or(coalesce(l IS NOT NULL AND (lo <> l OR hi <> l), false)) AS clash FROM e GROUP BY k)
SELECT c.k AS "case", (ins AND NOT ordered) OR (edits AND NOT coalesce(clash, false)) AS resolved,
  CASE WHEN ins AND NOT ordered THEN coalesce(x.merged, '') WHEN edits AND NOT coalesce(clash, false) THEN coalesce(y.merged, '') END AS merged,
  CASE WHEN ins AND ordered THEN '{handlers.SAID["ordered"]}' WHEN ins THEN '{handlers.SAID["united"]}' WHEN edits AND coalesce(clash, false) THEN '{handlers.SAID["clash"]}' WHEN edits THEN '{handlers.SAID["edited"]}' ELSE '{handlers.SAID["unsupported"]}' END AS diagnostic
FROM c LEFT JOIN x ON x.k = c.k LEFT JOIN y ON y.k = c.k
"""


def _edits(spark, sf_dir):
    """Words of a document's first line upper-cased by place, diagnostics by number, a faulty edit in some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("text"))
    word = docs.filter("text IS NOT NULL").select("doc_id", F.octet_length(F.substring_index("text", " ", 1)).cast("long").alias("n"), F.octet_length("text").cast("long").alias("size"))
    one = word.select("doc_id", F.lit(0).cast("long").alias("edit"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit("FIRST").alias("replacement"))
    two = word.select("doc_id", F.lit(1).cast("long").alias("edit"), F.when(F.col("doc_id") % 6 == 5, F.lit(0)).otherwise(F.col("size")).cast("long").alias("start"), F.when(F.col("doc_id") % 6 == 4, F.col("size") + 1).otherwise(F.col("size")).alias("end"), F.lit("!").alias("replacement"))
    said = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("edit")).withColumn("blocking", (F.col("edit") == 1) & (F.col("doc_id") % 4 == 0))
    return docs, one.unionByName(two), said


def projection_results(spark, sf_dir):
    docs, edits, said = _edits(spark, sf_dir)
    done = projections.execute_edits(docs, edits, said, "doc_id", "text")
    return done.select("doc_id", "status", "source", F.size("applied").alias("n_applied"), "n_diagnostics")


def provider_support(spark, sf_dir):
    """Suppliers as providers, what they support by the lines they ship; every operation has a cell."""
    operations = ["replace", "delete", "insert", "move", "wrap"]
    providers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"))
    kind = F.element_at(F.array(*[F.lit(o) for o in (*operations[:4], "other")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    support = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("provider"), kind.alias("operation"), F.when(F.col("l_discount") > 0.05, "native").otherwise("emulated").alias("support"))
    return projections.provider_matrix(providers, support, operations)


QUERIES = {f.__name__: f for f in (ruleset_diagnostics, ruleset_profiles, ruleset_comments, conflict_handlers, projection_results, provider_support)}
ORACLE_SQL = {
    "ruleset_diagnostics": RULES_SQL + 'SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line = 0, line, o)::INT AS "rank", line::INT AS line, message FROM m',
    "ruleset_profiles": RULES_SQL
    + """, z AS (SELECT *, CASE WHEN keyed AND len(args) >= CASE WHEN name = 'child_group' THEN 3 ELSE 2 END THEN name || ':' || array_to_string(args[1:CASE WHEN name = 'child_group' THEN 3 ELSE 2 END], ',') END AS item FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id))
    SELECT doc_id, max(args[1]) FILTER (name = 'format') AS format, max(args[1]) FILTER (name = 'owners') AS owners, max(args[1]) FILTER (name = 'match') AS "match", max(args[1]) FILTER (name = 'read') AS read, max(args[1]) FILTER (name = 'attach') AS attach, coalesce(string_agg(item, ';' ORDER BY line), '') AS declared FROM z GROUP BY doc_id""",
    "ruleset_comments": RULES_SQL + "SELECT doc_id, line::INT AS line, bare AS comment FROM t WHERE starts_with(bare, '#')",
    "conflict_handlers": HANDLERS_SQL,
    "projection_results": """
WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS t, doc_id % 6 AS f, doc_id % 4 = 0 AND doc_id % 3 >= 1 AS blocked FROM documents),
j AS (SELECT *, string_split(t, ' ')[1] AS w FROM d), b AS (SELECT *, (f = 4 AND t IS NOT NULL)::INT + (f = 5 AND strlen(w) > 0)::INT AS faults FROM j),
q AS (SELECT *, blocked OR faults > 0 AS bad FROM b)
SELECT doc_id, CASE WHEN bad THEN 'rejected' ELSE 'applied' END AS status, CASE WHEN bad OR t IS NULL THEN t WHEN f = 5 THEN 'FIRST!' ELSE 'FIRST' || substr(t, length(w) + 1) || '!' END AS source,
  CASE WHEN bad OR t IS NULL THEN 0 ELSE 2 END::INT AS n_applied, (doc_id % 3 + 1 + faults)::BIGINT AS n_diagnostics FROM q""",
    "provider_support": """
WITH s AS (SELECT l_suppkey AS p, ['replace', 'delete', 'insert', 'move', 'other'][l_partkey % 5 + 1] AS o, max(CASE WHEN l_discount > 0.05 THEN 'native' ELSE 'emulated' END) AS support FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2)
SELECT s_suppkey AS provider, v.o AS operation, coalesce(support, 'none') AS support FROM supplier CROSS JOIN (VALUES ('replace'), ('delete'), ('insert'), ('move'), ('wrap')) v(o) LEFT JOIN s ON s.p = s_suppkey AND s.o = v.o""",
}
