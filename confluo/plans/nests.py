"""Queries over nested merges, reviews of delegated groups, family contexts, suites, labels and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import nested
from ..sources.tables import table


def _fenced(spark, sf_dir):
    """Documents around two fences, of families that vary with the number; some stay open."""
    k = F.col("doc_id")
    info = F.element_at(F.array(*[F.lit(x) for x in ("ts", "yaml", "ruby", "JSONC", "")]), (k % 5 + 1).cast("int"))
    text = F.concat(F.lit("# "), k.cast("string"), F.lit("\n```"), info, F.lit("\nold\nlines\n```\nbetween\n~~~go x\nbody\n"), F.when(k % 4 == 0, "").otherwise("~~~\n"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _outputs(spark, sf_dir):
    """An output for the second fence, one for the first of every other document, and one for a fence that some lack."""
    k = F.col("doc_id")
    address = lambda n: F.concat(F.lit("document[0] > fenced_code_block[/code_fence/"), n, F.lit("]"))
    rows = F.array(
        F.struct(F.lit(0).alias("idx"), address(F.lit("1")).alias("address"), F.concat(F.lit("new "), k.cast("string"), F.lit("\n")).alias("output")),
        F.when(k % 2 == 0, F.struct(F.lit(1).alias("idx"), address(F.lit("0")).alias("address"), F.lit("").alias("output"))),
        F.when(k % 7 == 0, F.struct(F.lit(2).alias("idx"), address(F.lit("9")).alias("address"), F.lit("x").alias("output"))),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array_compact(rows)))


def _operations(spark, sf_dir):
    return nested.child_operations(_fenced(spark, sf_dir), "doc_id", "text")


def child_operations(spark, sf_dir):
    return _operations(spark, sf_dir).drop("start", "end")


def child_outputs(spark, sf_dir):
    """Entries of the apply plans."""
    entries, _ = nested.resolve_outputs(_operations(spark, sf_dir), _outputs(spark, sf_dir), "doc_id", "nested", "markdown")
    return entries.drop("start", "end")


def child_failures(spark, sf_dir):
    _, failed = nested.resolve_outputs(_operations(spark, sf_dir), _outputs(spark, sf_dir), "doc_id", "nested", "markdown")
    return failed


def nested_merge(spark, sf_dir):
    """Documents whose outputs all resolve, with the fences' bodies replaced."""
    docs = _fenced(spark, sf_dir)
    entries, failed = nested.resolve_outputs(_operations(spark, sf_dir), _outputs(spark, sf_dir), "doc_id", "nested", "markdown")
    return nested.apply_outputs(docs.join(failed.select("doc_id"), "doc_id", "left_anti"), entries, "doc_id", "text")


NEST_SQL = """
WITH d AS (SELECT doc_id, doc_id % 5 AS k, ['ts', 'yaml', 'ruby', 'JSONC', ''][doc_id % 5 + 1] AS info, ['typescript', 'yaml', '', 'json', ''][doc_id % 5 + 1] AS family, md5(coalesce(text, '')) AS tail FROM documents),
o AS (SELECT doc_id, 'markdown-fence-0' AS operation_id, '/code_fence/0' AS path, family, CASE WHEN info = 'JSONC' THEN 'jsonc' ELSE family END AS dialect FROM d WHERE family <> ''
      UNION ALL SELECT doc_id, CASE WHEN family <> '' THEN 'markdown-fence-1' ELSE 'markdown-fence-0' END, '/code_fence/1', 'go', 'go' FROM d),
a AS (SELECT doc_id, operation_id, 'document[0] > fenced_code_block[' || path || ']' AS address, family, dialect, path FROM o),
u AS (SELECT doc_id, 0 AS idx, '/code_fence/1' AS path, 'new ' || doc_id || chr(10) AS output FROM documents UNION ALL SELECT doc_id, 1, '/code_fence/0', '' FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 2, '/code_fence/9', 'x' FROM documents WHERE doc_id % 7 = 0),
f AS (SELECT u.doc_id, 'missing delegated child surface document[0] > fenced_code_block[' || arg_min(u.path, idx) || '].' AS message FROM u LEFT JOIN a ON a.doc_id = u.doc_id AND a.path = u.path WHERE a.path IS NULL GROUP BY u.doc_id)
"""


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("group"))


def _decisions(spark, sf_dir):
    """Orders decide about groups; some about groups that are not there, some with another action."""
    o = table(spark, sf_dir, "orders")
    group = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("o_custkey").cast("string")))
    action = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), nested.APPLY).otherwise("accept_default_context")
    return o.select(nested.request_id(group).alias("request_id"), action.alias("action"), F.col("o_orderkey").alias("pos"))


def review_apply_plan(spark, sf_dir):
    return nested.review_state(_groups(spark, sf_dir), _decisions(spark, sf_dir), "markdown")[0]


def review_requests(spark, sf_dir):
    return nested.review_state(_groups(spark, sf_dir), _decisions(spark, sf_dir), "markdown")[1]


def review_rejections(spark, sf_dir):
    return nested.review_state(_groups(spark, sf_dir), _decisions(spark, sf_dir), "markdown")[2]


DECISIONS_SQL = """
WITH g AS (SELECT 'g' || c_custkey AS "group", 'projected_child_group:g' || c_custkey AS request_id FROM customer),
d AS (SELECT 'projected_child_group:' || CASE WHEN o_orderkey % 10 = 0 THEN 'x' || o_orderkey ELSE 'g' || o_custkey END AS request_id, o_orderkey AS pos FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)
"""


def _families(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("family"), F.col("n_nationkey").alias("k"))


def _context_sides(spark, sf_dir):
    """Contexts of nations with a rich supplier, profiles of nations with a poor customer."""
    f = _families(spark, sf_dir)
    contexts = f.join(table(spark, sf_dir, "supplier").filter("s_acctbal > 9000"), F.col("k") == F.col("s_nationkey"), "left_semi")
    profiles = f.join(table(spark, sf_dir, "customer").filter("c_acctbal < -500"), F.col("k") == F.col("c_nationkey"), "left_semi")
    return f.select("family"), contexts.select("family"), profiles.select("family")


def family_contexts(spark, sf_dir):
    sides = _context_sides(spark, sf_dir)
    every = [nested.family_contexts(*sides, explicit).withColumn("explicit", F.lit(explicit)) for explicit in (False, True)]
    return every[0].unionByName(every[1])


CONTEXTS_SQL = """
WITH n AS (SELECT n_name AS family, n_nationkey AS k, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS c, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -500) AS p FROM nation)
"""


def reviewed_contexts(spark, sf_dir):
    """Customers decide about their nation, by number."""
    k = F.col("c_custkey")
    action = F.when(k % 4 == 0, "accept_default_context").when(k % 4 == 3, "postpone").otherwise("provide_explicit_context")
    decisions = table(spark, sf_dir, "customer").join(_families(spark, sf_dir), F.col("c_nationkey") == F.col("k")).select("family", k.alias("pos"), action.alias("action"), F.when(k % 8 == 1, F.col("family")).when(k % 8 == 2, F.lit("other")).alias("provided"))
    return nested.reviewed_contexts(*_context_sides(spark, sf_dir), decisions)


REVIEWED_SQL = CONTEXTS_SQL + """
, x AS (SELECT family, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'accepted' WHEN c_custkey % 8 = 1 THEN 'provided' WHEN c_custkey % 8 = 2 THEN 'family_mismatch' ELSE 'missing_required_payload' END AS kind FROM customer JOIN n ON c_nationkey = k WHERE c_custkey % 4 <> 3),
y AS (SELECT family, arg_min(kind, c_custkey) AS kind FROM x GROUP BY 1),
z AS (SELECT family, CASE WHEN c THEN 'explicit' WHEN NOT p THEN 'none' WHEN kind = 'accepted' THEN 'default' WHEN kind = 'provided' THEN 'provided' ELSE 'none' END AS context,
        CASE WHEN NOT c AND p AND kind IN ('missing_required_payload', 'family_mismatch') THEN kind ELSE '' END AS reason, c, p FROM n LEFT JOIN y USING (family))
SELECT family, context, reason, CASE WHEN NOT c AND p AND context = 'none' THEN 'family_context:' || family ELSE '' END AS request_id FROM z
"""


def replay_compatibility(spark, sf_dir):
    """Each user's first events as a replay context against the next user's."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("surface"), (F.count(F.lit(1)) % 2 == 0).alias("explicit"), F.array_sort(F.collect_set("event_type")).alias("families"))
    own = e.select("user_id", F.struct("surface", "explicit", "families").alias("a"))
    other = e.select((F.col("user_id") - 1).alias("user_id"), F.struct("surface", "explicit", "families").alias("b"))
    both = own.join(other, "user_id", "left")
    return both.select("user_id", nested.replay_compatible(both, "a", "b").alias("compatible"))


REPLAY_SQL = """
WITH e AS (SELECT user_id, min(event_type) AS s, count(*) % 2 = 0 AS x, list_sort(list(DISTINCT event_type)) AS f FROM events GROUP BY 1)
SELECT a.user_id, coalesce(a.s = b.s AND a.x = b.x AND a.f = b.f, false) AS compatible FROM e a LEFT JOIN e b ON a.user_id = b.user_id - 1
"""


def _suites(spark, sf_dir):
    """Suppliers are suites of their nation's family, parts of a size its entries; each wants three roles."""
    s = table(spark, sf_dir, "supplier").join(_families(spark, sf_dir), F.col("s_nationkey") == F.col("k"))
    roles = F.transform(F.array(F.lit(0), F.lit(7), F.lit(3)), lambda d: F.concat(F.lit("r"), ((F.col("s_suppkey") + d) % 20).cast("string")))
    suites = s.select(F.col("s_suppkey").alias("suite"), "family", roles.alias("roles"))
    p = table(spark, sf_dir, "part").join(_families(spark, sf_dir), F.col("p_partkey") % 25 == F.col("k"))
    entries = p.select("family", F.concat(F.lit("r"), (F.col("p_size") % 20).cast("string")).alias("role"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("entry"))
    f, contexts, profiles = _context_sides(spark, sf_dir)
    return nested.suite_plans(suites, entries, nested.family_contexts(f, contexts, profiles, False))


def suite_plans(spark, sf_dir):
    return _suites(spark, sf_dir)[0]


def suite_gaps(spark, sf_dir):
    return _suites(spark, sf_dir)[1]


def suite_results(spark, sf_dir):
    """Planned cases run: an outcome by the entry's name, and the counts of each suite."""
    plans, _ = _suites(spark, sf_dir)
    outcome = F.when(F.length("entry") % 5 == 0, "skipped").when(F.length("entry") % 7 == 0, "failed").otherwise("passed")
    return plans.withColumn("outcome", outcome).groupBy("suite").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped")])


SUITES_SQL = CONTEXTS_SQL + """
, u AS (SELECT s_suppkey AS suite, family, unnest([0, 7, 3]) AS d, unnest([0, 1, 2]) AS nth FROM supplier JOIN n ON s_nationkey = k WHERE c OR p),
r AS (SELECT suite, family, nth, 'r' || (suite + d) % 20 AS role FROM u),
e AS (SELECT family, 'r' || p_size % 20 AS role, arg_min(p_name, p_partkey) AS entry FROM part JOIN n ON p_partkey % 25 = k GROUP BY ALL),
j AS (SELECT r.*, entry FROM r LEFT JOIN e USING (family, role)),
m AS (SELECT suite, string_agg(role, ', ' ORDER BY nth) AS roles FROM j WHERE entry IS NULL GROUP BY 1),
q AS (SELECT suite, family, role, entry FROM j WHERE suite NOT IN (SELECT suite FROM m))
"""


def driver_labels(spark, sf_dir):
    """Engine, languages and policies of requests, from labels as people write them."""
    k = F.col("p_partkey").cast("int")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), k % len(names) + 1)
    path = F.concat(F.col("p_partkey").cast("string"), pick(".go", ".JSON", ".jsonc", ".txt", "", ".tar.go"))
    name = pick(" Golang", "json", "", "JSON with comments", "Plain", "rust", "jsonc")
    return table(spark, sf_dir, "part").select(
        "p_partkey", labels.merge_engine(pick("experimental_merge_ir", "owner_path", "x")).alias("engine"), labels.language(name, path).alias("language"), labels.merge_language(name, path).alias("merge_language"),
        labels.render_policy(pick("", " exact ", "  ", "canonical")).alias("render"), labels.fallback_policy(pick("", "none", "full-file", " line", "other")).alias("fallback"),
        labels.fallback_reason(F.when(k % 3 == 0, F.array(F.lit("parse_error"), F.lit("x"))).otherwise(F.array().cast("array<string>"))).alias("reason"),
        labels.base_name(F.concat_ws("/", "p_brand", path)).alias("base"), labels.quality_excluded(pick("unsupported", "merged", "excluded_ambiguous")).alias("excluded"),
    )


LABELS_SQL = """
WITH p AS (SELECT p_partkey, p_partkey || ['.go', '.JSON', '.jsonc', '.txt', '', '.tar.go'][p_partkey % 6 + 1] AS path, p_partkey % 7 AS l, ['go', 'json', 'jsonc', 'text', 'text', 'go'][p_partkey % 6 + 1] AS s FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'experimental_merge_ir' ELSE 'owner_path' END AS engine, CASE l WHEN 0 THEN 'go' WHEN 1 THEN 'json' WHEN 3 THEN 'jsonc' WHEN 4 THEN 'text' WHEN 6 THEN 'jsonc' ELSE s END AS language,
  CASE WHEN l = 0 THEN 'go' WHEN l = 1 THEN 'json' WHEN s IN ('go', 'json') THEN s ELSE ['', '', '', 'json with comments', 'plain', 'rust', 'jsonc'][l + 1] END AS merge_language,
  ['canonical', 'exact', 'canonical', 'canonical'][p_partkey % 4 + 1] AS render, ['none', 'none', 'full_file', 'line', 'other'][p_partkey % 5 + 1] AS fallback,
  CASE WHEN p_partkey % 3 = 0 THEN 'parse_error' ELSE 'structured_merge_failed' END AS reason, path AS base, p_partkey % 3 <> 1 AS excluded FROM p
"""


def safe_names(spark, sf_dir):
    """Names of parts and brands against the rules for languages, symbols, extractors and library paths."""
    from ..functions import text as T

    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))).when(k % 4 == 1, F.col("p_brand")).when(k % 4 == 2, F.repeat(F.lit("ab"), (k % 300).cast("int"))).otherwise(F.concat(F.lit("field:"), "p_name"))
    path = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("/opt/lib"), k.cast("string"), F.lit(".so.1"))).when(k % 6 == 2, "../x.so").when(k % 6 == 3, "/a/b.txt").when(k % 6 == 4, "C:\\x\\y z.dll").otherwise("/a/../lib.dylib")
    return table(spark, sf_dir, "part").select(k, labels.safe_language(name).alias("language"), labels.safe_symbol(name).alias("symbol"), labels.valid_extractor(name).alias("extractor"), F.coalesce(T.sanitized_language(name), F.lit("-")).alias("clean"), F.array_join(T.library_path_errors(path), ",").alias("path_errors"))


NAMES_SQL = r"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) WHEN 1 THEN p_brand WHEN 2 THEN repeat('ab', (p_partkey % 300)::INT) ELSE 'field:' || p_name END AS v FROM part)
SELECT p_partkey, strlen(v) <= 64 AND regexp_full_match(v, '[a-z][a-z0-9_]*') AS language, strlen(v) <= 256 AND regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_]*') AS symbol, starts_with(v, 'field:') AS extractor,
  CASE WHEN regexp_matches(regexp_replace(lower(v), '[^a-z0-9_]', '', 'g'), '^[a-z]') THEN regexp_replace(lower(v), '[^a-z0-9_]', '', 'g') ELSE '-' END AS clean,
  ['empty,not_absolute,extension,filename', '', 'not_absolute,traversal', 'extension', 'filename', 'traversal'][p_partkey % 6 + 1] AS path_errors FROM p
"""


def profile_reports(spark, sf_dir):
    """Profiles of edits with known and unknown values, and what their reports say."""
    k = F.col("p_partkey").cast("int")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), k % len(names) + 1)
    m = labels.match_report(pick("owner_start", "comment_region_start", "x"), pick("owner_end", "owner_end_plus_trailing_gap"), pick("structural_owner_body", "comment_owned_body", "section_branch", "", "y"))
    o = labels.operation_report(pick("replace", "delete", "insert", "move", "z"), pick("none", "optional", "required"), pick("required", "none"), pick("none", "explicit_text", "captured_text_or_explicit", "w"))
    d = labels.destination_report(pick("append_fallback", "anchor_after_statement", "v"), pick("none", "callable", "selector", "u"), pick("none", "statement_end_plus_following_gap"))
    flags = lambda s, *names: F.concat(*[F.when(s[n], "1").otherwise("0") for n in names])
    return table(spark, sf_dir, "part").select(
        "p_partkey", m["start_family"].alias("start_family"), m["end_family"].alias("end_family"), m["payload_family"].alias("payload_family"), flags(m, "known_start", "known_end", "known_payload", "comment_anchored", "gap_extended").alias("match_flags"),
        o["operation_family"].alias("operation_family"), flags(o, "known_kind", "known_source", "known_replacement", "selects_source", "requires_source", "supports_destination", "requires_destination", "explicit_replacement", "may_reuse").alias("operation_flags"),
        d["resolution_family"].alias("resolution_family"), d["source_family"].alias("source_family"), d["anchor_family"].alias("anchor_family"), flags(d, "known_kind", "known_source", "known_anchor", "append_fallback", "anchored").alias("destination_flags"),
    )


PROFILES_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 2 AS b, p_partkey % 3 AS c, p_partkey % 4 AS d, p_partkey % 5 AS e FROM part)
SELECT p_partkey, ['structural_owner', 'comment_anchor', 'unknown'][c + 1] AS start_family, ['structural_owner', 'gap_extension'][b + 1] AS end_family, ['owner_body', 'comment_owned', 'section_branch', 'unknown', 'unknown'][e + 1] AS payload_family,
  (c < 2)::INT || '1' || (e < 3)::INT || (c = 1 OR e = 1)::INT || b AS match_flags, ['rewrite', 'removal', 'insertion', 'relocation', 'unknown'][e + 1] AS operation_family,
  (e < 4)::INT || '1' || (d < 3)::INT || (c > 0)::INT || (c = 2)::INT || (b = 0)::INT || (b = 0)::INT || (d = 1)::INT || (d = 2)::INT AS operation_flags,
  ['append', 'anchored', 'unknown'][c + 1] AS resolution_family, ['implicit', 'callable', 'selector', 'unknown'][d + 1] AS source_family, ['none', 'gap_preserving_statement'][b + 1] AS anchor_family,
  (c < 2)::INT || (d < 3)::INT || '1' || (c = 0)::INT || (c = 1)::INT AS destination_flags FROM p
"""

QUERIES = {f.__name__: f for f in (child_operations, child_outputs, child_failures, nested_merge, review_apply_plan, review_requests, review_rejections, family_contexts, reviewed_contexts, replay_compatibility, suite_plans, suite_gaps, suite_results, driver_labels, safe_names, profile_reports)}
ORACLE_SQL = {
    "child_operations": NEST_SQL + "SELECT * FROM a",
    "child_outputs": NEST_SQL + "SELECT u.doc_id, 'nested:' || idx AS request_id, family, operation_id, address, output FROM u JOIN a ON a.doc_id = u.doc_id AND a.path = u.path WHERE u.doc_id NOT IN (SELECT doc_id FROM f)",
    "child_failures": NEST_SQL + "SELECT * FROM f",
    "nested_merge": NEST_SQL
    + "SELECT doc_id, '# ' || doc_id || chr(10) || '```' || info || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'old' || chr(10) || 'lines' || chr(10) END || '```' || chr(10) || 'between' || chr(10) || '~~~go x' || chr(10) || 'new ' || doc_id || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '~~~' || chr(10) END || tail || chr(10) AS merged FROM d WHERE doc_id NOT IN (SELECT doc_id FROM f)",
    "review_apply_plan": DECISIONS_SQL + "SELECT request_id, \"group\", 'markdown' AS family, min(pos) AS pos FROM g JOIN d USING (request_id) GROUP BY ALL",
    "review_requests": DECISIONS_SQL + "SELECT request_id, \"group\", 'delegated child group ' || \"group\" || ' is ready to apply for markdown.' AS message, true AS blocking, 'apply_delegated_child_group' AS default_action FROM g WHERE request_id NOT IN (SELECT request_id FROM d)",
    "review_rejections": DECISIONS_SQL + "SELECT request_id, pos, 'replay_rejected' AS category, 'request_not_found' AS reason, 'review decision ' || request_id || ' does not match any current delegated child review request.' AS message FROM d WHERE request_id NOT IN (SELECT request_id FROM g)",
    "family_contexts": CONTEXTS_SQL
    + "SELECT family, CASE WHEN c THEN 'explicit' WHEN p AND NOT x THEN 'default' ELSE 'none' END AS context, CASE WHEN c THEN '' WHEN p AND NOT x THEN 'warning' ELSE 'error' END AS severity, CASE WHEN c THEN '' WHEN p AND NOT x THEN 'assumed_default' ELSE 'configuration_error' END AS category, x AS explicit FROM n, (VALUES (true), (false)) v(x)",
    "reviewed_contexts": REVIEWED_SQL,
    "replay_compatibility": REPLAY_SQL,
    "suite_plans": SUITES_SQL + "SELECT * FROM q",
    "suite_gaps": SUITES_SQL + "SELECT suite, 'suite ' || suite || ' declares missing roles: ' || roles || '.' AS message FROM m",
    "suite_results": SUITES_SQL + "SELECT suite, count(*) AS total, count(*) FILTER (WHERE length(entry) % 5 <> 0 AND length(entry) % 7 <> 0) AS passed, count(*) FILTER (WHERE length(entry) % 5 <> 0 AND length(entry) % 7 = 0) AS failed, count(*) FILTER (WHERE length(entry) % 5 = 0) AS skipped FROM q GROUP BY 1",
    "driver_labels": LABELS_SQL,
    "safe_names": NAMES_SQL,
    "profile_reports": PROFILES_SQL,
}
