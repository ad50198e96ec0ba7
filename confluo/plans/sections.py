"""Queries over heading sections: their tree and paths, and readmes whose family section is kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections
from ..sources.tables import table


def _headed(spark, sf_dir):
    """Documents whose lines are headings of several levels by number, some blank, some with signs but no heading."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    k = lambda i: (F.col("doc_id") * 3 + i * 5) % 13

    def line(x, i):
        marks = [(F.lit(m), n) for n, m in ((1, "## "), (3, "### "), (4, " # "), (6, "#### "), (8, "## "), (9, "####### "), (11, "#"))]
        out = F.when(k(i) == 0, "")
        for mark, n in marks:
            out = out.when(k(i) == n, F.concat(mark, x))
        return out.otherwise(x)

    return d.select("doc_id", "lang", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def heading_tree(spark, sf_dir):
    """Each heading with the end of its section and the heading above it."""
    return sections.section_tree(_headed(spark, sf_dir), "doc_id", "text").select("doc_id", "line", "level", "title", "end", "parent")


def heading_paths(spark, sf_dir):
    """The titles from the top to each heading, digested."""
    found = sections.section_paths(sections.section_tree(_headed(spark, sf_dir), "doc_id", "text"), "doc_id")
    return found.select("doc_id", "line", F.md5(F.col("path").cast("binary")).alias("path"))


#: The section that a family's readmes share.
PARTIAL = "## {SM|FAMILY_SECTION_HEADING}\n\n{SM|SELF_LANG} ({SM|SELF_LANG_ID}) at {SM|SELF_PACKAGE_ROOT}: {SM|FAMILY_DESCRIPTION}\n\n- {SM|IMP_LANG1}: {SM|IMP_LANG1_PACKAGE_ROOT}\n- {SM|IMP_LANG3_ID}: {SM|IMP_LANG3_PACKAGE_MANAGER} {SM|IMP_LANG4} {KJ|OTHER}\n\n"


def _families(spark, sf_dir):
    """A family for each document: its heading is the document's first level-two heading, another's text, or none that is there."""
    d = _headed(spark, sf_dir)
    second = F.regexp_extract("text", r"(?m)^## (.*)$", 1)
    own = F.element_at(F.array(*[F.lit(x) for x in (*sections.LANGUAGES, "python")]), (F.col("doc_id") % 5 + 1).cast("int"))
    heading = F.when((F.col("doc_id") % 3 == 0) | (second == "") | second.rlike(r"^\s|\s$"), F.lit("Family")).otherwise(second)
    entry = lambda x: F.struct(F.concat(F.lit("packages/"), F.lit(x)).alias("root"), F.concat(F.lit("pm-"), F.lit(x)).alias("manager"))
    others = F.create_map(*[c for x in ("go", "rust", "typescript") for c in (F.lit(x), entry(x))])
    family = F.struct(heading.alias("heading"), F.col("lang").alias("description"), own.alias("own"), F.concat(F.lit("self/"), own).alias("own_root"), F.lit("pm").alias("own_manager"), others.alias("others"))
    missing = F.col("doc_id") % 10 == 9
    return d.select("doc_id", "lang", family.cast(sections.FAMILY).alias("family"), F.when(~missing, F.col("text")).alias("text"))


def readme_sections(spark, sf_dir):
    """Readmes with the family section replaced, inserted, or begun anew, and whether that changed them."""
    f = _families(spark, sf_dir).withColumns({"name": F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "summary": F.lit("A summary.")})
    done = sections.family_readmes(f, "text", "family", "name", "summary", PARTIAL, "new")
    return done.select("doc_id", F.md5(F.col("new").cast("binary")).alias("digest"), (~F.col("new").eqNullSafe(F.col("text"))).alias("changed"), F.col("text").isNull().alias("created"))



HEADED_SQL = r"""
WITH d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, lang, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
h0 AS (SELECT doc_id, lang, i, CASE (doc_id * 3 + i * 5) % 13 WHEN 0 THEN '' WHEN 1 THEN '## ' || x WHEN 3 THEN '### ' || x WHEN 4 THEN ' # ' || x WHEN 6 THEN '#### ' || x WHEN 8 THEN '## ' || x WHEN 9 THEN '####### ' || x WHEN 11 THEN '#' || x ELSE x END AS x FROM r),
h AS (SELECT *, max(CASE WHEN x <> '' THEN i ELSE -1 END) OVER (PARTITION BY doc_id) + 1 AS n, regexp_replace(x, '^\s+|\s+$', '', 'g') AS b FROM h0),
t AS (SELECT *, length(regexp_extract(b, '^(#{1,6}) ', 1)) AS level FROM h WHERE i < n),
g AS (SELECT doc_id, i, level, n, regexp_replace(regexp_replace(x, '^\s*#{1,6} ', ''), '^\s+|\s+$', '', 'g') AS title FROM t WHERE level > 0),
e AS (SELECT g.*, (SELECT min(o.i) FROM g o WHERE o.doc_id = g.doc_id AND o.i > g.i AND o.level <= g.level) AS stop, (SELECT max(o.i) FROM g o WHERE o.doc_id = g.doc_id AND o.i < g.i AND o.level < g.level) AS parent FROM g)
"""
QUERIES = {f.__name__: f for f in (heading_tree, heading_paths, readme_sections)}
ORACLE_SQL = {
    "heading_tree": HEADED_SQL + 'SELECT doc_id, i::INT AS line, level::INT AS level, title, coalesce(stop, n)::INT AS "end", parent::INT AS parent FROM e',
    "heading_paths": HEADED_SQL.replace("WITH d", "WITH RECURSIVE d", 1)
    + ", p(doc_id, i, path, parent) AS (SELECT doc_id, i, title, parent FROM e UNION ALL SELECT p.doc_id, p.i, e.title || '/' || p.path, e.parent FROM p JOIN e ON e.doc_id = p.doc_id AND e.i = p.parent) SELECT doc_id, i::INT AS line, md5(path) AS path FROM p WHERE parent IS NULL",
    "readme_sections": HEADED_SQL
    + r""", w AS (SELECT doc_id, lang, string_agg(x, chr(10) ORDER BY i) AS src FROM h GROUP BY doc_id, lang),
s AS (SELECT *, regexp_extract(src, '(?m)^## (.*)$', 1) AS second FROM w),
f AS (SELECT doc_id, lang, src, doc_id % 10 = 9 AS missing, CASE WHEN doc_id % 3 = 0 OR second = '' OR regexp_matches(second, '^\s|\s$') THEN 'Family' ELSE second END AS heading, ['go', 'ruby', 'rust', 'typescript', 'python'][doc_id % 5 + 1] AS own FROM s),
o AS (SELECT *, list_filter(['go', 'ruby', 'rust', 'typescript'], lambda x: x <> own) AS others, MAP {'go': 'Go', 'ruby': 'Ruby', 'rust': 'Rust', 'typescript': 'TypeScript'} AS names FROM f),
v AS (SELECT *, '## ' || heading || chr(10) || chr(10) || coalesce(names[own], own) || ' (' || own || ') at self/' || own || ': ' || lang || chr(10) || chr(10) || '- ' || names[others[1]] || ': ' || CASE WHEN others[1] = 'ruby' THEN '' ELSE 'packages/' || others[1] END || chr(10)
  || '- ' || others[3] || ': ' || CASE WHEN others[3] = 'ruby' THEN '' ELSE 'pm-' || others[3] END || ' ' || CASE WHEN len(others) = 4 THEN names[others[4]] ELSE '{SM|IMP_LANG4}' END || ' {KJ|OTHER}' AS section FROM o),
m AS (SELECT v.*, (SELECT min(i) FROM t WHERE t.doc_id = v.doc_id AND b = '## ' || heading) AS spot, (SELECT max(n) FROM h WHERE h.doc_id = v.doc_id) AS n,
  (SELECT max(level) FROM t WHERE t.doc_id = v.doc_id AND i = 0) = 1 AS titled FROM v),
z AS (SELECT *, coalesce((SELECT min(i) FROM t WHERE t.doc_id = m.doc_id AND i > spot AND level BETWEEN 1 AND 2), n) AS stop,
  CASE WHEN titled THEN coalesce((SELECT min(i) FROM t WHERE t.doc_id = m.doc_id AND i >= 1 AND x <> ''), n) ELSE 0 END AS body FROM m),
y AS (SELECT *, coalesce((SELECT min(i) FROM t WHERE t.doc_id = z.doc_id AND i >= body AND x = ''), n) AS blank FROM z),
q AS (SELECT *, coalesce((SELECT min(i) FROM t WHERE t.doc_id = y.doc_id AND i >= blank AND x <> ''), n) AS place FROM y),
c AS (SELECT *, CASE WHEN spot IS NULL THEN place ELSE spot END AS cut, CASE WHEN spot IS NULL THEN place ELSE stop END AS resume FROM q),
u AS (SELECT c.*, (SELECT string_agg(x || chr(10), '' ORDER BY i) FROM t WHERE t.doc_id = c.doc_id AND i < cut) AS head, (SELECT string_agg(x || chr(10), '' ORDER BY i) FROM t WHERE t.doc_id = c.doc_id AND i >= resume) AS tail,
  spot IS NULL AND (SELECT max(x) FROM t WHERE t.doc_id = c.doc_id AND i = cut - 1) <> '' AS gap, (SELECT max(x) FROM t WHERE t.doc_id = c.doc_id AND i = resume) <> '' AS space FROM c),
k AS (SELECT doc_id, missing, src, CASE WHEN missing THEN '# doc' || doc_id || chr(10) || chr(10) || 'A summary.' || chr(10) || chr(10) || section || chr(10) WHEN n = 0 THEN section || chr(10)
  ELSE coalesce(head, '') || CASE WHEN gap THEN chr(10) ELSE '' END || section || chr(10) || CASE WHEN space THEN chr(10) ELSE '' END || coalesce(tail, '') END AS new FROM u)
SELECT doc_id, md5(new) AS digest, missing OR new <> src AS changed, missing AS created FROM k
""",
}
