"""Queries over many edits of one text: line splices, byte splices, line ranges, merges of owned regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splices
from ..sources.tables import table


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _line_edits(docs):
    """Every fifth line or so replaced by its digest, with a second line in some, a range taken away, and faults in some texts."""
    lines = docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"), F.size(F.split("text", "\n")).alias("n"))
    digest = F.md5(F.col("body").cast("binary"))
    some = lines.filter((F.col("line") + F.col("doc_id")) % 5 == 0).select(
        "doc_id", F.col("line").cast("long").alias("edit"), F.col("line").cast("long").alias("start"), (F.col("line") + 1).cast("long").alias("end"),
        F.when(F.col("line") % 2 == 0, F.concat(digest, F.lit("\nadded"))).otherwise(digest).alias("replacement"),
    )
    each = docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    ahead = each.select("doc_id", F.lit(-1).cast("long").alias("edit"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("replacement"))
    # over the whole text, over the end of it, and of a text that is not there
    whole = each.filter("doc_id % 7 = 3").select("doc_id", F.lit(-2).cast("long").alias("edit"), F.lit(0).cast("long").alias("start"), "n", F.lit("").alias("replacement")).withColumnRenamed("n", "end")
    beyond = each.filter("doc_id % 7 = 5").select("doc_id", F.lit(-3).cast("long").alias("edit"), F.lit(0).cast("long").alias("start"), (F.col("n") + 1).alias("end"), F.lit("x").alias("replacement"))
    absent = each.filter("doc_id % 50 = 1").select((-F.col("doc_id")).alias("doc_id"), F.lit(0).cast("long").alias("edit"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("x").alias("replacement"))
    return some.unionByName(ahead).unionByName(whole).unionByName(beyond).unionByName(absent)


def line_splices(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    done, _ = splices.splice(docs, _line_edits(docs), "doc_id", "text", "lines")
    return done.select("doc_id", "edited", F.md5(F.col("result").cast("binary")).alias("digest"))


def line_splice_rejections(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return splices.splice(docs, _line_edits(docs), "doc_id", "text", "lines")[1]


LINES_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, len(l) AS n, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS line FROM d WHERE text IS NOT NULL),
e AS (SELECT doc_id, line, n, CASE WHEN (line + doc_id) % 5 = 0 THEN md5(body) || CASE WHEN line % 2 = 0 THEN chr(10) || 'added' ELSE '' END ELSE body END AS body FROM r),
w AS (SELECT doc_id, n, count(*) FILTER ((line + doc_id) % 5 = 0) AS edits, min(line) FILTER ((line + doc_id) % 5 = 0) AS first, md5('doc ' || doc_id || chr(10) || string_agg(body, chr(10) ORDER BY line)) AS digest FROM e GROUP BY doc_id, n),
f AS (SELECT d.doc_id, d.text, n, edits, w.first, digest, d.doc_id % 7 = 3 AND edits > 0 OR d.doc_id % 7 = 5 AS bad FROM d LEFT JOIN w USING (doc_id))
"""


def byte_splices(spark, sf_dir):
    """The first bytes of every word of a text's first line in brackets, as many edits as words, in one copy."""
    docs = _texts(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("text"))
    words = docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"), F.split("text", " ").alias("ws"))
    # the bytes ahead of a word by a running sum over its words
    from pyspark.sql import Window

    end = F.sum(F.octet_length("w") + 1).over(Window.partitionBy("doc_id").orderBy("i"))
    placed = words.select("doc_id", F.col("i").cast("long").alias("edit"), (end - F.octet_length("w") - 1).alias("start"), (end - 1).alias("end"), F.concat(F.lit("["), F.col("w"), F.lit("]")).alias("replacement"))
    done, _ = splices.splice(docs, placed, "doc_id", "text", "bytes")
    return done.select("doc_id", "result")


def line_ranges(spark, sf_dir):
    """Bytes of runs of lines: of one run by an expression, of each line by a running sum."""
    docs = _texts(spark, sf_dir).filter("text IS NOT NULL")
    first, last = F.col("doc_id") % 4, F.col("doc_id") % 4 + F.col("doc_id") % 3 + 1
    run = docs.select("doc_id", splices.bytes_of_lines(F.col("text"), first, last).alias("r")).select("doc_id", "r.*")
    return run.join(splices.line_offsets(docs, "doc_id", "text").groupBy("doc_id").agg(F.max("end").alias("n_bytes"), F.sum(F.col("start") * (F.col("line") % 7 + 1)).alias("checksum")), "doc_id")


def _sides(spark, sf_dir):
    """A document's lines with changes in one side or both: by line and document, ours and theirs."""
    d = _texts(spark, sf_dir).filter("text IS NOT NULL").withColumn("lines", F.split("text", "\n"))
    k = F.col("doc_id") % 4
    ours = F.transform("lines", lambda x, i: F.when((i + F.col("doc_id")) % 3 == 0, F.concat(F.lit("o "), x)).otherwise(x))
    theirs = F.transform("lines", lambda x, i: F.when((i + F.col("doc_id")) % 3 == 1, F.concat(F.lit("t "), x)).when((k == 1) & ((i + F.col("doc_id")) % 3 == 0), F.concat(F.lit("T "), x)).otherwise(x))
    # ours begins with lines of its own
    ours = F.when(k == 2, F.concat(F.array(F.lit("top"), F.lit("top")), ours)).otherwise(ours)
    theirs = F.when(k == 3, F.concat(F.slice(theirs, F.lit(1), F.size("lines") - 1), F.array(F.lit("x"), F.lit("y")))).otherwise(theirs)
    return d.select("doc_id", F.size("lines").alias("n"), F.col("text").alias("base"), F.array_join(ours, "\n").alias("ours"), F.array_join(theirs, "\n").alias("theirs"))


def _regions(sides):
    """Pairs of lines as regions; where ours has lines before, its regions stand lower."""
    low = F.when(F.col("doc_id") % 4 == 2, 2).otherwise(0)
    r = sides.select("doc_id", "n", low.alias("low"), F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(2))).alias("a")).withColumn("b", F.least(F.col("a") + 2, F.col("n")))
    return r.select("doc_id", (F.col("a") / 2).cast("long").alias("owner"), F.col("a").alias("base_start"), F.col("b").alias("base_end"), (F.col("a") + F.col("low")).alias("ours_start"), (F.col("b") + F.col("low")).alias("ours_end"), F.col("a").alias("theirs_start"), F.when((F.col("doc_id") % 4 == 3) & (F.col("b") == F.col("n")), F.col("b") + 1).otherwise(F.col("b")).alias("theirs_end"))


def region_merges(spark, sf_dir):
    """Regions of two lines merged line by line where that goes, in place; others between conflict marks."""
    sides = _sides(spark, sf_dir)
    done, _ = splices.merge_regions(sides, _regions(sides), "doc_id")
    return done.select("doc_id", F.md5(F.col("result").cast("binary")).alias("digest"))


def region_outcomes(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    return splices.merge_regions(sides, _regions(sides), "doc_id")[1]


REGIONS_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
s AS (SELECT *, doc_id % 4 AS k, i // 2 AS owner, CASE WHEN (i + doc_id) % 3 = 0 THEN 'o ' || x ELSE x END AS o, CASE WHEN (i + doc_id) % 3 = 1 THEN 't ' || x WHEN doc_id % 4 = 1 AND (i + doc_id) % 3 = 0 THEN 'T ' || x ELSE x END AS t FROM r),
g AS (SELECT doc_id, k, n, owner, bool_or(k = 1 AND (i + doc_id) % 3 = 0) OR (k = 3 AND max(i) = n - 1) AS clash,
        string_agg(CASE WHEN o = x THEN t ELSE o END, chr(10) ORDER BY i) AS merged, string_agg(o, chr(10) ORDER BY i) AS ours, string_agg(x, chr(10) ORDER BY i) AS base,
        string_agg(CASE WHEN k = 3 AND i = n - 1 THEN 'x' || chr(10) || 'y' ELSE t END, chr(10) ORDER BY i) AS theirs FROM s GROUP BY doc_id, k, n, owner),
m AS (SELECT doc_id, k, owner, clash, CASE WHEN clash THEN '<<<<<<< ours' || chr(10) || regexp_replace(ours, '\\n+$', '') || chr(10) || '||||||| base' || chr(10) || regexp_replace(base, '\\n+$', '') || chr(10) || '=======' || chr(10) || regexp_replace(theirs, '\\n+$', '') || chr(10) || '>>>>>>> theirs' ELSE merged END AS part FROM g)
"""

QUERIES = {f.__name__: f for f in (line_splices, line_splice_rejections, byte_splices, line_ranges, region_merges, region_outcomes)}
ORACLE_SQL = {
    "line_splices": LINES_SQL + "SELECT doc_id, text IS NOT NULL AND NOT bad AS edited, CASE WHEN text IS NULL THEN NULL WHEN bad THEN md5(text) WHEN doc_id % 7 = 3 THEN md5('doc ' || doc_id) ELSE digest END AS digest FROM f",
    "line_splice_rejections": LINES_SQL
    + """SELECT doc_id, line AS edit, 'overlap' AS category FROM r WHERE (line + doc_id) % 5 = 0 AND doc_id % 7 IN (3, 5) AND line > 0
      UNION ALL SELECT doc_id, CASE WHEN n = 1 THEN 0 ELSE -2 END, 'overlap' FROM f WHERE doc_id % 7 = 3 AND first = 0
      UNION ALL SELECT doc_id, -3, 'out_of_range' FROM f WHERE doc_id % 7 = 5 UNION ALL SELECT -doc_id, 0, 'no_text' FROM d WHERE doc_id % 50 = 1""",
    "byte_splices": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN '[' || replace(string_split(text, chr(10))[1], ' ', '] [') || ']' END AS result FROM documents",
    "line_ranges": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, doc_id % 4 AS a, doc_id % 4 + doc_id % 3 + 1 AS b FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
o AS (SELECT doc_id, i, sum(strlen(x) + CASE WHEN i < n - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS e, strlen(x) + CASE WHEN i < n - 1 THEN 1 ELSE 0 END AS s FROM r)
SELECT d.doc_id, least(coalesce(max(e) FILTER (i < a), 0), strlen(text))::BIGINT AS start, coalesce(max(e) FILTER (i < b), 0)::BIGINT AS "end", strlen(text)::BIGINT AS n_bytes, sum((e - s) * (i % 7 + 1))::BIGINT AS checksum
FROM d JOIN o USING (doc_id) GROUP BY d.doc_id, text""",
    "region_merges": REGIONS_SQL + "SELECT doc_id, md5(CASE WHEN k = 2 THEN 'top' || chr(10) || 'top' || chr(10) ELSE '' END || string_agg(part, chr(10) ORDER BY owner)) AS digest FROM m GROUP BY doc_id, k",
    "region_outcomes": REGIONS_SQL + "SELECT doc_id, owner, CASE WHEN clash THEN 'conflict' ELSE 'merged' END AS outcome FROM m",
}
