"""Filter interaction audit: what each of five filters removes, in every order in which they may stand.

A scan turns each document into a hash of its text and the bits of the filters A to D
that it fails.  E is an existential self-join: a left-semi join of the documents with one
row per text, on hash, exact text and a smaller id.  Its ids and those of the other
failures are united and their bits combined by id; what is then counted is combinations
of bits (32 at most) by part, and every order and step is worked out from those counts.

Only texts that share a slot of the Bloom filter of ``exact_dedup`` with another shuffle;
the others cannot have a copy.  The right side of the join holds each text once, so a
text of which there are very many copies is a left side that Spark may split.

Defined results: a null text is empty (it fails A, and E where an empty text has a smaller
id), a null part is the empty string and joins that part, rows without id never fail E and
count as a text's copy for no other, repeated rows count each, equal ids are no smaller
ids.  Rows of labels that share an id count together; a label row without document is not
used.  Texts of any length are read whole.  An empty table gives no rows, since there are
no parts.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of
from .exact_dedup import repeated_slots, split

FILTERS = "ABCDE"
#: The bit of the filter that looks at other documents.
COPY = 1 << FILTERS.index("E")
#: What stands between words.
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: few words (A), few different words (B), capitals (C), marks (D)."""
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.split(bare, r"[ \t-\r]+")
    some = F.when(bare == "", 0).otherwise(1)
    n, distinct = F.size(words) * some, F.size(F.array_distinct(words)) * some
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 200, distinct * 100 < n * 50, capitals.cast("long") * 100 > F.length(text).cast("long") * 3, text.rlike("[#$%&*|]"))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The (doc_id, part, hash) of documents whose text a smaller id has too.

    ``docs`` holds doc_id, part, text and hash, ``rows`` the hashes of all of them.
    """
    slots, n_segments = repeated_slots(rows.select(F.col("hash").alias("text_sha256")), rows.count())
    maybe = split(docs, stored(slots, "bloom"), n_segments, "hash")[0]
    firsts = stored(maybe.groupBy("hash", "text").agg(F.min("doc_id").alias("first")), "firsts")
    f, m = firsts.alias("f"), maybe.alias("m")
    same = (F.col("f.hash") == F.col("m.hash")) & (F.col("f.text") == F.col("m.text")) & (F.col("f.first") < F.col("m.doc_id"))
    return m.join(f, same, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, bits, good, toxic, n): how many documents fail just those filters.

    ``labels`` has doc_id, quality and toxic.
    """
    text = text_of(docs, text_column)
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = stored(keyed.select("doc_id", "part", "hash", own_failures(F.col("text")).alias("bits")), "failures")
    failures = rows.withColumn("n", F.lit(1)).unionByName(copies(keyed, rows).withColumns({"bits": F.lit(COPY), "n": F.lit(0)}))
    marked = failures.repartition("doc_id").groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return (
        marked.join(known, "doc_id", "left")
        .groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.sum("n").alias("n"))
    )


def orders(counted: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: the counts of COUNTS, from the combinations of bits."""
    steps = counted.select("*", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii({}) - ascii('A'))"
    own = bit.format("substring(filter_order, step, 1)")
    before = f"aggregate(transform(slice(split(filter_order, ''), 1, step - 1), c -> {bit.format('c')}), 0, (a, b) -> a | b)"
    steps = steps.withColumns({"own": F.expr(own), "before": F.expr(before)})
    fails, reached = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("before")) == 0
    shares = F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count("bits"), F.lit(1))  # orders in which this filter is the first of those failed: a whole number
    values = (
        F.when(reached & ~fails, F.col("n")), F.when(reached & fails, F.col("n")), F.when(~reached & fails, F.col("n")), F.when(F.col("bits") == F.col("own"), F.col("n")),
        F.when(reached & fails & F.col("good"), F.col("n")), F.when(reached & fails & F.col("toxic"), F.col("n")), F.when(fails, F.col("n") * shares.cast("long")),
    )
    return steps.groupBy("part", "filter_order", "step").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(name) for name, v in zip(COUNTS, values, strict=True)])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(combinations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE coalesce(e.text, '') = d.t AND e.doc_id < d.doc_id) THEN 16 ELSE 0 END) AS bits
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, bit)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, g.step::INT AS step, (SELECT bit FROM x WHERE x.x = filter_order[g.step]) AS own, coalesce((SELECT sum(bit) FROM x WHERE contains(filter_order[:g.step - 1], x.x) AND g.step > 1), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step) g)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (bits & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (bits & own > 0 AND bits & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (bits & own > 0 AND bits & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bits & own > 0 AND bits & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) FILTER (bits & own > 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY ALL
"""
