"""Exact deduplication: a two-pass Bloom filter decides which rows need a shuffle.

Pass 1 turns each text into a SHA-256 digest and counts, per slot of a Bloom
filter, whether it is hit more than once.  Pass 2 probes the slots that were:
a row with a slot of its own cannot have a copy and passes straight through;
the others ("possibly repeated") shuffle by digest and are compared exactly.
False positives cost a shuffled row, never a wrong result.

The filter has SLOTS_PER_ROW slots a row up to 32 MB, the bound of what is broadcast
(about 17 million rows; a fuller one lets more rows shuffle).  Nulls count as the
empty text; texts of any length are digested whole; an empty table gives an empty
result; other columns, whatever their names, come back as they were.  Rows equal in text and in ``doc_id`` are copies
of each other too; one of them stays.  A null ``doc_id`` sorts below all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, join_hot, stored, table, text_of

#: Slots per digest, and slots per row of the filter before its bound.
HASHES, SLOTS_PER_ROW = 3, 16
#: The filter's rows: 1 KB each; 2**15 of them (32 MB) at most are broadcast.
SEGMENT_BITS, MAX_SEGMENTS = 1 << 13, 1 << 15


def _slots(n_segments: int, digest: str = "text_sha256"):
    """Column expressions: the filter row of a digest and its bits in that row."""
    segment = F.pmod(F.xxhash64(digest), F.lit(n_segments)).cast("int")
    bits = [F.pmod(F.xxhash64(F.lit(i + 1), digest), F.lit(SEGMENT_BITS)).cast("int") for i in range(HASHES)]
    return segment, bits


def _partial(n_segments: int):
    """Per task: one row per filter segment, with bits seen and bits seen again."""

    def run(batches):
        once = np.zeros(n_segments * SEGMENT_BITS // 8, np.uint8)
        twice = np.zeros_like(once)
        touched = np.zeros(n_segments, bool)
        for batch in batches:
            segment = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            touched[segment] = True
            for i in range(HASHES):
                at = segment * SEGMENT_BITS + batch.column(1 + i).to_numpy(zero_copy_only=False)
                at = np.sort(at)
                again = at[1:][at[1:] == at[:-1]]
                at = np.unique(at)
                byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                seen = (once[byte] & bit) != 0
                np.bitwise_or.at(twice, byte[seen], bit[seen])
                np.bitwise_or.at(twice, again >> 3, (1 << (again & 7)).astype(np.uint8))
                np.bitwise_or.at(once, byte, bit)
        width = SEGMENT_BITS // 8
        rows = np.flatnonzero(touched)
        for part in np.array_split(rows, max(1, len(rows) // 1024)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([once[s * width : (s + 1) * width].tobytes() for s in part], pa.binary()), pa.array([twice[s * width : (s + 1) * width].tobytes() for s in part], pa.binary())],
                names=["segment", "once", "twice"],
            )

    return run


def _merged(key, parts):
    once = twice = None
    for a, b in zip(parts.column("once"), parts.column("twice"), strict=True):
        a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "repeated": pa.array([twice.tobytes()], pa.binary())})


def repeated_slots(digests: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """The filter of slots hit more than once: (segment, repeated), one row per segment.

    It has SLOTS_PER_ROW slots a row up to MAX_SEGMENTS * SEGMENT_BITS; a larger
    table has a fuller filter and so shuffles more rows, with the same result.
    """
    wanted = max(1, math.ceil(n_rows * SLOTS_PER_ROW / SEGMENT_BITS))
    n_segments = min(MAX_SEGMENTS, 1 << (wanted - 1).bit_length())
    segment, bits = _slots(n_segments)
    hits = digests.select(segment.alias("segment"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    partial = hits.mapInArrow(_partial(n_segments), "segment int, once binary, twice binary")
    return partial.groupBy("segment").applyInArrow(_merged, "segment int, repeated binary"), n_segments


def split(rows: DataFrame, slots: DataFrame, n_segments: int, digest: str = "text_sha256") -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a digest column) as (possibly repeated, certainly alone); neither shuffles."""
    segment, bits = _slots(n_segments, digest)
    where, again, maybe = (fresh(rows, n) for n in ("_segment", "_repeated", "_maybe"))
    probe = rows.withColumn(where, segment).join(F.broadcast(slots.select(F.col("segment").alias(where), F.col("repeated").alias(again))), where, "left")
    hit = F.lit(True)
    for b in bits:
        byte = F.conv(F.hex(F.substring(again, F.floor(b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & (byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), b % 8 + 1)) != 0)
    probe = probe.withColumn(maybe, F.coalesce(hit, F.lit(False)))
    return probe.filter(F.col(maybe)).select(*rows.columns), probe.filter(~F.col(maybe)).select(*rows.columns)


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    digests = stored(
        docs.select(F.col(id_column).alias("doc_id"), F.sha2(text_of(docs, text_column).cast("binary"), 256).alias("text_sha256")).withColumn("_row", F.monotonically_increasing_id()),
        "digests",
    )
    slots, n_segments = repeated_slots(digests, digests.count())
    slots = stored(slots, "bloom")
    maybe, alone = split(digests, slots, n_segments)
    best = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    marked = join_hot(maybe, stored(best, "copies"), "text_sha256", "group_size").select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256"
    )
    return marked.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; rows without copies do not shuffle."""
    sha, keep, own = (fresh(docs, n) for n in ("_sha", "_keep", "_own"))
    keyed = docs.withColumn(sha, F.sha2(text_of(docs, text_column).cast("binary"), 256))
    digests = stored(keyed.select(F.col(id_column).alias("_id"), F.col(sha).alias("text_sha256")), "digests")
    slots, n_segments = repeated_slots(digests, digests.count())
    slots = stored(slots, "bloom")
    best = split(digests, slots, n_segments)[0].groupBy(F.col("text_sha256").alias(sha)).agg(F.max("_id").alias(keep), F.count(F.lit(1)).alias(own))
    maybe, alone = split(keyed, slots, n_segments, sha)
    kept = join_hot(maybe, stored(best, "copies"), sha, own).filter(F.col(id_column).eqNullSafe(F.col(keep))).dropDuplicates([sha])
    return kept.select(*docs.columns).unionByName(alone.select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""
