"""Fuzzy line deduplication: SimHash and pigeonhole blocks, edit similarity, connected groups.

1. Lines are normalised (lower case, ASCII white space collapsed) and equal ones
   folded.  Each gets a 64-bit SimHash of its words, and MINIMA MinHashes of its
   word pairs: four bits of each make a sketch, PICK at a time make a band.
2. Lines share a block where they agree on a band, or on enough blocks of the
   SimHash: by the pigeonhole principle hashes that differ in at most DISTANCE bits
   agree on at least BLOCKS - DISTANCE of BLOCKS blocks, so every choice of that
   many blocks is a join key.
3. Within a block each line is tested against the block's least line first, then
   all pairs that these links leave in different components, so no two lines of a
   block stay apart untested.  The join itself compares lengths, SimHashes (at most
   REACH bits different) and sketches (at least ALIKE equal entries); what passes is
   linked if its edit similarity (1 - Levenshtein / longer length) is at least
   SIMILARITY.
4. Of each connected group the first occurrence stays: by doc_id (null first),
   document and line number.

Hashes and edit distances are numpy inside tasks: with DataFrame functions alone
the whole job takes many times the time allowed (figures in the README).
Small distances of SimHashes reach few of the lines that are similar at 0.8, hence
the bands; lines of one to three words that differ are mostly not found.

Blank lines are never removed.  Nulls count as the empty text.  Rows that repeat
both id and text are one document here and get the same result each.  An empty
table gives an empty result.  Very long lines are read whole, with an edit distance
whose memory grows with the longer line.  Other columns, whatever their names, are
neither read nor changed.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, LETTERS, discard, distance_within, fresh, join_hot, mix, running, slices, spans_hash, stored, table, text_of, utf8, words
from .components import components
from .near_dedup import _increasing

BLOCKS, DISTANCE, SIMILARITY = 4, 2, 0.8
#: MinHashes of a line; bands, and MinHashes of word pairs in a band.
MINIMA, BANDS, PICK = 48, 14, 2
#: Bits of two SimHashes that may differ, and sketch entries that must agree, where lines share a block.
REACH, ALIKE = 18, 17
#: Bytes of a band in storage: few unrelated lines share one even among 10**11.
BAND_BYTES = 5
#: First bit and width of the blocks of a hash.
WIDTHS = [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS - 64 * i // BLOCKS) for i in range(BLOCKS)]
#: Bits of the bitmap of wanted lines: 4 MB, whatever the input.
SLOTS = 1 << 25
U = np.uint64


def normal_lines(offsets: np.ndarray, data: np.ndarray):
    """Normalised lines that are not blank: (bytes, starts, ends, text of each, line number of each)."""
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.r_[offsets, breaks])
    starts, ends, owner = words(data, bounds)
    size = ends - starts + 1
    at = np.cumsum(size) - size
    joined = np.r_[data, np.uint8(32)][np.repeat(starts - at, size) + np.arange(size.sum())]
    joined[at + size - 1] = 32
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(owner)] - 1 if len(owner) else first
    text = np.searchsorted(offsets, starts[first], "right") - 1
    number = np.searchsorted(breaks, starts[first]) - np.searchsorted(breaks, offsets[text])
    return joined, at[first], at[last] + size[last] - 1, text, number


def summaries(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """SimHash, MinHashes (lines x MINIMA) of normalised lines; a line without letters or digits is one word."""
    bare = np.where(LETTERS[joined] == 1, joined, 32).astype(np.uint8)
    bounds = np.r_[starts, len(joined)]
    first, last, owner = words(bare, bounds)
    code = spans_hash(running(joined), first, last)
    blank = np.setdiff1d(np.arange(len(starts)), owner)
    if len(blank):
        order = np.argsort(np.r_[owner, blank], kind="stable")
        code = np.r_[code, spans_hash(running(joined), starts[blank], ends[blank])][order]
        owner = np.r_[owner, blank][order]
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    n = np.diff(np.r_[head, len(owner)])
    after = np.r_[code[1:], U(0)]
    after[np.r_[head[1:], len(owner)] - 1] = 0
    pair = mix(code * U(BASE) + after)
    minima = np.empty((len(head), MINIMA), U)
    for i in range(MINIMA):
        minima[:, i] = np.minimum.reduceat(pair ^ U((i + 1) * BASE & 0xFFFFFFFFFFFFFFFF), head)
    # counters of 8 bits, eight to a word: lines are counted in parts of 255 words
    place = np.arange(len(owner)) - np.repeat(head, n)
    part = np.flatnonzero(place % 255 == 0)
    of_line = np.searchsorted(part, head)
    ones = np.empty((len(head), 8, 8), np.int64)
    for i in range(8):
        lanes = np.add.reduceat((code >> U(i)) & U(0x0101010101010101), part).view(np.uint8).reshape(-1, 8)
        ones[:, :, i] = np.add.reduceat(lanes.astype(np.int64), of_line, axis=0)
    tie = mix(np.minimum.reduceat(code, head)).view(np.uint8).reshape(-1, 8)
    tie = np.unpackbits(tie, axis=1, bitorder="little").reshape(-1, 8, 8)
    twice = 2 * ones
    bits = (twice > n[:, None, None]) | ((twice == n[:, None, None]) & (tie == 1))
    return np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(U).ravel(), minima


def sketches(minima: np.ndarray) -> np.ndarray:
    """Four bits of each MinHash, sixteen to a word: lines x 3."""
    four = mix(minima.ravel()).reshape(minima.shape) & U(15)
    shift = U(4) * np.arange(16, dtype=U)
    return np.stack([np.bitwise_or.reduce(four[:, i : i + 16] << shift, axis=1) for i in range(0, MINIMA, 16)], 1)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """Block keys of each line from its MinHashes: lines x BANDS."""
    keys = []
    for i in range(BANDS):
        key = np.full(len(minima), i + 1, U)
        for j in range(PICK):
            key = mix(key * U(BASE) + minima[:, i + j * BANDS])
        keys.append(key)
    return np.stack(keys, 1)


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """Block keys of each line from its SimHash: one for each choice of blocks that must agree."""
    keys = []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        key = np.full(len(hashes), BANDS + k + 1, U)
        for i in chosen:
            first, width = WIDTHS[i]
            key = mix(key * U(BASE) + ((hashes >> U(first)) & U((1 << width) - 1)))
        keys.append(key)
    return np.stack(keys, 1)


def _fixed(raw: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes as a binary column."""
    n = raw.size // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _digests(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16-byte digests of the lines."""
    raw = joined.tobytes()
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint8)


def _parts(batch: pa.RecordBatch, column: int):
    offsets, data = utf8(batch.column(column))
    for a, b in slices(offsets):
        joined, starts, ends, text, number = normal_lines(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        if len(starts):
            yield joined, starts, ends, text + a, number


def _cut(batches):
    """One row a line: document, number, digest, and what blocks and joins need of it."""
    for batch in batches:
        for joined, starts, ends, text, number in _parts(batch, 2):
            hashes, minima = summaries(joined, starts, ends)
            lead = np.r_[0, np.cumsum((joined & 0xC0) != 0x80)]
            three = sketches(minima).view(np.int64)
            keys = band_keys(minima).view(np.uint8).reshape(len(starts), BANDS, 8)[:, :, :BAND_BYTES]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number.astype(np.int32)), _fixed(_digests(joined, starts, ends), 16), pa.array((lead[ends] - lead[starts]).astype(np.int32)),
                 pa.array(hashes.view(np.int64)), *[pa.array(three[:, i]) for i in range(3)], _fixed(keys, BANDS * BAND_BYTES)],
                names=["doc_id", "doc", "pos", "key", "size", "hash", "s0", "s1", "s2", "bands"],
            )


def _entries(batches):
    """(block, id) of every block of every line."""
    for batch in batches:
        offsets, data = utf8(batch.column(2))
        bands = np.zeros((batch.num_rows, BANDS, 8), np.uint8)
        bands[:, :, :BAND_BYTES] = data[offsets[0] : offsets[-1]].reshape(-1, BANDS, BAND_BYTES)
        blocks = np.concatenate([bands.view(np.int64)[:, :, 0], block_keys(batch.column(1).to_numpy().view(U)).view(np.int64)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(blocks.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), blocks.shape[1])))], names=["block", "id"])


def _slot(digests: np.ndarray) -> np.ndarray:
    return (digests.reshape(-1, 16)[:, :8].copy().view(U).ravel() % U(SLOTS)).astype(np.int64)


def _bitmap(batches):
    """The wanted digests of a task as one bitmap, in pieces that are not empty."""
    bits = np.zeros(SLOTS, bool)
    for batch in batches:
        offsets, data = utf8(batch.column(0))
        bits[_slot(data[offsets[0] : offsets[-1]])] = True
    packed = np.packbits(bits, bitorder="little").reshape(64, -1)
    full = np.flatnonzero(packed.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[i].tobytes() for i in full], pa.binary())], names=["piece", "bits"])


def _united(key, parts):
    """One piece of the bitmap from at most 64 tasks."""
    bits = [np.frombuffer(x.as_py(), np.uint8) for x in parts.column("bits")]
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(bits).tobytes()], pa.binary())})


def _wanted(bitmap):
    """(key, line) of the lines whose digest may be wanted."""

    def run(batches):
        bits = np.unpackbits(bitmap.value, bitorder="little").view(bool)
        for batch in batches:
            for joined, starts, ends, _, _ in _parts(batch, 0):
                digests = _digests(joined, starts, ends)
                hit = np.flatnonzero(bits[_slot(digests)])
                if len(hit):
                    raw = joined.tobytes()
                    lines = pa.array([raw[a:b] for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([_fixed(digests.reshape(-1, 16)[hit], 16), lines], names=["key", "line"])

    return run


def _texts(folded: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, line) of the lines in ``pairs``; a bitmap of fixed size keeps most others from the shuffle."""
    spark = folded.sparkSession
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    keys = stored(known.select("id", "key").join(wanted, "id"), "line-wanted")
    bits = np.zeros((64, SLOTS // 8 // 64), np.uint8)
    maps = keys.select("key").coalesce(64).mapInArrow(_bitmap, "piece int, bits binary").groupBy("piece").applyInArrow(_united, "piece int, bits binary")
    for r in maps.collect():
        bits[r.piece] = np.frombuffer(r.bits, np.uint8)
    lines = folded.mapInArrow(_wanted(spark.sparkContext.broadcast(bits.ravel())), "key binary, line binary")
    texts = stored(lines.join(keys, "key").dropDuplicates(["id"]).select("id", "line"), "line-texts")
    discard(keys)
    return texts


def similar_within(a: np.ndarray, b: np.ndarray, bound: int) -> bool:
    """Whether the edit distance of two arrays of code points is at most ``bound``.

    Equal ends are cut off; then bounds from the common words are tried, and bit
    vectors of the whole column (one Python integer each) decide what they leave open.
    """
    if abs(len(a) - len(b)) > bound:
        return False
    k = min(len(a), len(b))
    same = np.flatnonzero(a[:k] != b[:k])
    first = int(same[0]) if len(same) else k
    a, b = a[first:], b[first:]
    k -= first
    same = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    last = int(same[0]) if len(same) else k
    a, b = a[: len(a) - last], b[: len(b) - last]
    if max(len(a), len(b)) <= bound:
        return True
    if not len(a) or not len(b):
        return False
    least = np.bincount(a & 127, minlength=128) - np.bincount(b & 127, minlength=128)
    if max(least[least > 0].sum(), -least[least < 0].sum()) > bound:
        return False
    if _by_words(a, b) <= bound:
        return True
    if len(a) > len(b):
        a, b = b, a
    return distance_within(a.tolist(), b.tolist(), bound) is not None


def _by_words(a: np.ndarray, b: np.ndarray) -> int:
    """An edit distance from above: along words that occur once in either, with gaps replaced."""
    found = []
    for x in (a, b):
        cut = np.flatnonzero(x == 32)
        starts, ends = np.r_[0, cut + 1], np.r_[cut, len(x)]
        up = np.r_[U(0), np.cumsum(mix(x.astype(U) + U(1) + (np.arange(len(x)) - starts[np.searchsorted(starts, np.arange(len(x)), "right") - 1]).astype(U) * U(BASE)))]
        code = up[ends] - up[starts]
        word, at, n = np.unique(code, return_index=True, return_counts=True)
        found.append((word[n == 1], starts[at[n == 1]], ends[at[n == 1]]))
    (wa, sa, ea), (wb, sb, eb) = found
    _, i, j = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
    order = np.argsort(sa[i])
    i, j = i[order], j[order]
    chosen = _increasing(sb[j].tolist())
    i, j = i[chosen], j[chosen]
    wide_a, wide_b = np.r_[sa[i], len(a)] - np.r_[0, ea[i]], np.r_[sb[j], len(b)] - np.r_[0, eb[j]]
    even = (wide_a == wide_b) & (wide_a > 0)
    start_a, start_b = np.r_[0, ea[i]][even], np.r_[0, eb[j]][even]
    size = wide_a[even]
    place = np.repeat(start_a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    differ = int((a[place] != b[place + np.repeat(start_b - start_a, size)]).sum())
    return int(np.maximum(wide_a, wide_b).sum() - size.sum()) + differ


def _verify(batches):
    """The pairs whose lines are similar."""
    points = lambda x: np.frombuffer(x.as_py().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    for batch in batches:
        near = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = points(left), points(right)
            near.append(similar_within(a, b, int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-6)))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _verified(folded: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of line ids whose lines have edit similarity of SIMILARITY or more."""
    texts = _texts(folded, known, pairs)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    found = stored(both.select("a", "b", "line_a", "line_b").mapInArrow(_verify, "a bigint, b bigint"), "line-links")
    discard(texts)
    return found


CARRIED = ("size", "hash", "s0", "s1", "s2")


def _crowded(known: DataFrame) -> DataFrame:
    """(block, id, lead) and what tests compare, of the lines that share a block with others; ``lead`` is the block's least line."""
    block = Window.partitionBy("block")
    entries = known.select("id", "hash", "bands").mapInArrow(_entries, "block bigint, id bigint")
    led = entries.withColumns({"lead": F.min("id").over(block), "last": F.max("id").over(block)}).filter("last != lead").drop("last")
    crowd = stored(led, "line-blocks")
    found = stored(crowd.join(known.select("id", *CARRIED), "id"), "line-blocks")
    discard(crowd)
    return found


def _likely() -> Column:
    """Whether length, SimHash and sketch let two lines of a block be similar."""
    longer = F.greatest("size", "size_b")
    near = F.abs(F.col("size") - F.col("size_b")) <= F.floor(F.lit(1 - SIMILARITY + 1e-9) * longer)
    close = F.bit_count(F.col("hash").bitwiseXOR(F.col("hash_b"))) <= REACH
    ones = F.lit(0x1111111111111111)
    differ = []
    for c in ("s0", "s1", "s2"):
        x = F.col(c).bitwiseXOR(F.col(f"{c}_b"))
        differ.append(F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, i) for i in range(1, 4)], x).bitwiseAND(ones)))
    return near & close & (differ[0] + differ[1] + differ[2] <= MINIMA - ALIKE)


def _apart(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the likely pairs of a block that lie in different components; b is the less."""
    named = crowd.drop("lead").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    mixed = named.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("block")
    left = stored(named.join(mixed, "block"), "line-entries")
    other = left.select(F.col("block").alias("block_b"), *[F.col(c).alias(f"{c}_b") for c in ("id", "root", *CARRIED)])
    pairs = left.join(other, (F.col("block") == F.col("block_b")) & (F.col("id") > F.col("id_b")) & (F.col("root") != F.col("root_b")) & _likely())
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def groups(folded: DataFrame, known: DataFrame) -> DataFrame:
    """(node, root): ids of lines near other lines, and the least of their group.

    ``folded`` has the lower-case texts; ``known`` id, key, bands, size, hash and
    sketch of each distinct line.  Groups are what all tests within the blocks
    would join; pairs that others join already are not tested.
    """
    crowd = _crowded(known)
    leads = crowd.filter("id = lead").select(F.col("block").alias("block_b"), *[F.col(c).alias(f"{c}_b") for c in CARRIED])
    led = crowd.join(leads, (F.col("block") == F.col("block_b")) & (F.col("id") != F.col("lead")) & _likely())
    tests = stored(led.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), "line-pairs")
    roots = stored(components(_verified(folded, known, tests)), "line-roots")
    rest = stored(_apart(crowd, roots).join(tests, ["a", "b"], "left_anti"), "line-rest")
    more = _verified(folded, known, rest)
    found = stored(components(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "line-groups")
    discard(crowd, tests, roots, rest, more)
    return found


def _document_key(id_column: str, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("?")), F.lit(":"), text).cast("binary")))


def cut_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each line that is not blank: doc_id, doc, pos, key, size, hash, s0, s1, s2, bands."""
    text = text_of(docs, text_column)
    source = docs.select(F.col(id_column).alias("doc_id"), _document_key(id_column, text).alias("doc"), F.lower(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_cut, f"doc_id {kind}, doc binary, pos int, key binary, size int, hash bigint, s0 bigint, s1 bigint, s2 bigint, bands binary")


def distinct_lines(cut: DataFrame) -> DataFrame:
    """(id, key, n, bands, size, hash and sketch) of each distinct line."""
    once = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("bands", *CARRIED)])
    return stored(once.withColumn("id", F.monotonically_increasing_id()), "known-lines")


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, removed): per document key, the numbers of the lines that go."""
    cut = stored(cut_lines(docs, id_column, text_column), "lines")
    known = distinct_lines(cut)
    discard()
    node = groups(docs.select(F.lower(text_of(docs, text_column)).alias("text")), known)
    grouped = known.select("id", "key", "n").join(node, F.col("id") == F.col("node"), "left").select("key", "n", F.coalesce("root", "id").alias("root"))
    totals = grouped.groupBy("root").agg(F.sum("n").alias("total")).filter("total > 1")
    doubled = stored(grouped.join(totals, "root").select("key", "root", "n"), "line-doubled")
    places = stored(join_hot(cut.select("doc_id", "doc", "pos", "key"), doubled, "key", "n").select("doc_id", "doc", "pos", "root"), "line-places")
    stays = stored(places.groupBy("root").agg(F.min(F.struct("doc_id", "doc", "pos")).alias("stays"), F.count(F.lit(1)).alias("n")), "line-stays")
    gone = join_hot(places, stays, "root", "n").filter(~F.struct("doc_id", "doc", "pos").eqNullSafe(F.col("stays")))
    discard(cut, known, node, doubled)
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with their remaining lines as text, and all other columns as they were."""
    doc, key, removed = (fresh(docs, n) for n in ("_doc", "_key", "_removed"))
    gone = repeated_lines(docs, id_column, text_column).select(F.col("doc").alias(doc), F.col("removed").alias(removed))
    joined = docs.withColumn(key, _document_key(id_column, text_of(docs, text_column))).join(gone, F.col(key) == F.col(doc), "left")
    left = F.array_join(F.filter(F.split(text_column, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")
    return joined.withColumn(text_column, F.when(F.col(removed).isNull(), F.col(text_column)).otherwise(left)).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = text_of(docs)
    heads = docs.select("doc_id", _document_key("doc_id", text).alias("doc"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    marked = heads.join(repeated_lines(docs), "doc", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return marked.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
