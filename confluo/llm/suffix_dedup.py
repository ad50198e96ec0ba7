"""Repeated passages: every byte of a LENGTH-byte string that also starts elsewhere goes.

1. Each text's LENGTH-byte windows are dealt by their minimizer: the least hash
   of the GRAM-byte strings in the window, the leftmost of equal ones.  Windows
   that share it and adjoin form a record.  Equal windows have equal minimizers,
   so copies meet under one key wherever they stand.
2. Keys seen once are done.  Equal records under a key are folded, with a count.
3. The different records of a key are joined to one string, whose suffix array
   is built by grouping: suffixes are grouped by their longest Lyndon prefix,
   groups are processed in descending order, each sending its members' pointers
   to the previous smaller suffix, whose groups are split by how often they are
   hit; a second pass emits each group's order along the same pointers, with no
   recursive renaming.  Neighbours in the array that agree on LENGTH bytes mark
   each other; a record seen more than once is marked whole.
4. Marked windows go back to the documents, where their bytes are removed.

A key with more than MAX_RECORDS different records is dealt anew by a longer
context: its windows are cut into runs of neighbouring distances to the
minimizer, and all windows of a run share the bytes around it, whose hash is the
new key.  Runs get shorter until no key is crowded; at one window a run all
records of a key are equal.  Every group goes through the same steps.

Texts are UTF-8 bytes; nulls and empty texts have none, and texts below LENGTH
bytes keep everything.  Very long texts are cut into pieces that overlap.  Rows
that repeat both id and text repeat each other.  An empty table gives an empty
result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, running, spans_hash, stored, table, text_of, utf8

LENGTH, GRAM = 400, 64
WINDOW = LENGTH - GRAM + 1
#: Different records of a key that are handled together, and windows of a run where there are more.
MAX_RECORDS, RUNS = 1000, (48, 6, 1)
#: Bytes handled at once; longer texts are cut, with LENGTH - 1 bytes of overlap.
PIECE = 1 << 19
INDEX = np.uint64((1 << 20) - 1)


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a list of small non-negative integers, by Lyndon grouping."""
    n = len(s)
    if not n:
        return []
    # sa holds the groups in order; home[i] is where the group of suffix i starts, end[g] where group g ends
    sa = sorted(range(n), key=s.__getitem__)
    place, home, end, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for k, i in enumerate(sa):
        if k and s[i] != s[sa[k - 1]]:
            end[start] = k
            start = k
        place[i], home[i] = k, start
    end[start] = n
    top = n
    while top:
        group = home[sa[top - 1]]
        members = sa[group:top]
        if len(members) > 1:
            members.sort()
        hits: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and home[j] >= group:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        top = group
        levels: dict[int, list[int]] = {}
        for j, k in hits.items():
            levels.setdefault(k, []).append(j)
        for k in sorted(levels, reverse=True):
            old: dict[int, int] = {}
            for j in levels[k]:
                h = home[j]
                if h not in old:
                    old[h] = end[h]
                e = end[h] - 1
                end[h] = e
                p, other = place[j], sa[e]
                sa[p], sa[e], place[other], place[j] = other, j, p, e
            for h, e in old.items():
                first = end[h]
                if first == h:
                    end[h] = e
                    continue
                end[first] = e
                for p in range(first, e):
                    home[sa[p]] = first
    # the emptied array is filled from the left; free[g] is the next place of group g
    free, out, done = list(range(n)), [-1] * n, [False] * n
    for i in (n, *range(n)):
        j = (n if i == n else out[i]) - 1
        while j >= 0 and not done[j]:
            g = home[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out


def records(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Records of the windows that start in [first[k], last[k]] for some k: (lo, hi, key, k)."""
    n = len(data) - GRAM + 1
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    gram = spans_hash(running(data), np.arange(n), np.arange(GRAM, len(data) + 1))
    packed = (gram & ~INDEX) | np.arange(n, dtype=np.uint64)
    rows = -(-n // WINDOW)
    square = np.full(rows * WINDOW, ~np.uint64(0))
    square[:n] = packed
    square = square.reshape(rows, WINDOW)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    size = np.maximum(0, last - first + 1)
    owner = np.repeat(np.arange(len(first)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    anchor = (np.minimum(behind[start], ahead[start + WINDOW - 1]) & INDEX).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]) if len(start) else np.zeros(0, np.int64)
    end = np.r_[new[1:], len(start)] - 1 if len(start) else new
    return start[new], start[end], gram[anchor[new]], owner[new]


def _cut(batches):
    """Records of all texts: document key, first and last window, minimizer, digest of the bytes."""
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        size = np.diff(offsets)
        step = PIECE - LENGTH
        pieces = [(i, a) for i, n in enumerate(size.tolist()) if n >= LENGTH for a in range(0, n - LENGTH + 1, step)]
        at = 0
        while at < len(pieces):
            group, total = [], 0
            while at < len(pieces):
                i, a = pieces[at]
                n = int(min(size[i] - a, PIECE - 1))
                if group and total + n > PIECE:
                    break
                group.append((i, a, n))
                total += n
                at += 1
            joined = np.concatenate([data[offsets[i] + a : offsets[i] + a + n] for i, a, n in group])
            base = np.cumsum([0] + [n for _, _, n in group])
            lo, hi, key, k = records(joined, base[:-1], base[1:] - LENGTH)
            raw = joined.tobytes()
            body = [hashlib.blake2b(raw[a : b + LENGTH], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            shift = np.array([a for _, a, _ in group], np.int64)[k] - base[:-1][k]
            rows = np.array([i for i, _, _ in group], np.int64)[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(body, pa.binary())],
                names=["doc", "lo", "hi", "key", "body"],
            )


def marked_windows(bodies: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each record of one key, which of its windows occur more than once."""
    out = [np.full(len(b) - LENGTH + 1, n > 1) for b, n in zip(bodies, counts, strict=True)]
    if len(bodies) == 1 and len(bodies[0]) < 2 * GRAM:
        return out
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    begin = np.cumsum([0] + [len(b) + 1 for b in bodies])
    # only windows whose hash occurs twice can be repeated
    inside = np.ones(len(data), bool)
    inside[begin[1:] - 1] = False
    whole = np.r_[0, np.cumsum(~inside)]
    n = len(data) - LENGTH + 1
    code = spans_hash(running(data), np.arange(n), np.arange(LENGTH, len(data) + 1))
    able = whole[LENGTH:] == whole[:n]
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(able & (times[back] > 1))
    if not len(starts):
        return out
    breaks = np.flatnonzero(np.diff(starts) != 1)
    runs = list(zip(starts[np.r_[0, breaks + 1]].tolist(), starts[np.r_[breaks, len(starts) - 1]].tolist(), strict=True))

    def mark(spots: np.ndarray) -> None:
        which = np.searchsorted(begin, spots, "right") - 1
        for k in np.unique(which):
            out[k][spots[which == k] - begin[k]] = True

    # equal stretches are folded, as equal records were; the array is built over the different ones
    same: dict[bytes, list[tuple[int, int]]] = {}
    for a, b in runs:
        same.setdefault(data[a : b + LENGTH].tobytes(), []).append((a, b))
    for places in same.values():
        if len(places) > 1:
            mark(np.concatenate([np.arange(a, b + 1) for a, b in places]))
    if all(len(places) > 1 for places in same.values()):
        return out
    runs = [places[0] for places in same.values()]
    text, origin = [], []
    for a, b in runs:
        text += (data[a : b + LENGTH].astype(np.int64) + 1).tolist() + [0]
        origin += [*range(a, b + LENGTH), -1]
    room = np.zeros(len(text), bool)
    at = 0
    for a, b in runs:
        room[at : at + b - a + 1] = True
        at += b - a + LENGTH + 1
    packed = np.array(text, np.uint16).tobytes()
    order = [i for i in suffix_array(text) if room[i]]
    hit = set()
    for i, j in zip(order, order[1:], strict=False):
        if packed[2 * i : 2 * (i + LENGTH)] == packed[2 * j : 2 * (j + LENGTH)]:
            hit |= {i, j}
    if hit:
        mark(np.array(sorted(origin[i] for i in hit), np.int64))
    return out


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _grouped(batches):
    """Rows sorted by key: the marked ranges of each record, key by key."""
    key, bodies = None, []

    def settle():
        marks = marked_windows([b for _, b, _ in bodies], [n for _, _, n in bodies])
        for (body, _, _), m in zip(bodies, marks, strict=True):
            for a, b in _ranges(m):
                yield key, body, a, b

    def packed(rows):
        keys, digests, a, b = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["key", "body", "a", "b"])

    rows = []
    for batch in batches:
        for k, body, text, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if bodies:
                    rows += settle()
                key, bodies = k, []
            bodies.append((body, text, n))
        if len(rows) > 5_000:
            yield packed(rows)
            rows = []
    if bodies:
        rows += settle()
    if rows:
        yield packed(rows)


PIECES = "key bigint, body binary, text binary, n bigint, anchor int, of_key bigint, of_body binary, shift int"


def _split(width: int):
    """Records of crowded keys as runs of windows, each with the hash of what all windows of the run share as key."""

    def run(batches):
        for batch in batches:
            out = []
            for key, _, text, n, anchor, of_key, of_body, shift in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                data = np.frombuffer(text, np.uint8)
                sums = running(data)
                if anchor < 0:
                    grams = np.arange(len(data) - GRAM + 1)
                    anchor = int(np.argmax(spans_hash(sums, grams, grams + GRAM).view(np.int64) == key))
                last = len(data) - LENGTH
                for c in range((anchor - last) // width, anchor // width + 1):
                    far, near = max(0, anchor - (c + 1) * width + 1), min(last, anchor - c * width)
                    core = spans_hash(sums, np.array([anchor - c * width]), np.array([anchor - (c + 1) * width + 1 + LENGTH]))
                    new = mix(core + np.uint64(c)) ^ mix(np.array([key], np.int64).view(np.uint64))
                    part = text[far : near + LENGTH]
                    out.append((int(new.view(np.int64)[0]), hashlib.blake2b(part, digest_size=16).digest(), part, n, anchor - far, of_key, of_body, shift + far))
            for a in range(0, len(out), 5_000):
                columns = zip(*out[a : a + 5_000], strict=True)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
                names = [f.split()[0] for f in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _slices(batches):
    for batch in batches:
        offsets, data = utf8(batch.column(0))
        rows, texts = [], []
        for i, found in enumerate(batch.column(1).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            for r in found:
                rows.append(r)
                texts.append(raw[r["lo"] : r["hi"] + LENGTH])
        for a in range(0, len(rows), 5_000):
            part = rows[a : a + 5_000]
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in part], pa.int64()), pa.array([r["body"] for r in part], pa.binary()), pa.array(texts[a : a + 5_000], pa.binary()), pa.array([r["n"] for r in part], pa.int64()), pa.array([r["crowded"] for r in part], pa.bool_())], names=["key", "body", "text", "n", "crowded"])


def _removed(batches):
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        out = []
        for i, found in enumerate(batch.column(2).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            spans: list[list[int]] = []
            for r in sorted(found or (), key=lambda r: r["a"]):
                a, b = r["a"], r["b"] + LENGTH
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), b"".join([*kept, raw[at:]]), [{"start": a, "end": b} for a, b in spans]))
        sizes, gone, runs, kept, removed = zip(*out, strict=True) if out else ((), (), (), (), ())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(doc, a, b): ranges of window starts that are repeated.  ``keyed``: doc and text."""
    cut = stored(keyed.select("doc", "text").mapInArrow(_cut, "doc binary, lo int, hi int, key bigint, body binary"), "records")
    folded = cut.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "lo", "hi")).alias("one"))
    folded = stored(folded, "folded")
    keys = folded.groupBy("key").agg(F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("total")).filter("total > 1")
    shared = folded.join(keys, "key")
    plain = shared.filter("bodies = 1").select("key", "body", F.lit(0).alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b"))
    wanted = shared.filter("bodies > 1").select("key", "body", "n", "one", (F.col("bodies") > MAX_RECORDS).alias("crowded"))
    by_doc = wanted.groupBy(F.col("one.doc").alias("doc")).agg(F.collect_list(F.struct("key", "body", "n", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), "crowded")).alias("found"))
    one_each = keyed.select("doc", "text").join(by_doc, "doc").dropDuplicates(["doc"])
    texts = stored(one_each.select("text", "found").mapInArrow(_slices, "key bigint, body binary, text binary, n bigint, crowded boolean"), "variants")
    found = stored(plain.unionByName(_marked(texts.filter("not crowded").select("key", "body", "text", "n"))), "repeated")
    crowd = texts.filter("crowded").select("key", "body", "text", "n", F.lit(-1).alias("anchor"), F.col("key").alias("of_key"), F.col("body").alias("of_body"), F.lit(0).alias("shift"))
    levels = [found]
    for width in RUNS:
        if crowd.isEmpty():
            break
        pieces = stored(crowd.mapInArrow(_split(width), PIECES), "pieces")
        once = pieces.groupBy("key", "body").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
        keys = stored(pieces.groupBy("key", "body").agg(F.sum("n").alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("total")).filter("total > 1"), "piece-keys")
        fits = stored(_marked(once.join(keys.filter(F.col("bodies") <= MAX_RECORDS), "key", "left_semi")), "piece-ranges")
        levels.append(pieces.join(fits, ["key", "body"]).select(F.col("of_key").alias("key"), F.col("of_body").alias("body"), (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.col("b")).alias("b")))
        crowd = pieces.join(keys.filter(F.col("bodies") > MAX_RECORDS), "key", "left_semi").select(*pieces.columns)
    whole = reduce(DataFrame.unionByName, levels)
    return cut.join(whole, ["key", "body"]).select("doc", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))


def _marked(rows: DataFrame) -> DataFrame:
    """(key, body, a, b): ranges of repeated windows of the different records (key, body, text, n) of each key."""
    return rows.select("key", "body", "text", "n").repartition("key").sortWithinPartitions("key").mapInArrow(_grouped, "key bigint, body binary, a int, b int")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, the remaining bytes, kept, and the removed runs, removed (start, end)."""
    text = text_of(docs, text_column)
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("?")), F.lit(":"), text).cast("binary"))).alias("doc"), text.alias("text"))
    spans = repeated_ranges(keyed).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_removed, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, removed array<struct<start:int,end:int>>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeats"), "removed", left.alias("kept_text"))
