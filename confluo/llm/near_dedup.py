"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are lower-cased and cut at ASCII white space.  The k-mers of a text are
its runs of five words, each labelled with its occurrence number; a sketch takes
the ``PICK`` least of them under a random order and keeps them in text order, so
two texts agree on it only if they share k-mers in the same order.  Texts that
agree on a sketch are candidates; a banded alignment of their words decides: a
link is an edit similarity (1 - distance / longer length) of at least 0.8.  Bounds of the distance come first; the band decides
where they leave it open.

Before texts are fetched, the joins compare lengths and outlines (small MinHashes of
the words), which few pairs below the threshold pass.

Equal texts are folded into one node first.  Within a bucket each text is
aligned with the bucket's least text, which links the members of large groups in linear work.
Then, where a bucket holds several components, all its pairs of different ones follow if
it has at most FEW texts; in larger buckets the texts of other components are aligned with
the bucket's text of most links, for ``ROUNDS`` rounds.  What larger buckets
still hold apart is paired by its rarest words: two texts that are near share one of the
first words of each, as many as may be changed and one more, whatever the order of words,
so no pair of such a bucket that the outlines allow goes untested while it lies in two components.
Of these pairs each text's likeliest come first, which join most texts to their class.
Classes are the connected components of the links.

Nulls count as the empty text; empty texts are one class.  Texts of one to four
words have one k-mer of all their words; very long texts are read whole, and pairs
whose band would be too large are aligned by bit vectors instead, with the same
result.  Ids may be null or repeated; an empty table gives an empty result; other
columns, whatever their names, come back as they were.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, discard, distance_within, fresh, join_hot, lean, mix, running, slices, spans_hash, stored, table, text_of, utf8, words
from .components import components

WORDS, SKETCHES, PICK, SIMILARITY = 5, 32, 2, 0.8
#: MinHashes of a text's outline, and how many must agree: of pairs at SIMILARITY all but about one in 5000 do.
MINIMA, ALIKE = 96, 50
FEATURES = ("size", *[f"s{i}" for i in range(MINIMA // 16)])
#: Texts of a bucket up to which all pairs of different components are aligned.
FEW = 128
#: Rounds of larger buckets against their text of most links, and how many of the likeliest partners by a rare word are aligned first.
ROUNDS, LIKELIEST = 2, 8
#: Cells of a band from which on bit vectors align a pair.
MAX_CELLS = 20_000_000
U = np.uint64


def kmers(word: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers in text order, and the text of each."""
    size = np.bincount(owner, minlength=n_texts)
    first = np.cumsum(size) - size
    code, padded = np.zeros(len(word), U), np.r_[word, np.zeros(WORDS, U)]
    left = (first + size)[owner] - np.arange(len(word))
    for j in range(WORDS):
        code = code * U(BASE) + np.where(left > j, padded[j : j + len(word)], U(0))
    starts = (left >= WORDS) | (np.arange(len(word)) == first[owner])
    return labelled(mix(code[starts]), owner[starts]), owner[starts]


def labelled(code: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Codes that tell apart the occurrences of one code in a text, in text order."""
    code = code.copy()
    pair = mix(code + mix(owner.astype(U)))
    ordered = np.sort(pair)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        at = np.minimum(np.searchsorted(again, pair), len(again) - 1)
        spots = np.flatnonzero(again[at] == pair)
        order = np.argsort(pair[spots], kind="stable")
        run = pair[spots][order]
        begin = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1]
        number = np.arange(len(run)) - np.repeat(begin, np.diff(np.r_[begin, len(run)]))
        code[spots[order]] += mix(number.astype(U)) * U(2) + U(1)
    return code


def outlines(word: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text that has words: their number, and four bits of each of MINIMA MinHashes of its labelled words, sixteen to a long."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    code, out = labelled(word, owner), np.zeros((len(first), MINIMA // 16), U)
    for i in range(MINIMA):
        least = np.minimum.reduceat(mix(code ^ U((i + 1) * BASE & 0xFFFFFFFFFFFFFFFF)), first)
        out[:, i // 16] |= (least & U(15)) << U(4 * (i % 16))
    return np.diff(np.r_[first, len(owner)]), out.view(np.int64)


def sketches(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have words, and their sketches (texts x SKETCHES)."""
    starts, ends, owner = words(data, offsets)
    return sketched(spans_hash(running(data), starts, ends), owner, len(offsets) - 1)


def sketched(word: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    code, owner = kmers(word, owner, n_texts)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros((0, SKETCHES), np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
    out = np.empty((len(first), SKETCHES), np.int64)
    top = U(0xFFFFFFFFFFFFFFFF)
    for i in range(SKETCHES):
        h = mix(code ^ mix(np.array([i + 1], U)))
        found, place = [], []
        for _ in range(PICK):
            least = np.minimum.reduceat(h, first)
            at = np.flatnonzero(h == least[row])
            spot = np.full(len(first), len(h))
            spot[row[at][::-1]] = at[::-1]
            found.append(least)
            place.append(np.where(least == top, len(h), spot))
            h[at] = top
        by_place = np.argsort(np.stack(place), axis=0, kind="stable")
        picked = np.take_along_axis(np.stack(found), by_place, 0)
        key = np.full(len(first), i + 1, U)
        for x in picked:
            key = mix(key * U(BASE) + x)
        out[:, i] = key.view(np.int64)
    return owner[first], out


@lean
def _sketch(batches):
    """One row a text: key, size, outline, and the sketches as bytes; texts without words have none."""
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for a, b in slices(offsets):
            bounds, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
            starts, ends, owner = words(part, bounds)
            if not len(starts):
                continue
            word = spans_hash(running(part), starts, ends)
            rows, values = sketched(word, owner, b - a)
            size, outline = outlines(word, owner)
            blob = np.ascontiguousarray(values).tobytes()
            raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * 8 * SKETCHES, 8 * SKETCHES, dtype=np.int32).tobytes()), pa.py_buffer(blob)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + a)), pa.array(size.astype(np.int32)), *[pa.array(outline[:, i]) for i in range(MINIMA // 16)], raw], names=["key", *FEATURES, "sketches"])


@lean
def _buckets(batches):
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        buckets = data[offsets[0] : offsets[-1]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), SKETCHES)))], names=["bucket", "key"])


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], share: float) -> np.ndarray:
    """Edit distances of word sequences as far as they lie within ``share`` of the longer length, else -1."""
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    bound = np.floor(share * size.max(1, initial=0)).astype(np.int64)
    out = np.full(len(pairs), -1)
    todo = np.flatnonzero(np.abs(size[:, 0] - size[:, 1]) <= bound)
    long = size[todo].max(1) * (2 * bound[todo] + 1) > MAX_CELLS
    for i in todo[long]:
        a, b = pairs[i]
        d = distance_within(a.tolist(), b.tolist(), int(bound[i]))
        out[i] = -1 if d is None else d
    todo = todo[~long]
    todo = todo[np.argsort(size[todo].max(1), kind="stable")]
    while len(todo):
        cells = np.cumsum(2 * bound[todo] + 1)
        part, todo = np.split(todo, [max(1, int(np.searchsorted(cells, 150_000)))])
        k, rows, wide = int(bound[part].max()), int(size[part, 0].max()), int(size[part, 1].max())
        a, b = np.zeros((len(part), rows), U), np.ones((len(part), max(rows, wide) + 2 * k + 1), U)
        for i, p in enumerate(part):
            a[i, : size[p, 0]] = pairs[p][0]
            b[i, k : k + size[p, 1]] = pairs[p][1]
        step = np.arange(2 * k + 1, dtype=np.int32)
        now = np.broadcast_to(np.where(step >= k, step - k, 1 << 28).astype(np.int32), (len(part), 2 * k + 1)).copy()
        last, end = size[part, 0], size[part, 1] - size[part, 0] + k
        result = now[np.arange(len(part)), end]
        for i in range(rows):
            new = now + (a[:, i : i + 1] != b[:, i : i + 2 * k + 1])
            np.minimum(new[:, :-1], now[:, 1:] + 1, out=new[:, :-1])
            new -= step
            np.minimum.accumulate(new, axis=1, out=new)
            new += step
            now = new
            done = last == i + 1
            if done.any():
                result[done] = now[np.flatnonzero(done), end[done]]
        out[part] = np.where(result <= bound[part], result, -1)
    return out


def distance_bounds(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Bounds of the edit distance of two word sequences that need no table.

    Below: words of the longer one that the other lacks.  Above: the alignment
    along words that occur once in either, word by word in gaps of equal width.
    """
    in_a, at_a, n_a = np.unique(a, return_index=True, return_counts=True)
    in_b, at_b, n_b = np.unique(b, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(in_a, in_b, assume_unique=True, return_indices=True)
    longer = max(len(a), len(b))
    low = longer - int(np.minimum(n_a[x], n_b[y]).sum())
    if low > (1 - SIMILARITY) * longer + 1:
        return low, longer
    once = (n_a[x] == 1) & (n_b[y] == 1)
    i, j = at_a[x[once]], at_b[y[once]]
    j = j[order := np.argsort(i)]
    chosen = _increasing(j.tolist())
    i, j = np.r_[-1, i[order][chosen], len(a)], np.r_[-1, j[chosen], len(b)]
    wide_a, wide_b = np.diff(i) - 1, np.diff(j) - 1
    even = np.flatnonzero(wide_a == wide_b)
    size = wide_a[even]
    place = np.repeat(i[even] + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    differ = a[place] != b[place + np.repeat(j[even] - i[even], size)]
    return low, int(np.maximum(wide_a, wide_b).sum() - size.sum() + differ.sum())


def _increasing(values: list[int]) -> np.ndarray:
    """Places of a longest increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(ends, v)
        if at == len(ends):
            ends.append(v)
            last.append(k)
        else:
            ends[at], last[at] = v, k
        before[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1], np.int64)


def similar(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether two columns of texts have edit similarity of SIMILARITY or more, row by row."""
    found = []
    for column in (left, right):
        offsets, data = utf8(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends, owner = words(data, offsets)
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        hashes = spans_hash(running(data), starts, ends) | U(2)
        found.append([hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    pairs, ok, rest = list(zip(*found, strict=True)), np.zeros(len(left), bool), []
    for i, (a, b) in enumerate(pairs):
        low, high = distance_bounds(a, b)
        most = int((1 - SIMILARITY + 1e-9) * max(len(a), len(b)))
        ok[i] = high <= most
        if low <= most < high:
            rest.append(i)
    ok[rest] = aligned([pairs[i] for i in rest], 1 - SIMILARITY + 1e-9) >= 0
    return ok


@lean
def _verify(batches):
    for batch in batches:
        offsets = np.maximum.accumulate(utf8(batch.column(2))[0] + utf8(batch.column(3))[0])
        for a, b in slices(offsets):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similar(part.column(2), part.column(3)))], names=["a", "b", "near"])


def links(texts: DataFrame) -> DataFrame:
    """(a, b): keys of near-duplicate texts, b the less.  ``texts``: key and folded text, keys may repeat."""
    return _searched(texts)[0]


def _searched(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and the classes (node, root) that they make."""
    kinds = ", ".join(["key binary", "size int", *[f"{f} bigint" for f in FEATURES[1:]], "sketches binary"])
    known = stored(texts.select("key", "text").mapInArrow(_sketch, kinds).dropDuplicates(["key"]), "sketches")
    entries = known.select("key", "sketches").mapInArrow(_buckets, "bucket bigint, key binary")
    block = Window.partitionBy("bucket")
    shared = stored(entries.withColumns({"low": F.min("key").over(block), "high": F.max("key").over(block)}).filter("low != high").drop("high"), "shared")
    features = stored(known.select("key", *FEATURES).join(shared.select("key").distinct(), "key", "left_semi"), "features")
    # no join by key follows the bitmap: Spark would do it first, and shuffle all texts
    kept = stored(_with_keys(texts.select("key", "text"), features.select("key")).dropDuplicates(["key"]), "candidates")
    discard(known)

    def near(pairs: DataFrame, sifted: bool = False) -> DataFrame:
        """Pairs (a, b) with whether they are near; those whose features rule it out are left out, if they are not yet."""
        likely = pairs
        if not sifted:
            for side, end in (("a", ""), ("b", "_b")):
                likely = likely.join(features.select(F.col("key").alias(side), *[F.col(f).alias(f"{f}{end}") for f in FEATURES]), side)
            likely = stored(likely.filter(_likely()).select("a", "b"), "likely")
        both = likely
        for side in ("a", "b"):
            both = both.join(_with_keys(kept, likely.select(F.col(side).alias("key"))).select(F.col("key").alias(side), F.col("text").alias(f"text_{side}")), side)
        return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary, near boolean"), "checked")

    tried = stored(_untried(shared.filter("key != low").select("key", F.col("low").alias("b")), None), "pairs")
    checks = [near(tried)]
    roots = stored(components(_linked(checks)), "roots")

    def joined(new: DataFrame) -> DataFrame:
        """The classes with further links."""
        return stored(components(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "roots")

    mixed = _mixed(shared.select("bucket", "key"), roots)
    discard(shared)
    sizes = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    few, many = (mixed.join(sizes.filter(which).select("bucket"), "bucket", "left_semi") for which in (F.col("n") <= FEW, F.col("n") > FEW))
    apart = stored(few.join(features, "key"), "apart")
    others = apart.select(F.col("bucket").alias("of"), F.col("key").alias("b"), F.col("root").alias("root_b"), *[F.col(f).alias(f"{f}_b") for f in FEATURES])
    rest = apart.join(others, (F.col("bucket") == F.col("of")) & (F.col("key") > F.col("b")) & (F.col("root") != F.col("root_b")) & _likely()).select("key", "b")
    mixed, before = stored(many, "mixed"), mixed
    discard(before)
    for _ in range(ROUNDS):
        found = _linked(checks)
        degree = found.select(F.col("a").alias("key")).unionByName(found.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
        ranked = mixed.join(degree, "key", "left").select("bucket", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "key", "root").alias("lead"))
        hubs = stored(ranked.groupBy("bucket").agg(F.max("lead").alias("lead"), F.count(F.lit(1)).alias("n")), "hubs")
        tests = join_hot(mixed, hubs.select("bucket", F.col("lead.key").alias("b"), F.col("lead.root").alias("root_b"), "n"), "bucket", "n").filter("root != root_b").select("key", "b")
        pairs = stored(_untried(tests if rest is None else tests.unionByName(rest), tried), "pairs")
        checks.append(near(pairs))
        tried, rest, new = tried.unionByName(pairs), None, checks[-1].filter("near").select("a", "b")
        if new.isEmpty():
            break
        roots, before = joined(new), roots
        discard(before, hubs)
        if mixed.isEmpty():
            break
        before, mixed = mixed, _mixed(mixed.select("bucket", "key"), roots)
        discard(before)
        if mixed.isEmpty():
            break
    left = None if mixed.isEmpty() else stored(_across(mixed, kept, features).join(tried, (F.greatest("key", "other") == F.col("a")) & (F.least("key", "other") == F.col("b")), "left_anti"), "across")
    # the likeliest partners of each text first; most are of its class then
    for likeliest in (True, False):
        if left is None or left.isEmpty():
            break
        best = left.groupBy("key", F.pmod(F.xxhash64("other"), F.lit(LIKELIEST))).agg(F.min_by("other", F.struct("unlike", "other")).alias("other")) if likeliest else left
        pairs = stored(_untried(best.select("key", F.col("other").alias("b")), None), "pairs")
        checks.append(near(pairs, sifted=True))
        new = checks[-1].filter("near").select("a", "b")
        if not new.isEmpty():
            roots, before = joined(new), roots
            discard(before)
        if likeliest:
            apart_yet = left.join(pairs, (F.greatest("key", "other") == F.col("a")) & (F.least("key", "other") == F.col("b")), "left_anti")
            for side in ("key", "other"):
                apart_yet = apart_yet.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
            left, before = stored(apart_yet.filter("root_key != root_other").select("key", "other", "unlike"), "across"), left
            discard(before)
    discard(mixed, apart, kept, features)
    return _linked(checks), roots


#: Slots in which words are counted to put the rare ones first; any order of words gives the same pairs.
SLOTS = 1 << 16


def _labelled_words(batch: pa.RecordBatch):
    """Of slices of a batch (key, text): the first row, the labelled words, and the text of each."""
    offsets, data = utf8(batch.column(1))
    for a, b in slices(offsets):
        bounds, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        starts, ends, owner = words(part, bounds)
        if len(starts):
            yield a, labelled(spans_hash(running(part), starts, ends), owner), owner


@lean
def _counted(batches):
    often = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, code, _ in _labelled_words(batch):
            often += np.bincount((code % U(SLOTS)).astype(np.int64), minlength=SLOTS)
    slot = np.flatnonzero(often)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(often[slot])], names=["slot", "n"])


@lean
def _rarest(batches, often: np.ndarray):
    """(key, word): of each text the rarest labelled words, one more than may differ between it and a text near it."""
    for batch in batches:
        for a, code, owner in _labelled_words(batch):
            size = np.bincount(owner)
            order = np.lexsort((code, often[(code % U(SLOTS)).astype(np.int64)], owner))
            rank = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            taken = order[rank <= np.floor((1 - SIMILARITY + 1e-9) * size[owner])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[taken] + a)), pa.array(code[taken].view(np.int64))], names=["key", "word"])


def _across(mixed: DataFrame, kept: DataFrame, features: DataFrame) -> DataFrame:
    """(key, other, unlike): all pairs of texts of different components of ``mixed`` that may be near, by a rare word that both have, and how far their outlines differ.

    Near texts have all words in common but those that may differ, so the first of each
    in one order meet.  Texts of a word's largest component meet only those of others.
    """
    keys = stored(mixed.select("key", "root").distinct(), "crowded")
    texts = stored(kept.join(keys, "key").select("key", "text", "root"), "crowded-texts")
    often = np.zeros(SLOTS, np.int64)
    for slot, n in texts.select("key", "text").mapInArrow(_counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        often[slot] = n
    held = stored(texts.select("key", "text").mapInArrow(partial(_rarest, often=often), "key binary, word bigint").join(keys, "key"), "rarest")
    per = held.groupBy("word", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    here = stored(held.join(per, "word").join(features, "key"), "crowded-words")
    others = here.select(F.col("word").alias("of"), F.col("key").alias("b"), F.col("root").alias("root_b"), *[F.col(f).alias(f"{f}_b") for f in FEATURES])
    once = (F.col("root_b") == F.col("major")) | (F.col("key") > F.col("b"))
    pairs = stored(here.filter("root != major").join(others, (F.col("word") == F.col("of")) & (F.col("root") != F.col("root_b")) & once & _likely()).select("key", F.col("b").alias("other"), _unlike().alias("unlike")).distinct(), "across-words")
    discard(keys, texts, held, here)
    return pairs


def _linked(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.filter("near").select("a", "b") for c in checks])


#: Bits of a map of wanted keys: 4 MB, whatever the input.
KEY_BITS = 1 << 25


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys``: a bitmap of fixed size is broadcast, and nothing shuffles."""
    slot = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS))
    maps = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    probe = rows.withColumn("part", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "part")
    bit = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return probe.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), bit % 8 + 1)) != 0).select(*rows.columns)


def _mixed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, key, root) of the entries of buckets that hold several components; a text without links is one by itself."""
    named = stored(entries.join(roots, F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("root", "key").alias("root")), "named")
    several = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    mixed = stored(named.join(several, "bucket", "left_semi"), "mixed")
    discard(named)
    return mixed


def _untried(tests: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of tests, b the less, that were not looked at yet."""
    pairs = tests.select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b")).distinct()
    return pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _unlike() -> Column:
    """How many entries of two outlines differ."""
    differ = F.lit(0)
    for f in FEATURES[1:]:
        x = F.col(f).bitwiseXOR(F.col(f"{f}_b"))
        some = x
        for i in range(1, 4):
            some = some.bitwiseOR(F.shiftrightunsigned(x, i))
        differ = differ + F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))
    return differ


def _likely() -> Column:
    """Whether sizes and outlines let two texts be similar: of SIMILARITY or more, two thirds of their labelled words at least are common."""
    longer = F.greatest("size", "size_b")
    close = F.abs(F.col("size") - F.col("size_b")) <= F.floor(F.lit(1 - SIMILARITY + 1e-9) * longer)
    return close & (_unlike() <= MINIMA - ALIKE)


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), class_size, n_links, kept, key.

    ``kept`` marks one document of each class: the least id; of rows that repeat
    that id one is kept.  ``n_links`` counts other texts found near its own.
    """
    folded = F.lower(text_of(docs, text_column))
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.md5(folded.cast("binary"))).alias("key"), folded.alias("text"))
    found, node = _searched(keyed.select("key", "text"))
    degree = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rows = stored(
        keyed.select("doc_id", "key").join(node.join(degree, "node"), keyed["key"] == F.col("node"), "left")
        .select("doc_id", F.lower(F.hex("key")).alias("key"), F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.monotonically_increasing_id().alias("_row")),
        "members",
    )
    best = rows.groupBy("root").agg(F.min(F.struct("doc_id", "_row")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return join_hot(rows, stored(best, "classes"), "root", "class_size").select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", "n_links", (F.col("_row") == F.col("best._row")).alias("kept"), "key")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one of each class.

    Rows that repeat both id and text stay or go together; exact deduplication
    before this removes them.
    """
    own, gone_id, gone_key = (fresh(docs, n) for n in ("_own", "_gone_id", "_gone_key"))
    marked = classes(docs, id_column, text_column)
    stays = marked.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"))
    gone = stays.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key))
    keyed = docs.withColumn(own, F.md5(F.lower(text_of(docs, text_column)).cast("binary")))
    return keyed.join(gone, keyed[id_column].eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_key)), "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")
