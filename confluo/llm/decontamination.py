"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages (runs of SPAN words).
2. A randomised SVD of the passages' TF-IDF matrix A: one distributed pass gives
   Z = A'(A O) for a random O, and Z (O'Z)^-1 Z' approximates A'A, whose leading
   eigenvectors are the latent directions.
3. Overlapping windows of every text are folded in and compared by cosine with
   the benchmark items (those without a vector, of either side, with all of
   the other); a candidate counts if the longest common subsequence of
   the item's words and the words around the window covers most of the item,
   and enough of the item's answer (what follows its last question mark, else
   its last sentence, else its last third).

The benchmark is the query set: it is taken in blocks of at most BLOCK items.
Null or empty texts and items match nothing; repeated ids are separate rows
with results of their own; an empty benchmark leaves every document clean, and an
empty table, or one without words, gives no hits.  Texts of any length are read
whole, in overlapping windows; of equal shares the items are listed by id.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare_words, fresh, lean, slices, table, text_of, utf8

#: Hash buckets of words; latent directions, and extra ones of the random range.
TERMS, RANK, EXTRA = 1 << 13, 64, 8
#: Words of a passage and window, and by how many windows move on.
SPAN, STEP = 32, 16
#: Least cosine of a candidate, and least shares of an item and of its answer found in order.
COSINE, COVER, ANSWER = 0.3, 0.7, 0.5
#: Items, and bytes of items, that are searched for at once.
BLOCK, BLOCK_BYTES = 4096, 1 << 25
#: 64-bit words of the bitmap that bounds a common subsequence from above.
BITS = 16
#: Bytes of text handled at once.
PIECE = 1 << 17
#: Rows from which on a run of rows is summed by itself.
LONG = 12


def _texts(batch: pa.RecordBatch, column: int):
    offsets, data = utf8(batch.column(column))
    for a, b in slices(offsets, PIECE):
        yield a, b, *bare_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _blocks(owner: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` words, the last of a text shorter."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return np.flatnonzero(place % size == 0)


def _block_sums(rows: np.ndarray, term: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows[term]`` over blocks of at most ``size`` terms; the last of ``rows`` is zero and fills short blocks."""
    place = starts[:, None] + np.arange(size)
    ends = np.r_[starts[1:], len(term)][:, None]
    picked = np.where(place < ends, term[np.minimum(place, len(term) - 1)], len(rows) - 1)
    return np.matmul(np.ones((1, size), np.float32), rows[picked])[:, 0]


def _run_sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin there: long runs one by one, the others by their first rows, second rows and so on."""
    size = np.diff(np.r_[begin, len(rows)])
    out = rows[begin]
    for k in np.flatnonzero(size >= LONG):
        out[k] = rows[begin[k] : begin[k] + size[k]].sum(0)
    short = np.flatnonzero((size < LONG) & (size > 1))
    for i in range(1, LONG - 1):
        short = short[size[short] > i]
        out[short] += rows[begin[short] + i]
    return out


@lean
def _frequencies(batches):
    total, passages = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for _, _, code, owner in _texts(batch, 0):
            starts = _blocks(owner, SPAN)
            passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(code)]))
            once = np.sort((passage * TERMS + (code % np.uint64(TERMS)).astype(np.int64)).astype(np.uint32))
            total += np.bincount(once[np.r_[True, once[1:] != once[:-1]][: len(once)]] % TERMS, minlength=TERMS)
            passages += len(starts)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used], pa.int32()), pa.array(np.r_[passages, total[used]])], names=["term", "n"])


def _range(idf: np.ndarray, seed: int):
    """Per task: its part of A'(A O), one row per term."""

    @lean
    def run(batches):
        random = np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA)).astype(np.float32) * idf[:, None]
        total = np.zeros_like(random)
        random, weight = np.r_[random, np.zeros((1, random.shape[1]), np.float32)], idf**2
        for batch in batches:
            for _, _, code, owner in _texts(batch, 0):
                term = (code % np.uint64(TERMS)).astype(np.uint16)
                starts = _blocks(owner, SPAN)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(code)]))
                if not len(term):
                    continue
                y = _block_sums(random, term, starts, SPAN)
                y /= np.add.reduceat(weight[term], starts)[:, None]
                order = np.argsort(term, kind="stable")
                ordered = term[order]
                begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                total[ordered[begin]] += _run_sums(y[passage[order]], begin)
        total *= idf[:, None]
        used = np.flatnonzero(total.any(1))
        for part in np.array_split(used, max(1, len(used) // 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[i].astype(np.float32).tobytes() for i in part], pa.binary())], names=["term", "part"])

    return run


def _added(key, parts):
    rows = [np.frombuffer(x.as_py(), np.float32) for x in parts.column("part")]
    return pa.table({"term": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([np.sum(rows, axis=0, dtype=np.float64).astype(np.float32).tobytes()], pa.binary())})


def latent_space(docs: DataFrame, text_column: str = "text", seed: int = 11) -> np.ndarray:
    """TERMS x RANK: a word's weight times its latent coordinates, each over its singular value."""
    texts = docs.select(F.lower(text_of(docs, text_column)).alias("text"))
    df = texts.mapInArrow(_frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    passages, seen = int(df.n[df.term < 0].sum()), np.zeros(TERMS)
    seen[df.term[df.term >= 0]] = df.n[df.term >= 0]
    idf = (np.log((1 + passages) / (1 + seen)) + 0.1).astype(np.float32)
    sums = texts.mapInArrow(_range(idf, seed), "term int, part binary").groupBy("term").applyInArrow(_added, "term int, part binary").toArrow()
    z = np.zeros((TERMS, RANK + EXTRA))
    for term, part in zip(sums.column("term").to_pylist(), sums.column("part").to_pylist(), strict=True):
        z[term] = np.frombuffer(part, np.float32)
    random = np.random.default_rng(seed).standard_normal(z.shape).astype(np.float32)
    core = random.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-6 * max(value.max(initial=0), 1e-12)
    left, singular, _ = np.linalg.svd(z @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    keep = singular[:RANK] > 1e-6
    return (idf[:, None] * left[:, :RANK][:, keep] / singular[:RANK][keep]).astype(np.float32)


def _answer(text: str) -> str:
    if "?" in text and len(tail := text.rpartition("?")[2].split()) > 0:
        return " ".join(tail)
    sentences = [s for s in re.split(r"(?<=[.!])\s+", text.strip()) if s]
    every = text.split()
    return sentences[-1] if len(sentences) > 1 else " ".join(every[-max(1, len(every) // 3) :])


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return bare_words(data, np.array([0, len(data)]))[0]


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word as bits."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if u := row & masks.get(w, 0):
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def _bitmap(code: np.ndarray) -> np.ndarray:
    """One bit of BITS * 64 for each word, chosen by its hash."""
    out, spot = np.zeros((len(code), BITS), np.uint64), (code >> np.uint64(40)) % np.uint64(64 * BITS)
    out[np.arange(len(code)), (spot >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (spot & np.uint64(63))
    return out


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _search(space, items, items_column: str = "item_ids", cover_column: str = "cover"):
    """Per document: ids of the items found in it, and the largest share of one found in order."""

    @lean
    def run(batches):
        projection, known = np.r_[space.value, np.zeros((1, space.value.shape[1]), np.float32)], items.value
        ids = [i for i, _ in known]
        words = [(_hashes(t), _hashes(_answer(t))) for _, t in known]
        ready = [(len(w), _masks(w), len(a), _masks(a)) for w, a in words]
        bits = np.array([np.bitwise_or.reduce(_bitmap(w)) if len(w) else np.zeros(BITS, np.uint64) for w, _ in words]).reshape(-1, BITS)
        spare = np.array([len(w) - math.ceil(COVER * len(w)) for w, _ in words])
        around = np.array([-(-max(0, len(w) - SPAN // 2) // STEP) for w, _ in words])
        vectors, of = [], []
        for k, (w, _) in enumerate(words):
            cuts = [w] if len(w) <= 2 * SPAN else [w[a : a + SPAN] for a in range(0, len(w), SPAN)]
            for cut in cuts:
                v = projection[(cut % np.uint64(TERMS)).astype(np.int64)].sum(0)
                if len(cut):
                    vectors.append(v / max(np.linalg.norm(v), 1e-30))
                    of.append(k)
        matrix, of = np.array(vectors, np.float32).reshape(len(vectors), projection.shape[1]).T.copy(), np.array(of, np.int64)
        blind = ~matrix.any(0)
        for batch in batches:
            found: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for a, _, code, owner in _texts(batch, batch.num_columns - 1):
                if not len(code) or not matrix.shape[1]:
                    continue
                starts = _blocks(owner, STEP)
                term = (code % np.uint64(TERMS)).astype(np.int64)
                half = _block_sums(projection, term, starts, STEP)
                joint = half.copy()
                more = np.flatnonzero(owner[starts[1:]] == owner[starts[:-1]])
                joint[more] += half[more + 1]
                length = np.linalg.norm(joint, axis=1, keepdims=True)
                # what has no vector, item or window, goes to the exact check with all of the other side
                near = (joint @ matrix >= COSINE * length) | (length == 0) | blind
                window, item = np.divmod(np.flatnonzero(near), matrix.shape[1])
                item = of[item]
                # an item word that is nowhere around the window cannot be in the common subsequence
                present, keep = np.bitwise_or.reduceat(_bitmap(code), starts, axis=0), np.zeros(len(window), bool)
                for reach in np.unique(around[item]):
                    here, region = np.flatnonzero(around[item] == reach), present.copy()
                    for shift in range(1, reach + 2):
                        region[:-shift] |= present[shift:]
                        if shift <= reach:
                            region[shift:] |= present[:-shift]
                    for part in np.array_split(here, len(here) // 100_000 + 1):
                        absent = np.bitwise_count(bits[item[part]] & ~region[window[part]]).sum(1)
                        keep[part] = absent <= spare[item[part]]
                window, item = window[keep], item[keep]
                begin = np.searchsorted(owner, np.arange(owner[-1] + 2))
                for w, k in zip(window.tolist(), item.tolist(), strict=True):
                    text = int(owner[starts[w]])
                    size, masks, n_answer, answer = ready[k]
                    if not size or found[a + text].get(k, 0) >= 1:
                        continue
                    reach = max(0, size - SPAN // 2)
                    near = code[max(begin[text], starts[w] - reach) : min(begin[text + 1], starts[w] + SPAN + reach)].tolist()
                    share = common_subsequence(masks, size, near) / size
                    if share >= COVER and common_subsequence(answer, n_answer, near) >= ANSWER * n_answer:
                        found[a + text][k] = max(share, found[a + text].get(k, 0))
            hits = [sorted(ids[k] for k in f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(hits, pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found])],
                names=[*batch.schema.names[:-1], items_column, cover_column],
            )

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", items_column: str = "item_ids", cover_column: str = "cover") -> DataFrame:
    """``docs`` with the benchmark items found in each text, and the best share of one.

    Input columns named like the two output columns are replaced; all others come back as they were.
    """
    spark, kept = docs.sparkSession, [c for c in docs.columns if c.lower() not in (items_column.lower(), cover_column.lower())]
    found_items, found_cover, folded = (fresh(docs, n) for n in ("_items", "_cover", "_folded"))
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_items, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n_blocks = max(math.ceil(n_items / BLOCK), math.ceil((size or 0) / BLOCK_BYTES))
    nothing = {items_column: F.array().cast("array<bigint>"), cover_column: F.lit(0.0)}
    out = docs.select(*kept).withColumns(nothing)
    if not n_blocks:
        return out
    schema, space = out.schema, spark.sparkContext.broadcast(latent_space(docs, text_column))
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).orderBy("item_id", "text")
        search = partial(_search, space, spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()]))
        own = docs if k == 0 else out.withColumnsRenamed({items_column: found_items, cover_column: found_cover})
        names = kept if k == 0 else [*kept, found_items, found_cover]
        to = schema if k == 0 else own.select(*names).withColumns(nothing).schema
        out = own.select(*names, F.lower(text_of(own, text_column)).alias(folded)).mapInArrow(search(items_column, cover_column), to)
        if k:
            out = out.select(*kept, F.array_sort(F.concat(found_items, items_column)).alias(items_column), F.greatest(found_cover, cover_column).alias(cover_column))
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "cover")
