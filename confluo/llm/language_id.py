"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams hashed to buckets.  Document
frequencies cover every learning document; the weights are fitted on a bounded
sample with follow-the-regularised-leader and elastic-net penalties, and a
temperature fitted on rows kept apart calibrates the probabilities.

A text that is null or has no letter is ``und`` with score 0.  Empty tables and
tables without a language give ``und`` throughout.  Ties between languages go
to the one first in alphabetical order; null ids and repeated rows are predicted
like any other, and texts of any length whole.  The caller may name the two output
columns; input columns of those names are replaced, all others stay as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, fold, fresh, mix, slices, table, text_of, utf8

#: n-gram lengths, and hash buckets they share.
LENGTHS, BUCKETS = (1, 2, 3), 1 << 16
#: Documents of each language that the classifier is fitted on, by a hash of the id; never more than 1.2 times as many in all.
MAX_PER_LANGUAGE = 1000
#: FTRL step sizes and elastic-net penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
#: Factor of the features: shares of n-grams are small numbers, with which few steps would learn next to nothing.
SCALE = 50.0


def _grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the text each belongs to."""
    lead = (data & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(lead)][offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(chars) - 1), np.diff(chars))
    owner = owner[: len(points)]
    found, owners, code = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        size = max(0, len(points) - n + 1)
        code = code[:size] * np.uint64(BASE) + points[n - 1 :] + np.uint64(n)
        if n in LENGTHS:
            whole = owner[:size] == owner[n - 1 :]
            found.append((mix(code) >> np.uint64(48))[whole].astype(np.int32))
            owners.append(owner[:size][whole])
    return np.concatenate(found), np.concatenate(owners)


def _each(batch: pa.RecordBatch, column: int):
    offsets, data = utf8(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, *_grams(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])


def _frequencies(batches):
    """Per task: in how many texts each bucket occurs."""
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for a, b, gram, owner in _each(batch, 0):
            kind = np.uint32 if b - a <= 1 << 16 else np.uint64
            key = np.sort(owner.astype(kind) * kind(BUCKETS) + gram.astype(kind))
            once = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            total += np.bincount((once % kind(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used], pa.int32()), pa.array(np.r_[rows, total[used]])], names=["bucket", "n"])


def _counted(batches):
    for batch in batches:
        for a, b, gram, owner in _each(batch, batch.num_columns - 1):
            key, n = np.unique(owner * np.int64(BUCKETS) + gram, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(b - a + 1) * BUCKETS), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % BUCKETS, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], names=["lang", "apart", "buckets", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_classes: int, epochs: int = 3, seed: int = 5) -> np.ndarray:
    """FTRL-proximal over sparse rows; the last row of the result is the bias."""
    z, n, w = (np.zeros((BUCKETS + 1, n_classes)) for _ in range(3))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at, x = texts[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = _softmax(x @ wi)
            p[target[i]] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm."""
    if not len(target):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(target)), target] + 1e-12).mean()
    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, learn) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights per bucket (IDF multiplied in) and bias, both over the temperature.

    ``learn`` is the condition of rows that may be learned from.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", F.lower(text_of(docs)).alias("text"))
    df = rows.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS)
    seen[df.bucket[df.bucket >= 0]] = df.n[df.bucket >= 0]
    n_docs = int(df.n[df.bucket < 0].sum())
    idf = np.where(seen > 0, np.log((1 + n_docs) / (1 + seen)) + 1, 0)
    share = {r.lang: min(1.0, MAX_PER_LANGUAGE / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return [], np.zeros((BUCKETS, 1)), np.zeros(1)
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1e6
    chosen = rows.filter(draw(1) < F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang")))
    found = chosen.orderBy(draw(1), "doc_id", "lang", "text").limit(int(1.2 * MAX_PER_LANGUAGE) * len(share)).select("lang", (draw(2) < 0.2).alias("apart"), "text").mapInArrow(_counted, "lang string, apart boolean, buckets array<int>, counts array<int>").toArrow()
    langs = sorted(share)
    target = np.array([langs.index(x) for x in found.column("lang").to_pylist()], np.int64)
    apart = found.column("apart").to_numpy()
    texts = []
    for at, k in zip(found.column("buckets"), found.column("counts"), strict=True):
        at, k = at.values.to_numpy(), k.values.to_numpy()
        texts.append((at, SCALE * k / max(1, k.sum()) * idf[at]))
    fitted = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(texts))
    w = fit([texts[i] for i in fitted], target[fitted], len(langs))
    checked = np.flatnonzero(apart)
    logits = np.array([x @ w[at] + w[-1] for at, x in (texts[i] for i in checked)]).reshape(-1, len(langs))
    t = temperature(logits, target[checked])
    return langs, SCALE * w[:-1] * idf[:, None] / t, w[-1] / t


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a column ``language`` and its probability ``score``, from the whole text."""
    langs, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names = np.array([*langs, "und"], object)

    def run(batches):
        for batch in batches:
            letters = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool) & bool(langs)
            best, sure = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            for a, b, gram, owner in _each(batch, batch.num_columns - 1):
                size = np.maximum(1, np.bincount(owner, minlength=b - a))
                logit = np.stack([np.bincount(owner, shared.value[gram, k], b - a) for k in range(len(bias))], 1) / size[:, None] + bias
                p = _softmax(logit)
                best[a:b], sure[a:b] = p.argmax(1), p.max(1)
            best, sure = np.where(letters, best, len(langs)), np.where(letters, sure, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(names[best], pa.string()), pa.array(sure)], names=[*batch.schema.names[:-2], language, score])

    kept = [c for c in docs.columns if c.lower() not in (language.lower(), score.lower())]
    text = text_of(docs)
    schema = docs.select(*kept).withColumn(language, F.lit("")).withColumn(score, F.lit(0.0)).schema
    return docs.select(*kept, text.rlike(r"\p{L}").alias(fresh(docs, "_letters")), F.lower(text).alias(fresh(docs, "_folded"))).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    predicted = with_language(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")
