"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier over hashed word presence is fitted in numpy from confirmed
toxic texts and unlabelled texts.  The risk is corrected by the class prior p:

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])

with the logistic loss l; when the second term turns negative its gradient is
reversed (in the fit that picks words) or left out (in the one that weighs them),
which stops the fit from eating into the unlabelled texts.

Nulls and empty texts get the score of a text without words.  Texts of any length
are scored whole; an empty table gives an empty result, and one without toxic
labels a model that rejects nothing.  Repeated rows and null ids are scored like
any other; a label whose text is absent is not used, and of labels that repeat an
id the larger holds.  The score goes to a column whose name the caller may choose;
an input column of that name is replaced, all others come back as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare_words, fold, fresh, lean, slices, table, text_of, utf8

#: Hash buckets of words.
BUCKETS = 1 << 18
#: Texts fitted on at most: confirmed toxic ones and unlabelled ones.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
#: A word counts if so many of the fitted texts have it.
LEAST_TEXTS = 8


def _features(offsets: np.ndarray, data: np.ndarray):
    """Distinct word buckets of each text: (ends into the buckets, buckets)."""
    code, owner = bare_words(data, offsets)
    bucket = (code % np.uint64(BUCKETS)).astype(np.int64)
    key = np.unique(owner * BUCKETS + bucket)
    return np.searchsorted(key, np.arange(1, len(offsets)) * BUCKETS), key % BUCKETS


def _each(batch: pa.RecordBatch, column: int):
    offsets, data = utf8(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, *_features(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])


@lean
def _gather(batches):
    for batch in batches:
        for a, b, ends, buckets in _each(batch, 1):
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["toxic", "buckets"])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[ends] - total[np.r_[0, ends[:-1]]]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, batch: int = 1024, rate: float = 0.05, sparsity: float = 0.6, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights per bucket and the bias that minimise the nnPU risk, by proximal Adam.

    A first fit with an L1 penalty picks the words whose excess among the toxic
    texts stands out of sampling noise; a second one without it sets their weights.
    The bias is then moved so that score 0.5 has the least nnPU risk of the 0-1 loss.
    """
    penalty = sparsity * prior / max(1, len(positive)) ** 0.5
    weights, bias = _descend(positive, unlabelled, prior, None, epochs, batch, rate, penalty, seed)
    weights, bias = _descend(positive, unlabelled, prior, np.flatnonzero(np.abs(weights) > 0.2 * np.abs(weights).max(initial=1e-9)), 12 * epochs, 1 << 30, rate, 0.0, seed)
    cuts, in_positive, in_unlabelled = _levels(positive, unlabelled, weights)
    if len(cuts):
        risk = prior * (1 - in_positive) + np.maximum(0, in_unlabelled - prior * in_positive)
        bias = -cuts[np.argmin(risk)]
    return weights, bias


def _levels(positive, unlabelled, weights):
    """Thresholds between the scores that occur, and the share of either kind above each."""
    scores = [np.sort([weights[t].sum() for t in texts]) for texts in (positive, unlabelled)]
    found = np.unique(np.concatenate(scores).round(6))
    cuts = (found[1:] + found[:-1]) / 2
    return cuts, *[1 - np.searchsorted(s, cuts) / max(1, len(s)) for s in scores]


def _descend(positive, unlabelled, prior, chosen_words, epochs, batch, rate, penalty, seed):
    seen = np.bincount(np.concatenate([*positive, *unlabelled, np.zeros(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
    index = np.full(BUCKETS, -1)
    used = np.flatnonzero(seen >= LEAST_TEXTS) if chosen_words is None else chosen_words
    index[used] = np.arange(len(used))
    packed = [[x[x >= 0] for x in (index[t] for t in texts)] for texts in (positive, unlabelled)]
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, step, rng = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0, np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        orders = [rng.permutation(len(t)) for t in packed]
        for part in range(n_parts := max(1, len(packed[1]) // batch)):
            chosen = [[t[i] for i in np.array_split(o, n_parts)[part]] for t, o in zip(packed, orders, strict=True)]
            flat = [np.concatenate([*c, np.zeros(0, np.int64)]) for c in chosen]
            sizes = [np.array([len(x) for x in c], np.int64) for c in chosen]
            f = [_sums(w[x], np.cumsum(s)) + bias if len(s) else np.zeros(0) for x, s in zip(flat, sizes, strict=True)]
            loss_neg = [np.logaddexp(0, z) for z in f]
            rest = (loss_neg[1].mean() if len(f[1]) else 0) - prior * (loss_neg[0].mean() if len(f[0]) else 0)
            up = [-sigmoid(-f[0]) * prior / max(1, len(f[0])), np.zeros(len(f[1]))]
            down = [-sigmoid(f[0]) * prior / max(1, len(f[0])), sigmoid(f[1]) / max(1, len(f[1]))]
            pull = [a + b if rest >= 0 else -b if penalty else a for a, b in zip(up, down, strict=True)]
            grad = sum(np.bincount(x, np.repeat(p, s), len(w)) for x, p, s in zip(flat, pull, sizes, strict=True)) + 1e-5 * w
            g = np.append(grad, sum(p.sum() for p in pull))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
            w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty / (np.sqrt(v[:-1] / (1 - 0.999**step)) + 1e-8), 0)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, held_out_parts: int = 5) -> tuple[np.ndarray, float]:
    """Fit on documents outside the held-out fold (crc32 of the id mod ``held_out_parts`` = 0).

    At most MAX_POSITIVE toxic and MAX_UNLABELLED unlabelled texts are used,
    chosen by a hash of the id.  The class prior is the toxic share of the
    labelled rows outside the fold.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id"), held_out_parts) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic, n_docs = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first() + (docs.count(),)
    if not n_toxic:
        return np.zeros(BUCKETS), -30.0
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    toxic = marked.filter("toxic = 1").filter(order < min(1.0, 1.1 * MAX_POSITIVE / n_toxic)).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE)
    source = docs.select("doc_id", F.lower(text_of(docs)).alias("text")).filter(fold(F.col("doc_id"), held_out_parts) != 0)
    some = source.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1_000_000)) / 1e6 < min(1.0, 1.3 * MAX_UNLABELLED / max(1, n_docs))).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "text").select(F.lit(0).alias("toxic"), "text").limit(MAX_UNLABELLED)
    rows = source.join(F.broadcast(toxic), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text").unionByName(some)
    found = rows.mapInArrow(_gather, "toxic int, buckets array<int>").toArrow()
    kind = found.column("toxic").to_numpy()
    ends, buckets = np.r_[0, np.cumsum(found.column("buckets").combine_chunks().value_lengths().to_numpy())], found.column("buckets").combine_chunks().flatten().to_numpy()
    texts = [buckets[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit([t for t, k in zip(texts, kind, strict=True) if k], [t for t, k in zip(texts, kind, strict=True) if not k], min(0.9, n_toxic / n))


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``: the probability of toxicity of each whole text."""
    shared, bias = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]

    @lean
    def run(batches):
        weights = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, ends, buckets in _each(batch, batch.num_columns - 1):
                out[a:b] = 1 / (1 + np.exp(-np.clip(_sums(weights[buckets].astype(np.float64), ends) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], score])

    kept = [c for c in docs.columns if c.lower() != score.lower()]
    source = docs.select(*kept, F.lower(text_of(docs)).alias(fresh(docs, "_folded")))
    return source.mapInArrow(run, docs.select(*kept).withColumn(score, F.lit(0.0)).schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
