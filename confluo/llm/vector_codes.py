"""Vector code compression: product codes whose codebooks come from dual-tree Lloyd rounds over integers.

Vectors become integers (floor of 4096 times a component) and are cut into 8 parts; each
part is replaced by the number of one of 16 entries of its position's codebook.  The
rounds work on blocks of vectors that one scan writes: per block and part position a tree
over the parts, with the box, the sum and the count of every node.  A round is one pass
over the blocks, without Python rows and without a shuffle but of its sums: the tree over
the entries goes down together with the tree over the parts, a pair of nodes is dropped
where another entry is nearer for certain (the boxes are integers, so bounds are exact),
a node left with one entry is assigned whole by its cached sum, and only leaves with
several entries left are compared part by part.

What comes to the driver is the 16 first vectors, and sums of at most 16 entries a
position.  A vector that very many rows share is a node whose box is a point.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped, and so are those whose length is no multiple of 8 or not that of the least
vec_id with such a length (the contract knows one length).  Equal vec_ids come in the
order of their vectors, a null vec_id last.  Fewer than 16 vectors give as many entries.
Repeated rows count each.  Components of any size are exact: where a squared distance
could pass 64 bits, Python's integers take the place of numpy's; an error beyond a long
is the largest long.  An empty table gives an empty result.  Further columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and parts of a leaf.
BLOCK, LEAF = 4096, 32
#: Sums travel in limbs of so many bits, so that adding them up stays within a long.
LIMB = 40
LARGEST = (1 << 63) - 1


class Tree:
    """A balanced tree over points: per level the nodes' boxes, sums and first points.

    The points are put in the tree's order; ``order`` says where each came from.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        order, bounds = np.arange(len(points)), np.array([0, len(points)])
        self.bounds = [bounds]
        while np.diff(bounds).max() > leaf:
            middles = (bounds[:-1] + bounds[1:]) // 2
            for lo, mid, hi in zip(bounds[:-1], middles, bounds[1:], strict=True):
                own = points[order[lo:hi]]
                wide = int(np.argmax(own.max(0) - own.min(0)))
                order[lo:hi] = order[lo:hi][np.argsort(own[:, wide], kind="stable")] if own.dtype == object else order[lo:hi][np.argpartition(own[:, wide], mid - lo)]
            bounds = np.unique(np.concatenate([bounds, middles]))  # a node of one point is not cut
            self.bounds.append(bounds)
        self.order, self.points = order.astype(np.int32), points[order]
        at = [b[:-1] for b in self.bounds]
        self.low, self.high, self.sums = ([f.reduceat(self.points, b, axis=0) for b in at] for f in (np.minimum, np.maximum, np.add))

    def packed(self) -> Tree:
        """Points and boxes in the narrowest type that holds them."""
        if self.points.dtype != object:
            kind = np.min_scalar_type(-1 - max(abs(int(self.low[0].min())), abs(int(self.high[0].max()))))
            self.points, self.low, self.high = self.points.astype(kind), [x.astype(kind) for x in self.low], [x.astype(kind) for x in self.high]
        return self

    def unpacked(self) -> Tree:
        if self.points.dtype != object:
            self.points, self.low, self.high = self.points.astype(np.int64), [x.astype(np.int64) for x in self.low], [x.astype(np.int64) for x in self.high]
        return self


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry nearest to each of the tree's points (ties to the lower), and the sums and counts of entries."""
    of = Tree(entries, 1)
    labels = np.zeros(len(tree.points), np.int64)
    sums, counts = np.zeros(entries.shape, entries.dtype), np.zeros(len(entries), np.int64)
    nodes, left = np.zeros(1, np.int64), np.ones((1, 1), bool)
    deep, top = len(tree.bounds) - 1, len(of.bounds) - 1
    for level in range(max(deep, top) + 1):
        if 0 < level <= deep:
            nodes, left = (np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, axis=0))
        if 0 < level <= top:
            left = _children(left, of.bounds[level - 1], of.bounds[level])
        p, e = min(level, deep), min(level, top)
        q, c = np.nonzero(left)
        low, high = tree.low[p][nodes][q], tree.high[p][nodes][q]
        gap = np.maximum(np.maximum(of.low[e][c] - high, low - of.high[e][c]), 0)
        reach = np.maximum(np.abs(of.high[e][c] - low), np.abs(high - of.low[e][c]))
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        bound = np.minimum.reduceat(most, np.searchsorted(q, np.arange(len(nodes))))
        out = least > bound[q]
        left[q[out], c[out]] = False
        if e == top:
            sure = left.sum(1) == 1
            entry = of.order[np.argmax(left[sure], axis=1)]
            np.add.at(sums, entry, tree.sums[p][nodes[sure]])
            starts, ends = tree.bounds[p][nodes[sure]], tree.bounds[p][nodes[sure] + 1]
            np.add.at(counts, entry, ends - starts)
            labels[_ranges(starts, ends)] = np.repeat(entry, ends - starts)
            nodes, left = nodes[~sure], left[~sure]
            if not len(nodes):
                return labels, sums, counts
    starts, ends = tree.bounds[deep][nodes], tree.bounds[deep][nodes + 1]
    at = _ranges(starts, ends)
    own = tree.points[at]
    q, c = np.nonzero(np.repeat(left, ends - starts, axis=0))
    off = own[q] - entries[of.order[c]]
    distance = np.full((len(at), len(entries)), LARGEST if entries.dtype != object else math.inf, entries.dtype)
    distance[q, of.order[c]] = (off * off).sum(1)
    labels[at] = entry = np.argmin(distance, axis=1)
    np.add.at(sums, entry, own)
    np.add.at(counts, entry, 1)
    return labels, sums, counts


def _children(left: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Columns of a level's nodes become columns of their children; a node of one entry stands for itself."""
    return left[:, np.searchsorted(above, below[:-1], "right") - 1]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum())


def integers(values: np.ndarray, wide: bool) -> np.ndarray:
    """Floors of SCALE times the values; Python's integers if ``wide``."""
    if not wide:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) > 1 << 40 else math.floor(v * SCALE) for v in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def _blocks(dim: int, wide: bool):
    """Blocks of at most BLOCK vectors: their carried columns as lists, their trees pickled."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                points = integers(part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim), wide)
                trees = [Tree(np.ascontiguousarray(x), LEAF).packed() for x in np.split(points, PARTS, axis=1)]
                # plain arrays: workers of another session need no module to read them
                plain = [(t.order, t.points, t.bounds, t.low, t.high, t.sums) for t in trees]
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(plain)], pa.binary())], names=[*part.schema.names[:-1], "trees"])

    return run


def _trees(packed: bytes) -> list[Tree]:
    found = []
    for order, points, bounds, low, high, sums in pickle.loads(packed):
        t = Tree.__new__(Tree)
        t.order, t.points, t.bounds, t.low, t.high, t.sums = order, points, bounds, low, high, sums
        found.append(t.unpacked())
    return found


def _round(books: list[np.ndarray]):
    """Per task: (part, entry, position, limb, value); position -1 holds counts."""

    def run(batches):
        totals = [(np.zeros(b.shape, object), np.zeros(len(b), object)) for b in books]
        for batch in batches:
            for packed in batch.column(0):
                for tree, book, (sums, counts) in zip(_trees(packed.as_py()), books, totals, strict=True):
                    _, s, n = nearest(tree, book)
                    sums += s.astype(object)
                    counts += n.astype(object)
        rows = []
        for part, (sums, counts) in enumerate(totals):
            for entry in np.flatnonzero(counts):
                for position, value in enumerate([counts[entry], *sums[entry]], -1):
                    value, limb = int(value), 0
                    while abs(value) >> LIMB:
                        rows.append((part, int(entry), position, limb, value & (1 << LIMB) - 1))
                        value, limb = value >> LIMB, limb + 1
                    rows.append((part, int(entry), position, limb, value))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "position", "limb", "value"])

    return run


def _codes(books: list[np.ndarray]):
    """Per vector: the carried columns, its entries' numbers in hex and its squared distances summed."""

    def run(batches):
        for batch in batches:
            for i, packed in enumerate(batch.column("trees")):
                codes, errors = [], 0
                for tree, book in zip(_trees(packed.as_py()), books, strict=True):
                    labels, _, _ = nearest(tree, book)
                    off = tree.points - book[labels]
                    back = np.argsort(tree.order)
                    codes.append(labels[back].astype(np.uint8))
                    errors = errors + (off * off).sum(1)[back].astype(object)
                text = np.stack(codes, axis=1).tobytes().hex()
                lists = [batch.column(k)[i].values for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string()), pa.array([min(int(x), LARGEST) for x in errors], pa.int64())], names=[*batch.schema.names[:-1], "code", "error"]
                )

    return run


def compress(vectors: DataFrame, id_column: str, vector_column: str, carried: tuple[str, ...] = (), rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, carried columns, code, error) of each vector kept, and the final codebooks: by part, entry, position."""
    whole = vectors.select(F.col(id_column).alias("vec_id"), *carried, F.col(vector_column).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    kept = whole.filter(F.col("vector").isNotNull() & ~F.coalesce(odd, F.lit(False)) & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    ahead = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*ahead).first()
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, code string, error bigint"), []
    dim = len(first.vector)
    kept = kept.filter(F.size("vector") == dim)
    largest = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    # boxes are no wider than twice the largest component
    wide = 4 * (int(largest) * SCALE + SCALE) ** 2 * (dim // PARTS) >= 1 << 62
    start = integers(np.array([r.vector for r in kept.orderBy(*ahead).limit(ENTRIES).collect()], np.float64), wide)
    books = [np.ascontiguousarray(b) for b in np.split(start, PARTS, axis=1)]
    lists = ", ".join(f"`{c}` array<{t}>" for c, t in kept.dtypes[:-1])
    blocks = stored(kept.mapInArrow(_blocks(dim, wide), f"{lists}, trees binary"), "vector-blocks")
    for _ in range(rounds):
        sums = blocks.select("trees").mapInArrow(_round(books), "part int, entry int, position int, limb int, value bigint")
        totals: dict[tuple[int, int], list[int]] = {}
        for r in sums.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
            totals.setdefault((r.part, r.entry), [0] * (dim // PARTS + 1))[r.position + 1] += r.value << LIMB * r.limb
        for (part, entry), (n, *values) in totals.items():
            books[part][entry] = [v // n for v in values]
    coded = stored(blocks.mapInArrow(_codes(books), f"{schema}, code string, error bigint"), "vector-codes")
    discard(blocks)
    return coded, [b.tolist() for b in books]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, errors of vectors and of labels, and the digest of the codebooks."""
    coded, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ("label",))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    groups = stored(keyed.groupBy("key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("size")), "label-errors")
    return join_hot(keyed, groups, "key", "size").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other; parts are rows of one component each."""
    steps = [
        "WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)",
        "x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // 8) AS p, (i - 1) % (n // 8) AS d, floor(4096 * v::DOUBLE)::BIGINT AS v FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM kept))",
        "b0 AS MATERIALIZED (SELECT p, e, d, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(s) AS s, arg_min(e, (s, e)) AS e FROM (SELECT vec_id, x.p, e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS s FROM x JOIN b{r} b ON b.p = x.p AND b.d = x.d GROUP BY ALL) GROUP BY ALL)")
        if r < ROUNDS:
            # whole numbers round towards zero there, so the remainder decides
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.d, coalesce((s - ((s % n) + n) % n) // n, b.v)::BIGINT AS v FROM b{r} b LEFT JOIN (SELECT p, e, d, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL) t ON t.p = b.p AND t.e = b.e AND t.d = b.d)"
            )
    last = f"""c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(v, ',' ORDER BY p, e, d)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c JOIN kept USING (vec_id)"""
    return ",\n".join([*steps, last])


OP11_SQL = _sql()
