"""Connected components: parts of the links are united within tasks, what is left by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, stored

#: Links that a task unites at once, so many tasks unite many.
TOGETHER = 200_000


def _united(u: pa.Array, v: pa.Array) -> pa.RecordBatch:
    """Of the components that links make, each node but the least with the least."""
    coded = pa.chunked_array([u, v]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order), dtype=order.dtype)
    ends = rank[coded.indices.to_numpy()].astype(np.int64).reshape(2, -1)
    least, a, b = np.arange(len(order)), *ends
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
    hung = np.flatnonzero(least != np.arange(len(order)))
    nodes = coded.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(hung)), nodes.take(pa.array(least[hung]))], names=["u", "v"])


@lean
def _stars(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
            yield _united(part.column(0), part.column(1))
    if n:
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield _united(part.column(0), part.column(1))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the root is the least node of its component.

    First each task unites its part of the links, TOGETHER at a time, without a shuffle; so few
    links need no rounds.  Each round then hangs neighbours on smaller nodes; the number of rounds grows
    with the logarithm of a component's size.  A round's links are written out
    before the next reads them, and removed after it; rounds end when the links are stars.
    """
    given = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v"), "links")
    now = stored(given.coalesce(given.count() // TOGETHER + 1).mapInArrow(_stars, given.schema), "links")
    discard(given)
    while not _are_stars(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        now, before = stored(small, "links"), now
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))


def _are_stars(links: DataFrame) -> bool:
    """Whether each node that hangs on another hangs on that one alone, and none on it."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.filter("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1))).first()[0] == 0
