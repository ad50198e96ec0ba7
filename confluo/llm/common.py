"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into numpy arrays at once.
SLICE_BYTES = 1 << 20
#: Multiplier of the polynomial hashes; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session; executors of a
    cluster could not see it, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='confluo-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of stored tables that are still there, by the identity of their DataFrames.
_STORED: dict[int, tuple[DataFrame, str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here.

    The files survive lost executors; ``discard`` removes them after their last
    use, and the end of the program what is left.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _STORED[id(back)] = back, path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing will read again.

    Shuffle files go when the driver collects what refers to them, which a large
    heap puts off; it is asked to do so now.
    """
    for df in tables:
        if found := _STORED.pop(id(df), None):
            _remove(df.sparkSession, found[1])
    if session := SparkSession.getActiveSession():
        session.sparkContext._jvm.System.gc()


#: Keys that hold more than one in so many rows are hot; there are no more of them than this.
HOT = 1_000


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to one row per key; ``size`` is how many rows a key has at most.

    The rows of hot keys (fewer than HOT, so their groups are broadcast) stay where
    they are; only the others shuffle.  The column ``size`` is kept.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > max(1, total // HOT))
    cold = groups.filter(F.col(size) <= max(1, total // HOT))
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(cold, key))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column, without copies."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize)
    return ends.astype(np.int64), np.frombuffer(data or b"", np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def lean(task: Callable) -> Callable:
    """A task over batches that gives freed memory back to the system at its end: workers are kept from stage to stage."""

    @wraps(task)
    def run(batches, *args, **named):
        yield from task(batches, *args, **named)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def running(data: np.ndarray) -> np.ndarray:
    """Running sums of byte * BASE**position: any substring's hash is a difference of two."""
    up, _ = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return sums


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [starts, ends): equal bytes give equal hashes wherever they stand."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


#: ASCII white space ends a word; 1 marks bytes that belong to words.
IN_WORD = np.ones(256, np.int8)
IN_WORD[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts: starts, ends and the text each belongs to.

    ``bounds`` has the texts' offsets in ``data``; no word crosses one.
    """
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[bounds[bounds < len(data)]] = True
        edge[0] = True
    cuts = np.flatnonzero(edge[:-1]) if len(data) else np.zeros(0, np.int64)
    cuts = cuts.astype(np.int64)
    ends = np.append(cuts[1:], len(data)).astype(np.int64)
    keep = inside[cuts] == 1 if len(cuts) else np.zeros(0, bool)
    starts, ends = cuts[keep], ends[keep]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


#: ASCII letters, digits and all bytes of other characters make bare words.
LETTERS = np.zeros(256, np.int8)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def bare_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without punctuation of concatenated texts, and the text of each."""
    spaced = np.where(LETTERS[data] == 1, data, 32).astype(np.uint8)
    starts, ends, owner = words(spaced, bounds)
    return spans_hash(running(spaced), starts, ends), owner


def distance_within(a: list[int], b: list[int], bound: int) -> int | None:
    """The edit distance of two sequences if it is at most ``bound``.

    One column of the table is held as bits of two integers, so memory grows with
    the sequences' length only; it stops where ``bound`` is out of reach.
    """
    if not a:
        return len(b) if len(b) <= bound else None
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    size = len(a)
    mask, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = mask, 0, size
    left = len(b)
    for c in b:
        left -= 1
        eq = places.get(c, 0)
        across = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(diagonal | up) & mask, up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score - left > bound:
            return None
        rise = (rise << 1 | 1) & mask
        fall = fall << 1 & mask
        up, down = fall | ~(across | rise) & mask, rise & across
    return score if score <= bound else None
