"""Token counts without ids: pieces are counted once per distinct pre-token.

A pass cuts texts into pre-tokens and sends, per task and pre-token, the rows it
occurs in and how often, as one compact record.  One shuffle brings the records
of a pre-token together; there the library counts its pieces once, the count is
joined to the frequencies, and products are summed per row, in packed records
again until a second shuffle brings the sums of a row together.  Records of very
common pre-tokens are dealt over several tasks, each of which counts them once.

Nulls count as the empty text, which has 0 tokens.  Special strings inside a
text are one token each, as the library treats them by default.  Repeated rows,
null ids and ties are counted each for itself, texts of any length whole; an empty
table gives an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, utf8

#: Pre-tokens (with repeats) that a task holds before it sends what it has.
HELD = 6_000_000
#: Rows of a record from which on it may go to any task.
COMMON = 2_000
#: The pre-token pattern and special tokens of word_bpe_49k.json.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _tokenizer(shared):
    """The tokenizer from its broadcast file, which executors need not have."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(shared.value)


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of 7 bits, the last of each below 128; and each one's length."""
    length = 1 + sum((values >= (1 << 7 * i)).astype(np.int64) for i in range(1, 6))
    at = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    for i in range(int(length.max(initial=0))):
        has = length > i
        out[at[has] + i] = ((values[has] >> (7 * i)) & 127) | np.where(length[has] > i + 1, 128, 0)
    return out, length


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.r_[0, ends[:-1]]
    values = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max(initial=0))):
        has = ends - starts > i
        values[has] |= (data[starts[has] + i].astype(np.int64) & 127) << (7 * i)
    return values, ends


def _cut(shared, schema: pa.Schema):
    import regex

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flush(vocabulary, codes, owners, sizes):
        owners = np.array(owners)
        local = np.repeat(np.arange(len(owners)), sizes)
        key, freq = np.unique((np.concatenate(codes).astype(np.int64) << 32) + local, return_counts=True)
        code, at = key >> 32, owners[key & 0xFFFFFFFF] - owners[0]
        first = np.r_[True, code[1:] != code[:-1]]
        step = np.where(first, at, at - np.r_[0, at[:-1]])
        data, length = _packed(np.stack([step, freq], 1).ravel())
        cuts = np.flatnonzero(first)
        n_rows = np.diff(np.r_[cuts, len(code)])
        ends = np.r_[0, np.cumsum(length)][2 * np.r_[cuts, len(code)]]
        names = np.array(list(vocabulary), object)[code[cuts]]
        for a in range(0, len(cuts), 100_000):
            part = slice(a, a + 100_000)
            cut = ends[a : a + 100_001]
            blob = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).astype(np.int32)), pa.py_buffer(data[cut[0] : cut[-1]].tobytes())])
            yield rows(pretoken=names[part], base=np.full(len(cut) - 1, owners[0]), freqs=blob, deal=np.where(n_rows[part] >= COMMON, owners[0] + code[cuts[part]], 0))

    def run(batches):
        normal = _tokenizer(shared).normalizer.normalize_str
        find = regex.compile(PATTERN).findall
        split = regex.compile("|".join(map(regex.escape, SPECIAL))).split
        vocabulary, codes, owners, sizes, held = _Vocabulary(), [], [], [], 0
        for batch in batches:
            special = np.zeros(batch.num_rows, np.int64)
            for i, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                pieces = split(text.as_py())
                special[i] = len(pieces) - 1
                found = [np.fromiter(map(vocabulary.__getitem__, find(normal(piece))), np.int32) for piece in pieces]
                codes += found
                owners.append(row)
                sizes.append(sum(map(len, found)))
                held += sizes[-1]
                if held >= HELD:
                    yield from flush(vocabulary, codes, owners, sizes)
                    vocabulary, codes, owners, sizes, held = _Vocabulary(), [], [], [], 0
            yield rows(base=batch.column(0), doc_id=batch.column(1), n_bytes=batch.column(3), n=special, deal=batch.column(0))
        if held:
            yield from flush(vocabulary, codes, owners, sizes)

    return run


def _steps(blobs: pa.Array, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows and numbers that packed records hold, and the record of each."""
    offsets, data = utf8(blobs)
    values, ends = _unpacked(data[offsets[0] : offsets[-1]])
    step, n = values[::2], values[1::2]
    first = np.searchsorted(ends[1::2], offsets[:-1] - offsets[0], "right")
    owner = np.repeat(np.arange(len(blobs)), np.diff(np.r_[first, len(step)]))
    total = np.cumsum(step)
    return total - (total[first] - step[first])[owner] + base[owner], n, owner


class _Sums:
    """Numbers by row, merged as they grow."""

    def __init__(self) -> None:
        self.held, self.parts, self.bases = 0, [], np.zeros(0, np.int64)

    def add(self, row: np.ndarray, n: np.ndarray, base: np.ndarray) -> None:
        self.parts.append((row, n))
        self.bases = np.union1d(self.bases, base)
        self.held += len(row)
        if self.held >= 2_000_000:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, back = np.unique(np.concatenate([r for r, _ in self.parts]), return_inverse=True)
        return row, np.bincount(back, np.concatenate([n for _, n in self.parts])).astype(np.int64)


def _heads(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name != "freqs" else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def _counted(shared, schema: pa.Schema):
    """Records of pre-tokens to sums of pieces, one packed record for each task that cut them."""

    def packed(sums):
        row, n = sums.merged()
        part = np.searchsorted(sums.bases, row, "right") - 1
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(row) else np.zeros(0, np.int64)
        step = np.diff(row, prepend=0)
        step[first] = row[first] - sums.bases[part[first]]
        data, length = _packed(np.stack([step, n], 1).ravel())
        ends = np.r_[0, np.cumsum(length)][2 * np.r_[first, len(row)]]
        blobs = [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        bases = sums.bases[part[first]]
        return pa.RecordBatch.from_arrays([pa.array(bases) if f.name == "base" else pa.array(blobs, pa.binary()) if f.name == "freqs" else pa.nulls(len(blobs), f.type) for f in schema], schema=schema)

    def run(batches):
        tokenizer, known, sums = _tokenizer(shared), {}, _Sums()
        for batch in batches:
            yield _heads(batch.filter(batch.column("pretoken").is_null()), schema)
            batch = batch.filter(batch.column("pretoken").is_valid())
            words = batch.column("pretoken").to_pylist()
            new = list(dict.fromkeys(w for w in words if w not in known))
            if len(known) > 500_000:
                known, new = {}, list(dict.fromkeys(words))
            known.update(zip(new, (len(e.ids) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            if words:
                pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                base = batch.column("base").to_numpy()
                row, freq, owner = _steps(batch.column("freqs"), base)
                sums.add(row, freq * pieces[owner], base)
        yield packed(sums)

    return run


def _summed(schema: pa.Schema):
    """Packed sums to one number a row."""

    def run(batches):
        sums = _Sums()
        for batch in batches:
            yield _heads(batch.filter(batch.column("freqs").is_null()), schema)
            batch = batch.filter(batch.column("freqs").is_valid())
            if batch.num_rows:
                base = batch.column("base").to_numpy()
                sums.add(*_steps(batch.column("freqs"), base)[:2], base)
        row, n = sums.merged()
        yield pa.RecordBatch.from_arrays([pa.array(row) if f.name == "base" else pa.array(n) if f.name == "n" else pa.nulls(len(row), f.type) for f in schema], schema=schema)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes and n_tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, text = docs.sparkSession, text_of(docs, text_column)
    source = docs.select(F.monotonically_increasing_id().alias("base"), F.col(id_column).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = f"pretoken string, base bigint, doc_id {kind}, n_bytes bigint, n bigint, freqs binary, deal bigint"
    sums = f"base bigint, doc_id {kind}, n_bytes bigint, n bigint, freqs binary"
    got = f"base bigint, doc_id {kind}, n_bytes bigint, n bigint"
    arrow = lambda schema: to_arrow_schema(spark.createDataFrame([], schema).schema)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    records = source.mapInArrow(_cut(shared, arrow(sent)), sent)
    pieces = records.repartition("pretoken", "deal").mapInArrow(_counted(shared, arrow(sums)), sums)
    counted = pieces.repartition("base").mapInArrow(_summed(arrow(got)), got)
    return counted.groupBy("base").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("base")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
