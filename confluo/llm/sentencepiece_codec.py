"""SentencePiece encoding and decoding: batched numpy Viterbi over distinct words.

A text is cut before every run of word-start marks that follows something else;
no piece crosses such a place, so words are encoded once each and apart.  Words
of equal length advance together, one character a step: hashes of all substrings
probe the sorted hashes of the pieces, and the best admissible piece that ends
at the step is kept with a pointer back.

For a byte-pair model the admissible pieces are those that the model's merges
would leave side by side: a piece may follow another if, undoing the merges that
made the two from last to first, no merge across their border would have come
first.  Exactly one chain of pieces stands that test, the library's own result.

Nulls count as the empty text, which has no pieces.  Characters without a piece
become byte pieces.  Repeated rows and null ids are encoded like any other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, fresh, lean, mix, slices, table, text_of, utf8

MARK = "▁"
#: Distinct words that are encoded together, and words a worker remembers.
TOGETHER, REMEMBERED = 50_000, 600_000
#: Characters of equally long words that advance together; tables of some 20 times as many numbers are held.
CELLS = 100_000
NEVER = np.int64(1 << 40)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _string_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c) + 1) % (1 << 64)
    return h


def _merged(piece: str, rank: dict[str, int]) -> list[tuple[str, str, str]]:
    """Byte-pair merges of one string: the symbols left, each with the two it was made of last."""
    parts = [(c, "", "") for c in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i][0] + parts[i + 1][0], 1 << 40))
        left, right = parts[best][0], parts[best + 1][0]
        if left + right not in rank:
            break
        parts[best : best + 2] = [(left + right, left, right)]
    return parts


def load(path: str) -> dict[str, np.ndarray | int]:
    """The model's tables as arrays: sorted substring hashes, ranks, and the last merge of each piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    by_score = sorted(normal, key=lambda i: (-model.get_score(i), i))
    rank_of = {names[i]: r for r, i in enumerate(by_score)}
    ident = {names[i]: i for i in normal}
    # one id more than the model has stands for a character without a piece
    rank, left, right = np.full(size + 1, -1), np.arange(size + 1), np.arange(size + 1)
    length, code = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.uint64)
    whole = np.zeros(size + 1, bool)
    for i in normal:
        length[i], code[i] = len(names[i]), _string_hash(names[i])
        parts = _merged(names[i], rank_of)
        whole[i] = len(parts) == 1
        if len(names[i]) > 1 and whole[i]:
            rank[i] = rank_of[names[i]]
            left[i], right[i] = (ident.get(x, size) for x in parts[0][1:])
    keys = mix(code[normal] + length[normal].astype(np.uint64))
    order = np.argsort(keys)
    merge_rank = np.full(size + 1, NEVER)
    for i in normal:
        merge_rank[i] = rank_of[names[i]] if len(names[i]) > 1 else NEVER
    raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
    bytes_of = np.full(256, -1)
    for i in range(size):
        if model.is_byte(i):
            bytes_of[int(names[i][3:5], 16)] = i
    return {
        "keys": keys[order], "ids": np.array(normal)[order], "rank": rank, "left": left, "right": right, "length": length, "code": code, "whole": whole, "merge_rank": merge_rank,
        "longest": int(length.max()), "unknown": size, "byte_ids": bytes_of,
        "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_ends": np.r_[0, np.cumsum([len(r) for r in raw])],
    }


class Viterbi:
    """Encodes batches of words with the tables of ``load``."""

    def __init__(self, tables: dict) -> None:
        self.t = tables
        self.powers = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(tables["longest"] + 1, BASE, np.uint64)], dtype=np.uint64)
        # where the keys with equal first 20 bits start, and how many there are at most
        high = (tables["keys"] >> np.uint64(44)).astype(np.int64)
        self.starts = np.searchsorted(high, np.arange((1 << 20) + 1)).astype(np.int32)
        self.chain, self.crowded = int(np.diff(self.starts).max(initial=1)), np.diff(self.starts) > 1
        self.keys = np.r_[tables["keys"], np.zeros(self.chain, np.uint64)]
        self.ids = np.r_[tables["ids"], np.full(self.chain, -1)]
        self.slot_key, self.slot_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def probe(self, code: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Ids of the pieces with these string hashes; -1 where there is none."""
        key = mix(code + np.uint64(length) if np.isscalar(length) else code + length.astype(np.uint64))
        slot = (key >> np.uint64(44)).astype(np.int64)
        at = self.starts[slot]
        hit = self.keys[at] == key
        out = np.where(hit, self.ids[at], -1)
        # few slots hold several keys
        rest = np.flatnonzero(self.crowded[slot] & ~hit)
        for i in range(1, self.chain if len(rest) else 0):
            more = self.keys[at[rest] + i] == key[rest]
            out[rest[more]] = self.ids[at[rest[more]] + i]
        return out

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the model leaves ``second`` right after ``first`` unmerged."""
        key = first * np.int64(1 << 20) + second
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        result, miss = self.slot_ok[slot], self.slot_key[slot] != key
        if miss.any():
            new, first_at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            ok = self._undo(first[miss][first_at], second[miss][first_at])
            at = slot[miss][first_at]
            self.slot_key[at], self.slot_ok[at] = new, ok
            result[miss] = ok[back]
        return result

    def _undo(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = self.t
        ok, limit = np.ones(len(x), bool), np.full(len(x), NEVER)
        live = np.flatnonzero((x != t["unknown"]) & (y != t["unknown"]))
        x, y = x.copy(), y.copy()
        while len(live):
            a, b = x[live], y[live]
            size = t["length"][b]
            joint = self.probe(t["code"][a] * self.powers[np.minimum(size, len(self.powers) - 1)] + t["code"][b], t["length"][a] + size)
            clash = (joint >= 0) & (t["merge_rank"][joint] < limit[live])
            ok[live[clash]] = False
            ra, rb = t["rank"][a], t["rank"][b]
            more = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            # the later merge is undone; of equal ones the right one came later
            undo_right = rb >= ra
            limit[live] = np.where(undo_right, rb + 1, ra)
            x[live] = np.where(undo_right, a, t["right"][a])
            y[live] = np.where(undo_right, t["left"][b], b)
            live = live[(x[live] != t["unknown"]) & (y[live] != t["unknown"])]
        return ok

    def equal_length(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``points``: words x characters.  Piece ids in order, flat, and the number of each word."""
        n, size = points.shape
        longest, unknown = min(self.t["longest"], size), self.t["unknown"]
        code, found = np.zeros((n, size), np.uint64), []
        for length in range(1, longest + 1):
            code = code[:, : size - length + 1] * np.uint64(BASE) + points[:, length - 1 :] + np.uint64(1)
            ids = self.probe(code.ravel(), length).reshape(code.shape)
            ids[(ids >= 0) & ~self.t["whole"][ids]] = -1
            found.append(ids)
        found[0][found[0] < 0] = unknown
        some = [(ids >= 0).any(0).tolist() for ids in found]
        last, back = np.full((n, size + 1), -1), np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            # widths of pieces that end here in some word
            widths = np.array([w for w in range(1, min(longest, end) + 1) if some[w - 1][end - w]])
            piece = np.stack([found[w - 1][:, end - w] for w in widths], 1)
            before = last[:, end - widths]
            open_ = (piece >= 0) & ((before >= 0) | (end == widths)[None, :])
            check = open_ & (before >= 0)
            score = np.where(open_, widths, 0)
            if check.any():
                fit = self.follows(before[check], piece[check])
                score[check] = np.where(fit, score[check], 0)
            best = score.argmax(1)
            last[:, end] = np.where(score[rows, best] > 0, piece[rows, best], -1)
            back[:, end] = widths[best]
        at, pieces, counts = np.full(n, size), np.full((n, size), -1), np.zeros(n, np.int64)
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            counts[live] += 1
            pieces[live, size - counts[live]] = last[live, at[live]]
            at[live] -= back[live, at[live]]
        return pieces[np.arange(size)[None, :] >= (size - counts)[:, None]], counts

    def encode(self, words: list[str]) -> list[bytes]:
        """Piece ids of each word as 32-bit integers; characters without a piece as bytes."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[group[0]])
            for a in range(0, len(group), max(1, CELLS // size)):
                part = group[a : a + max(1, CELLS // size)].tolist()
                ids, counts = self.equal_length(_points("".join([words[i] for i in part])).reshape(len(part), size))
                ends = np.cumsum(counts)
                raw, first = ids.astype(np.int32).tobytes(), 0
                for i, end in zip(part, (4 * ends).tolist(), strict=True):
                    out[i] = raw[first:end]
                    first = end
                for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.t["unknown"]), "right")).tolist():
                    out[part[k]] = self._with_bytes(words[part[k]], ids[ends[k] - counts[k] : ends[k]]).tobytes()
        return out

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        for i in ids:
            if i == self.t["unknown"]:
                parts += self.t["byte_ids"][list(word[at].encode())].tolist()
                at += 1
            else:
                parts.append(i)
                at += int(self.t["length"][i])
        return np.array(parts, np.int32)


_cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


class Encoder:
    """Piece ids of columns of texts; words met before are looked up."""

    def __init__(self, tables: dict) -> None:
        self.viterbi, self.known = Viterbi(tables), {}

    def __call__(self, column: pa.Array) -> pa.ListArray:
        texts = [_cut(MARK + t.replace(" ", MARK)) if t else [] for t in column.to_pylist()]
        new = list({w for t in texts for w in t if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list({w for t in texts for w in t})
        for first in range(0, len(new), TOGETHER):
            some = new[first : first + TOGETHER]
            self.known.update(zip(some, self.viterbi.encode(some), strict=True))
        ids = [b"".join(map(self.known.__getitem__, t)) for t in texts]
        ends = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in ids])], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _spelled(column: pa.ListArray, tables: dict) -> pa.Array:
    """The texts that lists of piece ids spell; a null list has none."""
    raw, ends, texts = tables["raw"], tables["raw_ends"], []
    for ids in column:
        ids = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int64)
        size = ends[ids + 1] - ends[ids]
        at = np.repeat(ends[ids] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(ids) else np.zeros(0, np.int64)
        texts.append(raw[at].tobytes().removeprefix(b" ").decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, tables: dict, text_column: str = "text", ids_column: str = "piece_ids", decoded_column: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of each whole text.

    With ``decoded_column`` also with the text that they spell, read back in the same
    task: a second one for ``decode`` would hold two more workers on each core.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    added = [ids_column, *([decoded_column] if decoded_column else [])]

    @lean
    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            for a, b in slices(utf8(batch.column(batch.num_columns - 1))[0]):
                part = batch.slice(a, b - a)
                ids = encoder(part.column(part.num_columns - 1))
                more = [_spelled(ids, shared.value)] if decoded_column else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, *more], names=[*batch.schema.names[:-1], *added])

    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in added}]
    schema = docs.select(*kept).withColumn(ids_column, F.array(F.lit(0)))
    schema = (schema.withColumn(decoded_column, F.lit("")) if decoded_column else schema).schema
    return docs.select(*kept, text_of(docs, text_column).alias(fresh(docs, "_whole"))).mapInArrow(run, schema)


def decode(docs: DataFrame, tables: dict, ids_column: str = "piece_ids", text_column: str = "decoded") -> DataFrame:
    """``docs`` with the text that its piece ids spell; the first space is the encoder's own."""
    shared = docs.sparkSession.sparkContext.broadcast({k: tables[k] for k in ("raw", "raw_ends")})

    @lean
    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _spelled(batch.column(batch.num_columns - 1), shared.value)], names=[*batch.schema.names[:-1], text_column])

    kept = [c for c in docs.columns if c.lower() != text_column.lower()]
    schema = docs.select(*kept).withColumn(text_column, F.lit("")).schema
    return docs.select(*kept, docs[ids_column].alias(fresh(docs, "_ids"))).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tables = load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tables, decoded_column="decoded")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", (F.col("decoded") == text_of(coded)).alias("round_trip"))
