"""Edit distances, and the matching of two texts' blocks by them, for tasks that get both texts of a pair in a row."""

from __future__ import annotations

import sys
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from .text import REFINED, WEIGHTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word says which blocks belong together if no more blocks of a text hold it than these.
RARE = 8
#: Spark's type of a match.
MATCH = "struct<template_idx: int, destination_idx: int, phase: string, score: double>"


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance in code points if it is at most ``most``, else -1.

    What both begin and end with costs nothing; of the rest, characters that one side
    lacks bound the distance before a column of the table, held as bits, runs along it.
    """
    if a == b:
        return 0 if most >= 0 else -1
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = (a[:-end], b[:-end]) if end else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return -1
    if not a:
        return len(b)
    if a.isascii() and b.isascii():
        common = np.minimum(*(np.bincount(np.frombuffer(s.encode(), np.uint8), minlength=128) for s in (a, b))).sum()
        if len(b) - common > most:
            return -1
    return _by_bits(a, b, most)


def _by_bits(a: str, b: str, most: int) -> int:
    """Myers' algorithm: a column's steps up and down as bits of two integers."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask, top, score, left = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a), len(b)
    up, down = mask, 0
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
        if score - left > most:
            return -1
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        up, down = fall | ~(across | rise) & mask, rise & across
    return score if score <= most else -1


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _relative(index, total: int):
    return 0.5 + 0.0 * index if total <= 1 else index / (total - 1)


def exact_matches(template: list[str], destination: list[str]) -> list[tuple[int, int]]:
    """The k-th occurrence of a block with the k-th one of the other side."""
    places: dict[str, list[int]] = {}
    for i in range(len(template) - 1, -1, -1):
        places.setdefault(template[i], []).append(i)
    return [(places[x].pop(), j) for j, x in enumerate(destination) if places.get(x)]


def refined_matches(template: list[str], destination: list[str], left: list[int], right: list[int]) -> list[tuple[int, int, float]]:
    """Of the blocks ``right``, each in turn with the best of ``left`` that is still free and reaches the threshold; ties go to the earlier.

    Lengths and places bound the score of all.  The block that shares most rare words and
    the one nearest by its place are scored first, the others by their bounds and only as
    far as they might beat the best, so most edit distances are given up after a few steps.
    """
    content, length, position = WEIGHTS
    texts = [template[i] for i in left]
    chars, sizes = (np.array([count(x) for x in texts], float) for count in (len, _size))
    places, free = _relative(np.array(left, float), len(template)), np.ones(len(left), bool)
    holding: dict[str, list[int]] = {}
    for n, x in enumerate(texts):
        for word in set(x.split(" ")):
            holding.setdefault(word, []).append(n)
    out = []
    for j in right:
        own = destination[j]
        size, apart = _size(own), np.abs(places - _relative(float(j), len(destination)))
        longer = np.maximum(chars, len(own))
        fixed = length * (np.minimum(sizes, size) / np.maximum(sizes, size)) + position * (1 - apart)
        bounds = content * (np.minimum(chars, len(own)) / longer) + fixed
        able = np.flatnonzero(free & (bounds >= REFINED - 1e-9))
        if not len(able):
            continue
        shared = Counter(n for word in set(own.split(" ")) if len(at := holding.get(word, ())) <= RARE for n in at if free[n])
        ahead = {max(shared, key=lambda n: (shared[n], -n))} if shared else set()
        ahead.add(int(able[apart[able].argmin()]))
        best, chosen = REFINED, None
        for n in [*ahead, *(n for n in able[np.argsort(-bounds[able], kind="stable")].tolist() if n not in ahead)]:
            if bounds[n] < best - 1e-9:
                if n in ahead:
                    continue
                break
            most = int((1 - (best - fixed[n]) / content) * longer[n] + 1e-6)
            distance = edit_distance(texts[n], own, most)
            if distance < 0:
                continue
            score = float(content * (1 - distance / longer[n]) + fixed[n])
            if score > best or (score == best and (chosen is None or n < chosen)):
                best, chosen = score, n
        if chosen is not None:
            free[chosen] = False
            out.append((left[chosen], j, best))
    return out


def with_matches(batches):
    """Batches whose last columns are the blocks of two texts, in bytes, with their matches in a further column: exact ones, then refined ones of the blocks that these leave."""
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64()]
    for batch in batches:
        offsets, flat = [0], []
        for sides in zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True):
            template, destination = ([x.decode(errors="surrogateescape") for x in side] for side in sides)
            exact = exact_matches(template, destination)
            taken = [set(x) for x in zip(*exact, strict=True)] or [set(), set()]
            left, right = ([i for i in range(len(side)) if i not in found] for side, found in zip((template, destination), taken, strict=True))
            flat += [(*x, "exact", 1.0) for x in exact]
            flat += [(i, j, "refined", score) for i, j, score in refined_matches(template, destination, left, right)] if left and right else []
            offsets.append(len(flat))
        fields = zip(*flat, strict=True) if flat else [()] * len(kinds)
        rows = pa.StructArray.from_arrays([pa.array(list(f), k) for f, k in zip(fields, kinds, strict=True)], names=["template_idx", "destination_idx", "phase", "score"])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], names=[*batch.schema.names, "matches"])
