"""Personal data: base patterns, and a character BiLSTM with CRF transitions on top.

The base patterns give e-mail addresses, IP addresses, card and phone numbers.
A bidirectional LSTM with a CRF layer, trained in numpy on base spans and
rewritten forms of them (labels follow the text), reads windows around every
digit, ``@``, ``(at)`` and ``[at]`` and adds spans that the patterns miss.  Windows overlap; each
character takes its tag from the window in whose middle it stands nearest, and
spans are joined over the whole text and completed to the ends of the words they
cut.  Base spans always stay; an added span that overlaps a base span or breaks
its kind's rule is dropped.

Offsets are code points, end exclusive.  Nulls count as the empty text.  Texts
without a trigger hold none of the four kinds in a form that training writes
and are not read further; texts of any length and digit runs of any length are
read whole.  Where tags tie, the lower one wins.  Repeated rows and null ids are
treated like any other; an empty table gives an empty result, and one without
base spans a model that adds little.  Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Texts that training windows come from at most, training windows, and steps.
MAX_TEXTS, MAX_WINDOWS, STEPS = 600, 3_000, 360
#: Characters of a window, by how much windows move on, and context around a trigger.
WINDOW, STRIDE, MARGIN = 96, 48, 40
HIDDEN, EMBED = 16, 10
#: Outside, and begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

# The possessive first part reads each run once; what follows decides for all its suffixes alike.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(digits: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    found = []
    if "@" in text:
        found += [(0, m.start(), m.end()) for m in EMAIL.finditer(text) if m[1]]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if m[1] and all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def code_points(text: str) -> np.ndarray:
    """Input symbols: printable ASCII one by one, other letters, other characters; 0 pads."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((c >= 32) & (c < 127), c - 31, np.where(c < 32, 96, 97))


SYMBOLS = 98


def _renewed(kind: int, value: str, rng: np.random.Generator) -> str:
    """A span of the same form with other digits, so that no number is learned by heart."""
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(256, size=4))
    value = "".join(str(rng.integers(10)) if c in "0123456789" else c for c in value)
    if kind == 2:
        at = max(i for i, c in enumerate(value) if c in "0123456789")
        last = (value[:at] + d + value[at + 1 :] for d in "0123456789")
        value = next(x for x in last if luhn(re.sub("[^0-9]", "", x)))
    return value


def rewritten(kind: int, value: str, rng: np.random.Generator) -> str:
    """A span as people write it to keep programs from reading it; none of these forms meets its base pattern."""
    if kind == 0:
        value = value.replace("@", rng.choice([" @ ", " (at) ", "(at)", " [at] ", "[at]"]))
        return value.replace(".", " . ") if rng.random() < 0.3 and "@" in value else value
    if kind == 1:
        return value.replace(".", rng.choice([" . ", "[.]", ". ", "(.)"]))
    if kind == 2:
        return rng.choice([".", "/", "  ", "_"]).join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", value)))
    return re.sub(r"[\x20().-]+", rng.choice([" ", ".", "-", "/"]), value.lstrip("+")).strip(" ./-")


def _variants(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator):
    """The text with each span renewed and most of them rewritten, and the spans in the new text."""
    out, labels, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        value = _renewed(kind, text[a:b], rng)
        if rng.random() < 0.75:
            value = rewritten(kind, value, rng)
        out += [text[at:a], value]
        size += a - at + len(value)
        labels.append((kind, size - len(value), size))
        at = b
    return "".join([*out, text[at:]]), labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, keep: bool):
    """x: time x batch x inputs.  Hidden states, and what the backward pass needs."""
    steps, batch, _ = x.shape
    size = w.shape[1] // 4
    h, c, out, saved = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype), np.empty((steps, batch, size), x.dtype), []
    drive = x @ w[: x.shape[2]] + w[-1]
    recur = w[x.shape[2] : -1]
    for t in range(steps):
        z = drive[t] + h @ recur
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        before, past = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, tc, past))
    return out, saved


def _lstm_back(x: np.ndarray, w: np.ndarray, saved: list, up: np.ndarray):
    n_in, size = x.shape[2], w.shape[1] // 4
    dw, dx = np.zeros_like(w), np.empty_like(x)
    dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
    for t in range(len(saved) - 1, -1, -1):
        i, f, o, g, before, tc, past = saved[t]
        dh = dh + up[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw[:n_in] += x[t].T @ dz
        dw[n_in:-1] += past.T @ dz
        dw[-1] += dz.sum(0)
        dx[t] = dz @ w[:n_in].T
        dh, dc = dz @ w[n_in:-1].T, dc * f
    return dw, dx


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def emissions(p: dict[str, np.ndarray], symbols: np.ndarray, keep: bool = False):
    """symbols: batch x time.  Tag scores, time x batch x tags."""
    x = p["embed"][symbols.T]
    ahead, s1 = _lstm(x, p["ahead"], keep)
    behind, s2 = _lstm(x[::-1], p["behind"], keep)
    both = np.concatenate([ahead, behind[::-1]], 2)
    return both @ p["out"] + p["bias"], (x, both, s1, s2)


def viterbi(p: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """The best tags, batch x time, under emissions and transitions."""
    steps, batch, _ = scores.shape
    best, back = scores[0], np.empty((steps, batch, TAGS), np.int8)
    for t in range(1, steps):
        way = best[:, :, None] + p["moves"]
        back[t] = way.argmax(1)
        best = way.max(1) + scores[t]
    tags = np.empty((batch, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(batch), tags[:, t]]
    return tags


def _gradients(p: dict[str, np.ndarray], symbols: np.ndarray, tags: np.ndarray):
    """Of the CRF's negative log likelihood a character."""
    scores, (x, both, s1, s2) = emissions(p, symbols, keep=True)
    steps, batch, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[0] = scores[0]
    for t in range(1, steps):
        forward[t] = _lse(forward[t - 1][:, :, None] + p["moves"], 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        backward[t] = _lse(p["moves"] + (scores[t + 1] + backward[t + 1])[:, None, :], 2)
    total = _lse(forward[-1], 1)
    d = np.exp(forward + backward - total[:, None])
    moves = np.zeros_like(p["moves"])
    for t in range(1, steps):
        moves += np.exp(forward[t - 1][:, :, None] + p["moves"] + (scores[t] + backward[t])[:, None, :] - total[:, None, None]).sum(0)
    np.subtract.at(moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    d[np.arange(steps)[:, None], np.arange(batch)[None, :], tags.T] -= 1
    n = steps * batch
    d /= n
    up = d @ p["out"].T
    da, dx = _lstm_back(x, p["ahead"], s1, up[:, :, :HIDDEN])
    db, dy = _lstm_back(x[::-1], p["behind"], s2, up[::-1, :, HIDDEN:])
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, symbols.T.ravel(), (dx + dy[::-1]).reshape(-1, EMBED))
    return {"embed": embed, "ahead": da, "behind": db, "out": np.tensordot(both, d, ([0, 1], [0, 1])), "bias": d.sum((0, 1)), "moves": moves / n}


def fit(texts: list[str], seed: int = 3) -> dict[str, np.ndarray]:
    """Train on windows of the texts: around base spans as they stand, around renewed and rewritten ones, and around other triggers."""
    rng = np.random.default_rng(seed)
    shape = {"embed": (SYMBOLS, EMBED), "ahead": (EMBED + HIDDEN + 1, 4 * HIDDEN), "behind": (EMBED + HIDDEN + 1, 4 * HIDDEN), "out": (2 * HIDDEN, TAGS), "bias": (TAGS,), "moves": (TAGS, TAGS)}
    p = {k: rng.normal(0, 0.2, s).astype(np.float32) for k, s in shape.items()}
    p["bias"][0] += 2
    inputs, targets = [], []
    for text in texts:
        for turn in range(4):
            base = base_spans(text)
            if turn and not base:
                break
            new, labels = _variants(text, base, rng) if turn else (text, base)
            tags, symbols = np.zeros(len(new), np.int64), code_points(new)
            for kind, a, b in labels:
                tags[a:b] = 2 + 2 * kind
                tags[a] = 1 + 2 * kind
            spots = [m.start() for m in TRIGGER.finditer(new)]
            at = [a for _, a, _ in labels][:3] + ([] if turn else spots[:: max(1, len(spots) // 2)][:2])
            for spot in at:
                first = max(0, min(spot - int(rng.integers(WINDOW - 30)), len(new) - WINDOW))
                pad = max(0, WINDOW - (len(new) - first))
                inputs.append(np.r_[symbols[first : first + WINDOW], np.zeros(pad, np.int64)])
                targets.append(np.r_[tags[first : first + WINDOW], np.zeros(pad, np.int64)])
        if len(inputs) >= MAX_WINDOWS:
            break
    if not inputs:
        return p
    inputs, targets = np.stack(inputs), np.stack(targets)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, STEPS + 1):
        some = rng.integers(len(inputs), size=48)
        for k, g in _gradients(p, inputs[some], targets[some]).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - 0.03 * (0.1 + 0.9 * (1 - step / STEPS)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _windows(text: str) -> list[int]:
    """Starts of the windows that cover every trigger of the text with its surroundings."""
    starts, reach = [], -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while reach < b:
            first = a if a > reach else starts[-1] + STRIDE
            starts.append(first)
            reach = first + WINDOW
    return starts


def _tagged(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a run of tags; an inside tag without its begin starts a span too."""
    kind = (tags + 1) // 2
    begin = (kind > 0) & ((tags % 2 == 1) | (kind != np.r_[0, kind[:-1]]))
    starts = np.flatnonzero(begin)
    end = np.flatnonzero((kind > 0) & (np.r_[begin[1:], True] | (kind != np.r_[kind[1:], 0])))
    return [(int(kind[a]) - 1, int(a), int(b) + 1) for a, b in zip(starts, end, strict=True)]


def _plausible(kind: int, value: str) -> bool:
    """Whether an added span keeps to what its kind is: four parts up to 255, digits that pass Luhn, and so on."""
    digits = "".join(c for c in value if c in "0123456789")
    parts = re.findall("[0-9]+", value)
    return {
        0: bool(re.search(r"[A-Za-z0-9]\s*(@|\(at\)|\[at\])\s*[A-Za-z0-9-]+(\s*\.\s*[A-Za-z0-9-]+)+$", value)),
        1: len(parts) == 4 and all(map(_small, parts)),
        2: 16 <= len(digits) <= 19 and luhn(digits),
        3: 8 <= len(digits) <= 15,
    }[kind]


#: Characters that a span of each kind may go on with.
GOES_ON = ("[A-Za-z0-9._%+-]", "[0-9]", "[0-9]", "[0-9]")


def _completed(text: str, kind: int, a: int, b: int) -> tuple[int, int, int]:
    """The span up to the ends of the words or numbers that it cuts, without outer blanks and stops."""
    goes_on = re.compile(GOES_ON[kind]).match
    while a > 0 and goes_on(text[a - 1]) and goes_on(text[a]):
        a -= 1
    while b < len(text) and goes_on(text[b]) and goes_on(text[b - 1]):
        b += 1
    part = text[a:b]
    return kind, a + len(part) - len(part.lstrip(" .,;:-/_")), b - (len(part) - len(part.rstrip(" .,;:-/_")))


def find_all(p: dict[str, np.ndarray], texts: list[str], batch: int = 256):
    """Per text: its base spans, and all spans by kind and start."""
    where = [(i, s) for i, t in enumerate(texts) for s in (_windows(t) if TRIGGER.search(t) else [])]
    tags: dict[int, np.ndarray] = {}
    depth: dict[int, np.ndarray] = {}
    symbols: dict[int, np.ndarray] = {}
    for i, _ in where:
        if i not in symbols:
            symbols[i] = np.r_[code_points(texts[i]), np.zeros(WINDOW, np.int64)]
            tags[i], depth[i] = np.zeros(len(symbols[i]), np.int64), np.full(len(symbols[i]), -1)
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for a in range(0, len(where), batch):
        part = where[a : a + batch]
        found = viterbi(p, emissions(p, np.stack([symbols[i][s : s + WINDOW] for i, s in part]))[0])
        for (i, s), row in zip(part, found, strict=True):
            better = inner > depth[i][s : s + WINDOW]
            tags[i][s : s + WINDOW][better] = row[better]
            depth[i][s : s + WINDOW][better] = inner[better]
    for i, text in enumerate(texts):
        if i not in tags:
            yield [], []
            continue
        base = base_spans(text)
        more = []
        for k, a, b in (_completed(text, *span) for span in _tagged(tags[i][: len(text)])):
            if a < b and _plausible(k, text[a:b]) and all(b <= x or y <= a for _, x, y in base + more):
                more.append((k, a, b))
        yield base, sorted(base + more)


def train(docs: DataFrame, text_column: str = "text") -> dict[str, np.ndarray]:
    """Fit on at most MAX_TEXTS texts that hold a digit or ``@``, the first by a hash of the text.

    Texts that look as if they held a base span come first; what the hash bounds is
    ordered before it is cut, so the model does not depend on partitions.
    """
    rows = docs.select(text_of(docs, text_column).alias("text"))
    likely = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]\.[0-9]|[0-9]{12}")
    marked = rows.filter(F.col("text").rlike("[0-9@]")).withColumn("likely", likely)
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("likely"), 1)).alias("likely")).first()
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    few = lambda kept, n, most: kept.filter(share < min(1.0, 1.5 * most / max(1, n))).orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return fit([r.text for r in few(marked.filter("likely"), counts.likely, MAX_TEXTS) + few(marked.filter("not likely"), counts.n - counts.likely, MAX_TEXTS // 6)])


def find(docs: DataFrame, model: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, base and spans, both arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = list(find_all(shared.value, batch.column(1).to_pylist()))
            named = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[which]] for f in found], span) for which in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *named], names=["doc_id", "base", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_column).alias("doc_id"), text_of(docs, text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    more = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("personal")]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)
