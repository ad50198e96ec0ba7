import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import components, decontamination, exact_dedup, language_id, line_dedup, near_dedup, pii, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from confluo.llm.common import stored

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, _key int, score string"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(999)}" if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base, long = prose(1, 300), prose(2, 20_000, 5_000)
    rows = [
        (1, base, "en", "a", 1, "s"),
        (2, base, "en", None, None, None),
        (3, edited(base, 5, 0.05), None, "a", 1, "s"),
        (4, None, None, None, None, None),
        (5, "", "de", "b", 2, "t"),
        (None, "only this", "en", "a", 1, "s"),
        (6, long, "fr", "c", 3, "u"),
        (6, long, "fr", "c", 3, "u"),
        (7, prose(9, 120), "en", "a", 1, "s"),
        (8, "line one is here\nanother line\n\nLINE  one is here", "en", "a", 1, "s"),
        (9, "mail a.b@c.example.org from 10.0.0.255 or +1 (377) 555-0271, card 4111 1111 1111 1111", "en", "a", 1, "s"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_marks_and_drops(docs, empty):
    rows = exact_dedup.mark_copies(docs).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    assert (1, 2, 2, False) in by and (2, 2, 2, True) in by
    assert (4, 5, 2, False) in by and (5, 5, 2, True) in by
    assert sorted(r.kept for r in rows if r.doc_id == 6) == [False, True]
    assert all(r.text_sha256 for r in rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "5", "None", "6", "7", "8", "9"])
    assert exact_dedup.mark_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_bloom_filter_lets_repeats_through_only(spark):
    many = spark.range(20_000).select(F.sha2((F.col("id") % 19_000).cast("string"), 256).alias("text_sha256"))
    slots, n = exact_dedup.repeated_slots(many, 20_000)
    maybe, alone = exact_dedup.split(many, slots, n)
    assert maybe.count() + alone.count() == 20_000
    assert alone.groupBy("text_sha256").count().filter("count > 1").count() == 0
    assert 2_000 <= maybe.count() < 3_000


def test_near_dedup_classes(docs, empty):
    rows = {r.doc_id: r for r in near_dedup.classes(docs).collect()}
    assert rows[1].class_id == rows[2].class_id == rows[3].class_id == 1
    assert rows[1].kept and not rows[3].kept and rows[3].n_links == 1
    assert rows[4].class_id == rows[5].class_id == 4 and rows[7].class_size == 1
    assert near_dedup.drop_near_copies(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_copies(docs).collect() if r.doc_id != 6) == ["1", "4", "7", "8", "9", "None"]
    assert near_dedup.classes(empty).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_alignment_and_bounds_against_brute_force():
    r = random.Random(0)
    for _ in range(300):
        a = [r.randint(2, 60) for _ in range(r.randint(0, 50))]
        b = [x if r.random() > 0.15 else r.randint(2, 60) for x in a if r.random() > 0.05]
        left, right, want = np.array(a, np.uint64), np.array(b, np.uint64), edit_distance(a, b)
        low, high = near_dedup.distance_bounds(left, right)
        assert low <= want <= high
        got = near_dedup.aligned([(left, right)], 0.2 + 1e-9)[0]
        assert got == (want if want <= int((0.2 + 1e-9) * max(len(a), len(b))) else -1)


def test_long_pairs_are_aligned_alike(monkeypatch):
    r = random.Random(5)
    pairs = []
    for _ in range(60):
        a = [r.randint(2, 60) for _ in range(r.randint(1, 60))]
        pairs.append(tuple(np.array(x, np.uint64) for x in (a, [x if r.random() > 0.15 else 1 for x in a])))
    banded = near_dedup.aligned(pairs, 0.2)
    monkeypatch.setattr(near_dedup, "MAX_CELLS", 0)
    assert (near_dedup.aligned(pairs, 0.2) == banded).all() and (banded >= 0).any() and (banded < 0).any()


def test_near_dedup_links_drifting_texts_and_crowded_buckets(spark, monkeypatch):
    """Chains of three whose ends are not near each other, all in the same buckets."""
    n = near_dedup.SKETCHES
    monkeypatch.setattr(near_dedup, "sketched", lambda word, owner, n_texts: (np.arange(n_texts), np.tile(np.arange(n), (n_texts, 1))))
    rows, chain = [], {}
    for c in range(8):
        words = [f"w{c}x{i}" for i in range(60)]
        for k in range(3):
            chain[len(rows)] = c
            rows.append((len(rows), " ".join(["changed" if i < 9 * k else w for i, w in enumerate(words)])))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all((got[a] == got[b]) == (chain[a] == chain[b]) for a in got for b in got)


def test_near_dedup_finds_planted_copies(spark):
    originals = [prose(100 + i, 150, 2_000) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(originals)] + [(100 + i, edited(t, i, 0.06)) for i, t in enumerate(originals)]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[100 + i] == i for i in range(30)) and len(set(found.values())) == 30


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(200 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(1, 30))


def test_line_dedup_keeps_the_first_of_each_group(docs, empty, spark):
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[8] == "line one is here\nanother line\n" and got[4] is None and got[5] == ""
    assert got[1] and got[2] == ""
    assert line_dedup.repeated_lines(empty).count() == 0
    long = prose(3, 400, 4_000)
    near = spark.createDataFrame([(1, long), (2, long + " end"), (3, prose(4, 400))], "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(near).collect()}
    assert left[1] == long and left[2] == "" and left[3]


def test_line_dedup_recall_against_brute_force(spark):
    """Lines of 5 to 40 words, up to a fifth of the words replaced or changed by a character."""
    r, rows = random.Random(8), []
    for i in range(240):
        words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(r.randint(5, 40))]
        other = list(words)
        for at in r.sample(range(len(words)), r.randint(1, len(words) // 5)):
            other[at] = other[at] + "," if i % 2 else "".join(r.choices("qrstuvwxyz", k=len(other[at])))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    near = {i for i in range(240) if edit_distance(rows[2 * i][1], rows[2 * i + 1][1]) <= int(0.2 * max(len(rows[2 * i][1]), len(rows[2 * i + 1][1])) + 1e-6)}
    left = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(near) > 200 and all(left[2 * i] for i in range(240))
    assert {i for i in range(240) if not left[2 * i + 1]} <= near
    assert sum(not left[2 * i + 1] for i in near) >= 0.98 * len(near)


def test_line_dedup_leaves_no_pair_of_a_block_apart(spark):
    """Ten chains of three lines in one block: neighbours are near, the ends of a chain are not."""
    lines, chain = [], {}
    for c in range(10):
        words = ["".join(random.Random(100 * c + i).choices("abcdefghijklmnopqrstuvwxy", k=5)) for i in range(40)]
        for k in range(3):
            lines.append(" ".join(["zzzzz"[: len(w)] if k and i < 6 * k else w for i, w in enumerate(words)]))
            chain[lines[-1]] = c
    docs = spark.createDataFrame([*enumerate(lines)], "doc_id bigint, text string")
    known = line_dedup.distinct_lines(line_dedup.cut_lines(docs)).withColumns({"bands": F.lit(b"\1" * line_dedup.BANDS * line_dedup.BAND_BYTES), "hash": F.lit(0).cast("long"), **{f"s{i}": F.lit(0).cast("long") for i in range(3)}})
    text = {r.id: r.text for r in known.join(line_dedup.cut_lines(docs).select("key", "doc_id"), "key").join(docs, "doc_id").collect()}
    root = {text[r.node]: r.root for r in line_dedup.groups(docs.select("text"), stored(known, "known")).collect()}
    for a in lines:
        assert {b for b in lines if root[b] == root[a]} == {b for b in lines if chain[b] == chain[a]}
    assert edit_distance(lines[0], lines[2]) > 0.2 * len(lines[0])


def test_simhash_agrees_with_bit_counts():
    def plain(line):
        data = np.frombuffer(line.encode(), np.uint8)
        h = [int(x) for x in decontamination._hashes(line)]
        one = int(near_dedup.mix(np.array([min(h)], np.uint64))[0])
        ones = [2 * sum(x >> b & 1 for x in h) for b in range(64)]
        assert len(data)
        return sum(1 << b for b in range(64) if ones[b] > len(h) or (ones[b] == len(h) and one >> b & 1))

    lines = [prose(i, n) for i, n in ((1, 1), (2, 8), (3, 77), (4, 4_000))] + ["a | b | c", "ünïcode, yes"]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    joined, starts, ends, text, number = line_dedup.normal_lines(np.array([0, len(data)]), data)
    hashes, _ = line_dedup.summaries(joined, starts, ends)
    assert [int(h) for h in hashes] == [plain(x) for x in lines] and number.tolist() == [*range(len(lines))] and not text.any()


def test_lines_are_normalised_and_numbered():
    texts = ["  a\t b \n\n c\n", "", "d", "\n\n e  f", "  \n \t", "gé h"]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    joined, starts, ends, text, number = line_dedup.normal_lines(offsets, np.frombuffer("".join(texts).encode(), np.uint8))
    raw = joined.tobytes()
    want = [(i, k, " ".join(line.split())) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.strip()]
    assert [(int(t), int(k), raw[a:b].decode()) for t, k, a, b in zip(text, number, starts, ends, strict=True)] == want


def test_edit_distance_of_lines_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        w = ["".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(r.randint(1, 12))]
        a, b = " ".join(w), " ".join(x if r.random() > 0.15 else "".join(r.choices("abcde", k=3)) for x in w)
        points = [np.array([ord(c) for c in x], np.int64) for x in (a, b)]
        want = edit_distance(a, b)
        assert line_dedup._by_words(*points) >= want
        assert all(line_dedup.similar_within(*points, k) == (want <= k) for k in (want - 1, want, want + 1, int(0.2 * max(len(a), len(b)))))


def test_toxicity_learns_from_positives_and_unlabelled(spark, empty):
    r = random.Random(1)
    rows = []
    for i in range(1_500):
        words = prose(i, 60).split()
        if toxic := i % 8 == 0:
            words[r.randrange(60)] = r.choice(["zog", "blarg"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x if i % 3 else None) for i, _, x in rows if i % 5 != 4], "doc_id bigint, toxic int")
    scored = {x.doc_id: x.score for x in toxicity.with_scores(docs, toxicity.train(docs, labels)).collect()}
    held = [(scored[i] >= 0.5, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == bool(x) for p, x in held) / len(held) > 0.95
    assert toxicity.with_scores(empty, toxicity.train(docs, labels)).count() == 0
    none = toxicity.train(docs, labels.filter("false"))
    assert toxicity.with_scores(docs, none).filter("score >= 0.5").count() == 0


def test_language_id(spark, docs, empty):
    tongues = {"aa": "kala mola tiri sana", "bb": "strum gneft pfolk drusch", "cc": "ouieau eaux ielle"}
    rows = [(i, " ".join(random.Random(i).choices(w.split(), k=20)), k) for i in range(300) for k, w in [list(tongues.items())[i % 3]]]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(known, F.col("doc_id") % 4 != 2)
    got = language_id.with_language(known, model).filter("doc_id % 4 = 2").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in language_id.with_language(docs, model).collect()}
    assert odd[4] == odd[5] == "und" and odd[1] != "und"
    assert language_id.with_language(empty, model).count() == 0
    assert language_id.with_language(docs, language_id.train(empty, F.lit(True))).filter("lang_pred != 'und'").count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_against_the_plain_patterns(docs):
    r = random.Random(2)
    texts = ["".join(r.choices("a1. @+-()é9%", k=60)) for _ in range(3_000)] + ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "x" * 5_000 + "@"]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)


def test_pii_finds_base_spans_and_survives_odd_rows(docs, empty):
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert [s.kind for s in got[9].base] == ["email", "ip", "card", "phone"] and set(got[9].base) <= set(got[9].spans)
    assert got[4].base == [] and got[5].spans == []
    assert pii.find(empty, model).count() == 0


def pii_text(seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choices("abcdefghijklmnoprstu", k=r.randint(3, 8)))
    number = lambda n: "".join(r.choices("0123456789", k=n))
    card = number(15)
    card += next(d for d in "0123456789" if pii.luhn(card + d))
    spans = [f"{name()}.{number(2)}@{name()}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), card, f"+1 ({number(3)}) 555-{number(4)}"]
    said = lambda: " ".join(name() for _ in range(r.randint(6, 12)))
    return " ".join(f"{said()} {s}" for s in r.sample(spans, 3)) + f" {said()} {number(r.randint(1, 6))} {said()}"


def test_pii_adds_held_out_rewritten_spans_of_every_kind():
    model, rng = pii.fit([pii_text(i) for i in range(300)]), np.random.default_rng(1)
    total, hit, added, wrong = collections.Counter(), collections.Counter(), 0, 0
    for i in range(1_000, 1_150):
        text, out, labels, at = pii_text(i), "", [], 0
        for kind, a, b in sorted(pii.base_spans(text), key=lambda s: s[1]):
            out += text[at:a]
            labels.append((kind, len(out), len(out) + len(value := pii.rewritten(kind, text[a:b], rng))))
            out, at = out + value, b
        out += text[at:]
        ((base, spans),) = pii.find_all(model, [out])
        for span in labels:
            total[span[0]] += 1
            hit[span[0]] += span in spans
        more = set(spans) - set(base)
        added, wrong = added + len(more), wrong + len(more - set(labels))
    assert all(hit[k] >= 0.85 * total[k] for k in range(4)) and wrong <= 0.1 * added


def test_pii_survives_digit_runs_of_any_length():
    text = "9" * 5_000 + ".1.1.1 then 000000255.0.0.1"
    assert [s[0] for s in pii.base_spans(text)] == [1]
    assert len(list(pii.find_all(pii.fit([]), [text, "1" * 20_000]))) == 2


def test_pii_reads_written_addresses_far_from_digits():
    r = random.Random(6)
    name = lambda: "".join(r.choices("abcdefghijklmnoprstu", k=r.randint(3, 8)))
    said = lambda n: " ".join(name() for _ in range(n))
    model = pii.fit([f"{said(12)} {name()}.{name()}@{name()}.example.org {said(12)}" for _ in range(300)])
    for form in ("(at)", "[at]", " (at) ", " [at] "):
        texts = [f"{said(30)} {name()}.{name()}{form}{name()}.example.org {said(30)}" for _ in range(20)]
        at = [t.index(form) for t in texts]
        found = list(pii.find_all(model, texts))
        assert sum(any(k == 0 and a <= x < b for k, a, b in spans) for (_, spans), x in zip(found, at, strict=True)) >= 10
    assert list(pii.find_all(model, [said(60)])) == [([], [])]


def test_decontamination_finds_passages_and_light_paraphrases(spark, docs, empty):
    items = [prose(700 + i, 30 + i, 3_000) for i in range(12)]
    rows = [(i, prose(i, 200, 3_000)) for i in range(60)]
    rows += [(100 + i, f"{prose(900 + i, 90, 3_000)} {t} {prose(950 + i, 90, 3_000)}") for i, t in enumerate(items)]
    rows += [(200 + i, f"{prose(900 + i, 70, 3_000)} {edited(t, i, 0.1)}") for i, t in enumerate(items)] + [(300, None), (301, "")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (None, "x"), (51, "")], "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.with_leaks(corpus, bench).collect()}
    assert all(got[100 + i] == [i] for i in range(12)) and sum(got[200 + i] == [i] for i in range(12)) >= 11
    assert all(not got[i] for i in [*range(60), 300, 301])
    assert decontamination.with_leaks(empty, bench).count() == 0
    assert decontamination.with_leaks(docs, bench.filter("false")).filter("size(item_ids) > 0").count() == 0


def test_decontamination_finds_an_item_that_a_hot_source_repeats(spark):
    """Each word of the item is in far more than a few hundredths of the passages; a second one has common words only."""
    item, plain = prose(5_071, 40, 3_000), " ".join(random.Random(72).choices([f"c{i}" for i in range(24)], k=40))
    rows = [(i, f"{prose(i, 150, 3_000)} {item if i % 2 == 0 else ''} {prose(1_000 + i, 100, 3_000)}") for i in range(90)]
    rows += [(100 + i, f"{prose(2_000 + i, 60, 3_000)} {' '.join(random.Random(i).choices([f'c{j}' for j in range(24)], k=40))}") for i in range(90)]
    rows += [(300, f"{prose(3_000, 100, 3_000)} {plain} {prose(3_001, 100, 3_000)}")]
    bench = spark.createDataFrame([(1, item), (2, plain)], "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.with_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert all((1 in got[i]) == (i % 2 == 0) for i in range(90)) and got[300] == [2]


def test_decontamination_without_vectors_is_exact():
    """An item or window of zero length in the latent space is compared word by word."""
    import types

    import pyarrow as pa

    item = prose(73, 40)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([f"{prose(74, 50)} {item}", prose(75, 90, 3_000)])], names=["doc_id", "text"])
    held = lambda value: types.SimpleNamespace(value=value)
    space = np.zeros((decontamination.TERMS, 4), np.float32)
    (out,) = decontamination._search(held(space), held([(9, item)]))([batch])
    assert out.column("item_ids").to_pylist() == [[9], []]


def test_suffix_array_by_grouping():
    r = random.Random(3)
    for _ in range(500):
        s = [r.randrange(r.choice([2, 3, 26])) for _ in range(r.randint(0, 60))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain_removal(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        yield sum(gone), bytes(c for c, g in zip(t, gone, strict=True) if not g)


@pytest.mark.parametrize("crowded", [1000, 1])
def test_suffix_dedup_against_brute_force(spark, docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "MAX_RECORDS", crowded)
    shared, r = prose(5, 90), random.Random(4)
    rows = [(i, f"{prose(60 + i, 40)} {shared[r.randrange(40):]} {prose(80 + i, 40)}") for i in range(12)]
    rows += [(30 + i, f"{prose(90 + i, 9)} {shared[:400]}{prose(95 + i, 9)}") for i in range(5)]
    rows += [(20, "a" * 3_000), (21, "ab" * 700), (22, None), (23, ""), (24, "é" * 300), (25, shared * 3)]
    rows += [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 6] + [(None, shared), (None, shared)]
    got = collections.Counter((r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = collections.Counter((n, hashlib.sha256(k).hexdigest()) for n, k in plain_removal([(t or "").encode() for _, t in rows], suffix_dedup.LENGTH))
    assert got == want
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["It's  A TEST's ½ ² İstanbul ΑΣ ﬁ  x y\x1cz", "a<|endoftext|>b<|startoftext|>", "!!'s''t", "日本語 é é 😀😀", None, ""]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(odd, 50))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect())
    assert got == collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_sentencepiece_equals_the_library_and_round_trips(spark, docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, tables = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load(path)
    odd = [" ", "  a", "aaaa aaa aa", "hello   world\n\nfoo \t x", "日本語テキスト😀é", "<s> <0x0A>", "a" * 60, "=====-----////", "", None]
    rows = [(r.doc_id, r.text, "mine") for r in docs.collect()] + [(50 + i, t, "mine") for i, t in enumerate(odd)]
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(spark.createDataFrame(rows, "doc_id bigint, text string, piece_ids string"), tables), tables).collect()
    assert len(coded) == len(rows)
    for r in coded:
        assert r.piece_ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert sentencepiece_codec.encode(empty, tables).count() == 0


def test_pairs_that_share_a_template_with_many_others_are_found(spark):
    """Sixty pairs at 0.83 whose texts are at 0.78 to all others: one bucket of 120 texts, sixty classes."""
    template, rows = prose(40, 156, 5_000), []
    for p in range(60):
        shared = " ".join(f"p{p}x{k}" for k in range(10))
        for side in range(2):
            own = " ".join(f"o{p}s{side}x{k}" for k in range(34))
            rows.append((2 * p + side, f"{template} {shared} {own}"))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_pairs_in_a_bucket_of_any_size_are_found(spark):
    """As above with two hundred pairs: a bucket of 400 texts, of which no one is near more than one other."""
    template, rows = prose(40, 156, 5_000), []
    for p in range(200):
        shared = " ".join(f"p{p}x{k}" for k in range(10))
        for side in range(2):
            own = " ".join(f"o{p}s{side}x{k}" for k in range(34))
            rows.append((2 * p + side, f"{template} {shared} {own}"))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_rare_words_of_near_texts_meet():
    """Whatever the counts, texts at 0.8 share one of the words that are taken."""
    from functools import partial

    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    rows = []
    for _ in range(150):
        a = r.choices([f"w{i}" for i in range(40)], k=r.randint(1, 60))
        b = list(a)
        for _ in range(int(0.2 * len(a))):
            if r.random() < 0.5:
                b[r.randrange(len(b))] = "new"
            else:
                b.insert(r.randrange(len(b)), f"w{r.randrange(40)}")
        rows += [" ".join(a), " ".join(b)]
    often = np.random.default_rng(1).integers(0, 9, near_dedup.SLOTS)
    out = {}
    for batch in near_dedup._rarest([pa.record_batch([pa.array([b"%d" % i for i in range(len(rows))]), pa.array(rows)], names=["key", "text"])], often):
        for key, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault(int(key), set()).add(word)
    near = near_dedup.similar(pa.array(rows[::2]), pa.array(rows[1::2]))
    assert near.sum() > 100 and all(out[2 * i] & out[2 * i + 1] for i in np.flatnonzero(near))


def test_near_copies_shuffle_only_texts_of_shared_sketches(spark, monkeypatch):
    """No join by key is planned before the bitmap, which drops the texts that share no sketch where they are read."""
    plans, kept = {}, near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    rows = [(i, " ".join(f"w{(i // 2) * 100 + j}" for j in range(40)) + (" end" if i % 2 else "")) for i in range(40)]
    found = near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i // 2 * 2 for i in range(40)}
    assert "LeftSemi" not in plans["candidates"] and "bitmap_construct_agg" in plans["candidates"]


def test_components_end_with_the_round_that_leaves_stars(spark, monkeypatch):
    written, kept = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (written.append(name), kept(df, name))[1])
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(i, 0) for i in range(1, 9)], "a int, b int")).collect()}
    assert got == dict.fromkeys(range(9), 0)
    # the links as given, and one round
    assert len(written) == 2
    chain = {r.node: r.root for r in components.components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "a int, b int")).collect()}
    assert chain == dict.fromkeys(range(31), 0) | {40: 40, 41: 40}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_of_few_links_take_no_round_and_of_many_agree(spark, monkeypatch):
    """A long chain is written as given and as stars; with a task for every few links the rounds give the same."""
    written, kept = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (written.append(name), kept(df, name))[1])
    pairs = [(bytes([255 - i]), bytes([254 - i])) for i in range(100)] + [(b"\x01", b"\x02"), (b"\x02", b"\x01"), (b"\x07", b"\x07")]
    links = spark.createDataFrame(pairs, "a binary, b binary")
    want = {bytes([155 + i]): bytes([155]) for i in range(101)} | {b"\x01": b"\x01", b"\x02": b"\x01"}
    assert {bytes(r.node): bytes(r.root) for r in components.components(links).collect()} == want
    assert len(written) == 2
    monkeypatch.setattr(components, "TOGETHER", 10)
    several = components.components(links.repartition(20)).collect()
    assert {bytes(r.node): bytes(r.root) for r in several} == want and len(several) == len(want)
    assert len(written) > 4
