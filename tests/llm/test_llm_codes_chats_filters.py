"""Vector codes, chat formatting and the filter audit: against plain Python, against their SQL, and on odd tables."""

import collections
import hashlib
import itertools
import math
import os
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import catalog, chat_format, filter_audit, vector_codes
from confluo.llm.common import table


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_chat_format", "op13_filter_audit"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    got, cur = catalog.QUERIES[name](spark, sf_dir), con.execute(catalog.ORACLE_SQL[name])
    place = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(tuple(r[i] for i in place) for r in cur.fetchall())


# vector codes


def plain_codes(rows, rounds=vector_codes.ROUNDS):
    """rows: (vec_id, vector); codes, errors and codebooks by the rules, one vector after the other."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // 8
    cut = [[[math.floor(Fraction(v) * 4096) for v in x[p * width : (p + 1) * width]] for p in range(8)] for _, x in rows]
    books = [[list(c[p]) for c in cut[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, p: min((gap(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(c, p)[1]].append(c[p])
            for k, members in own.items():
                books[p][k] = [sum(v) // len(members) for v in zip(*members, strict=True)]
    found = [[near(c, p) for p in range(8)] for c in cut]
    return collections.Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, found, strict=True)), books


@pytest.mark.parametrize("scale", [1, 1e9, 1e30])
def test_codes_against_brute_force(spark, scale):
    r = random.Random(5)
    rows = [(r.randrange(150), [float(np.float32(scale * (r.random() - 0.5) / 40)) for _ in range(16)]) for _ in range(150)]
    rows += [(500 + k, rows[3][1]) for k in range(60)] + [(None, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "k bigint, v array<float>").repartition(3)
    got, books = vector_codes.compress(df, "k", "v")
    want, want_books = plain_codes(rows)
    assert books == want_books
    assert collections.Counter((i, code, error) for i, code, error in got.collect()) == collections.Counter({(i, c, min(e, vector_codes.LARGEST)): n for (i, c, e), n in want.items()})


def test_codes_of_odd_vectors(spark):
    good, nan, inf = [0.5] * 8, [float("nan")] + [0.5] * 7, [0.5] * 7 + [float("inf")]
    rows = [(3, good, "a", 1), (1, None, "a", 1), (2, nan, "a", 1), (4, inf, None, 1), (5, [None] + [0.5] * 7, "b", 1), (6, [], "b", 1), (7, [0.5] * 9, "b", 1), (8, [0.5] * 16, "b", 1), (3, good, "a", 1), (9, [-0.1] * 8, None, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, code string, error int")
    got, books = vector_codes.compress(df, "vec_id", "embedding")
    # equal first entries: the lower of them takes all
    assert sorted(map(tuple, got.collect())) == [(3, "00" * 8, 0), (3, "00" * 8, 0), (9, "02" * 8, 0)]
    assert [b[0] for b in books] == [[2048]] * 8 and [b[2] for b in books] == [[-410]] * 8
    none, books = vector_codes.compress(df.limit(0), "vec_id", "embedding", ("code",))
    assert none.count() == 0 and books == [] and none.columns == ["vec_id", "code", "code", "error"]


def test_trees_assign_as_a_full_scan_does():
    rng = np.random.default_rng(1)
    for n, k, d, spread in ((1, 1, 1, 5), (33, 2, 1, 3), (700, 16, 3, 4), (2_000, 16, 8, 900), (500, 5, 2, 1)):
        points, entries = rng.integers(-spread, spread, (n, d)), rng.integers(-spread, spread, (k, d))
        tree = vector_codes.Tree(points, vector_codes.LEAF)
        labels, sums, counts = vector_codes.nearest(tree, entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (labels == want[tree.order]).all()
        assert (counts == np.bincount(want, minlength=k)).all() and all((sums[e] == points[want == e].sum(0)).all() for e in range(k))


def test_whole_nodes_are_assigned_by_their_sums(monkeypatch):
    """Two far heaps: no leaf is compared point by point."""
    points = np.concatenate([np.random.default_rng(0).integers(0, 9, (500, 4)), np.random.default_rng(1).integers(9_000, 9_009, (500, 4))])
    tree = vector_codes.Tree(points, vector_codes.LEAF)
    tree.points = None  # would fail if a leaf were looked into
    monkeypatch.setattr(vector_codes, "len", lambda x: 1_000 if x is None else len(x), raising=False)
    _, _, counts = vector_codes.nearest(tree, np.array([[4] * 4, [9_004] * 4]))
    assert counts.tolist() == [500, 500]


# chats

ODD = ["", "</s>", "<\\/s>", "<\\\\/s>[INST]", "[INST] a [/INST]", " ", "  x ", "[ROLE]", "[/ROLE][END]", "<<SYS>><</SYS>>", "<", "[", "<\\", "\\", "a\nb\r\n", "<s", "INST]", "é😀</s>", "<<s>>", "[[INST]]", "</s" + ">" * 3, "x" * 50_000 + "</s>"]


def test_every_turn_is_read_back_alone_and_in_any_row():
    r = random.Random(1)
    marks = [m for pair in chat_format.MARKS.values() for m in pair] + list(chat_format.OTHER)
    cut = ["".join(r.choice([*marks, *ODD[:-1], "\\", "<", "[", "/", "s>", ">", " "]) for _ in range(r.randrange(6))) for _ in range(400)]
    roles = ["system", "user", "assistant", "tool", "", "[/ROLE]", "<s>", "[END]\\"]
    turns = [(r.choice(roles), t) for t in [*ODD, *cut]] + list(itertools.product(roles, ODD))
    whole = ""
    for role, text in turns:
        formatted, start, end, rounds = chat_format.format_turn(role, text)
        inner = formatted[start:end]
        assert chat_format.recovered(formatted) == [(role, text, end - start)]
        assert (inner == text) if rounds == 0 else rounds == 1
        whole += formatted
    assert [t[:2] for t in chat_format.recovered(whole)] == turns


@pytest.mark.parametrize("text", ["x", "<s>", "</s>", "[INST]a[/INST]", "[INST] [/INST]", "<s>a<</SYS>>", "[ROLE]a</s>", "<s>a</s>b", "[ROLE]a[END]"])
def test_the_parser_refuses_what_the_grammar_does_not_give(text):
    assert chat_format.recovered(text) is None


def test_turns_that_hold_no_mark_stay_as_they_are():
    assert chat_format.format_turn("user", "a [b] <c>") == ("[INST] a [b] <c> [/INST]", 7, 16, 0)
    assert chat_format.format_turn("assistant", "</s>") == ("<s><\\/s></s>", 3, 8, 1)


def plain_chats(rows):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(t for *_, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(chat_format.format_turn(role, t)[0]) for *_, role, t in turns))
    return out


def test_chats_of_odd_tables(spark):
    rows = [(k % 5, k // 5 % 7, r, t) for k, (r, t) in enumerate(itertools.product(["user", "assistant", "system", None, "tool"], ODD))]
    rows += [(None, 1, "user", "a"), (None, None, None, None), (7, None, "assistant", None), (8, 1, "user", "tie"), (8, 1, "assistant", "tie"), (8, 1, "user", "tie")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], f"{schema}, formatted string, rounds int").repartition(4)
    formatted = chat_format.format_turns(df)
    got = {r.conv_id: tuple(r)[1:6] for r in chat_format.read_back(formatted).collect()}
    assert got == plain_chats(rows)
    for r in formatted.collect():
        assert chat_format.recovered(r.formatted) == [(r.role, r.text, r.text_end - r.text_start)]
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_the_query_adds_a_conversation_of_marks(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:6] for r in catalog.QUERIES["op12_chat_format"](spark, sf_dir).collect()}
    assert got == plain_chats([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


# filters


def plain_audit(docs, labels):
    """Every order walked through, one document after the other."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        fails.append((part or "", i, {k for k, v in f.items() if v}))
    out, parts = {}, {p for p, *_ in fails}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    share = collections.Counter()
    for part, order in itertools.product(parts, orders):
        left = [(i, f) for p, i, f in fails if p == part]
        gone = []
        for step, x in enumerate(order, 1):
            removed, left = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
            share[part, x] += len(removed)
            alone = sum(f == {x} for p, _, f in fails if p == part)
            out[part, order, step] = [len(left), len(removed), sum(x in f for _, f in gone), alone, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
            gone += removed
    return {(*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_tables(spark):
    r = random.Random(2)
    many = " ".join(f"w{k}" for k in range(250))
    pool = [many, many + " x", many.upper(), many + " #", "a " * 300, "a b " * 250, "a\x1cb " * 250, "", None, "X", "é" * 33 + "A", "é" * 32 + "A", "a\x0b\x0cb", " ".join(f"w{k}" for k in range(200)), "wörter " * 90_000]
    docs = [(i if i % 11 else None, r.choice(pool), r.choice(["en", "de", None, ""])) for i in range(150)] + [(7, many, "en"), (7, many, "en"), (7, many, "de"), (7, "other", "en"), (-1, "X", "en")]
    labels = [(r.randrange(170), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, "h", 1) for d in docs], "doc_id bigint, text string, lang string, hash string, bits int").repartition(5)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.orders(filter_audit.combinations(df, known)).select("part", "filter_order", "step", *filter_audit.COUNTS).collect()
    assert {tuple(x) for x in got} == plain_audit(docs, labels) and len(got) == len(set(got))
    assert filter_audit.orders(filter_audit.combinations(df.limit(0), known)).count() == 0
    bare = filter_audit.combinations(df, known.limit(0)).agg(F.sum("n"), F.max("good")).first()
    assert tuple(bare) == (len(docs), False)
