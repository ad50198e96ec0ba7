"""The registered queries return the columns and rows of their contracts; operators and stages survive odd tables."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from confluo.llm import catalog, decontamination, exact_dedup, language_id, line_dedup, near_dedup, pii, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from confluo.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}


def rows_of(spark, sf_dir, name):
    return {r.doc_id: r for r in catalog.QUERIES[name](spark, sf_dir).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf_dir, texts):
    got, groups = rows_of(spark, sf_dir, "op1_exact_dedup"), collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(groups[t]), len(groups[t]), i == max(groups[t]), sha(t.encode()))


def test_op2_keeps_one_line_of_each_group(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op2_line_dedup")
    assert set(got) == set(texts) and all(r.n_lines == len(texts[i].split("\n")) and r.n_removed == len(r.removed_lines) for i, r in got.items())
    left = collections.Counter(" ".join(x.lower().split()) for i, t in texts.items() for k, x in enumerate(t.split("\n")) if k not in set(got[i].removed_lines))
    assert all(n == 1 for x, n in left.items() if x and x.isascii())


def test_op3_classes(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op3_near_dedup")
    assert set(got) == set(texts)
    sizes = collections.Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (i == r.class_id) for i, r in got.items())


def test_op4(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op4_toxicity")
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op5(spark, sf_dir, texts):
    got, docs = rows_of(spark, sf_dir, "op5_language_id"), table(spark, sf_dir, "documents")
    known = {r.doc_id: r.lang for r in docs.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i]))
    held = [(r.lang_pred, known[i]) for i, r in got.items() if r.held_out and known[i] and r.lang_pred != "und"]
    assert set(got) == set(texts) and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op6(spark, sf_dir, texts):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    got = rows_of(spark, sf_dir, "op6_pii")
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = []
        for kind, pattern in zip(pii.KINDS, patterns, strict=True):
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
        r, n = got[i], collections.Counter(s.split(":")[0] for s in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [n[k] for k in pii.KINDS] and r.base_sha256 == sha(",".join(spans).encode())
        assert set(spans) <= set(r.spans.split(",")) and r.personal == bool(r.spans)


def test_op7_finds_every_item_that_stands_in_a_text(spark, sf_dir, texts):
    got, items = rows_of(spark, sf_dir, "op7_decontamination"), {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert {k for k, x in items.items() if x and x in t} <= set(got[i].item_ids) and got[i].contaminated == bool(got[i].item_ids)


def test_op8(spark, sf_dir, texts):
    got, n = rows_of(spark, sf_dir, "op8_suffix_dedup"), suffix_dedup.LENGTH
    raw = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(b[k : k + n] for b in raw.values() for k in range(len(b) - n + 1))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept, r = bytes(c for c, g in zip(b, gone, strict=True) if not g), got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))


def test_op9_and_op10(spark, sf_dir, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in rows_of(spark, sf_dir, "op9_token_counts").items():
        n = len(library.encode(texts[i], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[i].encode()), n, n > 2048)
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows_of(spark, sf_dir, "op10_sentencepiece")
    assert set(got) == set(texts) and all(r.piece_ids == pieces.encode(texts[i]) and r.round_trip for i, r in got.items())


CLASHES = "doc_id bigint, text string, score string, item_ids string, cover string, lang_pred string, _folded string, _letters string, _items string, _cover string, _whole string, _ids string, _sha string, _keep string, _own string, _key string, _doc string, _removed string"


@pytest.fixture(scope="module")
def clashing(spark):
    n = CLASHES.count(",") - 1
    said = "some words that stand in a text of their own without any repeat"
    rows = [(1, said), (2, said), (2, said), (None, None), (3, ""), (4, None), (5, "x" * 3_000), (6, said + " at all")]
    return spark.createDataFrame([(*r, *(f"v{r[0]}{k}" for k in range(n))) for r in rows], CLASHES)


def test_operators_leave_columns_of_clashing_names_alone(spark, sf_dir, clashing):
    others = [c for c in clashing.columns if c not in ("doc_id", "text")]
    mine = collections.Counter(tuple(r[c] for c in ("doc_id", *others)) for r in clashing.collect())
    labels, bench = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    tables = sentencepiece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    model = ([], language_id.np.zeros((language_id.BUCKETS, 1)), language_id.np.zeros(1))
    out = [
        (exact_dedup.drop_copies(clashing), []), (near_dedup.drop_near_copies(clashing), []), (line_dedup.drop_repeated_lines(clashing), []),
        (toxicity.with_scores(clashing, toxicity.train(clashing, labels), "s"), ["s"]), (toxicity.with_scores(clashing, toxicity.train(clashing, labels)), ["score"]),
        (language_id.with_language(clashing, model, "l", "p"), ["l", "p"]), (decontamination.with_leaks(clashing, bench, items_column="i", cover_column="c"), ["i", "c"]),
        (sentencepiece_codec.decode(sentencepiece_codec.encode(clashing, tables), tables), ["piece_ids", "decoded"]),
    ]
    for df, added in out:
        assert [c for c in df.columns if c not in added] == [c for c in clashing.columns if c not in added]
        kept = [c for c in ("doc_id", *others) if c not in added]
        at = [("doc_id", *others).index(c) for c in kept]
        assert {tuple(r[c] for c in kept) for r in df.collect()} <= {tuple(r[k] for k in at) for r in mine}
    for find in (pii.find(clashing, pii.fit([])), suffix_dedup.without_repeats(clashing), token_counts.count_tokens(clashing, public_tokenizers.path("word_bpe_49k.json")), exact_dedup.mark_copies(clashing), near_dedup.classes(clashing)):
        assert collections.Counter(r.doc_id for r in find.collect()) == collections.Counter(r.doc_id for r in clashing.collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_survive_odd_and_empty_tables(spark, sf_dir, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, clashing, sf_dir)
    assert stage(spark, clashing.limit(0), sf_dir).count() == 0
    if name == "sentencepiece":
        assert got.count() == clashing.count()
        return
    assert got.schema == clashing.schema
    left = collections.Counter(tuple(r) for r in got.collect())
    assert left <= collections.Counter(tuple(r) for r in clashing.collect())
    texts = {r[1] for r in left}
    assert {"x" * 3_000} <= texts and (None in texts or "" in texts)


def test_an_empty_table_of_documents_gives_empty_results(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in catalog.QUERIES.items():
        own = name == "op12_chat_format"  # a conversation of its own
        assert query(spark, f"file://{tmp_path}").count() == own, name
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
