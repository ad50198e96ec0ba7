import collections

import corpus_pipeline
from confluo.llm import near_dedup, toxicity
from confluo.llm.common import table


def test_pipeline_against_stages_in_plain_python(spark, sf_dir):
    """Toxic rows go by the fitted score; the rest by rules written out again in Python."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = {r.doc_id: r.score for r in toxicity.with_scores(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.5}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: t for t, i in last.items()}
    words = {i: t.lower().split() for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    grams = collections.defaultdict(list)
    for i, w in words.items():
        for g in {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}:
            grams[g].append(i)
    import numpy as np

    number = collections.defaultdict(lambda: len(number) + 2)
    codes = {i: np.array([number[w] for w in ws], np.uint64) for i, ws in words.items()}
    for i, j in {(a, b) for g in grams.values() for a in g for b in g if a < b}:
        if near_dedup.aligned([(codes[i], codes[j])], 0.2 + 1e-9)[0] >= 0:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    rows = {i: t for i, t in rows.items() if root(i) == i}
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    clean = {i for i, t in rows.items() if not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id for r in got} == clean


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_pieces_are_read_back_in_the_task_that_made_them(spark, sf_dir):
    """Encoding and reading back share their workers, and give what the two operators give one after the other."""
    import public_tokenizers
    from confluo.llm import sentencepiece_codec

    docs = spark.createDataFrame([(1, "ab  cd\n"), (2, None), (3, ""), (None, "naïve ☃ 😀")], "doc_id bigint, text string")
    got = corpus_pipeline.to_pieces(spark, docs, sf_dir)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    tables = sentencepiece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    want = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, tables), tables).collect()
    assert {r.doc_id: r.piece_ids for r in got.collect()} == {r.doc_id: r.piece_ids for r in want}
    assert [r.decoded for r in sentencepiece_codec.encode(docs, tables, decoded_column="decoded").collect()] == [r.decoded for r in want]
    assert all(r.round_trip for r in got.collect())
