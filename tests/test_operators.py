import pytest
from pyspark.sql import functions as F

from confluo.functions import text as T
from confluo.operators import blocks, merge, review, templates
from confluo.sources.tables import file_tree


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_blocks_and_spans(spark):
    text = "  Alpha   beta\r\n\r\nGamma\n   delta\n\n\nEpsilon  \n"
    assert one(spark, T.normalized(F.col("t")), t=text) == "Alpha beta\n\nGamma delta\n\nEpsilon"
    spans = one(spark, T.spans(T.blocks(F.col("t"))), t=text)
    assert len(spans) == 3 and (spans[1].start, spans[1].end) == (12, 23)
    assert one(spark, T.normalized(F.col("t")), t="a \u0085b") == "a b"


def test_similarity(spark):
    score = T.similarity_score(F.col("a"), F.col("b"))
    assert one(spark, score, a="Alpha   beta\n\nGamma", b="  Alpha beta  \r\n\r\nGamma  ") == 1
    assert one(spark, score, a="Alpha beta\n\nGamma delta", b="Alpha beta\n\nGamma epsilon") == pytest.approx(2 / 3)
    assert one(spark, score, a="Alpha beta", b="Zeta theta") == 0 and one(spark, score, a="", b="") == 1


def sides(spark, template, destination):
    t, d = (spark.createDataFrame([(1, x)], "id int, text string") for x in (template, destination))
    return blocks.block_rows(t, "id", "text"), blocks.block_rows(d, "id", "text")


def test_block_merge(spark):
    t, d = sides(spark, "Alpha\n\nBeta\n\nAlpha\n\nTemplate only", "Beta\n\nAlpha revised\n\nAlpha\n\nDestination only")
    merged = blocks.merge_blocks(t, d, blocks.match_blocks(t, d, "id"), "id").first().merged
    assert merged == "Beta\n\nAlpha revised\n\nAlpha\n\nDestination only\n\nAlpha\n\nTemplate only"


def test_refined_match(spark):
    t, d = sides(spark, "Alpha beta gamma\n\nDelta anchor\n\nClosing line", "Alpha beta delta\n\nDelta anchor\n\nClosing line")
    got = {(r.template_idx, r.destination_idx): (r.phase, round(r.score, 3)) for r in blocks.match_blocks(t, d, "id").collect()}
    assert got == {(0, 0): ("refined", 0.825), (1, 1): ("exact", 1.0), (2, 2): ("exact", 1.0)}


def test_greedy_choice_where_blocks_compete(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.95), (1, 1, 1, 0.8), (2, 3, 5, 0.75)], "id int, template_idx int, destination_idx int, score double")
    got = {(r.id, r.template_idx, r.destination_idx) for r in blocks.take_greedily(rows, "id").collect()}
    assert got == {(1, 0, 0), (1, 1, 1), (2, 3, 5)}


def test_decisions_tell_null_from_absent_and_swap_alike(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    base, ours, theirs = frame([(1, None), (2, "a"), (3, "a")]), frame([(1, None), (2, None), (4, "x")]), frame([(1, "b"), (2, "c"), (3, "d"), (4, "y")])
    got = {r.k: (r.decision, r.value) for r in merge.decide(merge.three_way_rows(base, ours, theirs, ["k"], "v")).collect()}
    assert got == {1: ("theirs", "b"), 2: ("edit_edit", None), 3: ("delete_edit", "d"), 4: ("add_add", "x")}
    swapped = {r.k: r.decision for r in merge.decide(merge.three_way_rows(base, theirs, ours, ["k"], "v")).collect() if r.decision in merge.CONFLICTS}
    assert swapped == {2: "edit_edit", 3: "delete_edit", 4: "add_add"}


def test_two_way_merge_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    d = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    once = merge.merge_two_way(t, d, ["k"], "v").select("k", "v")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, merge.merge_two_way(t, once, ["k"], "v").select("k", "v").collect()), key=str)
    assert {r.k: r.v for r in once.collect()} == {1: "a", 2: None, 3: "c"}


def test_tokens(spark):
    text = "{KJ|NAME} {a {A|B} {KJ|NAME} {X|Y:Z} {bad} {A:B}"
    assert one(spark, T.token_keys(F.col("t")), t=text) == ["KJ|NAME", "X|Y:Z"]
    assert one(spark, T.resolve_tokens(F.col("t"), {"A|B": "{X|Y}", "X|Y": "z"}), t="{A|B}") == "z"


def test_paths(spark):
    kinds = {p: one(spark, templates.classified(F.col("p")), p=p).file_type for p in ("./Gemfile", "a/x.GEMSPEC", ".env.local", "d/a.JSONC", "x.rbs", "notes", ".git-hooks/commit-msg")}
    assert list(kinds.values()) == ["gemfile", "gemspec", "dotenv", "json", "rbs", "text", "ruby"]
    assert one(spark, templates.logical_path(F.col("p")), p="a.no-osc.example") == "a"
    assert one(spark, T.library_path_errors(F.col("p")), p="../x.txt") == ["not_absolute", "traversal", "extension"]
    assert one(spark, T.slug(F.col("p")), p="  Ünder -- Score! ") == "nder-score" and one(spark, T.slug(F.col("p")), p="--") == "section"


def test_envelope_checks_kind_first(spark):
    x = review.opened(F.lit("other"), F.lit(2), F.lit("p"), "wanted")
    assert one(spark, x, p="").error == "kind_mismatch"
    with pytest.raises(ValueError):
        review.within_limits(F.lit(1), {})


def test_file_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("hé")
    assert [tuple(r) for r in file_tree(spark, f"file://{tmp_path}").collect()] == [("a/b.txt", "hé")]


def test_json_merge_recurses_and_names_what_does_not_parse(spark):
    from confluo.operators import json_docs

    sides = [
        (1, '{"meta":{"mode":"template"},"items":[1,2]}', '{"meta":{"enabled":true},"items":[3]}'),
        (2, "{}", "{}"),
        (3, '{"a":1}', '{"a":'),
        (4, None, "{}"),
        (5, '{"b":1,"a":{"z":{"y":1}}}', '{"a":{"z":{"x":2}},"c":{"q":"\\u00e9\\n"}}'),
    ]
    t = spark.createDataFrame([(i, x) for i, x, _ in sides], "id int, source string")
    d = spark.createDataFrame([(i, x) for i, _, x in sides], "id int, source string")
    got = {r.id: (r.merged, r.diagnostic) for r in json_docs.merge_two(t, d, "id", "source").collect()}
    assert got == {
        1: ('{"meta":{"mode":"template","enabled":true},"items":[3]}', None),
        2: ("{}", None),
        3: (None, "destination_parse_error"),
        4: (None, "template_parse_error"),
        5: ('{"b":1,"a":{"z":{"y":1,"x":2}},"c":{"q":"é\\n"}}', None),
    }
    assert json_docs.merge_two(t.limit(0), d, "id", "source").count() == 0


def test_json_three_way_conflicts_where_a_type_changes(spark):
    from confluo.operators import json_docs

    sides = spark.createDataFrame([(1, '{"a":{"x":1},"b":2}', '{"a":{"x":1,"y":3},"b":2}', '{"a":[],"b":3}'), (2, "[1]", "[2]", "[1 ]")], "id int, base string, ours string, theirs string")
    merged, conflicts = json_docs.merge_three(sides, "id")
    assert {r.id: r.merged for r in merged.collect()} == {1: '{"a":{"x":1,"y":3},"b":3}', 2: "[2]"}
    assert [tuple(r) for r in conflicts.collect()] == [(1, "/a", "edit_edit")]


def test_markdown_owners_skip_what_stands_in_fences(spark):
    from confluo.functions import markdown

    text = "intro\n# Title #\n```ts strict\n# not a heading\n~~~\n````\n## Next  part ##\n#no\n~~~\nopen"
    rows = [(r.kind, r.match_key, r.start, r.end) for r in one(spark, markdown.owners(F.col("t")), t=text)]
    assert rows == [("heading", "h1:title", 1, 1), ("code_fence", "fence:ts", 2, 5), ("heading", "h2:next-part", 6, 6), ("code_fence", "fence:plain", 8, 9)]
    assert one(spark, markdown.owners(F.col("t")), t="") == []


def test_freeze_directives_discard_the_blocks_of_a_text_with_findings(spark):
    from confluo.operators import layout

    texts = {1: ["# keep:freeze why", "x", "#Keep: UNFREEZE"], 2: ["# keep:freeze", "# keep:freeze"], 3: ["# keep:unfreeze", "# keep:freeze", "# keep:unfreeze"], 4: ["plain"]}
    lines = spark.createDataFrame([(k, i + 1, x) for k, xs in texts.items() for i, x in enumerate(xs)], "k int, line int, text string")
    blocks, findings = layout.freeze_directives(lines, "k", "keep", "hash_comment")
    assert [tuple(r) for r in blocks.collect()] == [(1, 1, 3, "why")]
    assert sorted(tuple(r) for r in findings.collect()) == [(2, 1, "unclosed_freeze_open"), (2, 2, "nested_freeze_open"), (3, 1, "unmatched_freeze_close")]


def test_archive_paths(spark):
    from confluo.functions import layout

    cases = {"a\\..\\b": ("b", False), "../../x": ("../../x", True), "./.": ("", False), "/a/../..": ("/", True), "d/./": ("d/", False), "..": ("..", True)}
    for path, (clean, escapes) in cases.items():
        assert one(spark, layout.clean_path(F.col("p")), p=path) == clean and one(spark, layout.escapes_root(F.col("p")), p=path) is escapes


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def plain_matches(t, d):
    """Exact matches by occurrence, then for each destination block the best free template block from 0.7 up."""
    pairs, used = {}, set()
    for j, y in enumerate(d):
        k = d[:j].count(y)
        where = [i for i, x in enumerate(t) if x == y]
        if k < len(where):
            pairs[j] = (where[k], 1.0)
            used.add(where[k])
    place = lambda i, n: 0.5 if n <= 1 else i / (n - 1)
    for j, y in enumerate(d):
        if j in pairs:
            continue
        best = None
        for i, x in enumerate(t):
            if i in used:
                continue
            content = 1 - edit_distance(x, y) / max(len(x), len(y))
            sizes = sorted((len(x.encode()), len(y.encode())))
            score = 0.7 * content + 0.15 * sizes[0] / sizes[1] + 0.15 * (1 - abs(place(i, len(t)) - place(j, len(d))))
            if score >= 0.7 and (best is None or score > best[1] + 1e-12):
                best = (i, score)
        if best:
            pairs[j] = best
            used.add(best[0])
    return pairs


def test_refined_matches_and_merges_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = []
    for k in range(25):
        t = [" ".join("".join(r.choices("abcé", k=r.randint(1, 5))) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 7))]
        d = [" ".join(w if r.random() > 0.2 else "zz" for w in b.split()) for b in r.sample(t, r.randint(0, len(t)))] + r.choices(t, k=r.randint(0, 2)) or ["only"]
        rows.append((k, t, d))
    t = blocks.block_rows(spark.createDataFrame([(k, "\n\n".join(x)) for k, x, _ in rows], "id int, text string"), "id", "text")
    d = blocks.block_rows(spark.createDataFrame([(k, "\n\n".join(x)) for k, _, x in rows], "id int, text string"), "id", "text")
    matches = blocks.match_blocks(t, d, "id")
    got = {}
    for m in matches.collect():
        got.setdefault(m.id, {})[m.destination_idx] = (m.template_idx, round(m.score, 9))
    want = {k: {j: (i, round(s, 9)) for j, (i, s) in plain_matches(a, b).items()} for k, a, b in rows}
    assert got == {k: v for k, v in want.items() if v}
    merged = {x.id: x.merged for x in blocks.merge_blocks(t, d, matches, "id").collect()}
    assert merged == {k: "\n\n".join([*b, *[x for i, x in enumerate(a) if i not in {p for p, _ in want[k].values()}]]) for k, a, b in rows}


def test_blocks_of_a_pair_are_matched_within_its_row(spark, sf_dir):
    """Against every score worked out: texts of many alike blocks that compete; nothing is shuffled or stored."""
    import random

    from confluo.plans import texts

    r = random.Random(8)
    rows = [(k, [" ".join(r.choices(["ab", "abc", "bc", "é", "cab"], k=r.randint(2, 4))) for _ in range(r.randint(0, 14))], [" ".join(r.choices(["ab", "abc", "bc", "é", "cab"], k=r.randint(2, 4))) for _ in range(r.randint(0, 14))]) for k in range(120)]
    rows.append((500, ["same " * 40 + f"{c}{i}" for i, c in enumerate("abcdefgh" * 5)], ["same " * 40 + f"{i}{c}" for i, c in enumerate("hgfedcba" * 5)]))
    matched = blocks.match_texts(spark.createDataFrame(rows, "id int, template array<string>, destination array<string>"), "id")
    got, merged = {}, {x.id: x.merged for x in blocks.merged_texts(matched, "id").collect()}
    for m in blocks.matches_of(matched, "id").collect():
        got.setdefault(m.id, {})[m.destination_idx] = (m.template_idx, round(m.score, 9))
    want = {k: {j: (i, round(s, 9)) for j, (i, s) in plain_matches(a, b).items()} for k, a, b in rows}
    assert got == {k: v for k, v in want.items() if v}
    assert merged == {k: "\n\n".join([*b, *[x for i, x in enumerate(a) if i not in {p for p, _ in want[k].values()}]]) for k, a, b in rows if a or b}
    for query in (texts.refined_block_match, texts.merge_text):
        df = query(spark, sf_dir)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and all(f.endswith("documents.parquet") for f in df.inputFiles())


def test_tree_is_written_as_files(spark, tmp_path):
    from confluo.sources.tables import write_tree

    files = spark.createDataFrame([("a/b.txt", "hé"), ("c.txt", None)], "path string, content string")
    assert write_tree(files, f"file://{tmp_path}/out") == 2
    assert (tmp_path / "out" / "a" / "b.txt").read_text() == "hé" and (tmp_path / "out" / "c.txt").read_text() == ""
    for rows in ([("a", "x"), ("a", "y")], [("", "x")], [(None, "x")]):
        with pytest.raises(ValueError):
            write_tree(spark.createDataFrame(rows, "path string, content string"), f"file://{tmp_path}/bad")


def test_edit_distances_of_blocks(spark):
    import random
    import time

    from confluo.functions.distance import edit_distance

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(above + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choices("abé𝄞", k=r.randint(0, 14))) for _ in range(2))
        k, d = r.randint(-1, 12), table(a, b)
        assert edit_distance(a, b, k) == (d if d <= k else -1)
    words = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(4000)) for _ in range(6)]
    began = time.time()
    assert [edit_distance(w, f"Changed {w}", len(w) // 2) for w in words] == [8] * 6
    assert time.time() - began < 2
    t = blocks.block_rows(spark.createDataFrame([(1, "\n\n".join(words))], "id int, text string"), "id", "text")
    d = blocks.block_rows(spark.createDataFrame([(1, "\n\n".join(f"x{w[:9000]}y{w[9000:]}z" for w in words))], "id int, text string"), "id", "text")
    assert sorted((m.template_idx, m.destination_idx) for m in blocks.match_blocks(t, d, "id").collect()) == [(i, i) for i in range(6)]
