"""JSON with places, conflicts in place, splices, sections and nested documents: against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from confluo.functions import json_nodes
from confluo.operators import json_docs, nested_trees, placement, sections, splices

MISSING = object()


def document(r, depth=0):
    kind = r.random()
    if depth < 3 and kind < 0.55:
        return {r.choice(["a", "b", "x/y", "~k", "é", "z"]): document(r, depth + 1) for _ in range(r.randrange(4))}
    if depth < 3 and kind < 0.7:
        return [document(r, depth + 1) for _ in range(r.randrange(3))]
    return r.choice([None, True, 0, 1, -2.5, "t", 'q"\\\n', "é😀"])


def written(r, value):
    return json.dumps(value, indent=r.choice([None, 1, 2]), ensure_ascii=r.random() < 0.5)


def test_nodes_keep_bytes_lines_and_order():
    r = random.Random(1)
    for _ in range(300):
        value = document(r)
        source = f"\n {written(r, value)} \n"
        raw, found = source.encode(), json_nodes.nodes(source)
        assert json.loads(found[0]["value"]) == value and found[0]["path"] == ""
        for n in found:
            text = raw[n["start"] : n["end"]].decode()
            assert n["line"] == raw[: n["start"]].count(b"\n") and n["end_line"] == raw[: n["end"]].count(b"\n") + 1
            want = value
            for step in n["path"].split("/")[1:]:
                step = step.replace("~1", "/").replace("~0", "~")
                want = want[int(step)] if isinstance(want, list) else want[step]
            own = json.loads("{" + text + "}")[n["name"]] if n["name"] is not None else json.loads(text)
            assert own == want == json.loads(n["value"])
        assert [n["order"] for n in found] == sorted(n["order"] for n in found)


def test_nodes_of_odd_texts():
    paths = lambda source: {n["path"]: n["value"] for n in json_nodes.nodes(source)}
    assert paths('{"a":{"b":1},"c":2,"a":[3]}') == {"": '{"a":[3],"c":2}', "/a": "[3]", "/a/0": "3", "/c": "2"}
    assert paths('{"n":[1.50,1e3,-0]}')["/n"] == "[1.50,1e3,-0]"
    assert paths('{"\\ud800":"\\udc00"}') == {"": '{"\\\\ud800":"\\udc00"}', "/\\ud800": '"\\udc00"'}
    same = [json_nodes.nodes(x)[0]["digest"] for x in ('{"a":1,"b":10}', '{"b":1e1,"a":1.0}')]
    assert same[0] == same[1] != json_nodes.nodes('{"a":"1","b":10}')[0]["digest"]
    for bad in ("", "{", "NaN", "[1,]", "{'a':1}", '{"a":1}x', "[" * 100_000):
        assert not json_nodes.valid(bad)


def merged_two(t, d):
    if isinstance(t, dict) and isinstance(d, dict):
        return {k: merged_two(t[k], d[k]) if k in t and k in d else d.get(k, t.get(k)) for k in [*t, *[k for k in d if k not in t]]}
    return d


def merged_three(b, o, t, path, conflicts):
    if o is not MISSING and t is not MISSING and o == t or o is t:
        return o
    if b is o or (b is not MISSING and o is not MISSING and b == o):
        return t
    if b is t or (b is not MISSING and t is not MISSING and b == t):
        return o
    if all(isinstance(x, dict) for x in (b, o, t)):
        names = list(dict.fromkeys([*o, *t, *b]))
        parts = {k: merged_three(*(x.get(k, MISSING) for x in (b, o, t)), f"{path}/{k.replace('~', '~0').replace('/', '~1')}", conflicts) for k in names}
        return {k: v for k, v in parts.items() if v is not MISSING}
    conflicts.add((path, "add_add" if b is MISSING else "delete_edit" if o is MISSING or t is MISSING else "edit_edit"))
    return t if o is MISSING else o


def typed(value):
    """Values that Python takes for equal though JSON does not: true and 1."""
    if isinstance(value, dict):
        return {k: typed(v) for k, v in value.items()}
    return [typed(v) for v in value] if isinstance(value, list) else ("bool", value) if isinstance(value, bool) else value


def untyped(value):
    if isinstance(value, dict):
        return {k: untyped(v) for k, v in value.items()}
    return [untyped(v) for v in value] if isinstance(value, list) else value[1] if isinstance(value, tuple) else value


def edited(r, value):
    if isinstance(value, dict):
        out = {k: edited(r, v) for k, v in value.items() if r.random() > 0.1}
        return out | ({r.choice("abq"): document(r, 2)} if r.random() < 0.3 else {})
    return document(r, 2) if r.random() < 0.2 else value


def test_merges_of_random_documents(spark):
    r = random.Random(7)
    rows = []
    for k in range(150):
        base = {"a": document(r), "b": {"c": document(r, 1), "d": document(r, 1)}, "e": document(r)}
        rows.append((k, base, edited(r, base), edited(r, base)))
    texts = spark.createDataFrame([(k, *(written(r, x) for x in v)) for k, *v in rows], "id int, base string, ours string, theirs string")
    merged, conflicts = json_docs.merge_three(texts, "id")
    got, found = {x.id: x.merged for x in merged.collect()}, {}
    for x in conflicts.collect():
        found.setdefault(x.id, set()).add((x.path, x.category))
    for k, b, o, t in rows:
        want = set()
        value = untyped(merged_three(typed(b), typed(o), typed(t), "", want))
        assert json.loads(got[k]) == value and json.dumps(json.loads(got[k])) == json.dumps(value) and found.get(k, set()) == want
    two = json_docs.merge_two(texts.select("id", F.col("ours").alias("s")), texts.select("id", F.col("theirs").alias("s")), "id", "s")
    assert {x.id: json.dumps(json.loads(x.merged)) for x in two.collect()} == {k: json.dumps(merged_two(o, t)) for k, _, o, t in rows}
    assert json_docs.merge_three(texts.limit(0), "id")[0].count() == 0


def test_sides_that_are_missing_or_no_json(spark):
    rows = [(1, None, "{}", '{"a":1}'), (2, "{", "{}", "{}"), (3, "1", None, None), (4, None, None, None), (5, "{}", "{}", "[1,]")]
    merged, conflicts = json_docs.merge_three(spark.createDataFrame(rows, "id int, base string, ours string, theirs string"), "id")
    assert {tuple(x) for x in conflicts.collect()} == {(1, "", "add_add"), (2, "", "parse_error"), (5, "", "parse_error")}
    assert {x.id: x.merged for x in merged.collect()} == {1: "{}"}


def test_conflicts_stand_in_their_owners(spark):
    rows = [
        (1, '{"name":"demo","enabled":true}', '{"name":"demo","enabled":false}', '{"name":"demo","enabled":"yes"}'),
        (2, '{"a":{"b":1,"c":2}}', '{"a":{"b":3}}', '{"a":{"b":4,"c":5}}'),
        (3, '{"a":1}', '{"b":1}', '{"a":2}'),
        (4, "[1]", "[2]", "[3]"),
        (5, '{"a":1}', '{"a":1,"o":1}', '{"a":1,"t":1}'),
    ]
    sides = spark.createDataFrame(rows, "id int, base string, ours string, theirs string")
    shown, regions, clean = placement.conflicted_sources(sides, "id", 9, "tool")
    got = {x.id: (x.strategy, x.conflicts, x.source) for x in shown.collect()}
    mark = lambda c: c * 9
    inside = lambda o, b, t: f"{mark('<')} ours\n{o}\n{mark('|')} base\n{b}\n{mark('=')}\n{t}\n{mark('>')} theirs"
    assert got[1] == ("owned_region_conflict_markers", 1, '{"name":"demo",' + inside('"enabled":false', '"enabled":true', '"enabled":"yes"') + "}")
    # one of the two is deleted in ours, so both are shown within the object that holds them
    assert got[2] == ("owned_region_conflict_markers", 2, "{" + inside('"a":{"b":3}', '"a":{"b":1,"c":2}', '"a":{"b":4,"c":5}') + "}")
    assert got[3][:2] == ("full_file_conflict_markers", 1) and got[3][2] == "/* tool structured conflicts: 1 unresolved */\n" + inside('{"b":1}', '{"a":1}', '{"a":2}') + "\n"
    assert got[4][0] == "full_file_conflict_markers" and {x.id: x.merged for x in clean.collect()} == {5: '{"a":1,"o":1,"t":1}'}
    assert {(x.id, x.path, x.owner_path, x.base_start, x.base_end) for x in regions.collect()} == {(1, "/enabled", "/enabled", 15, 29), (2, "/a/b", "/a/b", 6, 11), (2, "/a/c", "/a", 1, 18)}


def test_conflicts_in_place_are_found_within_a_row(spark):
    """No shuffle and one reading of the texts; names repeated or escaped, numbers of one value, owners within owners, and texts nested as deep as any that parse."""
    deep = lambda x: '{"a":' * 3000 + x + "}" * 3000
    rows = [
        (1, '{"é":1,"a":[1.0],"é":{"b":1}}', '{"a":[1],"é":{"b":2}}', '{"é":{"b":3},"a":[2]}'),
        (2, '{"x":{"y":{"z":1},"w":1}}', '{"x":{"y":{"z":2}}}', '{"x":{"y":{"z":3},"w":2}}'),
        (3, deep("1"), deep("2"), deep("3")),
        (4, '{"a":true}', '{"a":1}', '{"a":1e0}'),
        (5, '{"\\ud800":1}', '{"\\ud800":2}', '{"\\ud800":3}'),
        (6, None, "1", "2"),
        (7, "{", "1", "2"),
    ]
    sides = spark.createDataFrame(rows, "id int, base string, ours string, theirs string")
    shown, regions, clean = placement.conflicted_sources(sides, "id")
    for df in (shown, regions):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow ") == 1
    got = {x.id: (x.strategy, x.conflicts, x.source) for x in shown.collect()}
    inside = lambda o, b, t: f"<<<<<<< ours\n{o}\n||||||| base\n{b}\n=======\n{t}\n>>>>>>> theirs"
    owned = "owned_region_conflict_markers"
    assert got[1] == (owned, 1, '{"a":[1],"é":{' + inside('"b":2', '"b":1', '"b":3') + "}}")
    assert got[2] == (owned, 2, "{" + inside('"x":{"y":{"z":2}}', '"x":{"y":{"z":1},"w":1}', '"x":{"y":{"z":3},"w":2}') + "}")
    assert got[3] == (owned, 1, deep("1")[: 5 * 2999 + 1] + inside('"a":2', '"a":1', '"a":3') + "}" * 3000)
    assert got[5] == (owned, 1, "{" + inside('"\\ud800":2', '"\\ud800":1', '"\\ud800":3') + "}")
    assert got[6][:2] == ("full_file_conflict_markers", 1) and set(got) == {1, 2, 3, 5, 6}
    assert {(x.id, x.path, x.owner_path, x.base_start, x.base_end) for x in regions.collect() if x.id < 3} == {(1, "/é/b", "/é/b", 24, 29), (2, "/x/y/z", "/x/y/z", 11, 16), (2, "/x/w", "/x", 1, 24)}
    assert {x.id: x.merged for x in clean.collect()} == {4: '{"a":1}'}


@pytest.mark.parametrize("unit", ["bytes", "lines"])
def test_splices_of_random_texts(spark, unit):
    r = random.Random(3)
    docs, edits, want, bad = [], [], {}, set()
    for k in range(120):
        text = "".join(r.choice(["a", "bé", "\n", "😀", "line\n"]) for _ in range(r.randrange(12)))
        size = len(text.encode()) if unit == "bytes" else len(text.split("\n"))
        cuts = sorted(r.randrange(size + 1) for _ in range(2 * r.randrange(4)))
        if unit == "bytes":  # between characters
            starts = [len(text[:i].encode()) for i in range(len(text) + 1)]
            cuts = sorted(r.choice(starts) for _ in cuts)
        own = [(e, a, b, r.choice(["", "new", "x\ny"])) for e, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=True))]
        if k % 5 == 0:
            own.append((99, 0, size + 1, "far"))
        if k % 7 == 0 and own:
            own.append((98, own[0][1], own[0][2], "again"))
        far = 0
        for e, a, b, _ in sorted(own, key=lambda x: (x[1], x[2], x[0])):
            if b > size:
                bad.add((k, e, "out_of_range"))
            elif a < far:
                bad.add((k, e, "overlap"))
            far = max(far, b)
        out = text.encode() if unit == "bytes" else text.split("\n")
        if not any(x[0] == k for x in bad):
            for e, a, b, new in sorted(own, key=lambda x: (x[1], x[2], x[0]), reverse=True):
                out = out[:a] + (new.encode() if unit == "bytes" else (new.split("\n") if new else [])) + out[b:]
        want[k] = out.decode() if unit == "bytes" else "\n".join(out)
        docs.append((k, text))
        edits += [(k, *e) for e in own]
    docs.append((500, None))
    d = spark.createDataFrame(docs, "id int, text string")
    e = spark.createDataFrame([*edits, (600, 1, 0, 0, "x"), (500, 1, 0, 0, "x")], "id int, edit bigint, start bigint, end bigint, replacement string")
    result, rejected = splices.splice(d, e, "id", "text", unit)
    assert {x.id: x.result for x in result.collect()} == want | {500: None}
    assert {tuple(x) for x in rejected.collect()} == bad | {(600, 1, "no_text"), (500, 1, "no_text")}


def test_bytes_of_lines(spark):
    texts = ["", "a", "a\n", "é\nb\n\nc", "\n\n"]
    df = spark.createDataFrame([(t, a, b) for t in texts for a in range(5) for b in range(5)], "t string, a int, b int")
    for x in df.select("t", "a", "b", splices.bytes_of_lines(F.col("t"), F.col("a"), F.col("b")).alias("r")).collect():
        parts = [p.encode() for p in x.t.split("\n")]
        lines = [p + b"\n" for p in parts[:-1]] + [parts[-1]]
        start, end = sum(map(len, lines[: x.a])), sum(map(len, lines[: max(x.a, x.b)]))
        assert (x.r.start, x.r.end) == (start, end)


def headings(text):
    lines, out, above = text.rstrip("\n").split("\n") if text.rstrip("\n") else [], [], []
    for i, x in enumerate(lines):
        bare = x.strip()
        level = len(bare) - len(bare.lstrip("#"))
        if not 1 <= level <= 6 or not bare[level:].startswith(" "):
            continue
        while above and out[above[-1]][1] >= level:
            out[above.pop()][3] = i
        out.append([i, level, bare[level + 1 :].strip(), len(lines), out[above[-1]][0] if above else None])
        above.append(len(out) - 1)
    return [tuple(x) for x in out]


def upserted(content, heading, replacement, level=2):
    """The same by hand."""
    lines = content.rstrip("\n").split("\n")
    if lines == [""]:
        return replacement + "\n"
    new = replacement.split("\n")
    for i, x in enumerate(lines):
        if x.strip() == "#" * level + " " + heading:
            end = next((h[0] for h in headings(content) if h[0] > i and h[1] <= level), len(lines))
            return "\n".join([*lines[:i], *new, *([""] if end < len(lines) and lines[end] else []), *lines[end:]]) + "\n"
    at = 0
    if headings(content) and headings(content)[0][:2] == (0, 1):
        at = next((k for k in range(1, len(lines)) if lines[k]), len(lines))
    at = next((k for k in range(at, len(lines)) if not lines[k]), len(lines))
    at = next((k for k in range(at, len(lines)) if lines[k]), len(lines))
    return "\n".join([*lines[:at], *([""] if at and lines[at - 1] else []), *new, *([""] if at < len(lines) and lines[at] else []), *lines[at:]]) + "\n"


def test_sections_of_random_texts(spark):
    r = random.Random(5)
    pool = ["", "text", "# one", "## two", "## Family", " ### three ", "###### six", "####### seven", "#bare", "#### four", "# ", "## Family "]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(12))) + "\n" * r.randrange(3)) for k in range(200)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, "")], "id int, text string")
    got = {}
    for x in sections.section_tree(df, "id", "text").collect():
        got.setdefault(x.id, []).append((x.line, x.level, x.title, x.end, x.parent))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t in rows if (v := headings(t))}
    new = sections.upsert_sections(df.filter("text IS NOT NULL").withColumns({"heading": F.lit("Family"), "section": F.lit("## Family\n\nnew")}), "text", "heading", "section", "new")
    want = {k: upserted(t, "Family", "## Family\n\nnew") for k, t in [*rows, (-2, "")]}
    assert {x.id: x.new for x in new.collect()} == want


def test_three_depths_are_merged_from_the_leaves_up(spark):
    inner = lambda x: f"## In\n\n```json\n{x}\n```\n"
    outer = lambda x, info="md": f"# Out\n\n````{info}\n{inner(x)}````\n"
    pairs = [(1, outer('{"t":1}'), outer('{"d":2}')), (2, outer('{"t":1}'), outer('{"d":')), (3, None, None), (4, "# A\n\nt", ""), (5, outer('{"t":1}', "go"), outer('{"d":2}')), (6, outer('{"t":1}'), outer('{"d":2}'))]
    df = spark.createDataFrame(pairs, "id int, template string, destination string")
    accepted = spark.createDataFrame([(f"{k}{p}",) for k in (1, 2, 5) for p in ("/code_fence/0", "/code_fence/0/code_fence/0")] + [("6/code_fence/0/code_fence/0",)], "node string")
    done, reports = nested_trees.execute_nested(df, "id", accepted)
    got = {x.node: x.merged for x in done.collect()}
    assert got["1"] == '# Out\n\n````md\n## In\n\n```json\n{"t":1,"d":2}\n```\n````\n'
    assert got["2"] == outer('{"d":') and got["5"] == outer('{"d":2}') and got["6"] == outer('{"d":2}') and got["4"] == "# A\n\nt\n"
    assert {(x.node, x.depth, x.diagnostic) for x in reports.collect() if x.depth} == {("1/code_fence/0", 1, None), ("1/code_fence/0/code_fence/0", 2, None), ("2/code_fence/0", 1, None), ("2/code_fence/0/code_fence/0", 2, "destination_parse_error")}


def test_nested_trees_find_and_merge_without_shuffles(spark):
    """Fences and sections of a text are found and merged in its own row, whatever their number."""
    rows = [(1, "# a\n\none\n# b\n```json\n1\n```\n## c\nthree", "# x\n```js\nb = 1\n```\n"), (2, "", None), (3, "# t\n~~~\nopen\n# no", ""), (4, "only\r\n# d\r\nends", "# e\nf\n\n\n# g\n")]
    pairs = spark.createDataFrame(rows, "id bigint, template string, destination string")
    done = nested_trees.merge_markdown(pairs, "id")
    assert {r.id: r.merged for r in done.collect()} == {1: "# x\n\n```js\nb = 1\n```\n\n# b\n\n## c\nthree\n", 2: "\n", 3: "# t\n\n~~~\nopen\n# no\n", 4: "# e\nf\n\n# g\n"}
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_owners_fold_only_lines_that_may_be_marks(spark):
    """Fences indented or closed by longer marks, headings after other white space, and lines that only look like them."""
    from confluo.functions import markdown

    text = "#no\n#\tyes\n \t```go x\n# in\n``\n  ````  \n#######  no\n###### six #\n~~~\n```\n~~\n\t~~~~\n ## no"
    found = spark.createDataFrame([(text,)], "t string").select(markdown.owners(F.col("t")).alias("o"))
    assert [(o.kind, o.level, o.start, o.end) for o in found.first().o] == [("heading", 1, 1, 1), ("code_fence", 0, 2, 5), ("heading", 6, 7, 7), ("code_fence", 0, 8, 11)]
    assert markdown.MARKED in found._jdf.queryExecution().optimizedPlan().toString()
