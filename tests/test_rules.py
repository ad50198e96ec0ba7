"""Rulesets, handlers, manifests with replay, projects, contracts and profiles on small tables."""

import hashlib
import json

from pyspark.sql import functions as F

from confluo.operators import contract_docs, handlers, manifests, projections, projects, rulesets

BASE = "format json\nowners line_bound_statements\nmatch stable_path\nread native_read_portable_write\n"


def said(spark, text):
    d = spark.createDataFrame([(1, text)], "id int, text string")
    return [x.message for x in rulesets.ruleset_diagnostics(d, rulesets.directive_lines(d, "id", "text"), "id").orderBy("rank").collect()]


def test_rulesets_at_their_edges(spark):
    assert said(spark, BASE) == ['missing required directive "attach"']
    assert said(spark, BASE.replace("format json\n", "format json\nformat yaml\n") + "attach layout_only\n") == ['repeated singleton directive "format" first seen on line 1']
    assert said(spark, BASE.replace("native_read_portable_write", "imaginary") + "attach layout_only") == ['unknown read value "imaginary"']
    assert said(spark, BASE + "attach layout_only\nmystery value\n") == ['unknown directive "mystery"']
    assert said(spark, BASE + "attach layout_only\n# note\n\n  backend a native\n") == []
    assert said(spark, BASE + 'attach layout_only\nformat a\nformat b\nbackend\nbackend x "é\nbackend x y\nchild_group p a z\nchild_group p b z\nchild_group p a q') == [
        'repeated singleton directive "format" first seen on line 1', 'repeated singleton directive "format" first seen on line 6', 'directive "backend" requires at least one argument', 'invalid argument token "\\"é"', 'repeated "backend" key "x"', 'repeated "child_group" key "p"',
    ]
    assert said(spark, "") == [f'missing required directive "{x}"' for x in rulesets.REQUIRED]


def test_handlers_of_mixed_cases(spark):
    cases = [("a", handlers.INSERTIONS, "commutative"), ("b", handlers.INSERTIONS, "ordered"), ("c", handlers.KEYED, None), ("d", handlers.KEYED, None), ("e", "other", None), ("f", handlers.KEYED, None), ("g", None, None)]
    members = [
        ("a", "base", 1, "n1", "s", None, None), ("a", "left", 1, "n2", "", None, None), ("a", "right", 1, "n3", "s", None, None), ("a", "right", 2, "n2", None, None, None),
        ("c", "base", 1, None, None, "k", "1"), ("c", "left", 1, None, None, "m", "2"), ("c", "right", 1, None, None, "k", "3"), ("c", "right", 2, None, None, "m", "2"),
        ("d", "base", 1, None, None, "k", "1"), ("d", "left", 1, None, None, "k", "2"), ("d", "right", 1, None, None, "k", "3"), ("e", "base", 1, "x", "x", "x", "x"),
    ]
    done = handlers.handled(spark.createDataFrame(cases, "case string, handler string, policy string"), spark.createDataFrame(members, "case string, side string, pos int, node string, signature string, key string, value string"))
    got = {x.case: (x.resolved, x.merged and [(m.node, m.key, m.value) for m in x.merged], x.diagnostic) for x in done.collect()}
    assert got["a"][:2] == (True, [("n1", None, None), ("n2", None, None)]) and got["b"] == (False, None, handlers.SAID["ordered"])
    assert got["c"] == (True, [(None, "k", "3"), (None, "m", "2")], handlers.SAID["edited"]) and got["d"] == (False, None, handlers.SAID["clash"])
    assert got["e"][2] == got["g"][2] == handlers.SAID["unsupported"] and got["f"] == (True, [], handlers.SAID["edited"])


def test_a_rejected_edit_rolls_its_source_back(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abc"), (4, None)], "id int, text string")
    edits = spark.createDataFrame([(1, 1, 0, 1, "X"), (1, 2, 2, 3, "Z"), (2, 1, 0, 1, "X"), (3, 1, 0, 2, "X"), (3, 2, 1, 3, "Y")], "id int, edit bigint, start bigint, end bigint, replacement string")
    notes = spark.createDataFrame([(1, 1, False), (2, 1, True), (2, 1, False)], "id int, edit bigint, blocking boolean")
    got = {x.id: (x.status, x.source, x.applied, x.n_diagnostics) for x in projections.execute_edits(docs, edits, notes, "id", "text").collect()}
    assert got == {1: ("applied", "XbZ", [1, 2], 1), 2: ("rejected", "abc", [], 2), 3: ("rejected", "abc", [], 1), 4: ("applied", None, [], 0)}


def test_replay_against_a_plain_loop(spark):
    import random

    r = random.Random(4)
    requests, decisions, want = [], [], {}
    for m in range(40):
        families = [f"f{i}" for i in r.sample(range(6), r.randrange(5))]
        requests += [(m, f, i, f"family_context:{f}") for i, f in enumerate(families)]
        state = lambda left: hashlib.md5(",".join(f"family_context:{f}" for f in left).encode()).hexdigest()
        left, chain = list(families), []
        for _ in range(len(families)):
            chain.append(list(left))
            left.remove(r.choice(left))
        own = []
        for pos in range(r.randrange(8)):
            at = r.choice([*chain, ["nothing"]])
            family = r.choice([*families, "f9"])
            action = r.choice([manifests.ACCEPT, manifests.PROVIDE, "look"])
            own.append((m, pos, f"family_context:{family}", action, r.choice([family, None, "f8"]) if action == manifests.PROVIDE else None, state(at)))
        decisions += own
        left, used, met, n = list(families), {}, {}, 0
        while True:
            here = [d for d in own if d[5] == state(left) and left and d[1] not in used]
            settled = {}
            for d in here:
                f = d[2].split(":")[1]
                met[d[1]] = met.get(d[1], False) or f in left
                if f in left and f not in settled and d[3] != "look":
                    settled[f] = (d, d[3] == manifests.ACCEPT or d[4] == f)
            done = {f: d for f, (d, ok) in settled.items() if ok}
            if not done:
                break
            for f, d in done.items():
                left.remove(f)
                used[d[1]] = n
            n += 1
        for d in own:
            want[m, d[1]] = ("applied", used[d[1]]) if d[1] in used else ("stale_context" if d[1] not in met else "not_settled" if met[d[1]] else "request_not_found", None)
        want[m, "left"] = sorted(left)
    q = spark.createDataFrame(requests, "manifest int, family string, place int, request_id string")
    d = spark.createDataFrame(decisions, "manifest int, pos int, request_id string, action string, provided string, state string")
    left, applied, rejected = manifests.replay_to_fixed_point(q, d)
    got = {(x.manifest, x.pos): ("applied", x.round) for x in applied.collect()} | {(x.manifest, x.pos): (x.reason, None) for x in rejected.collect()}
    assert got == {k: v for k, v in want.items() if k[1] != "left"}
    rest = {}
    for x in left.collect():
        rest.setdefault(x.manifest, []).append(x.family)
    assert {m: sorted(f) for m, f in rest.items()} == {m: v for (m, w), v in want.items() if w == "left" and v}
    none = manifests.replay_to_fixed_point(q.limit(0), d.limit(0))
    assert [t.count() for t in none] == [0, 0, 0]


def test_facts_and_files_of_a_project(spark):
    files = [
        ("p/go.mod", "module github.com/example/gomodder\n\ngo 1.26\n"), ("p/README.md", "# Old Module\n\nExisting Go module intro.\n"), ("p/CHANGELOG.md", "# Changelog\n\n## [0.1.0] - 2026-01-01\n\n- Initial release.\n"),
        ("p/internal/generated/packageinfo.go", "package generated\n\nconst LocalValue = true\n"), ("p/in/go.mod", "go 1.2\n"), ("p/in/a.go", None), ("q/none.txt", "x"), ("go.modx", "module m"),
    ]
    placed = projects.with_projects(spark.createDataFrame(files, "path string, content string"))
    assert {(x.path, x.project, x.relative) for x in placed.collect()} == {(p, "p/in" if p.startswith("p/in/") else "p", p[5:] if p.startswith("p/in/") else p[2:]) for p, _ in files if p.startswith("p/")}
    facts, faults = projects.project_facts(placed)
    f = facts.first()
    assert (f.project, f.name, f.slug, f.source_url, f.go_version, f.ecosystem) == ("p", "github.com/example/gomodder", "gomodder", "https://github.com/example/gomodder", "1.26", "gomod")
    assert [x.project for x in faults.collect()] == ["p/in"] and [tuple(x) for x in projects.nested_counts(placed).collect()] == [("p", 1)]
    made = {x.relative: (x.changed, x.content) for x in projects.planned_files(facts, "tool").collect()}
    url = "https://github.com/example/gomodder"
    assert made == {
        "README.md": (True, f"# github.com/example/gomodder\n\nExisting Go module intro.\n\n<!-- tool:metadata:start -->\n| Field | Value |\n|---|---|\n| Package | github.com/example/gomodder |\n| Homepage | {url} |\n| Source | {url} |\n<!-- tool:metadata:end -->\n"),
        "CHANGELOG.md": (True, "# Changelog\n\n## [Unreleased]\n\n### Added\n\n### Changed\n\n### Fixed\n\n## [0.1.0] - 2026-01-01\n\n- Initial release.\n"),
        "internal/generated/packageinfo.go": (True, 'package generated\n\nconst LocalValue = true\n// <<tool:generated>> do not edit below this line\nconst PackageName = "github.com/example/gomodder"\nconst PackageEcosystem = "gomod"\n// <</tool:generated>>\n'),
    }


def test_contracts_that_are_no_json_or_lack_sections(spark):
    text = "é"
    fine = {"run_manifest": {"selection": {"selected_case_ids": ["c"], "explanation": {"b": 1, "a": None}}}, "cases": [{"id": "c", "operation": "merge3"}], "case_results": [{"id": "r2", "outcome": "false_auto_merge", "score_eligible": True, "raw": {"x": {"inline": text, "bytes": 2, "sha256": hashlib.sha256(text.encode()).hexdigest()}, "y": 1}}, {"id": "r1", "outcome": "unsupported", "score_eligible": False, "raw": {}}]}
    rows = [(1, json.dumps(fine)), (2, "{"), (3, "{}"), (4, None), (5, '{"case_results":[{"id":"r","raw":{"x":{"inline":null}},"score_eligible":null}],"cases":[{"id":"h","operation":"history_replay","history_reference":null}]}')]
    docs = spark.createDataFrame(rows, "id int, source string")
    v = contract_docs.parsed(docs, "id", "source")
    wrong = contract_docs.record_violations(v, "id").unionByName(contract_docs.history_violations(v, "id"))
    assert {tuple(x) for x in wrong.collect()} == {(5, "r", "inline_not_string"), (5, "h", "history_not_object")}
    got = {x.id: x for x in contract_docs.canonical_summaries(docs, v, wrong, "id", "source").collect()}
    assert set(got) == {1, 3} and got[1].reasons == ["a", "b"] and got[1].eligible_ids == ["r2"] and got[1].excluded_ids == ["r1"] and (got[1].gate, got[1].cases, got[1].adapters) == ("fail", 1, 1)
    assert got[1].digest == hashlib.sha256(rows[0][1].encode()).hexdigest() and (got[3].results, got[3].gate) == (0, "pass")


def test_inherited_gates(spark):
    from confluo.operators import backend_profiles

    profiles = spark.createDataFrame([("p", "json"), ("q", "go"), ("r", "none")], "profile string, family string")
    policies = spark.createDataFrame([("p", 5, None), ("json", 6, 0.5), ("go", None, 0.7)], "scope string, fixtures int, formatting double")
    scopes = spark.createDataFrame([("profile", 0), ("family", 1), ("all", 2)], "kind string, rank int")
    done = backend_profiles.resolve_policy(profiles, policies, scopes)
    assert {tuple(x) for x in done.collect()} == {("p", "profile", 5, 0.5), ("q", "family", None, 0.7)}
    assert [x.profile for x in backend_profiles.unknown_profiles(profiles, done).collect()] == ["r"]
    assert done.filter(F.col("profile") == "p").count() == 1


def test_envelopes_at_their_edges(spark):
    from confluo.operators import envelopes

    rows = [
        (1, "review_replay_bundle", '{"kind":"review_replay_bundle","version":1,"replay_bundle":{"a":[1.50,"é"]}}'), (2, "review_replay_bundle", "{"), (3, "review_replay_bundle", None), (4, "review_replay_bundle", '{"kind":"review_replay_bundle","version":"1"}'),
        (5, "review_replay_bundle", '{"kind":"review_replay_bundle","version":1}'), (6, "review_replay_bundle", '{"kind":"other","version":9}'), (7, "review_replay_bundle", '{"kind":"review_replay_bundle","version":0,"replay_bundle":1}'), (8, "no_kind", '{"kind":"no_kind","version":1}'),
    ]
    got = {x.id: (x.ok, x.category, x.payload) for x in envelopes.imported(spark.createDataFrame(rows, "id int, wanted string, source string"), ["id"], "wanted", "source").collect()}
    assert json.loads(got[1][2]) == {"a": [1.5, "é"]} and got[2] == got[3] == got[6] == (False, "kind_mismatch", None)
    assert got[5] == (True, None, None) and got[7] == (False, "unsupported_version", None) and got[8] == (True, None, None)
    d = spark.createDataFrame([("structured_edit_request", "7", 'p"q'), ("structured_edit_request", None, ""), ("nothing", "1", "x")], "kind string, payload string, profile string")
    texts = [x.t for x in d.select(envelopes.exported(F.col("kind"), F.col("payload"), {"profile_id": F.col("profile")}).alias("t")).collect()]
    assert [t and json.loads(t) for t in texts] == [{"kind": "structured_edit_request", "version": 1, "profile_id": 'p"q', "request": 7}, {"kind": "structured_edit_request", "version": 1, "request": None}, None]
    assert len(envelopes.PAYLOADS) == 72


def test_suites_of_odd_tables(spark):
    from confluo.operators import merge, suites

    cases = spark.createDataFrame([(1, "s", 1, "a", "selected", ""), (2, "s", 2, "b", "skipped", "backend"), (3, "s", 3, "c", "selected", "")], "id int, suite string, pos int, case string, status string, messages string")
    ran = spark.createDataFrame([(1, "failed", "why"), (2, "passed", "")], "id int, outcome string, said string")
    report = suites.suite_reports(suites.run_cases(cases, ran, "id"), "suite", "pos", "case").first()
    assert [tuple(x) for x in report.results] == [("a", "failed", "why"), ("b", "skipped", "backend"), ("c", "skipped", "not run")] and (report.total, report.passed, report.failed, report.skipped) == (3, 0, 1, 2)
    assert suites.suite_reports(suites.run_cases(cases.limit(0), ran, "id"), "suite", "pos", "case").count() == 0
    odd = spark.createDataFrame([("0A", 10), ("0x1F-", 31), ("deadbeef99", 0xDEADBEEF), ("", 0), ("zz", 0), (None, 0)], "t string, n bigint")
    assert odd.filter(suites.crc32_of(F.col("t")) != F.col("n")).count() == 0
    leaves = "doc int, path array<string>, value string"
    t = spark.createDataFrame([(1, ["a"], "t"), (1, ["b", "c"], "t"), (1, ["d", "e"], "t"), (1, ["d", "f"], "t"), (1, ["g"], "t"), (2, ["a"], None)], leaves)
    d = spark.createDataFrame([(1, ["a", "x"], "d"), (1, ["b"], "d"), (1, ["d", "e"], "d")], leaves)
    got = {(x.doc, "/".join(x.path), x.value, x.source) for x in merge.merge_nested_keys(t, d, "doc", "path", "value").collect()}
    assert got == {(1, "a/x", "d", "destination"), (1, "b", "d", "destination"), (1, "d/e", "d", "destination"), (1, "d/f", "t", "template"), (1, "g", "t", "template"), (2, "a", None, "template")}
