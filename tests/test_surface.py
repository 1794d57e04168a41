"""Operators whose rules a table of parts does not reach: by small cases and plain loops."""

import json

import pytest
from pyspark.sql import functions as F

from apilattice.functions import classify, text
from apilattice.operators import detect, diagnostics, graph, packing, tables
from apilattice.plans import facade
from apilattice.sources import index
from apilattice.streaming import messages

FILES = "package_id string, rel_path string, ext string"


def files(spark, *paths):
    return spark.createDataFrame([("p", p, "." + p.rpartition(".")[2]) for p in paths], FILES)


@pytest.mark.parametrize("language, paths, want", [
    ("go", ["a.go", "pkg/b.go", "pkg/x/c.go"], ("", 1)),
    ("go", ["pkg/b.go", "pkg/x/c.go", "pkg/x/d.go"], ("pkg", 1)),
    ("go", ["pkg/x/c.go", "pkg/y/d.go", "pkg/y/e.go"], ("pkg/y", 2)),
    ("dotnet", ["src/a.cs", "x/b.cs", "x/c.cs"], ("src", 1)),
    ("dotnet", ["gen/a.cs", "x/b.cs"], ("", 2)),
    ("typescript", ["src/a.ts", "lib/b.ts", "lib/c.ts"], ("lib", 2)),
    ("typescript", ["a.ts", "other/b.ts", "other/c.ts"], ("", 1)),
    ("java", ["mod/src/main/java/A.java", "B.java"], ("mod/src/main/java", 1)),
    ("python", ["src/k/a.py", "src/k/b.py", "setup.py"], ("src/k", 2)),
    ("python", ["build/k/a.py", "k/b.py"], ("k", 1)),
    ("java", ["B.java"], None),
])
def test_conventional_source(spark, language, paths, want):
    ext = {"go": ".go", "dotnet": ".cs", "typescript": ".ts", "java": ".java", "python": ".py"}[language]
    got = detect.conventional_source(files(spark, *paths), language, ext).first()
    assert (got and (got.source_root, got.n_files)) == want


def test_script_language(spark):
    manifests = lambda *rows: spark.createDataFrame(rows, "package_id string, content string")
    of = lambda paths, content=None: (detect.script_language(files(spark, *paths), manifests(("p", content))).first() or [None, None])[1]
    assert of(["package.json", "tsconfig.json"], "{") == of(["web/tsconfig.json"]) == "typescript"
    assert of(["package.json", "dist/tsconfig.json"], "{}") == of(["package.json"], "{") == "javascript"
    assert of(["package.json"], '{"private": true, "exports": {}}') == "javascript"
    assert of(["package.json"], '{"private": true}') is of(["a/b/tsconfig.json"]) is None


def test_entry_namespaces(spark):
    roots = F.array(F.lit("A"), F.lit("A.B"), F.lit("c.D"))
    names = ["A", "a.x", "A.B", "A.B.C", "A.x.y", "C.d", "C.D.e", "c.d.e.f", "AB", None]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(classify.in_entry_namespace(F.col("n"), roots)).collect()]
    assert got == [True, True, True, False, False, True, True, False, False, False]


def test_merged_keeps_the_given_order(spark):
    rows = lambda *x: spark.createDataFrame([("p", i, "t", 1, g, None, o) for o, (i, g) in enumerate(x)], "package_id string, id string, text string, level int, target_type string, target_member string, ord int")
    made = diagnostics.merged(rows(("Z", "1"), ("A", "2")), rows(("Y", "1"), ("Z", "1")), rows(("Y", "1"), ("C", "9"), ("B", "8"), ("C", "9")))
    assert [r.id for r in made.orderBy("ord").collect()] == ["Z", "A", "Y", "Z", "C", "B"]


@pytest.mark.parametrize("n, capacity", [(40, 40), (41, 10), (3, 1), (5, 9), (0, 1), (0, 0)])
def test_evict(spark, n, capacity):
    rows = [(f"k{k:03d}", (k * 7) % 11) for k in range(n)]
    got = tables.evict_least_recent(spark.createDataFrame(rows, "key string, last_access int"), capacity)
    want = sorted(rows, key=lambda r: (r[1], r[0]))[: max(1, n // 4)] if n >= capacity else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_packing_with_references_equals_a_loop(spark):
    import random

    rnd = random.Random(5)
    names = [f"t{k:02d}" for k in range(30)]
    cost = {n: rnd.randint(20, 90) for n in names}
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(40)})
    taken, used = [], 0
    for n in names:
        group = [x for x in dict.fromkeys([n, *sorted(d for s, d in edges if s == n)]) if x not in taken]
        size = sum(cost[x] for x in group)
        if group and taken and used + size > 600 - 100:
            break
        taken, used = taken + group, used + size
    types = spark.createDataFrame([("p", n, k, cost[n]) for k, n in enumerate(names)], "package_id string, name string, place int, chars bigint")
    got = packing.pack_types(types, spark.createDataFrame([("p", *e) for e in edges], "package_id string, src string, dst string"), 600)
    assert [r.name for r in got.orderBy("ord").collect()] == taken


def test_languages_of_the_facade(spark):
    method = lambda name: {"name": name, "kind": "method", "sig": "()"}
    types = lambda *x: index.parse_indexes(spark.createDataFrame([(json.dumps({"package": "p", "containers": [{"name": "m", "types": list(x)}]}),)], "json string"))
    reached = lambda made, language: {r.name for r in facade.reachable_clients(made, language).collect()}
    cased = types({"name": "Client", "kind": "class", "entry_point": True, "members": [{"name": "get", "kind": "method", "sig": "(ITEM x)"}]}, {"name": "Item", "kind": "class", "members": [{"name": "id", "kind": "property"}]})
    assert reached(cased, "dotnet") == {"Client", "Item"} and reached(cased, "java") == {"Client"}
    derived = types({"name": "Base", "kind": "class", "entry_point": True, "members": [method("get")]}, {"name": "Heir", "kind": "class", "base": "Base", "members": []})
    assert "Heir" in reached(derived, "python")
    structural = types({"name": "Reader", "kind": "interface", "entry_point": True, "members": [method("Read")]}, {"name": "File", "kind": "struct", "members": [method("Read"), method("Close")]}, {"name": "Plain", "kind": "struct", "members": [{"name": "X", "kind": "field"}]})
    assert reached(structural, "go") == {"Reader", "File"}


def test_session_updates(spark):
    made = [
        {"sessionUpdate": "tool_call", "toolCallId": "7", "title": "read", "status": "pending"}, {"sessionUpdate": "tool_call_update", "toolCallId": "7", "status": "completed"},
        {"sessionUpdate": "agent_thought_chunk", "content": {"type": "text", "text": "hm"}}, {"sessionUpdate": "plan", "entries": [{}, {}, {}]},
        {"sessionUpdate": "available_commands_update", "availableCommands": [{}]}, {"sessionUpdate": "current_mode_update", "currentModeId": "ask"}, {"sessionUpdate": "other"},
    ]
    lines = [(json.dumps({"method": "session/update", "params": {"sessionId": "s", "update": u}}),) for u in made] + [("{broken",)]
    got = messages.session_updates(messages.parse(spark.createDataFrame(lines, "value string"))).collect()
    assert [(r.update, r.tool_call_id, r.title, r.status, r.text, r.n_entries, r.mode_id) for r in got] == [
        ("tool_call", "7", "read", "pending", None, None, None), ("tool_call_update", "7", None, "completed", None, None, None), ("agent_thought_chunk", None, None, None, "hm", None, None),
        ("plan", None, None, None, None, 3, None), ("available_commands_update", None, None, None, None, 1, None), ("current_mode_update", None, None, None, None, None, "ask"),
    ]


def test_secrets_with_quoted_keys(spark):
    hex_ = "0123456789abcdef" * 2
    scrub = lambda s: spark.range(1).select(text.scrub_secrets(F.lit(s))).first()[0]
    assert scrub(f'key = "{hex_}"') == 'key  = "[REDACTED]"'  # what stands before : or = comes twice, as the rule has it
    assert scrub(f"key={hex_}") == "key=[REDACTED]"


def test_empty_and_odd_graphs(spark):
    node = lambda *x: spark.createDataFrame([("p", n) for n in x], "package_id string, name string")
    edge = lambda *x: spark.createDataFrame([("p", a, b) for a, b in x], "package_id string, src string, dst string")
    of = lambda n, e: {(r.name, r.scc) for r in graph.components(n, e).collect()}
    assert of(node("a", "b"), edge()) == {("a", "a"), ("b", "b")}
    assert of(node("a", "b", "c", "d"), edge("ab", "bc", "cb", "cd", "aa")) == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "d")}
    assert graph.components(node(), edge()).collect() == []
