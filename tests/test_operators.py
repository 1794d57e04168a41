import random

import pytest
from pyspark.sql import functions as F

from apilattice import registry
from apilattice.operators import coverage, detect, diagnostics, packing, tables

OPS = "package_id string, client string, operation string"


def test_coverage(spark):
    ops = spark.createDataFrame([("p", "C", "a"), ("p", "C", "b"), ("p", "D", "a"), ("p", "D", "old"), ("p", "E", "x")], OPS)
    done = spark.createDataFrame([("p", "C", "a")], OPS)
    related = spark.createDataFrame([("p", "C", "D")], "package_id string, a string, b string")
    old = spark.createDataFrame([("p", "D", "old")], OPS)
    assert {(r.client, r.operation) for r in coverage.uncovered(ops, done, related, old).collect()} == {("C", "b"), ("E", "x")}
    row = coverage.report(ops, done, related, old).first()
    assert (row.total, row.covered, row.uncovered, row.coverage_percent) == (3, 1, 2, 33.3)


def test_call_resolution(spark):
    calls = spark.createDataFrame([("p", "f", 1, 1, "c", "list"), ("p", "f", 2, 2, "x", "only"), ("p", "f", 3, 3, "x", "list"), ("p", "f", 4, 4, "Client", "list")], "package_id string, file string, line int, call_ord int, receiver string, operation string")
    variables = spark.createDataFrame([("p", "f", "c", "Client")], "package_id string, file string, name string, client string")
    methods = spark.createDataFrame([("p", "Client", "list"), ("p", "Other", "list"), ("p", "Other", "only")], OPS)
    bases = lambda *pairs: spark.createDataFrame([("p", *x) for x in pairs], "package_id string, client string, base string")
    found = lambda b: {(r.line, r.client) for r in coverage.resolve_calls(calls, variables, methods, b).collect()}
    assert found(bases()) == {(1, "Client"), (2, "Other"), (4, "Client")}
    assert found(bases(("Other", "Client"), ("Client", "Base"))) == {(1, "Client"), (2, "Other"), (3, "Client"), (4, "Client")}  # one root
    assert {r.line for r in coverage.resolve_calls(calls, variables, methods).collect()} == {1, 4}


def test_reports(spark):
    done = spark.createDataFrame([("p", "C", "a", "s.py", 3)], OPS + ", file string, line int")
    open_ = spark.createDataFrame([("p", "C", "b", "b()")], OPS + ", sig string")
    assert coverage.usage_report(done, open_).first().report == "Covered (1):\n  C.a (s.py:3)\nUncovered (1):\n  C.b()\n"
    packages = spark.createDataFrame([("x", "analyzed", 4, 3, 1), ("y", "skipped", 0, 0, 0)], "package_id string, status string, total int, covered int, uncovered int")
    lines = [r.line for r in coverage.markdown_report(packages, skip_empty=True).orderBy("ord").collect()]
    assert lines[0] == "# Coverage: 3 of 4 operations (75.00%)" and len(lines) == 4
    sigs = spark.createDataFrame([("p", "C", "b", 2, "b(y)"), ("p", "C", "b", 1, "b(x)")], OPS + ", member_ord int, sig string")
    rows = spark.createDataFrame([("p", "C", "b"), ("p", "C", "z")], OPS)
    assert {r.sig for r in coverage.with_signatures(rows, sigs).collect()} == {"b(x)", "z(...)"}


def plan_by_hand(sizes, budget, limit):
    left, out = budget, []
    for name, size in sizes:
        if left <= 50:
            break
        n = min(size, limit, left - 50)
        if n <= 0:
            continue
        left -= n + 50
        out.append((name, n, n < size))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_load_plan_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    sizes = [(k, rnd.choice([0, 1, 40, 300, 900])) for k in range(rnd.randint(0, 15))]
    budget, limit = rnd.choice([60, 500, 2000]), rnd.choice([30, 400])
    files = spark.createDataFrame(sizes, "k int, size bigint")
    got = [(r.k, r.chars, r.truncated) for r in packing.load_plan(files, ["k"], budget=budget, limit=limit).orderBy("k").collect()]
    assert got == plan_by_hand(sizes, budget, limit)


def test_greedy_packing(spark):
    types = spark.createDataFrame([("p", "A", 1, 50), ("p", "B", 2, 60), ("p", "C", 3, 500)], "package_id string, name string, place int, chars bigint")
    edges = spark.createDataFrame([("p", "A", "B")], "package_id string, src string, dst string")
    assert [r.name for r in packing.pack_types(types, edges, 300).orderBy("ord").collect()] == ["A", "B"]
    assert [r.name for r in packing.pack_types(types.where("name = 'C'"), edges, 300).collect()] == ["C"]


def test_merge_and_overloads(spark):
    parts = spark.createDataFrame([("T", 2, "b", ["y"], False), ("T", 1, None, ["x"], True), ("T", 3, "c", ["x"], None)], "k string, o int, doc string, i array<string>, f boolean")
    row = tables.merge_partial(parts, ["k"], F.col("o"), ["doc"], ["i"], ["f"]).first()
    assert (row.doc, row.i, row.f) == ("b", ["x", "y"], True)
    members = spark.createDataFrame([("p", "C", "f", 1, True, None), ("p", "C", "f", 2, True, None), ("p", "C", "f", 3, False, "doc"), ("p", "C", "g", 4, False, None)], "package_id string, owner string, name string, ord int, is_overload boolean, doc string")
    assert {(r.ord, r.doc) for r in tables.overloads(members).collect()} == {(1, "doc"), (2, "doc"), (4, None)}


def test_conditions_and_external(spark):
    modules = spark.createDataFrame([("p", "node"), ("p", "edge")], "package_id string, condition string")
    dep = spark.createDataFrame([("p", "node", "n"), ("p", "default", "d")], "package_id string, condition string, target string")
    assert {(r.condition, r.target) for r in tables.match_condition(modules, dep).collect()} == {("node", "n"), ("edge", "d")}
    names = spark.createDataFrame([("p", "A"), ("p", "B"), ("p", "C")], "package_id string, type_name string")
    imports = spark.createDataFrame([("p", "A", "one")], "package_id string, type_name string, dep_package string")
    installed = spark.createDataFrame([("A", "zzz", 1), ("B", "late", 2), ("B", "first", 1)], "type_name string, dep_package string, rank int")
    assert {(r.type_name, r.dep_package) for r in tables.resolve_external(names, imports, installed).collect()} == {("A", "one"), ("B", "first"), ("C", None)}


def test_diagnostics(spark):
    row = "package_id string, id string, text string, level int, target_type string, target_member string"
    up = spark.createDataFrame([("p", "U", "t", 1, None, None), ("p", "U", "t", 1, None, None)], row)
    new = spark.createDataFrame([("p", "U", "t", 1, None, None), ("p", "N", "t", 1, None, None), ("p", "N", "t", 2, None, None)], row)
    got = [(r.id, r.ord) for r in diagnostics.merged(up, up.limit(0), new).orderBy("ord").collect()]
    assert got == [("U", 1), ("U", 2), ("N", 3)]
    err = spark.createDataFrame([("p", "one\n \ntwo\r\n")], "package_id string, stderr string")
    assert [r.text for r in diagnostics.from_stderr(err).collect()] == ["one", "two"]


def files(spark, paths):
    return spark.createDataFrame([("p", p, "." + p.rsplit(".", 1)[1] if "." in p else "", 1) for p in paths], "package_id string, rel_path string, ext string, size bigint")


def test_detection(spark):
    f = files(spark, ["pyproject.toml", "src/a.py", "src/b.py", "node_modules/x.py", "tests/test_a.py", "samples/one.py", "tools/pom.xml", "tools/A.java"])
    assert files(spark, ["a.py"]).count() == 1
    assert "node_modules/x.py" not in {r.rel_path for r in detect.scannable(f).collect()}
    got = detect.source_folder(detect.scannable(f)).first()
    assert (got.language, got.source_root) == ("python", "")
    assert detect.samples_folder(f).first().samples_root == "samples"
    assert {r.rel_path for r in detect.by_extension(f, [".PY"], ["tests/**"]).collect()} == {"src/a.py", "src/b.py", "node_modules/x.py", "samples/one.py"}


def test_monorepo_and_manifests(spark):
    f = files(spark, ["sdk/a/package.json", "sdk/b/pyproject.toml", "sdk/b/tests/setup.py", "other/c/go.mod"])
    assert {r.package_dir for r in detect.monorepo_packages(f).collect()} == {"sdk/a", "sdk/b"}
    m = spark.createDataFrame([('{"workspaces": ["a"]}',), ('{"private": true}',), ('{"private": true, "main": "x"}',)], "content string")
    assert detect.workspace_only(m).count() == 2
    c = spark.createDataFrame([('{"references": [{"path": "a"}], "files": []}',), ('{"files": ["x"]}',)], "content string")
    assert detect.solution_only(c).count() == 1


def test_scannable_files_of_a_large_brand(spark, tmp_path):
    part = spark.range(10_007).selectExpr("id p_partkey", "'B' p_brand", "'ECONOMY' p_type", "'a b' p_name", "1 p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert registry.load()["scannable_files"](spark, str(tmp_path)).count() == 10_007
    assert detect.scannable(files(spark, ["a.py", "b.py", "c.py"]), max_files=2).count() == 2


def test_numbered_over_many_partitions(spark):
    from apilattice.operators import tables

    rows = [(f"p{k * 7919 % 1000:04d}", k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, n int").repartition(9)
    got = {r.name: r.ord for r in tables.numbered(df, ["name"]).collect()}
    assert got == {name: k + 1 for k, (name, _) in enumerate(sorted(rows))}
    assert tables.numbered(df.limit(0), ["name"]).collect() == []
    assert tables.numbered(df.limit(1), ["n", "name"]).first().ord == 1
