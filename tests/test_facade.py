import json

from pyspark.sql import functions as F

from apilattice.functions import text
from apilattice.operators import coverage, detect, diagnostics, graph, packing
from apilattice.plans import facade
from apilattice.sources import exports, index, schemas

INDEX = {"package": "p", "containers": [{"name": "m", "types": [
    {"name": "Client", "kind": "class", "entry_point": True, "doc": "d", "members": [{"name": "list", "kind": "method", "sig": "(Old o)", "ret": "Item", "params": [{"name": "o", "type": "Old"}]}, {"name": "drop", "kind": "method", "deprecated": True, "sig": "()"}, {"name": "sub", "kind": "method", "sig": "()", "ret": "Sub"}]},
    {"name": "Sub", "kind": "class", "members": [{"name": "go", "kind": "method", "sig": "()"}]},
    {"name": "Item", "kind": "class", "doc": "x", "members": [{"name": "id", "kind": "property"}]},
    {"name": "Old", "kind": "class", "doc": "x", "deprecated": True}]}]}


def test_graph_and_coverage(spark):
    made = index.parse_indexes(spark.createDataFrame([(json.dumps(INDEX),)], "json string"))
    assert {r.name for r in facade.reachable_clients(made, "python").collect()} == {"Client", "Sub", "Item", "Old"}
    types, notes = facade.api_graph(made, "python")
    assert {r.name: r.priority for r in types.collect()} == {"Client": 0, "Sub": 3, "Item": 2, "Old": 3}
    assert sorted((r.id, r.target_member) for r in notes.collect() if r.target_member) == [("SDK003", "m.Client.list")]
    assert {r.target_type for r in notes.where("id = 'SDK001'").collect()} == {"m.Sub"}
    calls = spark.createDataFrame([("p", "f", 1, 1, "c", "list")], "package_id string, file string, line int, call_ord int, receiver string, operation string")
    variables = spark.createDataFrame([("p", "f", "c", "Client")], "package_id string, file string, name string, client string")
    row = facade.coverage(made, calls, variables, "python").first()
    assert (row.total, row.covered, row.uncovered) == (3, 1, 2)
    packages = spark.createDataFrame([("p", "samples", "python"), ("q", None, "go"), ("r", None, None)], "package_id string, samples_root string, language string")
    batch = facade.coverage_batch(facade.coverage(made, calls, variables, "python"), packages).first()
    assert (batch.analyzed_packages, batch.skipped_packages, batch.failed_packages, batch.total) == (1, 1, 1, 3)


def test_detection(spark):
    files = spark.createDataFrame([("p", "go.mod", ".mod", 1), ("p", "a.go", ".go", 1), ("q", "readme.md", ".md", 1)], "package_id string, rel_path string, ext string, size bigint")
    got = {r.package_id: (r.language, r.error_code) for r in facade.detect_source(files.select("package_id").distinct(), files).collect()}
    assert got == {"p": ("go", None), "q": (None, facade.LANGUAGE_DETECTION_FAILED)}
    assert [(r.package_id, r.language) for r in detect.quick_language(files).collect()] == [("p", "go")]
    assert {r.n_files for r in detect.count_files(files, 1).collect()} == {1}


def test_exports(spark):
    value = {".": {"import": {"types": "./a.d.ts", "node": "./n.js"}, "default": "./a.js"}, "./x": "./x.js"}
    rows = spark.createDataFrame([("p", json.dumps({"exports": value})), ("q", "{")], "package_id string, content string")
    made = exports.export_conditions(rows).withColumn("condition", text.condition_of(F.col("conditions")))
    assert {(r.target, r.condition) for r in made.collect()} == {("./a.d.ts", "types"), ("./n.js", "import"), ("./a.js", "default"), ("./x.js", "default")}
    assert exports.exported_names("from .a import B, _c\nfrom x.y import Z as W\n__all__ = ['B', 'D']") == [("B", ".a"), ("D", ""), ("W", "x.y")]
    files = spark.createDataFrame([("p", "k/__init__.py", "from .a import B"), ("p", "k/b.py", "from .a import C")], "package_id string, rel_path string, content string")
    assert [r.name for r in exports.entry_symbols(files).collect()] == ["B"]
    assert exports.annotation_refs("Optional['List[a.B]'] | dict[str, C]") == ["a.B", "C"]
    assert exports.annotation_refs(None) == exports.annotation_refs("x[") == []


def test_small_functions(spark):
    row = spark.range(1).select(text.budget_summary(F.lit(1234), F.lit(5000)).alias("b"), text.is_builtin(F.lit("List<T>"), "java").alias("j"), text.is_stdlib(F.lit("os.path"), ("os",)).alias("s")).first()
    assert tuple(row) == ("1,234/5,000 chars (24.7%)", True, True)
    schema = spark.createDataFrame([], "a int, b array<struct<c: string>>").schema
    assert schemas.json_schema(schema)["properties"]["b"]["items"]["properties"] == {"c": {"type": "string"}}


def test_more_operators(spark):
    members = spark.createDataFrame([("p", "C", "list", "method", "Sub"), ("p", "C", "name", "property", "str"), ("p", "D", "x", "method", "int")], "package_id string, owner string, name string, kind string, ret string")
    clients = spark.createDataFrame([("p", "Sub")], "package_id string, client string")
    assert [(r.name, r.client) for r in coverage.return_clients(members, clients, F.col("ret")).collect()] == [("list", "Sub")]
    open_ = spark.createDataFrame([("p", "C", "list")], "package_id string, client string, operation string")
    assert {r.name for r in coverage.uncovered_surface(members, open_).collect()} == {"list", "name"}
    types = spark.createDataFrame([("p", "A", 0, 1), ("p", "C", 3, 2)], "package_id string, name string, priority int, type_ord int")
    assert [r.name for r in coverage.coverage_order(types, open_).orderBy("place").collect()] == ["C", "A"]
    definitions = spark.createDataFrame([("A", "x", ["B", "str"]), ("B", "y", []), ("str", "builtins", [])], "name string, dep_package string, refs array<string>")
    builtins = spark.createDataFrame([("str",)], "name string")
    assert {(r.name, r.dep_package) for r in graph.dependency_closure(spark.createDataFrame([("A",)], "name string"), definitions, builtins).collect()} == {("A", "x"), ("B", "y")}
    options = spark.createDataFrame([("p", "go", "java"), ("q", "go", "go"), ("r", "go", None)], "package_id string, language string, option string")
    assert diagnostics.unmatched_options(options).count() == 1
    files = spark.createDataFrame([("a", 100), ("b", 900), ("c", 50)], "rel_path string, size bigint")
    plan = packing.load_plan(files, ["rel_path"], budget=600, limit=400)
    texts = spark.createDataFrame([("a", "x" * 100), ("b", "y" * 900), ("c", "z" * 50)], "rel_path string, content string")
    out = [r.text for r in packing.render_plan(plan, texts, files).orderBy("ord").collect()]
    assert len(out) == 3 and out[0] == '<file path="a" size="100" tokens="~25">\n' + "x" * 100 + "\n</file>\n\n"
    assert "\n// ... truncated ...\n</file>" in out[1] and out[2] == "<!-- 1 additional files omitted due to budget -->\n"
    later = packing.load_plan(files, [F.col("size")], budget=600, limit=400)  # loading order, not that of the paths
    shown = [r.text for r in packing.render_plan(later, texts, files, section="src").orderBy("ord").collect()]
    assert shown[0] == "<src>\n" and shown[1].startswith('<file path="c"') and shown[2].startswith('<file path="a"') and shown[-1] == "</src>\n\n"
