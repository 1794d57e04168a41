import json

from oracle import compare

from apilattice import registry
from apilattice.operators import coverage
from apilattice.sources import files as source_files
from apilattice.sources import index, python_ast

INDEX = {"package": "pkg", "version": "1", "containers": [{"name": "ns", "types": [{"name": "Client<T>", "kind": "class", "entry_point": True, "doc": "d", "members": [{"name": "get", "kind": "method", "sig": "(Item i)", "ret": "Item"}]}, {"name": "Item", "kind": "class", "members": [{"name": "id", "kind": "property", "ret": "int"}]}], "functions": [{"name": "open", "sig": "()", "ret": "Client"}]}], "dependencies": [{"package": "json", "is_stdlib": True, "types": [{"name": "Decoder", "kind": "class"}]}]}


def test_index(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(INDEX, indent=1))
    made = index.read_indexes(spark, str(tmp_path))
    types = {r.name: r for r in index.types(made).collect()}
    assert types["Client<T>"].norm_name == "Client" and types["Item"].type_id == "ns.Item"
    assert {(r.type_id, r.name, r.kind) for r in index.members(made).collect()} == {("ns.Client<T>", "get", "method"), ("ns.Item", "id", "property"), (None, "open", "function")}
    assert index.dependencies(made).first().type_name == "Decoder"
    refs = {r.name: set(r.refs) for r in index.referenced_names(made).collect()}
    assert refs["Client"] == {"Item", "i"}
    assert '"version"' not in index.to_json(made.drop("version")).first()[0]
    for language in ("python", "go", "java", "dotnet", "typescript"):
        assert "get" in index.stubs(made, language).orderBy("type_ord").first().stub
    broken = spark.createDataFrame([("{oops",), (json.dumps(INDEX),)], "json string")
    assert index.parse_indexes(broken).count() == 1


def test_cross_language(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    maps = spark.createDataFrame([("p", {"a": "X"}), (None, {"b": "Y"})], "packageId string, ids map<string, string>")
    assert {(r.id, r.xlang_id) for r in index.with_cross_language(rows, maps, "id").collect()} == {("a", "X"), ("b", None)}


def test_walk(tmp_path, spark):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "node_modules/b.py").write_text("x")
    (tmp_path / "src/loop").symlink_to(tmp_path)
    assert [p for p, _, _ in source_files.walk(str(tmp_path))] == ["src/a.py"]
    assert source_files.scan(spark, str(tmp_path), "p").first().ext == ".py"


def test_build_files(spark):
    rows = [("p", "pyproject.toml", '[project]\nname="x"\n[tool.setuptools.packages.find]\nwhere=["lib"]'), ("p", "pom.xml", "<project><groupId>g.h</groupId></project>"), ("p", "package.json", '{"name": "n", "main": "./dist/i.js"}'), ("p", "go.mod", "module m/n\n"), ("p", "tsconfig.json", "{broken")]
    got = {r.name: (r.source_path, r.package_name) for r in source_files.build_files(spark.createDataFrame(rows, "package_id string, name string, content string")).collect()}
    assert got == {"pyproject.toml": ("lib", "x"), "pom.xml": ("src/main/java", "g.h"), "package.json": ("dist", "n"), "go.mod": (None, "m/n"), "tsconfig.json": (None, None)}
    assert source_files.read_dotenv("# c\nexport A='b'\nB = 1\nbad") == {"A": "b", "B": "1"}


def test_python_sources(spark):
    api = 'class Client(Base):\n    """Doc."""\n    def get(self, x: int) -> "Item": ...\n    def _hide(self): ...\n    @property\n    def sub(self) -> Sub: ...\nclass _Private: ...\n'
    sample = "c = Client()\nc.get(1)\nd = c\nd.get(2)\nClient().get(3)\n"
    rows = spark.createDataFrame([("p", "pkg/a.py", api), ("p", "pkg/_b.py", api), ("p", "pkg/bad.py", "def (")], "package_id string, rel_path string, content string")
    types = python_ast.extract_types(rows).collect()
    assert [(t.name, t.base, [m.name for m in t.members]) for t in types] == [("Client", "Base", ["get", "sub"])]
    calls, variables = python_ast.extract_calls(spark.createDataFrame([("p", "s.py", sample)], "package_id string, rel_path string, content string"), {"Client": "Client"})
    methods = spark.createDataFrame([("p", "Client", "get")], "package_id string, client string, operation string")
    got = coverage.resolve_calls(calls, variables, methods).collect()
    assert sorted(r.line for r in got) == [2, 4, 5]


def test_python_calls_pass_no_table_through_the_driver(spark, no_broadcast):
    compare(spark, registry.load()["python_calls"], registry.ORACLES["python_calls"], "/root/testdata/sf0.001")


def test_samples(spark):
    rows = spark.createDataFrame([("a", "", "code", "../x y.py"), (" ", "", "code", None), ("b", "", " ", None)], "name string, description string, code string, filePath string")
    assert [r.path for r in source_files.write_samples(rows, ".py").collect()] == ["x_y.py"]
