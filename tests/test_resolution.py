import pytest
from oracle import compare
from pyspark.sql import functions as F

from apilattice import registry
from apilattice.operators import resolution as R
from apilattice.sources import declarations, modules

FILES = "package_id string, rel_path string, content string"


def facts(spark, texts, language="typescript", go_module=None):
    files = spark.createDataFrame([("p", f, c) for f, c in texts.items()], FILES)
    mods = spark.createDataFrame([("p", go_module)], "package_id string, module_path string") if go_module else None
    rows = R.module_files(modules.names(files, language), files, mods)
    return files, R.resolve(rows, language)


def given(found, file, space="e"):
    return {r.name: (r.decl_file, r.decl_name) for r in found.where((F.col("file") == file) & (F.col("space") == space)).collect()}


def test_statements_of_a_file():
    text = """import D, { A, type B as C } from './x';
import * as ns from "../lib/y.js"; // import { Z } from './no'
import type { Q } from '@scope/pkg';
export { A as E, C };
export * from './z'; export * as all from './w';
export type { T } from './t';
export default class Foo { method() { const inner = 1; return import('./lazy'); } }
export abstract class Bar {}  export const k = "export * from './fake'";
declare function fn(): void;
namespace N { export class Hidden {} }
"""
    rows = modules.typescript_names(text, "src/a.ts")
    assert set(rows) == {
        ("import", "D", "src/x", "default"), ("import", "A", "src/x", "A"), ("import", "C", "src/x", "B"), ("import", "ns", "lib/y.js", "*"), ("import", "Q", ":@scope/pkg", "Q"),
        ("export", "E", None, "A"), ("export", "C", None, "C"), ("star", None, "src/z", None), ("export", "all", "src/w", "*"), ("export", "T", "src/t", "T"),
        ("decl", "Foo", None, None), ("export", "default", None, "Foo"), ("decl", "Bar", None, None), ("export", "Bar", None, "Bar"), ("decl", "k", None, None), ("export", "k", None, "k"), ("decl", "fn", None, None), ("decl", "N", None, None),
    }


def test_long_chains_aliases_defaults_and_namespaces(spark):
    texts = {f"m{k}.ts": f"export * from './m{k + 1}';" for k in range(12)}
    texts["m12.ts"] = "export class Deep {} class Hidden {} export default Deep;"
    texts["a.ts"] = "import Made, { Deep as D } from './m0'; export { D as Renamed, Made };"
    texts["b/index.ts"] = "import * as m from '../m12'; export { m as space }; export * as more from '../a';"
    texts["c.ts"] = "import { space, more } from './b'; import { default as Own } from './m12'; export { Own }; export { default } from './m12';"
    files, found = facts(spark, texts)
    assert given(found, "m0.ts") == {"Deep": ("m12.ts", "Deep")}
    assert given(found, "a.ts") == {"Renamed": ("m12.ts", "Deep")}  # a star brings no default
    assert given(found, "b/index.ts") == {"space": ("m12.ts", "*"), "more": ("a.ts", "*")}
    assert given(found, "c.ts") == {"Own": ("m12.ts", "Deep"), "default": ("m12.ts", "Deep")}
    refs = spark.createDataFrame([("p", "c.ts", "X", r) for r in ("space.Deep", "more.Renamed", "space.Hidden", "space", "Own", "nothing", "space.Deep.x")], "package_id string, file string, name string, ref string")
    assert {(r.ref, r.decl_file, r.decl_name) for r in R.references(refs, found).collect()} == {("space.Deep", "m12.ts", "Deep"), ("more.Renamed", "m12.ts", "Deep"), ("Own", "m12.ts", "Deep")}


def test_shadowing_ambiguity_and_cycles(spark):
    texts = {
        "x.ts": "export class A {} export class B {} export class C {}",
        "y.ts": "export class A {} export class D {} export { C } from './x';",
        "z.ts": "export * from './x'; export * from './y'; export class B {}",
        "p.ts": "export * from './q'; export class P {}",
        "q.ts": "export * from './p'; export class Q {} export * from './missing'; export * from 'other-package';",
    }
    _, found = facts(spark, texts)
    assert given(found, "z.ts") == {"B": ("z.ts", "B"), "C": ("x.ts", "C"), "D": ("y.ts", "D")}  # A means two things, hence none
    assert given(found, "p.ts") == given(found, "q.ts") == {"P": ("p.ts", "P"), "Q": ("q.ts", "Q")}


@pytest.mark.parametrize("said, there", [("./x", "x.ts"), ("./x", "x/index.ts"), ("./x.js", "x.ts"), ("./x", "x.d.ts"), ("./x.js", "x.tsx")])
def test_where_a_path_leads(spark, said, there):
    _, found = facts(spark, {"a.ts": f"export * from '{said}';", there: "export class K {}"})
    assert given(found, "a.ts") == {"K": (there, "K")}


def test_go_folders_and_imports(spark):
    texts = {
        "client.go": 'package sdk\nimport (\n "context"\n m "example.com/sdk/models"\n . "example.com/sdk/dots"\n)\ntype Client struct { W *Widget; S m.Shape; D Dot }\nfunc (c *Client) Get(ctx context.Context) (m.Shape, error) { return nil }\n',
        "widget.go": "package sdk\ntype (\n Widget struct { A int }\n Other = int\n)\n",
        "models/shape.go": "package models\ntype Shape struct{ P Point }\n",
        "models/point.go": 'package models\nimport "example.com/sdk"\ntype Point struct{ C sdk.Client }\n',
        "dots/dot.go": "package dots\ntype Dot struct{}\n",
        "dots/dot_test.go": "package dots\ntype Fake struct{}\n",
    }
    files, found = facts(spark, texts, "go", "example.com/sdk")
    types = declarations.extract_types(files, "go")
    edges = {(r.src, r.dst) for r in R.resolved_edges(types, found).collect()}
    assert edges == {("client.go#Client", "widget.go#Widget"), ("client.go#Client", "models/shape.go#Shape"), ("client.go#Client", "dots/dot.go#Dot"), ("models/shape.go#Shape", "models/point.go#Point"), ("models/point.go#Point", "client.go#Client")}


def test_reachable_from_entry_points_only(spark):
    texts = {
        "index.ts": "export { Client } from './client';",
        "client.ts": "import { Options as O } from './options'; import * as models from './models';\nexport class Client { run(o: O): Promise<models.Result> { return null!; } }\nexport class Unlisted { x: Lost; }",
        "options.ts": "export interface Options { retry: Retry } interface Retry {} export interface Result {}",
        "models.ts": "export interface Result { next?: Result } export interface Lost {}",
    }
    files, found = facts(spark, texts)
    types = declarations.extract_types(files, "typescript")
    entries = spark.createDataFrame([("p", "index.ts")], "package_id string, file string")
    got = {(r.name, r.depth) for r in R.entry_reachable(types, found, entries).collect()}
    assert got == {("client.ts#Client", 0), ("options.ts#Options", 1), ("models.ts#Result", 1)}


def test_nothing(spark):
    files, found = facts(spark, {"a.ts": ""})
    assert found.count() == 0
    assert facts(spark, {})[1].count() == 0


@pytest.mark.parametrize("name", ["resolved_references", "entry_reachable_types"])
def test_names_pass_no_table_through_the_driver(spark, no_broadcast, name):
    compare(spark, registry.load()[name], registry.ORACLES[name], "/root/testdata/sf0.001")


def mixed():
    """A package of stars, cycles, two meanings, aliases and defaults; one of a chain."""
    rows = [("p", f"m{k}.ts", f"export * from './m{k + 1}';") for k in range(24)] + [("p", "m24.ts", "export class Deep {} class Hidden {} export default Deep;")]
    for p in ("q", None):
        rows += [(p, "x.ts", "export class A {} export class B {}"), (p, "y.ts", "export class A {} export * from './z';"), (p, "z.ts", "export * from './x'; export * from './y'; export class B {}")]
        rows += [(p, "a.ts", "import Own, { B as D } from './z'; import * as all from './y'; export { D as Renamed, all, Own }; export { default } from './d';"), (p, "d.ts", "export default class K {}")]
    return rows


def test_small_packages_take_no_step_for_each_file_of_a_chain(spark):
    rows = R.module_files(modules.names(spark.createDataFrame(mixed(), FILES), "typescript"), spark.createDataFrame(mixed(), FILES))
    spark.sparkContext.setJobGroup("names", "names")
    try:
        found = {tuple(r) for r in R.resolve(rows).collect()}
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert ("p", "m0.ts", "e", "Deep", "m24.ts", "Deep") in found
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("names")) < 48


@pytest.mark.parametrize("bound, most", [("LOCAL", 0), ("LOCAL", 20), ("MOST", 20), ("MOST", 45)])
def test_names_by_steps_and_in_a_task_are_the_same(spark, monkeypatch, bound, most):
    files = spark.createDataFrame(mixed(), FILES)
    rows = R.module_files(modules.names(files, "typescript"), files)
    want = sorted(map(str, R.resolve(rows).select(*R.FACT).collect()))
    monkeypatch.setattr(R, bound, most)
    assert sorted(map(str, R.resolve(rows).select(*R.FACT).collect())) == want
