"""Samples of parts in Go, Java and TypeScript: a file for each part, in eight shapes, against one API a package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.operators import receivers
from apilattice.plans.bindings import t
from apilattice.registry import register
from apilattice.sources import flow

#: The API of every package: (owner, name, kind, result); ``%`` is the package's word.
_API = {
    "typescript": [("%Hub", "widgets", "method", "Promise<%Widget[]>"), ("%Hub", "main", "property", "%Widget"), ("%Hub", "byName", "method", "Map<string, %Widget>"), ("%Hub", "create", "method", "%Hub"), ("%Base", "refresh", "method", "void"), ("%Widget", "session", "method", "Promise<%Session>"), ("%Widget", "ping", "method", "void"), ("%Session", "close", "method", "void"), (None, "open%", "function", "%Hub")],
    "java": [("%Hub", "widgets", "method", "List<%Widget>"), ("%Hub", "main", "field", "%Widget"), ("%Hub", "byName", "method", "Map<String, %Widget>"), ("%Hub", "create", "method", "%Hub"), ("%Base", "refresh", "method", "void"), ("%Widget", "session", "method", "CompletableFuture<%Session>"), ("%Widget", "ping", "method", "void"), ("%Session", "close", "method", "void")],
    "go": [("%Hub", "Widgets", "method", "([]*%Widget, error)"), ("%Hub", "Main", "field", "*%Widget"), ("%Hub", "ByName", "method", "map[string]*%Widget"), ("%Base", "Refresh", "method", "error"), ("%Widget", "Session", "method", "(*%Session, error)"), ("%Widget", "Ping", "method", "error"), ("%Session", "Close", "method", "error"), (None, "Open%", "function", "(*%Hub, error)")],
}
#: Eight shapes of a sample: its text, and the calls that are covered as (line, type, operation).
_SHAPES = {
    "typescript": [
        ("const hub = new %Hub('a;{');\nhub.refresh(); // hub.close()\n", [(2, "Hub", "refresh")]),
        ("const hub = open%();\n(await hub.widgets())[0].ping();\nhub\n  .main\n  .ping();\n", [(2, "Hub", "widgets"), (2, "Widget", "ping"), (5, "Widget", "ping")]),
        ("const hub: %Hub = make();\nfor (const w of await hub.widgets()) {\n  const s = await w.session();\n  s.close();\n}\n", [(2, "Hub", "widgets"), (3, "Widget", "session"), (4, "Session", "close")]),
        ("const hub = %Hub.create();\nconst all = await hub.widgets();\nall.forEach(async (w) => {\n  (await w.session()).close();\n});\n", [(1, "Hub", "create"), (2, "Hub", "widgets"), (4, "Widget", "session"), (4, "Session", "close")]),
        ("let x = new %Hub();\n{\n  const x = new %Widget();\n  x.ping();\n}\nx.refresh();\n", [(4, "Widget", "ping"), (6, "Hub", "refresh")]),
        ("class App {\n  constructor(private readonly hub: %Hub) {}\n  async run() {\n    const { main } = this.hub;\n    main.ping();\n    this.hub.refresh();\n  }\n}\n", [(5, "Widget", "ping"), (6, "Hub", "refresh")]),
        ("import * as sdk from 'sdk';\nlet w = new sdk.%Hub().byName()['k'];\nw?.ping();\nw = null;\n(thing as %Session).close();\n", [(2, "Hub", "byName"), (3, "Widget", "ping"), (5, "Session", "close")]),
        ("const text = `hub.refresh()`;\nhub.refresh();\nunknown().ping();\n", []),
    ],
    "java": [
        ("class A {\n  void f() {\n    %Hub hub = new %Hub(\"}\");\n    hub.refresh(); // hub.close()\n  }\n}\n", [(4, "Hub", "refresh")]),
        ("class A {\n  void f(final %Hub hub) {\n    hub.main\n      .session()\n      .close();\n  }\n}\n", [(4, "Widget", "session"), (5, "Session", "close")]),
        ("class A {\n  void f(%Hub hub) {\n    for (var w : hub.widgets()) {\n      var s = w.session();\n      s.close();\n    }\n  }\n}\n", [(3, "Hub", "widgets"), (4, "Widget", "session"), (5, "Session", "close")]),
        ("class A {\n  void f() {\n    var all = %Hub.create().widgets();\n    all.stream().filter(x -> true).forEach(w -> w.ping());\n  }\n}\n", [(3, "Hub", "create"), (3, "Hub", "widgets"), (4, "Widget", "ping")]),
        ("class A {\n  void f() {\n    { %Widget x = one(); x.ping(); }\n    %Hub x = two();\n    x.refresh();\n    x.ping();\n  }\n}\n", [(3, "Widget", "ping"), (5, "Hub", "refresh")]),
        ("class A {\n  private final %Hub hub;\n  A(%Hub other) { this.hub = other; }\n  void f() {\n    this.hub.refresh();\n    for (%Widget w : hub.byName()) w.ping();\n  }\n}\n", [(5, "Hub", "refresh"), (6, "Hub", "byName"), (6, "Widget", "ping")]),
        ("class A {\n  void f(Object o) {\n    ((%Hub) o).refresh();\n    try (%Session s = open()) { s.close(); }\n  }\n}\n", [(3, "Hub", "refresh"), (4, "Session", "close")]),
        ("class A {\n  String text = \"hub.refresh()\";\n  void f() { hub.refresh(); unknown().ping(); }\n}\n", []),
    ],
    "go": [
        ('package main\nimport "example.com/sdk"\nfunc f() {\n\thub, err := sdk.Open%()\n\thub.Refresh() // hub.Close()\n\terr.Refresh()\n}\n', [(5, "Hub", "Refresh")]),
        ("package main\nfunc f(a, hub *sdk.%Hub) {\n\ts, _ := hub.Main.Session()\n\ts.Close()\n\ta.Main.Ping()\n}\n", [(3, "Widget", "Session"), (4, "Session", "Close"), (5, "Widget", "Ping")]),
        ("package main\nfunc f(hub *sdk.%Hub) {\n\tall, err := hub.Widgets()\n\tif err != nil {\n\t\treturn\n\t}\n\tfor _, w := range all {\n\t\tw.Ping()\n\t}\n}\n", [(3, "Hub", "Widgets"), (8, "Widget", "Ping")]),
        ("package main\nfunc f() {\n\thub := &sdk.%Hub{A: 1}\n\tfor name, w := range hub.ByName() {\n\t\tw.Ping()\n\t\tname.Ping()\n\t}\n}\n", [(4, "Hub", "ByName"), (5, "Widget", "Ping")]),
        ("package main\nfunc f() {\n\tvar x sdk.%Hub\n\tif x := new(sdk.%Widget); x != nil {\n\t\tx.Ping()\n\t}\n\tx.Refresh()\n}\n", [(5, "Widget", "Ping"), (7, "Hub", "Refresh")]),
        ("package main\nfunc f(hub sdk.%Hub) {\n\tall, _ := hub.Widgets()\n\tall[0].Ping()\n\tall[1:].Ping()\n}\n", [(3, "Hub", "Widgets"), (4, "Widget", "Ping")]),
        ("package main\nfunc f(v any) {\n\tif s, ok := v.(*sdk.%Session); ok {\n\t\ts.Close()\n\t}\n}\nfunc (w *%Widget) g() { w.Ping() }\n", [(4, "Session", "Close"), (7, "Widget", "Ping")]),
        ("package main\nvar text = `hub.Refresh()`\nfunc f() {\n\thub.Refresh()\n\tunknown().Ping()\n}\n", []),
    ],
}
_END = {"typescript": "ts", "java": "java", "go": "go"}


def _covered(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """Package g{k} has parts 64 k to 64 k + 63; its word is K{k}, its API that of _API, its samples the shapes by p_size."""
    package, word = F.expr("concat('g', p_partkey div 64)"), F.expr("concat('K', p_partkey div 64)")
    parts = t(spark, sf_dir, "part")
    shape = F.element_at(F.array(*(F.lit(text) for text, _ in _SHAPES[language])), (F.col("p_size") % 8 + 1).cast("int"))
    files = parts.select(package.alias("package_id"), F.format_string(f"s%d.{_END[language]}", "p_partkey").alias("rel_path"), F.replace(shape, F.lit("%"), word).alias("content"))
    row = lambda r: F.struct(*(F.replace(F.lit(x).cast("string"), F.lit("%"), F.col("word")).alias(c) for c, x in zip(("owner", "name", "kind", "ret"), r)))
    api = parts.select(package.alias("package_id"), word.alias("word")).distinct().select("package_id", "word", F.explode(F.array(*map(row, _API[language]))).alias("m")).select("package_id", "word", "m.*")
    types = api.where("owner is not null").select("package_id", F.col("owner").alias("name")).distinct()
    bases = api.select("package_id", F.concat("word", F.lit("Hub")).alias("name"), F.concat("word", F.lit("Base")).alias("base")).distinct()
    known = receivers.inherited(receivers.member_types(api, types, language), bases)
    operations = known.where("owner <> '' and step like '%()'").select("package_id", F.col("owner").alias("client"), F.expr("substring(step, 1, length(step) - 2)").alias("operation"))
    found = receivers.covered_calls(flow.extract_flow(files, language), known, operations)
    return found.select("package_id", "file", "line", "client", "operation")


def _sql(language: str) -> str:
    rows = ", ".join(f"({k}, {line}, '{type_}', '{operation}')" for k, (_, calls) in enumerate(_SHAPES[language]) for line, type_, operation in calls)
    return f"""SELECT 'g' || (p_partkey // 64) AS package_id, 's' || p_partkey || '.{_END[language]}' AS file, c.line, 'K' || (p_partkey // 64) || c.type AS client, c.operation
FROM part JOIN (VALUES {rows}) AS c(shape, line, type, operation) ON c.shape = p_size % 8"""


@register(_sql("typescript"))
def typescript_sample_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir, "typescript")


@register(_sql("java"))
def java_sample_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir, "java")


@register(_sql("go"))
def go_sample_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir, "go")
