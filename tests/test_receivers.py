import pytest
from oracle import compare
from pyspark.sql import functions as F

from apilattice import registry
from apilattice.operators import receivers as R
from apilattice.sources import flow

MEMBERS = "package_id string, owner string, name string, kind string, ret string"
API = {
    "typescript": [("Hub", "widgets", "method", "Promise<Widget[]>"), ("Hub", "pages", "method", "PagedAsyncIterator<Widget>"), ("Hub", "main", "property", "Widget"), ("Hub", "byName", "method", "Map<string, Widget>"), ("Hub", "create", "method", "Hub"), ("Hub", "refresh", "method", "void"), ("Hub", "maybe", "method", "Widget | undefined"), ("Widget", "session", "method", "Promise<Session>"), ("Widget", "ping", "method", "void"), ("Session", "close", "method", "void"), (None, "createHub", "function", "Hub")],
    "java": [("Hub", "widgets", "method", "List<Widget>"), ("Hub", "stream", "method", "Stream<Widget>"), ("Hub", "main", "field", "Widget"), ("Hub", "main", "method", "Widget"), ("Hub", "byName", "method", "Map<String, Widget>"), ("Hub", "create", "method", "Hub"), ("Hub", "refresh", "method", "void"), ("Widget", "session", "method", "Session"), ("Widget", "ping", "method", "void"), ("Session", "close", "method", "void")],
    "go": [("Hub", "Widgets", "method", "([]*Widget, error)"), ("Hub", "Main", "field", "*Widget"), ("Hub", "ByName", "method", "map[string]*Widget"), ("Hub", "Refresh", "method", "error"), ("Widget", "Session", "method", "(*Session, error)"), ("Widget", "Ping", "method", "error"), ("Session", "Close", "method", ""), (None, "NewHub", "function", "(*Hub, error)"), (None, "Default", "field", "*Hub")],
}
CASES = {
    "typescript": {
        "direct": ("const hub = new Hub('x;{');\nhub.refresh();", {(2, "Hub", "refresh")}),
        "declared": ("function f(hub: Hub, n = 1) {\n  hub.refresh();\n}\nhub.refresh();", {(2, "Hub", "refresh")}),
        "chained": ("const hub = createHub();\n(await hub.widgets())[0].ping();\nhub\n  .main\n  .ping();", {(2, "Hub", "widgets"), (2, "Widget", "ping"), (5, "Widget", "ping")}),
        "loop": ("const hub = Hub.create();\nfor (const w of await hub.widgets()) {\n  const s = await w.session();\n  s.close();\n}\nfor await (const w of hub.pages()) w.ping();", {(1, "Hub", "create"), (2, "Hub", "widgets"), (3, "Widget", "session"), (4, "Session", "close"), (6, "Hub", "pages"), (6, "Widget", "ping")}),
        "callback": ("const hub: Hub = make();\nconst all = await hub.widgets();\nall.forEach(w => w.ping());\nall.filter((x, i) => i > 0).map(async (w) => { await w.session(); });\nall.reduce((w) => w.ping());", {(2, "Hub", "widgets"), (3, "Widget", "ping"), (4, "Widget", "session")}),
        "shadow": ("let x = new Hub();\n{\n  const x = new Widget();\n  x.ping();\n  { const x = other(); x.refresh(); }\n}\nx.refresh();\nx = (await x.widgets())[0];\nx.ping();", {(4, "Widget", "ping"), (7, "Hub", "refresh"), (8, "Hub", "widgets"), (9, "Widget", "ping")}),
        "fields": ("class App {\n  private hub: Hub;\n  private last = new Session();\n  constructor(private readonly w: Widget) { this.other = createHub(); }\n  run() {\n    this.hub.refresh();\n    this.w.ping();\n    this.last.close();\n    this.other.main.ping();\n  }\n}", {(6, "Hub", "refresh"), (7, "Widget", "ping"), (8, "Session", "close"), (9, "Widget", "ping")}),
        "names": ("import * as sdk from 'sdk';\nconst { main, missing: m2 } = new sdk.Hub();\nmain.ping();\nconst w = sdk.createHub().byName()['a']!;\nw.ping();\n(x as Session).close();\nconst v = sdk.createHub().maybe();\nv?.ping();", {(3, "Widget", "ping"), (4, "Hub", "byName"), (5, "Widget", "ping"), (6, "Session", "close"), (7, "Hub", "maybe"), (8, "Widget", "ping")}),
        "none": ("// hub.refresh()\nconst s = 'hub.refresh()';\nhub.refresh();\nhub.close(", set()),
    },
    "java": {
        "direct": ("class A { void f() {\n Hub hub = new Hub(\"}\");\n hub.refresh();\n} }", {(3, "Hub", "refresh")}),
        "declared": ("class A { void f(final Hub hub, int n) throws Exception {\n hub.refresh();\n}\nvoid g() { hub.refresh(); } }", {(2, "Hub", "refresh")}),
        "chained": ("class A { void f() {\n var hub = Hub.create();\n hub.widgets().get(0);\n hub.main()\n  .session()\n  .close();\n} }", {(2, "Hub", "create"), (3, "Hub", "widgets"), (4, "Hub", "main"), (5, "Widget", "session"), (6, "Session", "close")}),
        "loop": ("class A { void f(Hub hub) {\n for (var w : hub.widgets()) {\n  Session s = w.session();\n  s.close();\n }\n for (Widget w : hub.widgets()) w.ping();\n for (var w : hub.byName()) { w.ping(); }\n} }", {(2, "Hub", "widgets"), (3, "Widget", "session"), (4, "Session", "close"), (6, "Hub", "widgets"), (6, "Widget", "ping"), (7, "Hub", "byName"), (7, "Widget", "ping")}),
        "callback": ("class A { void f(Hub hub) {\n hub.widgets().forEach(w -> w.ping());\n hub.widgets().stream().filter(x -> true).map((w) -> { return w.session(); });\n} }", {(2, "Hub", "widgets"), (2, "Widget", "ping"), (3, "Hub", "widgets"), (3, "Widget", "session")}),
        "shadow": ("class A { void f() {\n { Widget x = one(); x.ping(); }\n Hub x = two();\n x.refresh();\n x.ping();\n} }", {(2, "Widget", "ping"), (4, "Hub", "refresh"), (5, "Hub", "ping")}),
        "fields": ("class A {\n private final Hub hub;\n Widget w = make();\n A() { this.hub = new Hub(); }\n void f() {\n  this.hub.refresh();\n  w.ping();\n  try (Session s = w.session()) { s.close(); }\n  ((Hub) thing()).refresh();\n }\n}", {(6, "Hub", "refresh"), (7, "Widget", "ping"), (8, "Widget", "session"), (8, "Session", "close"), (9, "Hub", "refresh")}),
    },
    "go": {
        "direct": ('package main\nimport "example.com/sdk"\nfunc f() {\n\thub, err := sdk.NewHub()\n\thub.Refresh()\n\terr.Refresh()\n}', {(5, "Hub", "Refresh")}),
        "declared": ('package main\nfunc f(ctx context.Context, a, hub *sdk.Hub) {\n\thub.Refresh()\n\ta.Refresh()\n}\nfunc (h *Hub) g() { h.Refresh() }', {(3, "Hub", "Refresh"), (4, "Hub", "Refresh"), (6, "Hub", "Refresh")}),
        "loop": ('package main\nimport s "example.com/sdk"\nfunc f() {\n\thub := &s.Hub{A: 1}\n\tall, _ := hub.Widgets()\n\tfor _, w := range all {\n\t\tsession, err := w.Session()\n\t\tif err != nil { return }\n\t\tsession.Close()\n\t}\n\tfor name, w := range hub.ByName() {\n\t\tw.Ping()\n\t\tname.Ping()\n\t}\n\tall[0].Ping()\n\tall[1:].Ping()\n}', {(5, "Hub", "Widgets"), (7, "Widget", "Session"), (9, "Session", "Close"), (11, "Hub", "ByName"), (12, "Widget", "Ping"), (15, "Widget", "Ping")}),
        "shadow": ('package main\nfunc f() {\n\tvar x sdk.Hub\n\tif x := new(sdk.Widget); x != nil {\n\t\tx.Ping()\n\t}\n\tx.Refresh()\n\tfor i := 0; i < 3; i++ { x := sdk.Session{}; x.Close() }\n\tvar y = x.Main\n\ty.Ping()\n}', {(5, "Widget", "Ping"), (7, "Hub", "Refresh"), (8, "Session", "Close"), (10, "Widget", "Ping")}),
        "modules": ('package main\nimport (\n\t"fmt"\n\t"example.com/sdk/v2"\n)\nfunc f(v any) {\n\tsdk.Default.Refresh()\n\tif w, ok := sdk.Default.ByName()["a"]; ok {\n\t\tw.Ping()\n\t}\n\tv.(*sdk.Session).Close()\n\tfmt.Println()\n}', {(7, "Hub", "Refresh"), (8, "Hub", "ByName"), (9, "Widget", "Ping"), (11, "Session", "Close")}),
    },
}
END = {"typescript": ".ts", "java": ".java", "go": ".go"}


def members(spark, language, api=None):
    rows = spark.createDataFrame([("p", *r) for r in api or API[language]], MEMBERS)
    types = rows.where("owner is not null").select("package_id", F.col("owner").alias("name")).distinct()
    return R.member_types(rows, types, language)


def typed(spark, language, texts, found, bases=None):
    files = spark.createDataFrame([("p", name + END[language], text) for name, text in texts.items()], "package_id string, rel_path string, content string")
    calls = R.typed_calls(flow.extract_flow(files, language), found, bases).collect()
    return {name: {(r.line, r.client, r.operation) for r in calls if r.file == name + END[language]} for name in texts}


@pytest.mark.parametrize("language", sorted(CASES))
def test_receivers(spark, language):
    got = typed(spark, language, {k: text for k, (text, _) in CASES[language].items()}, members(spark, language))
    known = {(o, n) for o, n, *_ in API[language]}
    for name, (_, want) in CASES[language].items():
        assert {c for c in got[name] if c[1:] in known or c in want} == want, name


def test_inherited_members(spark):
    api = members(spark, "typescript", [("Base", "own", "method", "Widget"), ("Middle", "ping", "method", "Base"), ("Widget", "x", "method", "void")])
    bases = spark.createDataFrame([("p", "Top", "Middle<T>"), ("p", "Middle", "Base"), ("p", "Base", "Top")], "package_id string, name string, base string")
    got = typed(spark, "typescript", {"a": "const t: Top = get();\nt.own().x();\nt.ping().own();"}, api, bases)["a"]
    assert got == {(2, "Top", "own"), (2, "Widget", "x"), (3, "Top", "ping"), (3, "Base", "own")}


def test_types_of_results(spark):
    rows = spark.createDataFrame([(s,) for s in ("(*sdk.Hub, error)", "[]*Widget", "map[string][]Widget", "(n int, err error)", "error", None)], "s string")
    assert [r[0] for r in rows.select(R.result_type(F.col("s"), "go")).collect()] == ["sdk.Hub", "[]*Widget", "map[string][]Widget", "int", "error", None]
    rows = spark.createDataFrame([(s,) for s in ("Widget[]", "[]*Widget", "map[string][]Widget", "Map<String, List<Widget>>", "readonly Widget[]", "(A | B)[]", "Widget", "Widget[][]", None)], "s string")
    assert [r[0] for r in rows.select(R.element_type(F.col("s"))).collect()] == ["Widget", "Widget", "[]Widget", "List<Widget>", "Widget", "A | B", None, "Widget[]", None]
    rows = spark.createDataFrame([(s,) for s in ("*sdk.Hub", "List<Widget>", "Widget[]", "Hub | undefined", " a.b.C ", None)], "s string")
    assert [r[0] for r in rows.select(R.plain_type(F.col("s"))).collect()] == ["Hub", "List", None, "Hub", "C", None]


def test_odd_texts():
    for language in END:
        for text in ("", "(((", "}}}", "a.b(", "const x = x;\nx.y()", "x := x\nx.y()", "new", "var", "for (const a of", "((a", "a" * 5000, "f(" * 300, "this.", "{" * 300 + "}" * 300):
            flow.file_flow(text, language)


def test_coverage_of_sources_and_samples(spark):
    """From sources to the report: the index of TypeScript files, and samples that cover two of its three operations."""
    from apilattice.plans import facade

    schema = "package_id string, rel_path string, content string"
    sources = spark.createDataFrame([("p", "index.ts", "export * from './client';"), ("p", "client.ts", "import { W } from './w';\nexport class Client extends Base { list(): Promise<W[]> { return null!; } }\nexport class Base { stop(): void {} }"), ("p", "w.ts", "export class W { ping(): void {} }")], schema)
    entries = spark.createDataFrame([("p", "index.ts")], "package_id string, file string")
    index = facade.source_index(sources, "typescript", entries)
    samples = spark.createDataFrame([("p", "s.ts", "const c = new Client();\nfor (const w of await c.list()) w.ping();\nc.stop();")], schema)
    assert {(r.line, r.client, r.operation) for r in facade.sample_calls(index, samples, "typescript").collect()} == {(2, "Client", "list"), (2, "W", "ping"), (3, "Client", "stop")}
    report = facade.sample_coverage(index, samples, "typescript").first()
    assert (report.total, report.covered, report.uncovered) == (3, 2, 1)


@pytest.mark.parametrize("language", ["go", "java", "typescript"])
def test_calls_pass_no_table_through_the_driver(spark, no_broadcast, language):
    name = f"{language}_sample_calls"
    compare(spark, registry.load()[name], registry.ORACLES[name], "/root/testdata/sf0.001")


ODD_TYPES = ("Widget[]", "[]*Widget", "[]", "[]*", "chan *sdk.Hub", "map[string][]Widget", "Map<String, List<Widget>>", "Map<string,\n  Widget>", "Map<A,\r\nB>\n", "readonly Widget[]", "readonly []", "(A | B)[]", "Widget[][]", "*sdk.Hub", " a.b.C ", "Hub | undefined", "Hub | null\n", "Hub?!", "&*Hub", "a.b.", "", "<A>", "Caf\u00e9<Caf\u00e9>", "A<\u2028B>", "List<Widget>\r\n", "x\u00a0| null", None)


def test_types_in_tasks(spark):
    """A task reads types as the columns do."""
    rows = spark.createDataFrame([(s,) for s in ODD_TYPES], "s string").select("s", R.element_type(F.col("s")), R.plain_type(F.col("s"))).collect()
    assert [(r[0], R._element(r[0]), R._plain(r[0])) for r in rows] == [tuple(r) for r in rows]


def _flow(spark, n):
    """Package p: a chain of n values; q: without members of its own; null: no package; a file that comes twice."""
    chain = [("p", "a", 0, "value", "type", "T", [], 0, 0, None)] + [("p", "a", k, "value", "value", str(k - 1), ["next()"], 0, 0, None) for k in range(1, n)] + [("p", "a", n, "call", "value", str(n - 1), ["all()", "[]"], 7, 0, "stop")]
    odd = [(p, f, *r) for p, f in (("p", "b"), ("q", "b"), (None, "b"), ("p", "c"), ("p", "c")) for r in ((0, "value", "type", "List<p.T>", [], 0, 0, None), (1, "call", "value", "0", ["[]"], 3, 1, "go"), (2, "call", "type", "T", ["next()", "next()"], 4, 2, "go"), (3, "call", "free", "", ["make()"], 5, 3, "go"), (4, "value", "value", "5", [], 0, 0, None), (5, "value", "value", "4", [], 0, 0, None), (6, "call", "value", "4", [], 6, 4, "go"), (7, "call", "type", "T[]", [], 7, 5, "go"), (8, "call", "type", "*U", [], 8, 6, "go"))]
    return spark.createDataFrame(chain + odd, flow.ROWS)


def _members(spark):
    return spark.createDataFrame([("p", "T", "next()", "T"), ("p", "T", "all()", "T[]"), ("p", "", "make()", "U"), (None, "T", "next()", "T"), ("r", "T", "next()", "V")], "package_id string, owner string, step string, type string")


@pytest.mark.parametrize(("most", "part"), [(0, 1 << 16), (1 << 17, 1), (1 << 17, 1 << 16), (1, 3)])
def test_typed_calls_in_tasks_and_by_steps(spark, monkeypatch, most, part):
    """Packages in a task, in parts and by steps give the same rows."""
    monkeypatch.setattr(R, "MOST", most)
    monkeypatch.setattr(R, "PART", part)
    got = [tuple(r) for r in R.typed_calls(_flow(spark, 4), _members(spark)).collect()]
    own = lambda p, f: [(p, f, 3, 1, "T", "go")] * (p is not None) + [(p, f, 4, 2, "T", "go"), (p, f, 5, 3, "U", "go")] * (p == "p") + [(p, f, 8, 6, "U", "go")]
    twice = [(r, 4 if r[2] == 3 else 2) for r in own("p", "c")]  # each of two values reaches each of two calls
    want = [("p", "a", 7, 0, "T", "stop"), *own("p", "b"), *own("q", "b"), *own(None, "b"), *(r for r, n in twice for _ in range(n))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jobs_do_not_grow_with_chains(spark):
    """Chains through variables are followed in tasks; each link was a round of jobs and a written table before."""
    sc, jobs = spark.sparkContext, []
    for n in (2, 12):
        sc.setJobGroup(f"chain{n}", "")
        assert R.typed_calls(_flow(spark, n), _members(spark)).where("file = 'a'").count() == 1
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"chain{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("language", ["java", "typescript"])
def test_sample_calls_write_few_tables(spark, monkeypatch, language):
    """A table was written for each step and each link of the longest chain of values, with more partitions each time."""
    cuts, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: cuts.append(df) or cut(df))
    registry.load()[f"{language}_sample_calls"](spark, "/root/testdata/sf0.001")
    assert len(cuts) <= 10


@pytest.mark.parametrize("lent", [0, 20, 1 << 19])
def test_inherited_in_tasks_and_by_levels(spark, monkeypatch, lent):
    """A diamond, a cycle, a chain longer than the bound, a base of many types, a package without bases and none at all: both ways give the same rows."""
    monkeypatch.setattr(R, "LENT", lent)
    chain = [("deep", f"T{k}", f"T{k - 1}") for k in range(1, 20)]
    bases = [("p", "D", "B<X>"), ("p", "D", "C"), ("p", "B", "a.A"), ("p", "C", "A"), ("p", "A", "D"), ("p", "A", "A"), (None, "D", "B"), ("q", "D", None), *chain]
    own = [("p", "A", "run()", "Z"), ("p", "A", "own", "A"), ("p", "B", "run()", "Y"), ("p", "C", "run()", "X"), ("p", "B", "z", "m"), ("p", "B", "z", "k"), (None, "B", "run()", "N"), ("q", "D", "go()", "G"), ("deep", "T0", "go()", "T0")]
    schema = "package_id string, owner string, step string, type string"
    got = [tuple(r) for r in R.inherited(spark.createDataFrame(own, schema), spark.createDataFrame(bases, "package_id string, name string, base string")).collect()]
    more = [("p", "D", "run()", "X"), ("p", "B", "own", "A"), ("p", "C", "own", "A"), ("p", "D", "own", "A"), ("p", "D", "z", "k"), ("p", "A", "z", "k"), ("p", "C", "z", "k")]
    assert sorted(got, key=str) == sorted([*own, *more, *(("deep", f"T{k}", "go()", "T0") for k in range(1, 17))], key=str)


def test_jobs_do_not_grow_with_bases(spark):
    """What a type has from a base is told in tasks; each base on the way up was two written tables before."""
    sc, jobs = spark.sparkContext, []
    own = spark.createDataFrame([("p", "T0", "go()", "T0")], "package_id string, owner string, step string, type string")
    for n in (1, 9):
        bases = spark.createDataFrame([("p", f"T{k}", f"T{k - 1}") for k in range(1, n + 1)], "package_id string, name string, base string")
        sc.setJobGroup(f"bases{n}", "")
        assert R.inherited(own, bases).count() == n + 1
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"bases{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("language", ["java", "typescript"])
def test_sample_calls_write_three_tables(spark, monkeypatch, language):
    """API, members and rows; two tables for each level of bases, and empty ones of large packages, were written besides."""
    cuts, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: cuts.append(df) or cut(df))
    registry.load()[f"{language}_sample_calls"](spark, "/root/testdata/sf0.001")
    assert len(cuts) == 3
