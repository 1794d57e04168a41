import re

from apilattice.functions import classify
from apilattice.plans import facade
from apilattice.sources import declarations, index

JAVA = """package a.b;
import java.util.List;
/** A client. Says "{" */
@Deprecated
public class Client<T extends Foo> extends Base<T> implements Closeable, Iface<Map<String, T>> {
  private int x = 3;
  public static final String NAME = "a;b{";
  /** Lists. */
  public List<Item> list(String q, @Nullable final Map<String, Integer> m) throws IOException { if (x) { y(); } return null; }
  public Client(String url) { }
  <R> R hidden() { return null; }
  public <R> Mono<R> generic(Class<R> c) { return null; }
  protected abstract void prot();
  public static class Builder { public Builder url(String u) { return this; } }
  private static class Secret { public void no() {} }
  public enum Mode { FAST(1), SLOW(2); public int n() { return 1; } }
}
interface Hidden { void a(); }
public interface Shape extends A, B { int area(); default void d() { } }
public record Point(int x, List<String> y) implements Shape { }
"""
CSHARP = """using System;
namespace My.Pkg {
  /// <summary>The client.</summary>
  [Obsolete("old")]
  public partial class Client : BaseClient, IDisposable {
    private readonly int _x;
    public string Name { get; set; } = "x";
    public int Size => 3;
    /// <summary>Gets it.</summary>
    public virtual async Task<Response<Item>> GetAsync(string id, CancellationToken ct = default) { return null; }
    protected Client() { }
    public Client(Uri u, ClientOptions o = null) : this(u) { }
    internal void Hide() { }
    public event EventHandler Changed;
    public class Inner : IFoo { public void Go() {} }
  }
  internal class No { public void X() {} }
  public interface IFoo { void Go(); int P { get; } }
  public enum Mode { A = 1, B }
  public record struct Pt(int X, int Y);
}
"""
GO = """// Package w does.
package widgets

import "fmt"

// Client talks.
// Deprecated: use Other.
type Client struct {
	Base
	*ext.Embedded
	Name, Title string `json:"name"`
	hidden int
}

type Lister interface {
	// List lists.
	List(ctx context.Context, n int) ([]Item, error)
	io.Closer
}

type (
	ID string
	Alias = Client
)

// List lists things.
func (c *Client) List(ctx context.Context, a, b int) ([]Item, error) {
	for { break }
	return nil, nil
}
func (c *Client) hide() {}
func NewClient(url string) *Client { return &Client{} }
func (o *Other) Run() {}
"""
SCRIPT = """import { x } from "y";
/** The client.
 * @deprecated use Other */
export class Client<T> extends Base<T> implements Closer, Other {
  private secret = 1;
  #hash = 2;
  readonly name: string;
  options?: { a: number; b: string } = { a: 1, b: "}" };
  constructor(private url: string, opts?: Options) { super(); }
  /** Lists. */
  async list(q: string, ...rest: number[]): Promise<Item[]> { return []; }
  get size(): number { return 1 }
  static create(): Client<any> { return null; }
}
export interface Options extends A, B {
  url: string
  retries?: number
  run(a: { x: number }): void
}
class Hidden { go() {} }
export type Id = string | number;
export enum Color { Red, Green = 2 }
export async function connect(url: string): Promise<Client<any>> { return null; }
export declare namespace Inner { export interface Deep { a: string } }
export const x = 1;
"""


def found(text, language, **kw):
    return {t["name"]: t for t in declarations.file_types(text, language, **kw)}


def members(t):
    return [(m["kind"], m["name"], m["sig"], m["ret"]) for m in t["members"]]


def test_java():
    got = found(JAVA, "java")
    assert list(got) == ["Client", "Client.Builder", "Client.Mode", "Shape", "Point"]
    client = got["Client"]
    assert (client["container"], client["base"], client["supers"], client["deprecated"], client["doc"]) == ("a.b", "Base<T>", ["Closeable", "Iface<Map<String, T>>"], True, 'A client. Says "{"')
    assert members(client) == [("field", "NAME", None, "String"), ("method", "list", "(String q, @Nullable final Map<String, Integer> m)", "List<Item>"), ("ctor", "Client", "(String url)", None), ("method", "generic", "(Class<R> c)", "Mono<R>"), ("method", "prot", "()", "void")]
    assert [(p["name"], p["type"]) for p in client["members"][1]["params"]] == [("q", "String"), ("m", "Map<String, Integer>")]
    assert got["Client.Mode"]["values"] == ["FAST", "SLOW"] and got["Shape"]["supers"] == ["A", "B"] and members(got["Shape"])[1][1] == "d"
    assert [m[1] for m in members(got["Point"])] == ["x", "y"] and not got["Client.Builder"]["entry_point"]


def test_csharp():
    got = found(CSHARP, "dotnet")
    assert list(got) == ["Client", "Client.Inner", "IFoo", "Mode", "Pt"]
    assert (got["Client"]["base"], got["Client"]["supers"], got["Client"]["deprecated"], got["Client"]["doc"]) == ("BaseClient", ["IDisposable"], True, "The client.")
    assert [m[:2] for m in members(got["Client"])] == [("property", "Name"), ("property", "Size"), ("method", "GetAsync"), ("ctor", "Client"), ("event", "Changed")]
    call = got["Client"]["members"][2]
    assert (call["ret"], call["is_async"], call["params"][1]["default"], call["doc"]) == ("Task<Response<Item>>", True, "default", "Gets it.")
    assert got["Mode"]["values"] == ["A", "B"] and got["Pt"]["kind"] == "record struct" and [m[1] for m in members(got["IFoo"])] == ["Go", "P"]


def test_go():
    got = found(GO, "go")
    assert list(got) == ["Client", "Lister", "ID", "Alias", "Other", ""]
    assert got["Client"]["embeds"] == ["Base", "ext.Embedded"] and got["Client"]["deprecated"] and got["Lister"]["embeds"] == ["io.Closer"]
    assert members(got["Client"]) == [("field", "Name", None, "string"), ("field", "Title", None, "string"), ("method", "List", "(ctx context.Context, a, b int)", "([]Item, error)")]
    assert [p["type"] for p in got["Client"]["members"][2]["params"]] == ["context.Context", "int", "int"]
    assert (got["ID"]["base"], got["Alias"]["kind"], got["Other"]["kind"]) == ("string", "alias", "part") and members(got[""]) == [("function", "NewClient", "(url string)", "*Client")]


def test_typescript():
    got = found(SCRIPT, "typescript")
    assert list(got) == ["Client", "Options", "Id", "Color", "Deep", ""]
    assert (got["Client"]["base"], got["Client"]["supers"], got["Client"]["deprecated"]) == ("Base<T>", ["Closer", "Other"], True)
    assert [m[:2] for m in members(got["Client"])] == [("property", "name"), ("property", "options"), ("ctor", "constructor"), ("method", "list"), ("property", "size"), ("method", "create")]
    assert [(p["name"], p["modifier"]) for p in got["Client"]["members"][3]["params"]] == [("q", None), ("rest", "...")]
    assert [m[1] for m in members(got["Options"])] == ["url", "retries", "run"] and got["Color"]["values"] == ["Red", "Green"]
    assert members(got[""]) == [("function", "connect", "(url: string)", "Promise<Client<any>>")]
    assert list(found("class A { b(): void; }\ninterface C {}", "typescript", declared=True)) == ["A", "C"]


def test_broken_files():
    for language in ("java", "dotnet", "go", "typescript"):
        for text in ("", "}}}}", "{{{{", "public class A {", "class", "/* open", "\"open", "type X struct {", "func (", "export function f(", "((((", "public class A { int x( }", "a" * 10_000 + "{" * 500):
            assert isinstance(declarations.file_types(text, language), list)
        assert declarations.file_types("public class A { " * 3000, language) is not None


def test_index_of_extracted_types(spark):
    more = "package widgets\nfunc (c *Client) Drop(id string) {}\ntype Item struct { Id string }"
    rows = spark.createDataFrame([("p", "a.go", GO), ("p", "b.go", more), ("p", "b_test.go", more), ("p", "c.txt", more)], "package_id string, rel_path string, content string")
    made = declarations.as_index(declarations.extract_types(rows, "go"))
    types = {r.name: r for r in index.types(made).collect()}
    assert set(types) == {"Client", "Lister", "ID", "Alias", "Other", "Item"}
    assert {m.name for m in types["Client"].members} == {"Name", "Title", "List", "Drop"} and types["Client"].kind == "struct"
    assert {r.name for r in index.members(made).where("kind = 'function'").collect()} == {"NewClient"}
    assert "Item" in {r.name for r in facade.reachable_clients(made, "go").collect()}
    assert index.types(made).where(classify.is_client()).count() == 3
    none = declarations.as_index(declarations.extract_types(rows.limit(0), "java"))
    assert none.collect() == []


def stub(spark, text, language, name):
    rows = spark.createDataFrame([("p", "a" + declarations.EXTENSIONS[language], text)], "package_id string, rel_path string, content string")
    made = index.stubs(declarations.as_index(declarations.extract_types(rows, language)), language)
    return next(r.stub for r in made.collect() if re.search(rf"\b(class|interface|enum|record|type) {re.escape(name)}(?![\w.])", r.stub))


def test_stubs_in_each_language(spark):
    assert stub(spark, JAVA, "java", "Client").startswith('/** A client. Says "{" */\n@Deprecated\npublic class Client extends Base<T> implements Closeable, Iface<Map<String, T>> {\n    public static String NAME;\n    /** Lists. */\n    public List<Item> list(String q')
    assert "public enum Client.Mode {\n    FAST, SLOW;\n    public int n();\n}\n" == stub(spark, JAVA, "java", "Client.Mode") and stub(spark, JAVA, "java", "Shape").startswith("public interface Shape extends A, B {\n")
    sharp = stub(spark, CSHARP, "dotnet", "Client")
    assert sharp.startswith("/// <summary>The client.</summary>\n[Obsolete]\npublic class Client : BaseClient, IDisposable {\n    public string Name { get; }\n") and "    public Client(Uri u, ClientOptions o = null);\n" in sharp
    go = stub(spark, GO, "go", "Client")
    assert go.startswith("// Client talks. Deprecated: use Other.\n// Deprecated\ntype Client struct {\n    Base\n    ext.Embedded\n    Name string\n    Title string\n}\n// List lists things.\nfunc (Client) List(ctx context.Context, a, b int) ([]Item, error)\n")
    assert "type Lister interface {\n    io.Closer\n    // List lists.\n    List(ctx" in stub(spark, GO, "go", "Lister") and stub(spark, GO, "go", "ID") == "type ID string\n" and stub(spark, GO, "go", "Alias") == "type Alias = Client\n"
    script = stub(spark, SCRIPT, "typescript", "Client")
    assert "export class Client extends Base<T> implements Closer, Other {\n" in script and "    constructor(private url: string, opts?: Options);\n" in script and "    static create(): Client<any>;\n" in script
    assert stub(spark, SCRIPT, "typescript", "Color") == "export enum Color {\n    Red, Green\n}\n"


def test_members_of_csharp_that_have_no_plain_name(spark):
    code = """namespace N;
    public class V {
      public static bool operator true(V v) { return true; }
      public static V operator checked -(V a) => a;
      public static bool operator >=(V a, V b) => true;
      public static bool operator <=(V a, V b) { return false; }
      public static explicit operator List<int>(V v) => null;
      internal static V operator *(V a, V b) => a;
      public int this[string k, int n = 0] { get { return 1; } set { } }
      int this[long k] => 1;
      public event Action<int> Done { add { } remove { } }
      private event Action Hidden;
      public const string Name = "operator +(";
      public static readonly int[] All = { 1, 2 };
      public readonly int own;
      public ValueTask Close() => default;
      public System.Threading.Tasks.Task<V> Open() => null;
      public Tasks Not() => null;
    }"""
    (made,) = declarations.file_types(code, "dotnet")
    got = [(m["kind"], m["name"], m["sig"], m["ret"], m["is_async"]) for m in made["members"]]
    assert got == [
        ("operator", "operator true", "(V v)", "bool", False), ("operator", "operator -", "(V a)", "V", False), ("operator", "operator >=", "(V a, V b)", "bool", False), ("operator", "operator <=", "(V a, V b)", "bool", False),
        ("operator", "explicit operator List<int>", "(V v)", "List<int>", False), ("indexer", "this[]", "[string k, int n = 0]", "int", False), ("event", "Done", None, "Action<int>", False), ("const", "Name", None, "string", False),
        ("field", "All", None, "int[]", False), ("method", "Close", "()", "ValueTask", True), ("method", "Open", "()", "System.Threading.Tasks.Task<V>", True), ("method", "Not", "()", "Tasks", False),
    ]
    text = stub(spark, code, "dotnet", "V")
    assert all(line in text for line in ("public static explicit operator List<int>(V v);", "public static bool operator >=(V a, V b);", "public int this[string k, int n = 0] { get; }", "public event Action<int> Done;", "public const string Name;"))
