"""Declarations of many shapes, read back out of a source file for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.plans.bindings import t
from apilattice.registry import register
from apilattice.sources import declarations
from apilattice.sources import index as api_index

#: Source texts in which T stands for the part's own type name, D for its kind and 1000 for its size.
SOURCES = {
    "java": """package k.x;
/** Finds D. */
public interface TApi extends Runnable, Comparable<T> {
  List<D> find(String q);
  @Deprecated
  List<D> find(String q, int n);
}
public enum TKind { A, B(1000); private int n; }
@Deprecated
public abstract class T extends Base<D> implements TApi, Closeable {
  public static final int SIZE = 1000;
  private void hidden() { }
  public T(int n) { }
  public static class Part { public int at; }
}
""",
    "dotnet": """namespace K.X;
/// <summary>Finds D.</summary>
public interface IT : IDisposable, IEquatable<T>
{
    Task<D> Find(string q);
    [Obsolete("old")]
    Task<D> Find(string q, int n = 1000);
}
public enum TKind { A, B = 1000 }
[Obsolete]
public abstract class T : Base<D>, IT
{
    public const int Size = 1000;
    public static readonly T Empty = Make("}");
    public int counter;
    private void Hidden() { }
    public T(int n) { }
    public event Action<D> Changed;
    public D this[int i] => all[i];
    public static T operator +(T a, T b) => a;
    public static bool operator ==(T a, T b) { return true; }
    public static implicit operator T(int n) => new T(n);
    public class Part { public int At { get; init; } }
}
public record TRow(string Name, D Kind);
""",
    "typescript": """/** Finds D. */
export interface TApi extends Runnable, Comparable<T> {
  find(q: string): D[];
  /** @deprecated use the other */
  find(q: string, n?: number): D[];
  readonly size: number;
}
export enum TKind { A = "a", B = 'b' }
/** @deprecated */
export abstract class T extends Base<D> implements TApi {
  static readonly size: number = 1000;
  private hidden() { }
  constructor(n: number) { super(); }
  async *walk(): AsyncIterable<D> { }
}
class Hidden { }
export type TAlias = T | null;
export function makeT(n: number): T { return null!; }
""",
    "go": """package x

// Api finds D.
type TApi interface {
	io.Reader
	Base
	// Find finds 1000.
	Find(q string) ([]D, error)
	hidden()
}

// T is old.
//
// Deprecated: use TApi.
type T struct {
	*Base
	Size, Count int `json:"size"`
	hidden string
}

type TAlias = T
type TKind int
type hiddenT struct{}

func (t T) Close() error { return nil }
func NewT(n int) *T { return nil }
func (h hiddenT) No() {}
""",
}

#: (name, kind, base, supers and embeds, values, deprecated, members) that users of the sources see; a member is
#: its name, parameters and result, and a mark: s static, a asynchronous, d deprecated.
SHOWN = {
    "java": [
        ("TApi", "interface", "", "Runnable, Comparable<T>", "", False, "find(String q) List<D> ; find(String q, int n) List<D> d"),
        ("TKind", "enum", "", "", "A, B", False, ""),
        ("T", "class", "Base<D>", "TApi, Closeable", "", True, "SIZE int s; T(int n)  "),
        ("T.Part", "class", "", "", "", False, "at int "),
    ],
    "dotnet": [
        ("IT", "interface", "", "IDisposable, IEquatable<T>", "", False, "Find(string q) Task<D> a; Find(string q, int n = 1000) Task<D> ad"),
        ("TKind", "enum", "", "", "A, B", False, ""),
        ("T", "class", "Base<D>", "IT", "", True, "Size int ; Empty T s; T(int n)  ; Changed Action<D> ; this[][int i] D ; operator +(T a, T b) T s; operator ==(T a, T b) bool s; implicit operator T(int n) T s"),
        ("T.Part", "class", "", "", "", False, "At int "),
        ("TRow", "record", "", "", "", False, "Name string ; Kind D "),
    ],
    "typescript": [
        ("TApi", "interface", "", "Runnable, Comparable<T>", "", False, "find(q: string) D[] ; find(q: string, n?: number) D[] d; size number "),
        ("TKind", "enum", "", "", "A, B", False, ""),
        ("T", "class", "Base<D>", "TApi", "", True, "size number s; constructor(n: number)  ; walk() AsyncIterable<D> a"),
        ("TAlias", "type", "", "", "", False, ""),
    ],
    "go": [
        ("TApi", "interface", "", "io.Reader, Base", "", False, "Find(q string) ([]D, error) "),
        ("T", "struct", "", "Base", "", True, "Size int ; Count int ; Close() error "),
        ("TAlias", "alias", "T", "", "", False, ""),
        ("TKind", "type", "int", "", "", False, ""),
    ],
}

_COLUMNS = ("name", "kind", "base", "heirs", "vals", "deprecated", "members")


def _filled(column: str) -> str:
    """SQL: T, D and 1000 as words of their own or before a capital, replaced as in the sources."""
    return f"""replace(regexp_replace(regexp_replace({column}, '\\bD\\b', p_type, 'g'), '\\b(I|new|New|make)?T([A-Z]\\w*)?\\b', '\\1T' || p_partkey || '\\2', 'g'), '1000', CAST(p_size AS VARCHAR))"""


def _values() -> str:
    quote = lambda v: str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return ",\n".join(f"({k}, " + ", ".join(map(quote, row)) + ")" for k, language in enumerate(SOURCES) for row in SHOWN[language])


@register(f"""WITH shown(k, {", ".join(_COLUMNS)}) AS (VALUES {_values()})
SELECT CAST(p_partkey AS VARCHAR) AS package_id, {_filled("name")} AS name, kind, {_filled("base")} AS base, {_filled("heirs")} AS heirs, vals, deprecated, {_filled("members")} AS members
FROM part JOIN shown ON k = p_size % 4""")
def declared_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces, enums, heirs, embedding, nested types, overloads, operators, indexers, events, records and aliases of each part's file."""
    part = t(spark, sf_dir, "part").withColumn("package_id", F.col("p_partkey").cast("string"))
    made = None
    for k, (language, source) in enumerate(SOURCES.items()):
        code = F.regexp_replace(F.regexp_replace(F.lit(source), F.lit(r"\bD\b"), F.col("p_type")), F.lit(r"\b(I|new|New|make|hidden)?T([A-Z]\w*)?\b"), F.concat(F.lit("$1T"), "package_id", F.lit("$2")))
        code = F.replace(code, F.lit("1000"), F.col("p_size").cast("string"))
        rows = part.where(F.col("p_size") % 4 == k).select("package_id", F.lit("k/a" + declarations.EXTENSIONS[language]).alias("rel_path"), code.alias("content"))
        types = api_index.types(declarations.as_index(declarations.extract_types(rows, language)))
        made = types if made is None else made.unionByName(types)
    mark = lambda m: F.concat(F.when(m["is_static"], "s").otherwise(""), F.when(m["is_async"], "a").otherwise(""), F.when(m["deprecated"], "d").otherwise(""))
    shown = lambda m: F.concat(m["name"], F.coalesce(m["sig"], F.lit("")), F.lit(" "), F.coalesce(m["ret"], F.lit("")), F.lit(" "), mark(m))
    heirs = F.array_join(F.concat("supers", "embeds"), ", ")
    return made.select("package_id", "name", "kind", F.coalesce("base", F.lit("")).alias("base"), heirs.alias("heirs"), F.array_join("values", ", ").alias("vals"), "deprecated", F.array_join(F.transform("members", shown), "; ").alias("members"))
