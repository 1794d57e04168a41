"""Sources of parts: a file for each part, 64 parts a package, whose names lead through each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.operators import packing, resolution
from apilattice.plans import facade
from apilattice.plans.bindings import t
from apilattice.registry import register
from apilattice.sources import declarations, modules

def _package() -> Column:
    return F.expr("concat('g', p_partkey div 64)")


def _names(n: int) -> Column:
    return F.concat(F.lit("C"), (F.col("p_partkey") - n).cast("string"))


def _typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File m{k}.ts: class C{k}, which refers to C{k-1} through the module and to C{k-5} by name; half of the
    files give out all of the one before, a quarter its own class under another name."""
    before = F.format_string("'./m%d%s'", F.col("p_partkey") - 1, F.when(F.col("p_size") % 3 == 0, ".js").otherwise(""))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))
    gives = F.when(F.col("p_size") % 2 == 0, line("export * from ", before, ";")).when(F.col("p_size") % 4 == 1, line("import {\n  ", _names(1), " as Own, // export * from './no'\n} from ", before, ";\nexport { Own as R", F.col("p_partkey").cast("string"), " };")).otherwise(F.lit(""))
    text = F.concat(line("import * as near from ", before, ";"), line("import { ", _names(5), " as Far } from ", before, ";"), gives, line("export class ", _names(0), " {"), line("  step(to: Far): Promise<near.", _names(1), "> { const x = { y: 1 }; return null!; }"), F.lit("}\n"))
    return t(spark, sf_dir, "part").select(_package().alias("package_id"), F.format_string("m%d.ts", "p_partkey").alias("rel_path"), text.alias("content"))


_SEEN = """seen(f, name, d) AS (SELECT p_partkey, 'C' || p_partkey, p_partkey FROM part
  UNION SELECT p.p_partkey, CASE WHEN p.p_size % 2 = 0 THEN seen.name ELSE 'R' || p.p_partkey END, seen.d FROM seen JOIN part p ON p.p_partkey = seen.f + 1 AND p.p_partkey % 64 <> 0
    WHERE p.p_size % 2 = 0 OR (p.p_size % 4 = 1 AND seen.name = 'C' || seen.f))"""
_STEPS = """steps AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1 AND a.p_partkey % 64 <> 0
  UNION SELECT p.p_partkey, seen.d FROM part p JOIN seen ON seen.f = p.p_partkey - 1 AND p.p_partkey % 64 <> 0 AND seen.name = 'C' || (p.p_partkey - 5))"""


@register(f"""WITH RECURSIVE {_SEEN}
SELECT 'g' || (f // 64) AS package_id, 'm' || f || '.ts' AS file, name, 'm' || d || '.ts' AS decl_file, 'C' || d AS decl_name FROM seen""")
def resolved_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _typescript(spark, sf_dir)
    facts = resolution.resolve(resolution.module_files(modules.names(files, "typescript"), files))
    return facts.where("space = 'e'").drop("space")


@register(f"""WITH RECURSIVE {_SEEN}, {_STEPS}
SELECT 'g' || (src // 64) AS package_id, 'm' || src || '.ts#C' || src AS src, 'm' || dst || '.ts#C' || dst AS dst FROM steps""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _typescript(spark, sf_dir)
    facts = resolution.resolve(resolution.module_files(modules.names(files, "typescript"), files))
    return resolution.resolved_edges(declarations.extract_types(files, "typescript"), facts)


@register(f"""WITH RECURSIVE {_SEEN}, {_STEPS},
reach(n, depth) AS (SELECT DISTINCT d, 0 FROM seen WHERE f % 64 = 40 UNION SELECT s.dst, r.depth + 1 FROM reach r JOIN steps s ON s.src = r.n WHERE r.depth < 64)
SELECT 'g' || (n // 64) AS package_id, 'm' || n || '.ts#C' || n AS name, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY n""")
def entry_reachable_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a package is its 41st file."""
    entries = t(spark, sf_dir, "part").where("p_partkey % 64 = 40").select(_package().alias("package_id"), F.format_string("m%d.ts", "p_partkey").alias("file"))
    return facade.entry_reachable(_typescript(spark, sf_dir), entries)


def _go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File d{k % 8}/f{k}.go: type C{k} refers to C{k-8} of its folder and, under an alias or not, to C{k-1} of the folder before."""
    folder = lambda n: F.format_string("d%d", (F.col("p_partkey") - n) % 8)
    alias = F.col("p_size") % 2 == 0
    text = F.concat(F.lit("package "), folder(0), F.lit('\n\nimport (\n\t"fmt"\n\t'), F.when(alias, F.lit("other ")).otherwise(F.lit("")), F.lit('"example.com/'), _package(), F.lit("/"), folder(1), F.lit('"\n)\n\n// '), _names(0), F.lit(" has \"quotes\".\ntype "), _names(0), F.lit(" struct {\n\tNear []*"), _names(8), F.lit(" `json:\"near\"`\n\tFar map[string]"), F.when(alias, F.lit("other")).otherwise(folder(1)), F.lit("."), _names(1), F.lit("\n\tName fmt.Stringer\n}\n"))
    return t(spark, sf_dir, "part").select(_package().alias("package_id"), F.format_string("%s/f%d.go", folder(0), "p_partkey").alias("rel_path"), text.alias("content"))


@register("""WITH n AS (SELECT a.p_partkey AS k, list_sort(list('C' || b.p_partkey)) AS refs FROM part a JOIN part b ON b.p_partkey // 64 = a.p_partkey // 64 AND (b.p_partkey = a.p_partkey - 1 OR b.p_partkey = a.p_partkey - 8) GROUP BY 1)
SELECT 'g' || (p_partkey // 64) AS package_id, 'd' || (p_partkey % 8) AS container, 'C' || p_partkey AS name, coalesce(refs, []) AS referenced_types FROM part LEFT JOIN n ON k = p_partkey""")
def go_referenced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of Go sources carries what its types refer to across files and folders."""
    paths = t(spark, sf_dir, "part").select(_package().alias("package_id"), F.concat(F.lit("example.com/"), _package()).alias("module_path")).distinct()
    index = facade.source_index(_go(spark, sf_dir), "go", module_paths=paths)
    boxes = index.select(F.col("package").alias("package_id"), F.explode("containers").alias("c"))
    types = boxes.select("package_id", F.col("c.name").alias("container"), F.explode("c.types").alias("t"))
    return types.select("package_id", "container", F.col("t.name").alias("name"), F.col("t.referenced_types").alias("referenced_types"))


@register("""WITH n AS (SELECT p_partkey AS k, p_partkey // 64 AS g, 'C' || p_partkey AS name, CAST(floor(p_retailprice) AS BIGINT) AS chars, row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY p_size, 'C' || p_partkey) AS place FROM part),
f AS (SELECT m.k, m.g, m.name, m.chars, m.place, least(m.place, coalesce(min(x.place), m.place)) AS spot FROM n m LEFT JOIN n x ON x.g = m.g AND x.k - m.k IN (3, 7, 20) GROUP BY m.k, m.g, m.name, m.chars, m.place),
u AS (SELECT *, sum(chars) OVER (PARTITION BY g ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, min(spot) OVER (PARTITION BY g) AS start FROM f)
SELECT 'g' || g AS package_id, name, CAST(row_number() OVER (PARTITION BY g ORDER BY spot, place <> spot, name) AS INTEGER) AS ord, chars FROM u WHERE upto <= 24900 OR spot = start""")
def packed_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of 64 parts a package, each with the parts 3, 7 and 20 before it."""
    parts = t(spark, sf_dir, "part")
    types = parts.select(_package().alias("package_id"), _names(0).alias("name"), F.col("p_size").alias("place"), F.floor("p_retailprice").cast("bigint").alias("chars"))
    edges = parts.select("p_partkey", F.explode(F.array(F.lit(3), F.lit(7), F.lit(20))).alias("n")).where("p_partkey % 64 >= n")
    edges = edges.select(_package().alias("package_id"), _names(0).alias("src"), F.concat(F.lit("C"), (F.col("p_partkey") - F.col("n")).cast("string")).alias("dst"))
    return packing.pack_types(types, edges, 25_000)
