"""Operators on sources, manifests, packing, updates and the facade, bound to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.functions import classify, text
from apilattice.operators import coverage, detect, diagnostics, graph, packing, tables
from apilattice.plans import facade
from apilattice.plans.bindings import _index_json, t
from apilattice.plans.more_bindings import _FILES, _files
from apilattice.registry import register
from apilattice.sources import declarations, exports, python_ast
from apilattice.sources import files as source_files
from apilattice.sources import index as api_index
from apilattice.streaming import messages

_WORD = "string_split(p_name, ' ')[1]"


def _word():
    return F.substring_index("p_name", " ", 1)


# --- files and manifests ----------------------------------------------------------------------


@register(f"""WITH {_FILES} SELECT package_id, least(count(*), 10000) AS n_files FROM files GROUP BY 1""")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.count_files(_files(spark, sf_dir))


@register(f"""WITH {_FILES} SELECT package_id, rel_path FROM files WHERE (rel_path LIKE '%.py' OR rel_path LIKE '%.toml') AND rel_path NOT LIKE 'tests/%'""")
def files_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_extension(_files(spark, sf_dir), [".PY", ".toml"], ["tests/*/*"]).select("package_id", "rel_path")


@register(f"""WITH {_FILES}, c AS (
  SELECT package_id, 3 AS rank, string_split(rel_path, '/')[1] || '/' || string_split(rel_path, '/')[2] AS root FROM files WHERE rel_path LIKE '%.py' AND rel_path NOT LIKE 'node_modules/%'
  UNION ALL SELECT package_id, 0, string_split(rel_path, '/')[1] || '/' || string_split(rel_path, '/')[2] FROM files WHERE rel_path LIKE 'src/%.py'
  UNION ALL SELECT package_id, 4, string_split(rel_path, '/')[1] FROM files WHERE rel_path LIKE '%.py' AND rel_path NOT LIKE 'node_modules/%'),
n AS (SELECT package_id, rank, root, count(*) AS n_files FROM c GROUP BY 1, 2, 3)
SELECT package_id, root AS source_root, n_files FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY n_files DESC, rank, root) AS k FROM n) WHERE k = 1""")
def conventional_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.conventional_source(_files(spark, sf_dir), "python", ".py")


@register("""SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS package_id, CASE WHEN p_size % 5 = 0 THEN 'typescript' ELSE 'javascript' END AS language FROM part WHERE p_size % 5 = 0 OR NOT (p_size % 2 = 0 AND p_size % 3 <> 0)""")
def script_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("package_id", F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")))
    places = F.array(F.lit("package.json"), F.when(F.col("p_size") % 5 == 0, "web/tsconfig.json").otherwise("dist/tsconfig.json"))
    files = part.select("package_id", F.explode(places).alias("rel_path"))
    content = F.concat(F.lit('{"name": "x"'), F.when(F.col("p_size") % 2 == 0, ', "private": true').otherwise(""), F.when(F.col("p_size") % 3 == 0, ', "exports": {"a": 1}').otherwise(""), F.lit("}"))
    return detect.script_language(files, part.select("package_id", content.alias("content")))


@register("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR (p_size % 4 = 1 AND p_size % 3 > 0) THEN 'workspace' END AS package_json, CASE WHEN p_size % 4 = 0 THEN 'solution' END AS tsconfig FROM part""")
def manifest_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("p_size") % 4, F.col("p_size") % 3
    package = F.when(k == 0, '{"workspaces": ["a"], "main": "x"}').when(k == 1, F.when(m == 0, '{"private": true, "types": "x.d.ts"}').otherwise('{"private": true}')).otherwise('{"name": "x"}')
    config = F.when(k == 0, '{"files": [], "references": [{"path": "a"}]}').when(k == 1, '{"files": [], "references": [{"path": "a"}], "include": ["src"]}').when(k == 2, '{"files": ["a.ts"], "references": [{"path": "a"}]}').otherwise('{"include": ["src"]}')
    part = t(spark, sf_dir, "part")
    bound = detect.workspace_only(part.select("p_partkey", package.alias("content"))).select("p_partkey", F.lit("workspace").alias("package_json"))
    solutions = detect.solution_only(part.select("p_partkey", config.alias("content"))).select("p_partkey", F.lit("solution").alias("tsconfig"))
    return part.select("p_partkey").join(bound, "p_partkey", "left").join(solutions, "p_partkey", "left")


@register(f"""SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS package_id, CASE WHEN p_size % 3 < 2 THEN {_WORD} WHEN p_size % 2 = 0 THEN 'src/main/java' ELSE 'java/' || {_WORD} END AS source_path, CASE WHEN p_size % 3 = 0 THEN lower(p_type) WHEN p_size % 3 = 2 THEN 'org.' || lower(p_type) END AS package_name FROM part""")
def build_file_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("p_size") % 3, F.lower("p_type")
    toml = F.concat(F.lit('[project]\nname = "'), kind, F.lit('"\n[tool.setuptools.packages.find]\nwhere = ["'), _word(), F.lit('"]\n'))
    npm = F.concat(F.lit('{"source": "./'), _word(), F.lit('/index.js"}'))
    pom = F.concat(F.lit("<project><groupId>org."), kind, F.lit("</groupId>"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("<build><sourceDirectory>java/"), _word(), F.lit("</sourceDirectory></build>"))), F.lit("</project>"))
    rows = t(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("package_id"), F.when(k == 0, "pyproject.toml").when(k == 1, "package.json").otherwise("pom.xml").alias("name"), F.when(k == 0, toml).when(k == 1, npm).otherwise(pom).alias("content"))
    return source_files.build_files(rows).drop("name")


@register(f"""WITH {_FILES}, b AS (SELECT package_id, min(CASE WHEN rel_path LIKE '%.toml' THEN 1 ELSE 2 END) AS k FROM files WHERE p_size > 45 GROUP BY 1)
SELECT package_id, CASE k WHEN 1 THEN 'python' ELSE 'java' END AS language FROM b""")
def quick_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.quick_language(_files(spark, sf_dir), max_depth=2)


@register(f"""WITH {_FILES}, l AS (SELECT DISTINCT package_id FROM files f WHERE p_size > 45 AND rel_path NOT LIKE 'tests/%' AND rel_path NOT LIKE 'samples/%' AND rel_path NOT LIKE 'node_modules/%'
  AND EXISTS (SELECT 1 FROM files g WHERE g.package_id = f.package_id AND starts_with(g.rel_path, string_split(f.rel_path, '/')[1] || '/' || string_split(f.rel_path, '/')[2] || '/') AND g.rel_path LIKE CASE WHEN f.rel_path LIKE '%.toml' THEN '%.py' ELSE '%.java' END)),
p AS (SELECT DISTINCT package_id FROM files UNION ALL SELECT 'none')
SELECT p.package_id, l.package_id IS NOT NULL AS success, CASE WHEN p.package_id = 'none' THEN 'ROOT_NOT_FOUND' WHEN l.package_id IS NULL THEN 'LANGUAGE_DETECTION_FAILED' END AS error_code, s.package_id IS NOT NULL AS has_samples
FROM p LEFT JOIN l ON l.package_id = p.package_id LEFT JOIN (SELECT DISTINCT package_id FROM files WHERE rel_path LIKE 'samples/%') s ON s.package_id = p.package_id""")
def detection_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    packages = files.select("package_id").distinct().union(spark.createDataFrame([("none",)], "package_id string"))
    return facade.detect_source(packages, files).select("package_id", "success", "error_code", F.col("samples_root").isNotNull().alias("has_samples"))


# --- names, marks and texts -------------------------------------------------------------------


@register("""SELECT p_partkey, p_size % 2 = 0 AS go, p_size % 2 = 0 AS typescript, p_size % 3 = 0 AS dotnet, p_size % 3 = 0 AS java, p_size % 3 = 1 AS python FROM part""")
def deprecation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, k = F.col("p_size") % 2 == 0, F.col("p_size") % 3
    doc = F.concat("p_name", F.when(even, F.lit("\n Deprecated: use @deprecated other")).otherwise(" Not Deprecated: in the line's midst"))
    notes = F.when(k == 0, F.array(F.lit("System.Obsolete"), F.lit("java.lang.Deprecated"))).when(k == 1, F.array(F.lit("typing_extensions.deprecated")))
    mark = lambda language: classify.is_deprecated(doc, notes, language).alias(language)
    return t(spark, sf_dir, "part").select("p_partkey", *map(mark, ("go", "typescript", "dotnet", "java", "python")))


@register(r"""SELECT item_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z_]\w*'))), ' ')) AS python, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))), ' ')) AS go FROM benchmark""")
def script_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda language: F.md5(F.array_join(F.sort_array(text.script_tokens(F.col("text"), language)), " ")).alias(language)
    return t(spark, sf_dir, "benchmark").select("item_id", joined("python"), joined("go"))


@register("""SELECT p_partkey, p_type AS name, '.' || lower(p_type) AS extension FROM part""")
def stripped_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('import("./'), "p_brand", F.lit('").'), "p_type", F.when(F.col("p_size") % 2 == 0, "<import('x').Y>").otherwise(""))
    kinds = F.create_map(*[x for k in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE", "STANDARD") for x in (F.lit(k), F.lit(text.glob_extension(f"**/*.{k.lower()}")))])
    return t(spark, sf_dir, "part").select("p_partkey", text.strip_imports(name).alias("name"), kinds[F.col("p_type")].alias("extension"))


@register("""SELECT o_orderkey, format('{:,}', o_orderkey * 7) || '/' || format('{:,}', 1000003) || ' chars (' || printf('%.1f', o_orderkey * 7 * 100.0 / 1000003) || '%)' AS summary FROM orders""")
def budget_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", text.budget_summary(F.col("o_orderkey") * 7, F.lit(1_000_003)).alias("summary"))


@register("""SELECT p_partkey, p_size % 4 IN (0, 2) AS python, p_size % 4 = 3 AS go, p_size % 4 = 1 AS stdlib FROM part""")
def builtin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    name = F.when(k == 0, F.concat(F.lit("List<"), "p_type", F.lit(">"))).when(k == 1, "os.str").when(k == 2, "MutableMapping").otherwise("rune")
    return t(spark, sf_dir, "part").select("p_partkey", text.is_builtin(name, "python").alias("python"), text.is_builtin(name, "go").alias("go"), text.is_stdlib(name, ("os", "sys")).alias("stdlib"))


@register("""WITH e AS (SELECT p_partkey, unnest([{'p': '.', 't': './' || p_type || '.d.ts', 'c': 'types'}, {'p': '.', 't': './n.js', 'c': 'node'}, {'p': '.', 't': './' || p_type || '.js', 'c': 'default'}, {'p': './x', 't': './x.js', 'c': 'default'}]) AS r FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS package_id, r.p AS export_path, r.t AS target, r.c AS condition FROM e""")
def export_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit('{"exports": {".": {"import": {"types": "./'), "p_type", F.lit('.d.ts"}, "types": {"node": "./n.js"}, "default": "./'), "p_type", F.lit('.js"}, "./x": ["./x.js"]}}'))
    made = exports.export_conditions(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("package_id"), content.alias("content")))
    return made.select("package_id", "export_path", "target", text.condition_of(F.col("conditions")).alias("condition"))


@register("""WITH a AS (SELECT p_brand AS package_id, p_type AS name, unnest([replace(p_brand, '#', '_'), 'm.' || p_type]) AS ref FROM part) SELECT DISTINCT package_id, name, ref FROM a""")
def annotation_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("Optional['List["), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("]'] | dict[str, Callable[[m."), "p_type", F.lit("], None]]"))
    return exports.annotation_edges(t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.col("p_type").alias("name"), note.alias("annotation")))


@register(f"""WITH s AS (SELECT DISTINCT p_brand AS package_id, {_WORD} AS w, p_type FROM part WHERE p_size % 2 = 0)
SELECT package_id, w AS name, '.' || lower(p_type) AS module FROM s""")
def entry_point_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's ``__init__`` exports a word from a module; modules of odd size are no ``__init__``."""
    code = F.concat(F.lit("from ."), F.lower("p_type"), F.lit(" import "), _word(), F.lit(", _hidden\nimport os\n"))
    path = F.concat(F.lit("k/"), F.when(F.col("p_size") % 2 == 0, "__init__.py").otherwise("other.py"))
    return exports.entry_symbols(t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), path.alias("rel_path"), code.alias("content")))


@register(f"""SELECT CAST(p_partkey AS VARCHAR) AS package_id, p_type AS name, p_brand || ' parts.' AS doc, CASE WHEN p_size % 2 = 0 THEN ['run', {_WORD}] ELSE ['run'] END AS members FROM part""")
def python_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("    async def "), _word(), F.lit("(self, x: int) -> str: ...\n"))).otherwise("")
    code = F.concat(F.lit("class "), "p_type", F.lit('(Base):\n    """'), "p_brand", F.lit(' parts.\n\n    More."""\n    def run(self): ...\n'), more, F.lit("    def _own(self): ...\nclass _Hidden: ...\n"))
    made = python_ast.extract_types(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("package_id"), F.lit("k/mod.py").alias("rel_path"), code.alias("content")))
    return made.select("package_id", "name", "doc", F.transform("members", lambda m: m["name"]).alias("members"))


@register("""SELECT CAST(p_partkey AS VARCHAR) AS package_id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Sub' END AS client, 'go' AS operation, 2 AS line FROM part""")
def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on variables whose type comes from a constructor or a method that returns a client."""
    kinds = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE", "STANDARD")
    code = F.concat(F.lit("c = "), "p_type", F.lit("('x')"), F.when(F.col("p_size") % 2 == 0, "").otherwise(".sub()"), F.lit("\nc.go()\n"))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("package_id"), F.lit("s.py").alias("rel_path"), code.alias("content"))
    calls, variables = python_ast.extract_calls(rows, {k: k for k in kinds} | {"sub": "Sub"})
    methods = rows.select("package_id").withColumn("client", F.explode(F.array(*map(F.lit, (*kinds, "Sub"))))).withColumn("operation", F.lit("go"))
    return coverage.covered(coverage.resolve_calls(calls, variables, methods)).select("package_id", "client", "operation", "line")


@register(f"""WITH w AS (SELECT *, {_WORD} AS w, upper(left({_WORD}, 1)) || substr({_WORD}, 2) AS up FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS package_id, p_type AS name, CASE p_size % 4 WHEN 2 THEN 'struct' ELSE 'class' END AS kind, p_brand || ' parts.' AS doc,
  CASE p_size % 4 WHEN 0 THEN [w || '(String q, int n) List<' || p_type || '>', 'size(null) int'] WHEN 1 THEN ['Name(null) string', up || '(string q, int n = 1) Task<' || p_type || '>'] WHEN 2 THEN ['Size(null) int', up || '(q string, n int) ([]' || p_type || ', error)'] ELSE ['size(null) number', w || '(q: string, n?: number) Promise<' || p_type || '[]>'] END AS members FROM w""")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file of each part, in Java, C#, Go or TypeScript, read back."""
    t_, w, up, b = F.col("p_type"), _word(), F.concat(F.upper(F.left(_word(), F.lit(1))), F.substr(_word(), F.lit(2))), F.col("p_brand")
    lit = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    java = lit("package k;\n/** ", b, " parts. */\npublic class ", t_, " {\n  private int hidden = '{';\n  public List<", t_, "> ", w, "(String q, int n) { if (n > 0) { return null; } return null; }\n  public int size;\n}\n")
    sharp = lit("namespace K\n{\n  /// <summary>", b, ' parts.</summary>\n  public class ', t_, "\n  {\n    public string Name { get; set; }\n    internal void Hidden() { }\n    public async Task<", t_, "> ", up, '(string q, int n = 1) { return Find("}"); }\n  }\n}\n')
    go = lit("package k\n\n// ", b, " parts.\ntype ", t_, " struct {\n\tSize int // not { told\n\thidden string\n}\n\nfunc (t *", t_, ") ", up, "(q string, n int) ([]", t_, ", error) {\n\treturn nil, nil\n}\n")
    script = lit("/** ", b, " parts. */\nexport class ", t_, " {\n  private hidden = `}`;\n  size: number;\n  async ", w, "(q: string, n?: number): Promise<", t_, "[]> { return [] }\n}\n")
    part = t(spark, sf_dir, "part").withColumn("package_id", F.col("p_partkey").cast("string"))
    made = None
    for k, (language, code) in enumerate((("java", java), ("dotnet", sharp), ("go", go), ("typescript", script))):
        rows = part.where(F.col("p_size") % 4 == k).select("package_id", F.lit("k/a" + declarations.EXTENSIONS[language]).alias("rel_path"), code.alias("content"))
        types = api_index.types(declarations.as_index(declarations.extract_types(rows, language)))
        made = types if made is None else made.unionByName(types)
    shown = lambda m: F.concat(m["name"], F.coalesce(m["sig"], F.lit("(null)")), F.lit(" "), m["ret"])
    return made.select("package_id", "name", "kind", "doc", F.transform("members", shown).alias("members"))


_STUB = """SELECT p_brand AS package_id, md5({head} || {body}) AS stub_md5 FROM (SELECT p_brand, p_size, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS n FROM part)"""
_KEY = "CASE WHEN p_size % 7 = 0 THEN '{}ValueError' ELSE '' END"


def _stub(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return api_index.stubs(api_index.parse_indexes(_index_json(spark, sf_dir)), language).select("package_id", F.md5("stub").alias("stub_md5"))


@register(_STUB.format(head="'public class ' || n || " + _KEY.format(" extends ") + " || ' {' || chr(10)", body="CASE p_size % 3 WHEN 0 THEN '    public string run();' || chr(10) WHEN 1 THEN '    public string size;' || chr(10) ELSE '' END || '}' || chr(10)"))
def java_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stub(spark, sf_dir, "java")


@register(_STUB.format(head="'public class ' || n || " + _KEY.format(" : ") + " || ' {' || chr(10)", body="CASE p_size % 3 WHEN 0 THEN '    public string run();' || chr(10) WHEN 1 THEN '    public string size { get; }' || chr(10) ELSE '' END || '}' || chr(10)"))
def dotnet_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stub(spark, sf_dir, "dotnet")


@register(_STUB.format(head="'export class ' || n || " + _KEY.format(" extends ") + " || ' {' || chr(10)", body="CASE p_size % 3 WHEN 0 THEN '    run(): string;' || chr(10) WHEN 1 THEN '    size: string;' || chr(10) ELSE '' END || '}' || chr(10)"))
def typescript_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stub(spark, sf_dir, "typescript")


@register(_STUB.format(head="'type ' || n || ' struct {' || chr(10)", body="CASE p_size % 3 WHEN 0 THEN '}' || chr(10) || 'func (' || n || ') run() string' || chr(10) WHEN 1 THEN '    size string' || chr(10) || '}' || chr(10) ELSE '}' || chr(10) END"))
def go_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stub(spark, sf_dir, "go")


# --- packing and coverage ---------------------------------------------------------------------


@register("""WITH f AS (SELECT doc_id, lang, length(text) AS size, least(length(text), 50000) AS share FROM documents WHERE length(text) > 0),
w AS (SELECT *, 512000 - coalesce(sum(share + 50) OVER (PARTITION BY lang ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM f),
p AS (SELECT least(share, rest - 50) AS chars FROM w WHERE rest > 50)
SELECT CAST(count(*) AS BIGINT) AS included, CAST((SELECT count(*) FROM documents) - count(*) AS BIGINT) AS omitted, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(chars // 4) AS BIGINT) AS est_tokens FROM p""")
def plan_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("size"))
    return packing.plan_totals(packing.load_plan(docs, [F.col("size").desc(), "doc_id"], by=["lang"], parts=64), docs).select(*[F.col(c).cast("bigint").alias(c) for c in ("included", "omitted", "chars", "est_tokens")])


@register("""WITH f AS (SELECT conv_id, turn, text, length(text) AS size, least(length(text), 300) AS share FROM conversations WHERE length(text) > 0),
w AS (SELECT *, 1000 - coalesce(sum(share + 50) OVER o, 0) AS rest, row_number() OVER (PARTITION BY conv_id ORDER BY size, turn) AS ord FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY size, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CAST(least(share, rest - 50) AS BIGINT) AS chars FROM w WHERE rest > 50),
x AS (SELECT conv_id, string_agg('<file path="' || CAST(turn AS VARCHAR) || '" size="' || CAST(size AS VARCHAR) || '" tokens="~' || CAST(chars // 4 AS VARCHAR) || '">' || chr(10) || left(text, chars) || CASE WHEN chars < size THEN chr(10) || '// ... truncated ...' ELSE '' END || chr(10) || '</file>' || chr(10) || chr(10), '' ORDER BY ord) AS body, count(*) AS n FROM p GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, md5('<turns>' || chr(10) || body || CASE WHEN a.n > x.n THEN '<!-- ' || CAST(a.n - x.n AS VARCHAR) || ' additional files omitted due to budget -->' || chr(10) ELSE '' END || '</turns>' || chr(10) || chr(10)) AS rendered_md5 FROM x JOIN a USING (conv_id)""")
def rendered_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as files, the shortest first."""
    turns = t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("rel_path"), "turn", F.col("text").alias("content"), F.length("text").cast("bigint").alias("size"))
    files = turns.drop("content")
    plan = packing.load_plan(files, ["size", "turn"], budget=1000, limit=300, by=["conv_id"])
    made = packing.render_plan(plan, turns.select("conv_id", "rel_path", "content"), files, by=["conv_id"], section="turns")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return made.groupBy("conv_id").agg(F.md5(whole).alias("rendered_md5"))


@register("""WITH c AS (SELECT s_nationkey AS n, s_suppkey AS k, 100 + s_suppkey % 50 AS chars, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS place FROM supplier),
w AS (SELECT *, sum(chars) OVER (PARTITION BY n ORDER BY place) AS used FROM c)
SELECT CAST(n AS VARCHAR) AS package_id, CAST(k AS VARCHAR) AS name, CAST(place AS INTEGER) AS ord, CAST(chars AS BIGINT) AS chars FROM w WHERE used <= 400 OR place = 1""")
def packed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without references packing is a prefix; with them it is compared with a plain loop in the tests."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey"))
    types = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("package_id"), F.col("s_suppkey").cast("string").alias("name"), place.alias("place"), (100 + F.col("s_suppkey") % 50).alias("chars"))
    none = types.select("package_id", F.col("name").alias("src"), F.col("name").alias("dst")).limit(0)
    return packing.pack_types(types, none, 500)


@register("""WITH o AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part WHERE p_size > 48)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN o.t IS NULL THEN 1 ELSE 0 END, p_size % 4, p_partkey) AS INTEGER) AS place FROM part LEFT JOIN o ON o.b = p_brand AND o.t = p_type""")
def coverage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("package_id", F.col("p_brand"))
    types = part.select("package_id", F.col("p_type").alias("name"), (F.col("p_size") % 4).alias("priority"), F.col("p_partkey").alias("type_ord"))
    open_ = part.where("p_size > 48").select("package_id", F.col("p_type").alias("client"))
    return coverage.coverage_order(types, open_).select(F.col("type_ord").alias("p_partkey"), "place")


@register("""WITH m AS (SELECT p_partkey, p_brand AS b, p_type AS owner, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'property' ELSE 'method' END AS kind FROM part), o AS (SELECT DISTINCT p_brand AS b, p_type AS owner, p_name AS name FROM part WHERE p_size > 45)
SELECT p_partkey FROM m WHERE EXISTS (SELECT 1 FROM o WHERE o.b = m.b AND o.owner = m.owner) AND (kind = 'property' OR EXISTS (SELECT 1 FROM o WHERE o.b = m.b AND o.owner = m.owner AND o.name = m.name))""")
def open_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("package_id", F.col("p_brand"))
    members = part.select("package_id", F.col("p_type").alias("owner"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "property").otherwise("method").alias("kind"), "p_partkey")
    open_ = part.where("p_size > 45").select("package_id", F.col("p_type").alias("client"), F.col("p_name").alias("operation"))
    return coverage.uncovered_surface(members, open_).select("p_partkey")


@register("""SELECT p_brand AS package_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS client, 'run' AS operation FROM part WHERE p_size % 3 = 0 AND p_size > 10""")
def client_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = api_index.types(api_index.parse_indexes(_index_json(spark, sf_dir)))
    reached = t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_brand").alias("package_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    return coverage.client_methods(types, reached)


@register("""SELECT p_partkey, p_type AS client FROM part WHERE p_type IN ('ECONOMY', 'SMALL')""")
def client_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("package_id", F.col("p_brand"))
    members = part.select("package_id", F.lit("C").alias("owner"), F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("Awaitable["), "p_type", F.lit("]")).alias("ret"))
    clients = part.select("package_id").distinct().withColumn("client", F.explode(F.array(F.lit("ECONOMY"), F.lit("SMALL"))))
    return coverage.return_clients(members, clients, text.unwrap_async(F.col("ret"), "python")).select(F.col("name").cast("bigint").alias("p_partkey"), "client")


# --- graphs, facade, updates -------------------------------------------------------------------


@register("""WITH e AS (SELECT p_brand AS package_id, p_name AS dst, unnest([p_type, p_name]) AS src FROM part) SELECT DISTINCT package_id, src, dst FROM e WHERE src <> dst""")
def extra_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.col("p_name").alias("name"), F.array("p_type", "p_name").alias("supers"))
    return graph.implementer_edges(rows).select("package_id", "src", "dst")


@register("""WITH RECURSIVE d AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS name, CAST(s_nationkey AS VARCHAR) AS dep, ['S' || CAST(s_suppkey // 2 AS VARCHAR), 'S' || CAST(s_suppkey // 3 AS VARCHAR)] AS refs FROM supplier),
a AS (SELECT 'A' || substr(name, 2) AS name, dep, [name] AS refs FROM d),
k AS (SELECT * FROM (SELECT * FROM d UNION ALL SELECT * FROM a) WHERE name NOT LIKE '%5'),
r(name) AS (SELECT 'A' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 IN (5, 7) UNION SELECT x.ref FROM r JOIN (SELECT name, unnest(refs) AS ref FROM k) x ON x.name = r.name)
SELECT DISTINCT k.name, k.dep AS dep_package FROM r JOIN k ON k.name = r.name""")
def dependency_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names renamed on import need what the first name needs; names that end in 5 are built in."""
    s = t(spark, sf_dir, "supplier")
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    key = F.col("s_suppkey")
    definitions = s.select(named("S", key).alias("name"), F.col("s_nationkey").cast("string").alias("dep_package"), F.array(named("S", F.floor(key / 2)), named("S", F.floor(key / 3))).alias("refs"))
    aliases = s.select(named("A", key).alias("alias"), named("S", key).alias("name"))
    builtins = s.where("s_suppkey % 10 = 5").select(F.explode(F.array(named("S", key), named("A", key))).alias("name"))
    return graph.dependency_closure(s.where("s_suppkey % 10 in (5, 7)").select(named("A", key).alias("name")), definitions, builtins, aliases)


@register("""SELECT p_brand AS package_id, 'Option ''java'' does not apply to ' || p_type || '; it is ignored.' AS text, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2""")
def unmatched_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("java").alias("language"), F.lit("java").alias("option"))
    return diagnostics.unmatched_options(rows).groupBy("package_id", "text").agg(F.count("*").alias("n"))


@register("""SELECT p_brand AS package_id, CASE WHEN p_size > 25 AND p_size % 3 = 0 THEN 0 WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 ELSE 3 END AS priority, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS undocumented FROM part GROUP BY 1, 2""")
def graph_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facade's types and diagnostics; no type of this index has documentation."""
    types, notes = facade.api_graph(api_index.parse_indexes(_index_json(spark, sf_dir)), "python")
    open_ = notes.where("id = 'SDK001'").select("package_id", F.col("target_type").alias("type_id"))
    return types.join(open_, ["package_id", "type_id"], "left_semi").groupBy("package_id", "priority").agg(F.count("*").alias("n"), F.count("*").alias("undocumented"))


@register("""WITH s AS (SELECT p_brand AS package_id, CAST(count(*) FILTER (WHERE p_size % 3 = 0) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE p_size % 3 = 0 AND p_partkey % 2 = 0) AS BIGINT) AS covered FROM part GROUP BY 1)
SELECT package_id, total, covered, total - covered AS uncovered FROM s WHERE total > 0""")
def coverage_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facade's coverage of the index by calls on every other part's type."""
    part = t(spark, sf_dir, "part").where("p_partkey % 2 = 0").withColumn("package_id", F.col("p_brand"))
    client = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    calls = part.select("package_id", F.lit("s.py").alias("file"), F.col("p_partkey").alias("line"), F.lit(0).alias("call_ord"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("receiver"), F.lit("run").alias("operation"))
    variables = part.select("package_id", F.lit("s.py").alias("file"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"), client.alias("client"))
    return facade.coverage(api_index.parse_indexes(_index_json(spark, sf_dir)), calls, variables, "java").select("package_id", "total", "covered", "uncovered")


@register("""SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'LANGUAGE_DETECTION_FAILED' ELSE 'NO_SAMPLES_FOUND' END AS error_code, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 2 = 0 GROUP BY 1""")
def coverage_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "nation").select(F.col("n_name").alias("package_id"), F.when(F.col("n_nationkey") % 2 == 1, "samples").alias("samples_root"), F.when(F.col("n_nationkey") % 5 > 0, "go").alias("language"))
    return facade.coverage_errors(rows).groupBy("error_code").agg(F.count("*").alias("n"))


@register("""SELECT p_brand AS package_id, CAST(count(*) AS BIGINT) AS n_types, CAST(0 AS BIGINT) AS n_functions, true AS has_surface FROM part GROUP BY 1""")
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_index.surface_sizes(api_index.parse_indexes(_index_json(spark, sf_dir)))


@register("""SELECT conv_id, turn, 's' || CAST(conv_id AS VARCHAR) AS session_id, CASE role WHEN 'user' THEN 'user_message_chunk' WHEN 'assistant' THEN 'agent_message_chunk' ELSE 'plan' END AS update, CASE WHEN role IN ('user', 'assistant') THEN text END AS text, CASE WHEN role IN ('user', 'assistant') THEN NULL ELSE 2 END AS n_entries FROM conversations""")
def session_update_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as update messages, written as lines, read and unpacked again."""
    kind = F.when(F.col("role") == "user", "user_message_chunk").when(F.col("role") == "assistant", "agent_message_chunk").otherwise("plan")
    plan = F.when(~F.col("role").isin("user", "assistant"), F.array(F.struct(F.lit("a").alias("content")), F.struct(F.lit("b").alias("content"))))
    update = F.struct(kind.alias("sessionUpdate"), F.when(F.col("role").isin("user", "assistant"), F.struct(F.lit("text").alias("type"), "text")).alias("content"), plan.alias("entries"), "conv_id", "turn")
    rows = t(spark, sf_dir, "conversations").select(F.lit("2.0").alias("jsonrpc"), F.lit("session/update").alias("method"), F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), update.alias("update")).alias("params"))
    made = messages.session_updates(messages.parse(messages.to_lines(rows)))
    at = lambda c: F.get_json_object("params", f"$.update.{c}").cast("bigint").alias(c)
    return made.select(at("conv_id"), at("turn"), "session_id", "update", "text", "n_entries")


@register("""SELECT p_brand AS package_id, p_type AS client, p_name AS operation, CAST(min(p_partkey) AS BIGINT) AS line FROM part WHERE p_size < 30 GROUP BY 1, 2, 3""")
def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_brand").alias("package_id"), F.col("p_type").alias("client"), F.col("p_name").alias("operation"), F.col("p_partkey").alias("line"))
    return tables.first_of_each(rows, ["package_id", "client", "operation"], ["line"])


@register("""WITH x AS (SELECT p_brand AS package_id, p_name AS name, CASE WHEN p_size < 10 THEN '.' ELSE './' || CAST(p_size % 5 AS VARCHAR) END AS export_path, CASE p_size % 4 WHEN 0 THEN 'types' WHEN 1 THEN 'node' WHEN 2 THEN 'default' ELSE 'zz' END AS condition, p_size, p_type FROM part),
e AS (SELECT *, export_path || '/' || condition AS entry_file FROM x),
r AS (SELECT *, CASE p_size % 3 WHEN 0 THEN entry_file WHEN 1 THEN CASE WHEN p_type = 'SMALL' THEN './1/node' ELSE 'lib/a' END END AS declared_in FROM e),
f AS (SELECT r.*, CASE WHEN declared_in IS NULL OR declared_in = entry_file THEN 0 WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.package_id = r.package_id AND e.entry_file = r.declared_in) THEN 1 END AS phase FROM r)
SELECT package_id, name, export_path, condition FROM (SELECT *, row_number() OVER (PARTITION BY package_id, name ORDER BY phase, CASE export_path WHEN '.' THEN '' ELSE export_path END, CASE condition WHEN 'default' THEN 0 WHEN 'types' THEN 1 WHEN 'node' THEN 4 ELSE 100 END, condition, entry_file) AS k FROM f WHERE phase IS NOT NULL) WHERE k = 1""")
def declaration_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") < 10, ".").otherwise(F.concat(F.lit("./"), (F.col("p_size") % 5).cast("string"))).alias("export_path"), F.when(k == 0, "types").when(k == 1, "node").when(k == 2, "default").otherwise("zz").alias("condition"), "p_size", "p_type")
    rows = rows.withColumn("entry_file", F.concat_ws("/", "export_path", "condition"))
    site = F.when(F.col("p_size") % 3 == 0, F.col("entry_file")).when(F.col("p_size") % 3 == 1, F.when(F.col("p_type") == "SMALL", "./1/node").otherwise("lib/a"))
    return tables.owner_by_declaration(rows.withColumn("declared_in", site), text.condition_rank(F.col("condition"))).select("package_id", "name", "export_path", "condition")


@register("""WITH r AS (SELECT DISTINCT p_brand AS package_id, p_type AS dep, 'x.' || p_name AS type_name FROM part),
k AS (SELECT 'x.' || p_name AS type_name, bool_or(p_size % 2 = 0) AS i FROM part WHERE p_size > 47 GROUP BY 1), h AS (SELECT p_brand AS package_id, 'x.' || p_name AS type_name, bool_or(p_size % 3 = 0) AS i FROM part WHERE p_size < 20 GROUP BY 1, 2),
f AS (SELECT r.*, coalesce(k.i, h.i) AS i, substr(r.type_name, 3) AS base FROM r LEFT JOIN k ON k.type_name = r.type_name LEFT JOIN h ON h.package_id = r.package_id AND h.type_name = r.type_name)
SELECT package_id, dep AS dep_package, dep = 'ECONOMY' AS is_stdlib, coalesce(list_sort(list(DISTINCT base) FILTER (WHERE NOT i)), []) AS classes, coalesce(list_sort(list(DISTINCT base) FILTER (WHERE i)), []) AS interfaces, coalesce(list_sort(list(DISTINCT base) FILTER (WHERE i IS NULL)), []) AS types FROM f GROUP BY 1, 2, 3""")
def dependency_type_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("type_name", F.concat(F.lit("x."), "p_name")).withColumn("package_id", F.col("p_brand"))
    known = part.where("p_size > 47").select("type_name", F.when(F.col("p_size") % 2 == 0, "interface").otherwise("class").alias("kind"))
    heads = part.where("p_size < 20").select("package_id", "type_name", F.when(F.col("p_size") % 3 == 0, "interface").otherwise("superclass").alias("role"))
    references = part.select("package_id", F.col("p_type").alias("dep_package"), "type_name")
    return tables.dependency_kinds(references, known, heads, spark.createDataFrame([("ECONOMY",)], "dep_package string"))
