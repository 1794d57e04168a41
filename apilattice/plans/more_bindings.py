"""More operators bound to whole tables: predicates, functions, resolution, reports, detection, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.functions import classify, text
from apilattice.operators import coverage, detect, diagnostics, graph, packing, tables
from apilattice.plans.bindings import _index_json, t
from apilattice.registry import register
from apilattice.sources import files as source_files
from apilattice.sources import index as api_index
from apilattice.streaming import exchanges, messages, objects

# --- predicates and functions ---------------------------------------------------------------


@register("""SELECT p_brand AS package_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, p_size > 25 AND p_size % 3 = 0 AS is_client, p_size % 3 = 1 AS is_model, p_size % 7 = 0 AS is_error, true AS is_root FROM part""")
def type_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = api_index.types(api_index.parse_indexes(_index_json(spark, sf_dir)))
    return types.select("package_id", "name", classify.is_client().alias("is_client"), classify.is_model("python").alias("is_model"), classify.is_error("python").alias("is_error"), classify.is_root_candidate("python").alias("is_root"))


@register("""WITH n AS (SELECT p_partkey, p_type || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.' || string_split(p_name, ' ')[1] WHEN 2 THEN '.' || string_split(p_name, ' ')[1] || '.x' ELSE '.Deep.' || p_brand END AS ns FROM part)
SELECT p_partkey, ns AS namespace, CASE WHEN ns = 'ECONOMY' THEN true WHEN starts_with(ns, 'ECONOMY.') THEN ns NOT LIKE '%.%.%' WHEN ns = 'SMALL.Deep' THEN true WHEN starts_with(ns, 'SMALL.Deep.') THEN ns NOT LIKE '%.%.%.%' WHEN ns = 'SMALL' THEN true WHEN starts_with(ns, 'SMALL.') THEN ns NOT LIKE '%.%.%' ELSE false END AS is_entry FROM n""")
def entry_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of other case, one below another: the first that fits decides."""
    k, word = F.col("p_size") % 4, F.concat(F.lit("."), F.substring_index("p_name", " ", 1))
    ns = F.concat("p_type", F.when(k == 0, "").when(k == 1, word).when(k == 2, F.concat(word, F.lit(".x"))).otherwise(F.concat(F.lit(".Deep."), "p_brand")))
    roots = F.array(*map(F.lit, ("economy", "Economy.Deep", "small.DEEP", "Small")))
    return t(spark, sf_dir, "part").select("p_partkey", ns.alias("namespace"), classify.in_entry_namespace(ns, roots).alias("is_entry"))


@register(r"""SELECT p_partkey, p_size % 5 IN (0, 1) AS py, regexp_matches(n, '^\p{Lu}') AS go FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN '__init__' WHEN 2 THEN '_x' WHEN 3 THEN '__x' ELSE '_' || p_type END AS n FROM part)""")
def public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    name = F.when(k == 0, F.col("p_name")).when(k == 1, "__init__").when(k == 2, "_x").when(k == 3, "__x").otherwise(F.concat(F.lit("_"), "p_type"))
    rows = t(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return rows.select("p_partkey", classify.is_public(F.col("n"), F.lit(None).cast("array<string>"), "python").alias("py"), classify.is_public(F.col("n"), F.lit(None).cast("array<string>"), "go").alias("go"))


@register("""SELECT p_partkey, p_type AS java, p_brand AS python, CASE WHEN p_size < 10 THEN p_type || '|' || p_brand ELSE p_type END AS typescript, p_type AS go FROM part""")
def unwrapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrap = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    ts = F.when(F.col("p_size") < 10, F.concat("p_type", F.lit("|"), "p_brand")).otherwise(wrap("Promise<", F.col("p_type"), ">"))
    return t(spark, sf_dir, "part").select("p_partkey", text.unwrap_async(wrap("Flow.Publisher<", F.col("p_type"), ">"), "java").alias("java"), text.unwrap_async(wrap("Coroutine[Any, None, ", F.col("p_brand"), "]"), "python").alias("python"), text.unwrap_async(ts, "typescript").alias("typescript"), text.unwrap_async(wrap("(*", F.col("p_type"), ", error)"), "go").alias("go"))


@register(r"""WITH l AS (SELECT item_id, string_split(text, chr(10))[1] AS x FROM benchmark)
SELECT item_id, CASE WHEN length(x) > 150 THEN left(x, 150) || '...' ELSE x END AS python, CASE WHEN length(x) > 120 THEN left(x, 117) || '...' ELSE x END AS go, length(text) // 4 AS est_tokens, left(sha256(text), 16) AS hash FROM l JOIN benchmark USING (item_id)""")
def doc_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "benchmark")
    return rows.select("item_id", text.summary_line(F.col("text"), "python").alias("python"), text.summary_line(F.col("text"), "go").alias("go"), text.token_estimate(F.col("text")).cast("bigint").alias("est_tokens"), text.short_hash(F.col("text")).alias("hash"))


@register("""SELECT p_partkey, lower(p_type) || '/' || replace(p_name, ' ', '_') || '.py' AS path, 'x|' || p_brand || '||' AS key, CASE WHEN p_size % 2 = 0 THEN 'dotnet' ELSE 'unknown' END AS language FROM part""")
def path_and_key_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("../"), F.lower("p_type"), F.lit("\\"), "p_name", F.when(F.col("p_size") < 20, F.lit(".txt")).otherwise(F.lit("")))
    alias = F.when(F.col("p_size") % 2 == 0, " C# ").otherwise(F.col("p_type"))
    none = F.lit(None).cast("string")
    return t(spark, sf_dir, "part").select("p_partkey", text.sanitize_path(path, ".py").alias("path"), text.diagnostic_key(F.lit("x"), F.col("p_brand"), none, none).alias("key"), text.language_of(alias).alias("language"))


_FILES = """files AS (SELECT p_brand AS package_id, CASE p_type WHEN 'ECONOMY' THEN 'src' WHEN 'SMALL' THEN 'tests' WHEN 'MEDIUM' THEN 'node_modules' WHEN 'PROMO' THEN 'samples' WHEN 'LARGE' THEN 'sdk' ELSE 'tools' END || '/' || string_split(p_name, ' ')[1] || '/' ||
  CASE WHEN p_size > 47 THEN 'pyproject.toml' WHEN p_size > 45 THEN 'pom.xml' ELSE 'f' || CAST(p_partkey AS VARCHAR) || CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.txt' END END AS rel_path, p_partkey, p_size FROM part)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each part: its kind is a folder, its first word another."""
    top = F.create_map(*[F.lit(x) for pair in (("ECONOMY", "src"), ("SMALL", "tests"), ("MEDIUM", "node_modules"), ("PROMO", "samples"), ("LARGE", "sdk"), ("STANDARD", "tools")) for x in pair])[F.col("p_type")]
    k = F.col("p_size") % 3
    name = F.when(F.col("p_size") > 47, "pyproject.toml").when(F.col("p_size") > 45, "pom.xml").otherwise(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(k == 0, ".py").when(k == 1, ".java").otherwise(".txt")))
    path = F.concat_ws("/", top, F.substring_index("p_name", " ", 1), name)
    return t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), path.alias("rel_path"), F.concat(F.lit("."), F.substring_index(name, ".", -1)).alias("ext"), F.col("p_size").cast("bigint").alias("size"), "p_partkey")


@register(f"""WITH {_FILES} SELECT package_id, rel_path, CASE WHEN rel_path LIKE '%/pyproject.toml' THEN 10 ELSE 10 END AS priority FROM files WHERE rel_path NOT LIKE 'node_modules/%'""")
def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scannable(_files(spark, sf_dir), max_files=None).select("package_id", "rel_path", text.file_priority(F.col("rel_path")).alias("priority"))


@register(f"""WITH {_FILES}, b AS (SELECT package_id, rel_path, string_split(rel_path, '/')[1] || '/' || string_split(rel_path, '/')[2] AS root, CASE WHEN rel_path LIKE '%.toml' THEN 'python' ELSE 'java' END AS language FROM files WHERE p_size > 45 AND NOT rel_path LIKE 'tests/%' AND NOT rel_path LIKE 'samples/%'),
c AS (SELECT b.package_id, b.root, b.language, b.rel_path, count(*) AS n FROM b JOIN files f ON f.package_id = b.package_id AND starts_with(f.rel_path, b.root || '/') AND f.rel_path LIKE CASE b.language WHEN 'python' THEN '%.py' ELSE '%.java' END GROUP BY ALL),
d AS (SELECT package_id, root, language, min(rel_path) AS rel_path, CAST(max(n) / count(*) AS BIGINT) AS n FROM (SELECT package_id, root, language, rel_path, n FROM c) GROUP BY 1, 2, 3),
e AS (SELECT b.package_id, b.root, b.language, count(DISTINCT f.p_partkey) AS n_files FROM (SELECT DISTINCT package_id, root, language FROM b) b JOIN files f ON f.package_id = b.package_id AND starts_with(f.rel_path, b.root || '/') AND f.rel_path LIKE CASE b.language WHEN 'python' THEN '%.py' ELSE '%.java' END GROUP BY 1, 2, 3)
SELECT package_id, language, root AS source_root, CAST(n_files AS BIGINT) AS n_files FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY n_files DESC, CASE language WHEN 'python' THEN 1 ELSE 2 END, root) AS k FROM e) WHERE k = 1""")
def source_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.source_folder(_files(spark, sf_dir))


@register(f"""WITH {_FILES} SELECT DISTINCT package_id, 'samples' AS samples_root FROM files WHERE rel_path LIKE 'samples/%'""")
def samples_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.samples_folder(_files(spark, sf_dir))


@register(f"""WITH {_FILES}, r AS (SELECT *, CASE WHEN rel_path LIKE 'sdk/%' THEN 0 WHEN rel_path LIKE 'src/%' THEN 1 ELSE 2 END AS rank FROM files),
b AS (SELECT *, min(rank) OVER (PARTITION BY package_id) AS best FROM r)
SELECT DISTINCT package_id, string_split(rel_path, '/')[1] || '/' || string_split(rel_path, '/')[2] AS package_dir FROM b WHERE rank = best AND p_size > 45 AND rel_path NOT LIKE 'tests/%' AND rel_path NOT LIKE 'samples/%'""")
def monorepo_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.monorepo_packages(_files(spark, sf_dir))


@register("""WITH s AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS dir, html FROM pages),
c AS (SELECT dir, count(*) AS n_files, count(*) FILTER (WHERE len(list_filter(list_slice(string_split(html, chr(10)), 1, 50), lambda l: regexp_matches(l, '(?i)"(?:[.]{1,2}/)*fr["/]'))) > 0) AS n_imports FROM s GROUP BY 1)
SELECT dir, CAST(n_files AS BIGINT) AS n_files, CAST(n_imports AS BIGINT) AS n_imports FROM c ORDER BY n_imports DESC, n_files DESC, dir LIMIT 1""")
def samples_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").select(F.lit("p").alias("package_id"), F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.col("page_id").cast("string")).alias("rel_path"), F.col("html").alias("content"))
    return detect.rank_samples(detect.import_scan(rows, "fr", "go", max_files=1 << 30)).select("dir", "n_files", "n_imports")


# --- joins and aggregates --------------------------------------------------------------------

_CALLS = """calls AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'v' || CAST(user_id AS VARCHAR) WHEN user_id % 3 = 1 THEN 'C' || CAST(user_id % 7 AS VARCHAR) ELSE 'x' END AS receiver, event_type AS operation, user_id FROM events),
methods AS (SELECT 'C' || CAST(user_id % 7 AS VARCHAR) AS client, event_type AS operation FROM events WHERE event_type <> 'error' OR user_id % 7 = 2 GROUP BY 1, 2)"""


@register(f"""WITH {_CALLS}, r AS (SELECT event_id, operation, CASE WHEN user_id % 3 = 0 THEN 'C' || CAST(user_id % 7 AS VARCHAR) WHEN user_id % 3 = 1 THEN receiver END AS client FROM calls),
sure AS (SELECT event_id, r.operation, r.client FROM r JOIN methods m ON m.client = r.client AND m.operation = r.operation),
heirs AS (SELECT m.operation, m.client FROM methods m JOIN methods b ON b.operation = m.operation AND b.client = 'C' || CAST(CAST(substr(m.client, 2) AS INTEGER) - 1 AS VARCHAR)),
one AS (SELECT m.operation, min(m.client) AS client FROM methods m WHERE NOT EXISTS (SELECT 1 FROM heirs h WHERE h.operation = m.operation AND h.client = m.client) GROUP BY 1 HAVING count(*) = 1)
SELECT event_id, operation, client FROM sure UNION ALL SELECT r.event_id, r.operation, one.client FROM r JOIN one ON one.operation = r.operation WHERE r.event_id NOT IN (SELECT event_id FROM sure)""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events")
    user, client = F.col("user_id").cast("string"), F.concat(F.lit("C"), (F.col("user_id") % 7).cast("string"))
    receiver = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("v"), user)).when(F.col("user_id") % 3 == 1, client).otherwise("x")
    calls = events.select(F.lit("p").alias("package_id"), F.lit("f").alias("file"), F.lit(0).alias("line"), F.col("event_id").alias("call_ord"), receiver.alias("receiver"), F.col("event_type").alias("operation"))
    variables = events.where("user_id % 3 = 0").select(F.lit("p").alias("package_id"), F.lit("f").alias("file"), F.concat(F.lit("v"), user).alias("name"), client.alias("client")).distinct()
    methods = events.where("event_type <> 'error' or user_id % 7 = 2").select(F.lit("p").alias("package_id"), client.alias("client"), F.col("event_type").alias("operation")).distinct()
    number = F.substring("client", 2, 1).cast("int")
    bases = methods.select("package_id", "client", F.concat(F.lit("C"), (number - 1).cast("string")).alias("base")).distinct()
    return coverage.resolve_calls(calls, variables, methods, bases).select(F.col("call_ord").alias("event_id"), "operation", "client")


@register("""WITH o AS (SELECT DISTINCT c_mktsegment AS client, c_nationkey AS operation FROM customer), s AS (SELECT s_nationkey AS operation, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT client, CAST(o.operation AS VARCHAR) AS operation, coalesce('sig ' || CAST(k AS VARCHAR), CAST(o.operation AS VARCHAR) || '(...)') AS sig FROM o LEFT JOIN s ON s.operation = o.operation AND client <> 'BUILDING'""")
def signature_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = lambda c: F.col(c).cast("string").alias("operation")
    open_ = t(spark, sf_dir, "customer").select(F.lit("p").alias("package_id"), F.col("c_mktsegment").alias("client"), op("c_nationkey")).distinct()
    clients = F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"))))
    known = t(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(op("s_nationkey"), F.col("s_suppkey").alias("member_ord"), F.concat(F.lit("sig "), F.col("s_suppkey").cast("string")).alias("sig"))
    sigs = known.select(F.lit("p").alias("package_id"), "*", clients.alias("client"))
    return coverage.with_signatures(open_, sigs).select("client", "operation", "sig")


@register("""WITH n AS (SELECT DISTINCT p_brand AS package_id, p_name AS type_name FROM part), i AS (SELECT p_brand AS package_id, p_name AS type_name, min(p_type) AS dep FROM part WHERE p_size < 25 GROUP BY 1, 2),
s AS (SELECT p_name AS type_name, min_by(p_brand, p_size * 1000 + CAST(string_split(p_brand, '#')[2] AS INTEGER)) AS dep FROM part WHERE p_size > 40 GROUP BY 1)
SELECT n.package_id, n.type_name, coalesce(i.dep, s.dep) AS dep_package FROM n LEFT JOIN i ON i.package_id = n.package_id AND i.type_name = n.type_name LEFT JOIN s ON s.type_name = n.type_name""")
def external_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("type_name", F.col("p_name"))
    names = part.select(F.col("p_brand").alias("package_id"), "type_name").distinct()
    imports = part.where("p_size < 25").select(F.col("p_brand").alias("package_id"), "type_name", F.col("p_type").alias("dep_package"))
    rank = F.col("p_size") * 1000 + F.substring_index("p_brand", "#", -1).cast("int")
    installed = part.where("p_size > 40").select("type_name", F.col("p_brand").alias("dep_package"), rank.alias("rank"))
    return tables.resolve_external(names, imports, installed).select("package_id", "type_name", "dep_package")


@register("""WITH m AS (SELECT DISTINCT p_brand AS package_id, p_type AS condition FROM part), d AS (SELECT p_brand AS package_id, CASE WHEN p_type = 'SMALL' THEN 'default' ELSE p_type END AS condition, min(p_name) AS target FROM part WHERE p_size < 10 GROUP BY 1, 2)
SELECT m.package_id, m.condition, coalesce(e.target, f.target) AS target FROM m LEFT JOIN d e ON e.package_id = m.package_id AND e.condition = m.condition LEFT JOIN d f ON f.package_id = m.package_id AND f.condition = 'default'""")
def condition_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").withColumn("package_id", F.col("p_brand"))
    modules = part.select("package_id", F.col("p_type").alias("condition")).distinct()
    kind = F.when(F.col("p_type") == "SMALL", "default").otherwise(F.col("p_type"))
    deps = part.where("p_size < 10").groupBy("package_id", kind.alias("condition")).agg(F.min("p_name").alias("target"))
    return tables.match_condition(modules, deps)


@register("""WITH m AS (SELECT p_brand AS owner, p_name AS name, p_partkey AS ord, p_size > 40 AS is_overload, CASE WHEN p_size % 2 = 0 THEN p_type END AS doc FROM part)
SELECT owner, name, ord, coalesce(doc, (SELECT min_by(x.doc, x.ord) FROM m x WHERE x.owner = m.owner AND x.name = m.name AND NOT x.is_overload AND x.doc IS NOT NULL)) AS doc
FROM m WHERE is_overload OR NOT EXISTS (SELECT 1 FROM m y WHERE y.owner = m.owner AND y.name = m.name AND y.is_overload)""")
def overload_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.lit("p").alias("package_id"), F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), (F.col("p_size") > 40).alias("is_overload"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("doc"))
    return tables.overloads(rows).select("owner", "name", "ord", "doc")


@register("""SELECT p_brand AS package_id, p_name AS name, list_sort(list(DISTINCT p_type)) AS conditions FROM part GROUP BY 1, 2""")
def name_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.col("p_name").alias("name"), F.col("p_type").alias("condition"))
    return tables.group_conditions(rows)


# --- graphs and packing ------------------------------------------------------------------------


@register("""WITH RECURSIVE up AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_acctbal < 0 THEN 'System.Exception' ELSE 'S' || CAST(s_suppkey // 2 AS VARCHAR) END AS base FROM supplier WHERE s_suppkey > 0),
e(name) AS (SELECT name FROM up WHERE base = 'System.Exception' UNION SELECT up.name FROM e JOIN up ON up.base = e.name) SELECT name FROM e""")
def error_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").where("s_suppkey > 0")
    base = F.when(F.col("s_acctbal") < 0, "System.Exception").otherwise(F.concat(F.lit("S"), F.floor(F.col("s_suppkey") / 2).cast("string")))
    types = s.select(F.lit("p").alias("package_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), base.alias("base"))
    return graph.error_types(types).select("name")


@register("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'interface' ELSE 'class' END AS own, p_brand || 'X' AS a, 'I' || p_type AS b, p_type AS c FROM part),
k AS (SELECT DISTINCT p_type AS n FROM part WHERE p_size > 49)
SELECT p_partkey, CASE WHEN own = 'interface' THEN NULL ELSE a END AS base, CASE WHEN own = 'interface' THEN [a, b, c] WHEN c IN (SELECT n FROM k) THEN [b, c] ELSE [b] END AS interfaces FROM s""")
def base_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    own = part.select(F.lit("p").alias("package_id"), F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") % 5 == 0, "interface").otherwise("class").alias("kind"), F.array(F.concat("p_brand", F.lit("X")), F.concat(F.lit("I"), "p_type"), F.col("p_type")).alias("supers"))
    known = part.where("p_size > 49").select(F.lit("p").alias("package_id"), F.col("p_type").alias("name"), F.lit("interface").alias("kind"), F.array().cast("array<string>").alias("supers")).distinct()
    made = graph.split_bases(own.union(known))
    return made.where("name rlike '^[0-9]+$'").select(F.col("name").cast("bigint").alias("p_partkey"), "base", "interfaces")


@register("""WITH n AS (SELECT s_nationkey AS package_id, s_suppkey AS name, s_acctbal > 8000 AS is_client, CAST(s_suppkey % 4 AS INTEGER) AS priority FROM supplier),
x AS (SELECT n.*, CASE WHEN is_client THEN 0 WHEN EXISTS (SELECT 1 FROM n c WHERE c.package_id = n.package_id AND c.is_client AND c.name % 10 = n.name % 10 AND c.name <> n.name) THEN 1 ELSE priority + 2 END AS tier FROM n)
SELECT CAST(package_id AS VARCHAR) AS package_id, name, CAST(row_number() OVER (PARTITION BY package_id ORDER BY tier, name) AS INTEGER) AS place FROM x""")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("package_id"), F.col("s_suppkey").alias("name"), (F.col("s_acctbal") > 8000).alias("is_client"), (F.col("s_suppkey") % 4).cast("int").alias("priority"))
    digit = s.withColumn("d", F.col("name") % 10)
    edges = digit.select("package_id", "d", F.col("name").alias("src")).join(digit.select("package_id", "d", F.col("name").alias("dst")), ["package_id", "d"]).where("src <> dst").select("package_id", "src", "dst")
    return packing.dependency_order(s, edges).select("package_id", "name", "place")


@register("""WITH p AS (SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN text END, '' ORDER BY turn) AS a, string_agg(CASE WHEN role = 'user' THEN text ELSE '' END, '' ORDER BY turn) AS ex, string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn) AS su FROM conversations GROUP BY 1),
q AS (SELECT *, 4000 - length(coalesce(a, '')) - 6 AS rest FROM p),
r AS (SELECT *, CASE WHEN least(5000, rest // 2) - 200 > 500 AND length(ex) > 0 THEN left(ex, CAST(least(5000, rest // 2) - 200 AS BIGINT)) ELSE '' END AS e FROM q)
SELECT CAST(conv_id AS VARCHAR) AS package_id, md5(coalesce(a, '') || chr(10) || '<code>' || CASE WHEN e <> '' THEN chr(10) || e ELSE '' END || chr(10) || left(su, CAST(greatest(0, rest - length(e) - 500) AS BIGINT))) AS prompt_md5 FROM r""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda role: F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), ""), F.lit(""))
    parts = t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("package_id")).agg(of("system").alias("prefix"), F.lit("<code>").alias("output_tag"), of("user").alias("example"), of("assistant").alias("surface"))
    return packing.prompt(parts, 4000).select("package_id", F.md5("prompt").alias("prompt_md5"))


# --- reports, diagnostics, messages --------------------------------------------------------------


@register("""WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS package_id, role AS id, turn FROM conversations WHERE turn < 2),
i AS (SELECT CAST(conv_id AS VARCHAR) AS package_id, role AS id, turn FROM conversations WHERE turn = 3),
n AS (SELECT CAST(conv_id AS VARCHAR) AS package_id, role AS id, min(turn) AS turn FROM conversations GROUP BY 1, 2),
a AS (SELECT *, 0 AS part FROM u UNION ALL SELECT *, 1 FROM i UNION ALL SELECT *, 2 FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.package_id = n.package_id AND u.id = n.id) AND NOT EXISTS (SELECT 1 FROM i WHERE i.package_id = n.package_id AND i.id = n.id))
SELECT package_id, id, CAST(row_number() OVER (PARTITION BY package_id ORDER BY part, turn) AS INTEGER) AS ord FROM a""")
def merged_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns come from upstream, the third from the index, all others are new; the turn is each part's order."""
    none = F.lit(None).cast("string")
    rows = t(spark, sf_dir, "conversations").select(F.col("turn").alias("ord"), F.col("conv_id").cast("string").alias("package_id"), F.col("role").alias("id"), F.lit("t").alias("text"), F.lit(1).alias("level"), none.alias("target_type"), none.alias("target_member"))
    return diagnostics.merged(rows.where("ord < 2"), rows.where("ord = 3"), rows).select("package_id", "id", "ord")


@register(r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS package_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT package_id, id, CAST(count(*) AS BIGINT) AS n_lines, md5(string_agg(md5(trim(x, ' ')), '' ORDER BY md5(trim(x, ' ')))) AS lines_md5 FROM (SELECT *, 'SDKWARN' AS id FROM l) WHERE regexp_replace(x, '\s', '', 'g') <> '' GROUP BY 1, 2""")
def stderr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("package_id"), F.col("text").alias("stderr"))
    lines = F.array_join(F.sort_array(F.collect_list(F.md5("text"))), "")
    return diagnostics.from_stderr(streams).groupBy("package_id", "id").agg(F.count("*").alias("n_lines"), F.md5(lines).alias("lines_md5"))


@register("""WITH d AS (SELECT p_brand AS package_id, p_type AS client, p_name AS operation, min(p_partkey) AS line FROM part WHERE p_size < 25 GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT p_brand AS package_id, p_type AS client, p_name AS operation FROM part),
o AS (SELECT a.* FROM a LEFT JOIN d ON d.package_id = a.package_id AND d.client = a.client AND d.operation = a.operation WHERE d.line IS NULL),
x AS (SELECT package_id, 'Covered (' || CAST(count(*) AS VARCHAR) || '):' || chr(10) || string_agg('  ' || client || '.' || operation || ' (f:' || CAST(line AS VARCHAR) || ')', chr(10) ORDER BY client, operation) || chr(10) AS r FROM d GROUP BY 1),
y AS (SELECT package_id, 'Uncovered (' || CAST(count(*) AS VARCHAR) || '):' || chr(10) || string_agg('  ' || client || '.' || operation || '()', chr(10) ORDER BY client, operation) || chr(10) AS r FROM o GROUP BY 1)
SELECT coalesce(x.package_id, y.package_id) AS package_id, md5(coalesce(x.r, '') || coalesce(y.r, '')) AS report_md5 FROM x FULL JOIN y ON y.package_id = x.package_id""")
def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.col("p_type").alias("client"), F.col("p_name").alias("operation"), F.lit("f").alias("file"), F.col("p_partkey").alias("line"), F.lit(0).alias("call_ord"), "p_size")
    done = coverage.covered(ops.where("p_size < 25"))
    open_ = coverage.uncovered(ops, done).withColumn("sig", F.concat("operation", F.lit("()")))
    return coverage.usage_report(done, open_).select("package_id", F.md5("report").alias("report_md5"))


@register("""WITH p AS (SELECT CAST(n_nationkey AS VARCHAR) AS package_id, CASE WHEN c.total IS NULL THEN 'skipped' ELSE 'analyzed' END AS status, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(covered, 0) AS BIGINT) AS covered
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS covered FROM customer WHERE c_nationkey <> 7 GROUP BY 1) c ON c_nationkey = n_nationkey)
SELECT 0 AS ord, '# Coverage: ' || CAST(sum(covered) AS VARCHAR) || ' of ' || CAST(sum(total) AS VARCHAR) || ' operations (' || printf('%.2f', sum(covered) * 100.0 / sum(total)) || '%)' AS line FROM p
UNION ALL SELECT 1, '| package | status | covered | total | percent |' UNION ALL SELECT 2, '|---|---|---|---|---|'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY package_id) + 2 AS INTEGER), '| ' || package_id || ' | ' || status || ' | ' || CAST(covered AS VARCHAR) || ' | ' || CAST(total AS VARCHAR) || ' | ' || printf('%.2f', CASE WHEN total > 0 THEN covered * 100.0 / total ELSE 0 END) || ' |' FROM p WHERE total > 0""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = t(spark, sf_dir, "customer").where("c_nationkey <> 7").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("covered"))
    rows = t(spark, sf_dir, "nation").join(sums, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    packages = rows.select(F.col("n_nationkey").cast("string").alias("package_id"), F.when(F.col("total").isNull(), "skipped").otherwise("analyzed").alias("status"), n("total"), n("covered"))
    return coverage.markdown_report(packages.withColumn("uncovered", F.col("total") - F.col("covered")), skip_empty=True)


@register("""SELECT o_orderkey, md5('{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderstatus <> 'F' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}') AS json_md5 FROM orders""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    made = api_index.to_json(rows)
    return made.select(F.get_json_object("json", "$.o_orderkey").cast("bigint").alias("o_orderkey"), F.md5("json").alias("json_md5"))


@register("""SELECT CAST(a.event_id AS VARCHAR) AS id, a.event_type AS method, b.event_type AS result FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE b.ts <= a.ts + INTERVAL 5 MINUTE""")
def correlated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("method"), "ts")
    told = events.select((F.col("event_id") - 1).cast("string").alias("id"), F.col("event_type").alias("result"), F.lit(None).cast("string").alias("error"), "ts")
    return messages.correlate(asked, told).select("id", "method", "result")


@register("""WITH b AS (SELECT a.event_id, a.event_type AS method, min_by(b.event_type, b.ts) AS result, count(b.event_id) AS n FROM events a LEFT JOIN events b ON b.event_id - a.event_id IN (1, 2) AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTE GROUP BY a.event_id, a.event_type)
SELECT CAST(event_id AS VARCHAR) AS id, method, CASE WHEN n > 0 THEN 'answered' ELSE 'timeout' END AS status, result FROM b""")
def message_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks, the next two answer, of two at one time the one that comes first; without one in five minutes it times out."""
    events = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("method"), "ts")
    told = events.select(F.explode(F.array(*((F.col("event_id") - k).cast("string") for k in (1, 2)))).alias("id"), F.col("event_type").alias("result"), F.lit(None).cast("string").alias("error"), "ts", F.col("event_id").alias("ord"))
    return exchanges.exchanges(asked, told).select("id", "method", "status", "result")


@register("""SELECT conv_id, turn, role = 'assistant' AS needs_correction, CASE WHEN role = 'assistant' THEN NULL ELSE text END AS code FROM conversations""")
def sample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.to_json(F.array(F.struct(F.lit("n").alias("name"), F.col("text").alias("code")))))
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))
    return objects.array_samples(rows).select("conv_id", "turn", "needs_correction", F.col("samples")[0]["code"].alias("code"))


@register("""SELECT conv_id, turn, 'c' || CAST(conv_id AS VARCHAR) || '/t_' || CAST(turn AS VARCHAR) || '.py' AS path FROM conversations WHERE role <> 'system'""")
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations")
    number = turns.select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string")).alias("name"), F.when(F.col("role") != "system", F.col("text")).otherwise(" \n").alias("code"), F.concat(F.lit("../c"), F.col("conv_id").cast("string"), F.lit("/./t "), F.col("turn").cast("string"), F.lit(".txt")).alias("filePath"))
    made = source_files.write_samples(number, ".py")
    id_ = F.split("name", " ")
    return made.select(id_[0].cast("bigint").alias("conv_id"), id_[1].cast("bigint").alias("turn"), "path")


@register("""SELECT p_brand AS package_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, 'x-' || p_type AS xlang_id FROM part WHERE p_size < 30 UNION ALL SELECT p_brand, p_name || ' ' || CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_size >= 30""")
def cross_language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    key = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    rows = part.select(F.col("p_brand").alias("package_id"), key.alias("name"))
    maps = part.where("p_size < 30").select(F.col("p_brand").alias("packageId"), F.create_map(key, F.concat(F.lit("x-"), "p_type")).alias("ids"))
    return api_index.with_cross_language(rows, maps, "name").select("package_id", "name", "xlang_id")
