"""The operators bound to whole tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apilattice.functions import classify, text
from apilattice.operators import coverage, detect, diagnostics, graph, packing, tables
from apilattice.registry import register
from apilattice.sources import index as api_index
from apilattice.streaming import messages, objects, sessions


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- coverage -----------------------------------------------------------------------------


def _operations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users are clients and event types operations; what came before 2024-01-04 is covered."""
    events = t(spark, sf_dir, "events").select(F.lit("events").alias("package_id"), F.col("user_id").alias("client"), F.col("event_type").alias("operation"), "ts", "event_id")
    return events, events.where("ts < timestamp '2024-01-04 00:00:00'")


_COVERED = """
universe AS (SELECT DISTINCT user_id, event_type FROM events),
covered AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-04 00:00:00'),
via AS (SELECT DISTINCT user_id % 50 AS grp, event_type FROM covered),
flagged AS (
  SELECT u.user_id, u.event_type, c.user_id IS NOT NULL AS is_covered,
         c.user_id IS NULL AND v.grp IS NULL AND u.event_type <> 'signup' AS is_open
  FROM universe u LEFT JOIN covered c ON c.user_id = u.user_id AND c.event_type = u.event_type
  LEFT JOIN via v ON v.grp = u.user_id % 50 AND v.event_type = u.event_type)
"""


def _open(events: DataFrame, done: DataFrame) -> DataFrame:
    groups = events.select("package_id", "client", (F.col("client") % 50).alias("grp")).distinct()
    deprecated = events.where("operation = 'signup'")
    return coverage.uncovered_by_group(events, done, groups, deprecated)


@register(f"""WITH {_COVERED}, s AS (SELECT CAST(count(*) FILTER (WHERE is_covered) AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE is_open) AS BIGINT) AS uncovered FROM flagged)
SELECT covered + uncovered AS total, covered, uncovered,
       CASE WHEN covered + uncovered > 0 THEN CAST(round_even(covered * 100.0 / (covered + uncovered), 1) AS DOUBLE) ELSE 0.0 END AS coverage_percent FROM s""")
def op_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, done = _operations(spark, sf_dir)
    return coverage.summed(events, done, _open(events, done)).drop("package_id")


@register(f"""WITH {_COVERED} SELECT user_id AS client, event_type AS operation FROM flagged WHERE is_open""")
def uncovered_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(*_operations(spark, sf_dir)).select("client", "operation")


@register(f"""WITH {_COVERED}, p AS (
  SELECT user_id % 10 AS k, CASE user_id % 10 WHEN 9 THEN 'failed' WHEN 8 THEN 'skipped' ELSE 'analyzed' END AS status,
         sum(CASE WHEN user_id % 10 < 8 AND (is_covered OR is_open) THEN 1 ELSE 0 END) AS total,
         sum(CASE WHEN user_id % 10 < 8 AND is_covered THEN 1 ELSE 0 END) AS covered,
         sum(CASE WHEN user_id % 10 < 8 AND is_open THEN 1 ELSE 0 END) AS uncovered
  FROM flagged GROUP BY 1, 2)
SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(uncovered) AS BIGINT) AS uncovered,
       CAST(count(*) FILTER (WHERE status = 'analyzed') AS BIGINT) AS analyzed_packages, CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS skipped_packages,
       CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_packages,
       CASE WHEN sum(total) > 0 THEN CAST(sum(covered) AS DOUBLE) * 100.0 / CAST(sum(total) AS DOUBLE) ELSE 0.0 END AS coverage_percent FROM p""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, done = _operations(spark, sf_dir)
    bucket = lambda df: df.withColumn("package_id", (F.col("client") % 10).cast("string"))
    rows = coverage.summed(bucket(events), bucket(done), bucket(_open(events, done)))
    status = F.when(F.col("package_id") == "9", "failed").when(F.col("package_id") == "8", "skipped").otherwise("analyzed")
    ran = lambda c: F.when(F.col("status") == "analyzed", F.col(c)).otherwise(0).alias(c)
    return coverage.rollup(rows.withColumn("status", status).select("status", *map(ran, ("total", "covered", "uncovered"))))


@register("""SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.first_witness(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "ts", "event_id")


@register("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events),
s AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY CAST(user_id AS VARCHAR)) AS n, count(*) OVER (PARTITION BY event_type) AS m FROM d),
c AS (SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1)
SELECT s.event_type, CAST(max(m) AS BIGINT) AS n_names, CAST(max(c.n_rows) AS BIGINT) AS n_rows,
       string_agg(CASE WHEN n <= 10 THEN CAST(user_id AS VARCHAR) END, ', ' ORDER BY n) || CASE WHEN max(m) > 10 THEN ' (+' || CAST(max(m) - 10 AS VARCHAR) || ' more)' ELSE '' END AS summary
FROM s JOIN c ON c.event_type = s.event_type GROUP BY s.event_type""")
def overflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"))
    return coverage.grouped_names(events, ["event_type"], "user_id")


@register("""SELECT CAST(user_id % 10 AS VARCHAR) AS package_id,
  list_filter([CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'error-handling' END,
               CASE WHEN max(CASE WHEN value > 190 THEN 1 ELSE 0 END) = 1 THEN 'large-value' END,
               CASE WHEN max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) = 1 THEN 'streaming' END], lambda x: x IS NOT NULL) AS patterns
FROM events GROUP BY 1""")
def usage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").withColumn("package_id", (F.col("user_id") % 10).cast("string"))
    return coverage.usage_patterns(rows, {"error-handling": F.col("event_type") == "error", "large-value": F.col("value") > 190, "streaming": F.col("event_type") == "view"})


# --- column functions ---------------------------------------------------------------------


@register(r"""SELECT doc_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[\p{L}\p{Nd}_]+'))), ' ')) AS tokens_md5 FROM documents""")
def signature_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.sort_array(text.tokens(F.col("text"))), " ")).alias("tokens_md5"))


@register(r"""WITH m AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_\.]*') AS x FROM benchmark)
SELECT item_id, md5(array_to_string(flatten(list_transform(x, lambda s: CASE WHEN regexp_matches(s, '^.+\.[^.]+$') THEN [s, regexp_extract(s, '^.+\.([^.]+)$', 1)] ELSE [s] END)), ' ')) AS tokens_md5 FROM m""")
def type_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(text.type_tokens(F.col("text")), " ")).alias("tokens_md5"))


@register(r"""SELECT p_partkey, p_type AS norm_name, string_split(p_name, ' ')[-1] AS last_name, p_brand AS plain_name, lower(p_type) AS folded FROM part""")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    generic = F.concat("p_type", F.lit("<"), "p_brand", F.lit(">[]"))
    return part.select("p_partkey", text.normalize_type(generic).alias("norm_name"), text.last_segment(F.replace("p_name", F.lit(" "), F.lit("."))).alias("last_name"), text.strip_generics(F.concat("p_brand", F.lit("<T>"))).alias("plain_name"), F.lower("p_type").alias("folded"))


_SCRUB = "text"
for _pattern, _new in text.SECRETS:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_new.replace('$1$2', chr(92) + '1' + chr(92) + '2')}', 'g')"


@register(f"""WITH s AS (SELECT doc_id, {_SCRUB} AS x, text FROM documents)
SELECT doc_id, md5(x) AS scrubbed_md5, CAST((length(x) - length(replace(x, '[REDACTED]', ''))) / 10 AS INTEGER) AS n_redacted FROM s WHERE x <> text""")
def scrub_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").withColumn("x", text.scrub_secrets(F.col("text"))).where("x <> text")
    return rows.select("doc_id", F.md5("x").alias("scrubbed_md5"), ((F.length("x") - F.length(F.replace("x", F.lit("[REDACTED]"), F.lit("")))) / 10).cast("int").alias("n_redacted"))


@register("""SELECT p_partkey, CAST(CAST(string_split(p_brand, '#')[2] AS INTEGER) AS INTEGER) AS major, CAST(p_size AS INTEGER) AS minor FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CAST(string_split(p_brand, '#')[2] AS INTEGER) DESC, p_size DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def semver_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.substring_index("p_brand", "#", -1), F.lit("."), F.col("p_size").cast("string"), F.lit("-preview"))
    rows = t(spark, sf_dir, "part").withColumn("key", text.semver_key(version))
    best = tables.first_of_each(rows, ["p_type"], [F.col("key").desc(), "p_partkey"])
    return best.select("p_partkey", F.col("key")[0].alias("major"), F.col("key")[1].alias("minor"))


@register(r"""WITH u AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages),
s AS (SELECT page_id, p, list_transform(string_split(lower(p), '/'), lambda x: CASE WHEN regexp_matches(x, '\.[^.]+$') THEN regexp_replace(x, '\.[^.]*$', '') ELSE x END) AS segs FROM u)
SELECT page_id, list_has_any(flatten(list_transform(segs, lambda x: list_concat([x], regexp_split_to_array(x, '[._-]')))), ['test','tests','testing','sample','samples','example','examples','demo','demos','benchmark','benchmarks','perf','performance','mock','mocks','fixture','fixtures']) AS is_test,
       regexp_matches(p, '(?i)^/[^/]*/[^/]*\.html$') AS in_glob FROM s""")
def glob_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").withColumn("p", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))
    return rows.select("page_id", text.is_test_path(F.col("p")).alias("is_test"), F.col("p").rlike(text.glob_to_regex("/*/*.html")).alias("in_glob"))


@register("""SELECT page_id, len(list_filter(list_slice(string_split(html, chr(10)), 1, 50), lambda l: regexp_matches(l, '(?i)"(?:[.]{1,2}/)*en["/]'))) > 0 AS imports FROM pages""")
def import_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.slice(F.split("html", "\n"), 1, detect.MAX_LINES)
    return t(spark, sf_dir, "pages").select("page_id", F.exists(lines, lambda line: text.imports_library(line, "en", "go")).alias("imports"))


# --- joins, sets, aggregates --------------------------------------------------------------


@register("""SELECT n_nationkey, n_name, coalesce(r_name, 'method(...)') AS label FROM nation LEFT JOIN (SELECT r_regionkey, min(r_name) AS r_name FROM region WHERE r_regionkey <> 3 GROUP BY 1) r ON r_regionkey = n_regionkey""")
def xlang_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("label"))
    return tables.lookup_or_keep(t(spark, sf_dir, "nation"), names, "n_regionkey", "label", F.lit("method(...)")).select("n_nationkey", "n_name", "label")


@register("""SELECT s_nationkey, s_suppkey, n_lines FROM (SELECT s_nationkey, s_suppkey, n_lines, row_number() OVER (PARTITION BY s_nationkey ORDER BY n_lines DESC, s_suppkey) AS k FROM (
  SELECT s_nationkey, s_suppkey, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)) WHERE k = 1""")
def arg_max_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    counts = lines.join(t(spark, sf_dir, "supplier"), "s_suppkey")
    return tables.arg_max(counts, ["s_nationkey"], [F.col("n_lines"), -F.col("s_suppkey")], ["s_suppkey", "n_lines"])


@register("""SELECT l_partkey, min_by(l_shipmode, k) AS kind, list_sort(list(DISTINCT l_linestatus)) AS statuses, bool_or(l_returnflag = 'R') AS returned FROM (
  SELECT l_partkey, l_returnflag AS l_shipmode, l_linestatus, l_returnflag,
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') || l_returnflag AS k FROM lineitem) GROUP BY l_partkey""")
def merge_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    order = F.concat(pad(F.col("l_orderkey"), 12), pad(F.col("l_linenumber"), 3), pad(F.col("l_suppkey"), 9), pad(price, 12), "l_returnflag")
    rows = t(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("kind"), F.array("l_linestatus").alias("statuses"), (F.col("l_returnflag") == "R").alias("returned"), order.alias("k"))
    return tables.merge_partial(rows, ["l_partkey"], F.col("k"), ["kind"], ["statuses"], ["returned"])


@register("""SELECT min(doc_id) AS doc_id, md5(lower(text)) AS text_md5, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 2""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text")).alias("text_md5"))
    return tables.first_of_each(docs, ["text_md5"], ["doc_id"]).join(docs.groupBy("text_md5").agg(F.count("*").alias("copies")), "text_md5").select("doc_id", "text_md5", "copies")


@register("""WITH c AS (SELECT DISTINCT c_nationkey AS v FROM customer), s AS (SELECT DISTINCT s_nationkey AS v FROM supplier)
SELECT 'union' AS op, v AS value FROM (SELECT v FROM c UNION SELECT v FROM s)
UNION ALL SELECT 'intersect', v FROM (SELECT v FROM c INTERSECT SELECT v FROM s)
UNION ALL SELECT 'a_minus_b', v FROM (SELECT v FROM c EXCEPT SELECT v FROM s)
UNION ALL SELECT 'b_minus_a', v FROM (SELECT v FROM s EXCEPT SELECT v FROM c)""")
def union_distinct_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.set_operations(t(spark, sf_dir, "customer").select("c_nationkey"), t(spark, sf_dir, "supplier").select("s_nationkey"))


@register("""WITH u AS (SELECT user_id, max(ts) AS last_access FROM events GROUP BY 1)
SELECT user_id, last_access FROM (SELECT *, row_number() OVER (ORDER BY last_access, user_id) AS n, count(*) OVER () AS m FROM u) WHERE n <= greatest(1, m // 4)""")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_access"))
    return tables.evict_least_recent(users, 1, "user_id")


@register("""SELECT c_mktsegment AS container, CAST(c_nationkey AS VARCHAR) AS package_id, list_sort(list(c_name)) AS types FROM customer GROUP BY 1, 2""")
def group_by_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("package_id"), F.col("c_mktsegment").alias("container"), F.col("c_name").alias("name"))
    return tables.by_container(rows)


@register("""SELECT CAST(s_nationkey AS VARCHAR) AS package_id, p_brand AS dep_package, p_brand IN (SELECT p_brand FROM part WHERE p_size = 50 GROUP BY 1 HAVING count(*) > 2) AS is_stdlib, list_sort(list(DISTINCT p_type)) AS types
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def dependency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rows = lines.join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.col("s_nationkey").cast("string").alias("package_id"), F.col("p_brand").alias("dep_package"), F.col("p_type").alias("type_name"))
    standard = part.where("p_size = 50").groupBy(F.col("p_brand").alias("dep_package")).agg(F.count("*").alias("n")).where("n > 2")
    return tables.dependencies(rows, standard)


@register("""SELECT CAST(l_orderkey AS VARCHAR) AS package_id, left(sha256(string_agg(r, chr(10) ORDER BY r)), 32) AS fingerprint FROM (
  SELECT l_orderkey, CAST(l_partkey AS VARCHAR) || '|' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS r FROM lineitem) GROUP BY 1""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("package_id"), F.col("l_partkey").cast("string").alias("rel_path"), F.col("l_quantity").cast("bigint").alias("size"), F.col("l_suppkey").alias("mtime_ticks"))
    return tables.set_fingerprint(rows)


@register("""WITH c(condition, rank) AS (VALUES ('ECONOMY', 100), ('types', 1), ('node', 4)),
s AS (SELECT p_brand AS package_id, p_name AS name, CASE WHEN p_type = 'SMALL' THEN 'types' WHEN p_type = 'PROMO' THEN 'node' ELSE p_type END AS condition, CASE WHEN p_size < 5 THEN '.' ELSE './' || CAST(p_size AS VARCHAR) END AS export_path FROM part)
SELECT package_id, name, condition, export_path FROM (SELECT *, row_number() OVER (PARTITION BY package_id, name ORDER BY CASE condition WHEN 'types' THEN 1 WHEN 'node' THEN 4 ELSE 100 END, CASE WHEN export_path = '.' THEN '' ELSE export_path END, condition) AS n FROM s) WHERE n = 1""")
def condition_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.when(F.col("p_type") == "SMALL", "types").when(F.col("p_type") == "PROMO", "node").otherwise(F.col("p_type"))
    path = F.when(F.col("p_size") < 5, ".").otherwise(F.concat(F.lit("./"), F.col("p_size").cast("string")))
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), F.col("p_name").alias("name"), condition.alias("condition"), path.alias("export_path"))
    return tables.owner_by_condition(rows, text.condition_rank(F.col("condition")))


@register("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, p_name, p_partkey) AS INTEGER) AS place FROM part""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).when(F.col("p_type") == "MEDIUM", 2).otherwise(3)
    name = F.concat("p_name", F.lit("\x00"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    types = t(spark, sf_dir, "part").select(F.col("p_brand").alias("package_id"), name.alias("name"), (rank == 0).alias("is_client"), rank.alias("priority"), "p_partkey")
    none = types.select("package_id", F.col("name").alias("src"), F.col("name").alias("dst")).limit(0)
    return packing.dependency_order(types, none).select("p_partkey", "place")


@register("""WITH f AS (SELECT doc_id, lang, n_chars, least(n_chars, 50000) AS share FROM documents WHERE least(n_chars, 50000) > 0),
w AS (SELECT *, 512000 - coalesce(sum(share + 50) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM f)
SELECT doc_id, CAST(least(share, rest - 50) AS BIGINT) AS chars, CAST(least(share, rest - 50) // 4 AS BIGINT) AS est_tokens, least(share, rest - 50) < n_chars AS truncated FROM w WHERE rest > 50""")
def token_budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    plan = packing.load_plan(docs, [F.col("n_chars").desc(), "doc_id"], "n_chars", by=["lang"], parts=64)
    return plan.select("doc_id", F.col("chars").cast("bigint").alias("chars"), "est_tokens", "truncated")


@register("""WITH w AS (SELECT conv_id, turn, text, 1000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM conversations)
SELECT conv_id, turn, left(text, CAST(rest AS BIGINT)) AS text, length(text) > rest AS truncated, CAST(length(left(text, CAST(rest AS BIGINT))) // 4 AS INTEGER) AS est_tokens FROM w WHERE rest > 0""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return packing.budget_cut(turns, ["turn"], 1000, by=["conv_id"]).select("conv_id", "turn", "text", "truncated", "est_tokens")


# --- graphs -------------------------------------------------------------------------------

# Visits: what a user did on a day is a node for each kind of event; each next event of the day is an edge.

_VISITS = """
visit AS (SELECT CAST(user_id AS VARCHAR) AS package_id, strftime(ts, '%Y-%m-%d') || '/' || event_type AS name, event_type, user_id, lead(event_type) OVER d AS next_type, strftime(ts, '%Y-%m-%d') AS day FROM events WINDOW d AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)),
edge AS (SELECT DISTINCT package_id, name AS src, day || '/' || next_type AS dst FROM visit WHERE next_type IS NOT NULL AND next_type <> event_type)
"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    rows = t(spark, sf_dir, "events").withColumn("dst", F.concat(day, F.lit("/"), F.lead("event_type").over(order)))
    return rows.select(F.col("user_id").cast("string").alias("package_id"), F.concat(day, F.lit("/"), "event_type").alias("name"), "event_type", "dst")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir).where("dst is not null and dst <> name").select("package_id", F.col("name").alias("src"), "dst").distinct()


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _visits(spark, sf_dir).select("package_id", "name", kind.isin("purchase", "click").alias("has_operations"), (kind == "signup").alias("is_entry_point"), (kind != "error").alias("is_root_candidate")).distinct()


@register(f"""WITH RECURSIVE {_VISITS}, hit(package_id, name) AS (SELECT package_id, src FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge i WHERE i.package_id = e.package_id AND i.dst = e.src) UNION SELECT e.package_id, e.dst FROM hit JOIN edge e ON e.package_id = hit.package_id AND e.src = hit.name) SELECT package_id, name FROM hit""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.cut(_edges(spark, sf_dir))
    roots = edges.select("package_id", F.col("src").alias("name")).join(edges.select("package_id", F.col("dst").alias("name")), ["package_id", "name"], "left_anti")
    return graph.reachable(edges, roots).select("package_id", "name")


_CLOSURE = f"{_VISITS}, path(package_id, src, dst) AS (SELECT package_id, src, dst FROM edge UNION SELECT p.package_id, p.src, e.dst FROM path p JOIN edge e ON e.package_id = p.package_id AND e.src = p.dst)"
_SCC = f"{_CLOSURE}, back AS (SELECT p.package_id, p.src AS name, min(p.dst) AS low FROM path p JOIN path q ON q.package_id = p.package_id AND q.src = p.dst AND q.dst = p.src GROUP BY 1, 2), scc AS (SELECT DISTINCT v.package_id, v.name, least(v.name, coalesce(low, v.name)) AS scc FROM visit v LEFT JOIN back ON back.package_id = v.package_id AND back.name = v.name)"


@register(f"WITH RECURSIVE {_CLOSURE} SELECT package_id, src, dst FROM path")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_edges(spark, sf_dir))


@register(f"WITH RECURSIVE {_SCC} SELECT package_id, name, scc FROM scc")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("package_id", "name", "scc")


_KINDS = "node AS (SELECT DISTINCT package_id, name, event_type IN ('purchase', 'click') AS works, event_type = 'signup' AS entry, event_type <> 'error' AS cand FROM visit), using_ AS (SELECT DISTINCT e.package_id, e.src AS name FROM edge e JOIN node d ON d.package_id = e.package_id AND d.name = e.dst AND d.works)"


@register(f"""WITH RECURSIVE {_SCC}, {_KINDS},
n AS (SELECT node.*, scc.scc, u.name IS NOT NULL AS uses FROM node JOIN scc ON scc.package_id = node.package_id AND scc.name = node.name LEFT JOIN using_ u ON u.package_id = node.package_id AND u.name = node.name),
cands AS (SELECT DISTINCT package_id, scc FROM n WHERE cand),
entered AS (SELECT DISTINCT e.package_id, d.scc FROM edge e JOIN n s ON s.package_id = e.package_id AND s.name = e.src JOIN n d ON d.package_id = e.package_id AND d.name = e.dst JOIN cands c ON c.package_id = s.package_id AND c.scc = s.scc WHERE s.scc <> d.scc),
relevant AS (SELECT DISTINCT n.package_id, n.scc FROM n LEFT JOIN entered x ON x.package_id = n.package_id AND x.scc = n.scc WHERE cand AND NOT entry AND (works OR uses) AND x.scc IS NULL)
SELECT n.package_id, n.name FROM n LEFT JOIN relevant r ON r.package_id = n.package_id AND r.scc = n.scc WHERE entry OR (cand AND r.scc IS NOT NULL)""")
def scc_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("package_id", "name")


@register(f"""WITH {_VISITS}, {_KINDS},
n AS (SELECT node.*, u.name IS NOT NULL AS uses, c.dst IS NOT NULL AS called FROM node LEFT JOIN using_ u ON u.package_id = node.package_id AND u.name = node.name LEFT JOIN (SELECT DISTINCT package_id, dst FROM edge) c ON c.package_id = node.package_id AND c.dst = node.name),
f AS (SELECT *, (entry AND works) OR (NOT called AND (works OR uses)) AS first FROM n),
a AS (SELECT package_id, bool_or(first) AS any_first FROM f GROUP BY 1)
SELECT f.package_id, f.name FROM f JOIN a ON a.package_id = f.package_id WHERE first OR ((works OR uses) AND NOT any_first)""")
def in_degree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree_roots(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("package_id", "name")


# The same on one dense graph: supplier to next supplier of an order, over all lines.

_LINES = """
line AS (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS next_key FROM lineitem),
edge AS (SELECT DISTINCT l_suppkey AS src, next_key AS dst FROM line WHERE next_key IS NOT NULL AND next_key <> l_suppkey)
"""
_LINE_CLOSURE = f"{_LINES}, path(src, dst) AS (SELECT src, dst FROM edge UNION SELECT p.src, e.dst FROM path p JOIN edge e ON e.src = p.dst)"
_LINE_SCC = f"{_LINE_CLOSURE}, scc AS (SELECT s_suppkey AS name, least(s_suppkey, coalesce(min(p.dst), s_suppkey)) AS scc FROM supplier LEFT JOIN path p ON p.src = s_suppkey AND EXISTS (SELECT 1 FROM path q WHERE q.src = p.dst AND q.dst = p.src) GROUP BY s_suppkey)"
_FLAGS = "node AS (SELECT s_suppkey AS name, s_acctbal > 2000 AS works, s_nationkey = 3 AS entry, s_nationkey % 4 <> 1 AS cand FROM supplier)"


def _all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier")
    return s.select(F.lit("tpch").alias("package_id"), F.col("s_suppkey").alias("name"), (F.col("s_acctbal") > 2000).alias("has_operations"), (F.col("s_nationkey") == 3).alias("is_entry_point"), (F.col("s_nationkey") % 4 != 1).alias("is_root_candidate"))


def _all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to next supplier of an order, of all lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    lines = t(spark, sf_dir, "lineitem").withColumn("dst", F.lead("l_suppkey").over(order))
    return graph.cut(lines.where("dst is not null and dst <> l_suppkey").select(F.lit("tpch").alias("package_id"), F.col("l_suppkey").alias("src"), "dst").distinct())


@register(f"""WITH RECURSIVE {_LINES}, hit(name) AS (SELECT src FROM edge WHERE src NOT IN (SELECT dst FROM edge) UNION SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 UNION SELECT e.dst FROM hit JOIN edge e ON e.src = hit.name) SELECT name FROM hit""")
def reachability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _all_edges(spark, sf_dir)
    first = edges.select("package_id", F.col("src").alias("name")).join(edges.select("package_id", F.col("dst").alias("name")), ["package_id", "name"], "left_anti")
    entries = _all_nodes(spark, sf_dir).where("is_entry_point").select("package_id", "name")
    return graph.reachable(edges, first.union(entries)).select("name")


@register(f"WITH RECURSIVE {_LINE_CLOSURE} SELECT src, dst FROM path")
def closure_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_all_edges(spark, sf_dir)).select("src", "dst")


@register(f"WITH RECURSIVE {_LINE_SCC} SELECT name, scc FROM scc")
def strong_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_all_nodes(spark, sf_dir), _all_edges(spark, sf_dir)).select("name", "scc")


@register(f"""WITH RECURSIVE {_LINE_SCC}, {_FLAGS},
n AS (SELECT node.*, scc.scc, EXISTS (SELECT 1 FROM edge JOIN node d ON d.name = edge.dst WHERE edge.src = node.name AND d.works) AS uses FROM node JOIN scc ON scc.name = node.name),
entered AS (SELECT DISTINCT d.scc FROM edge JOIN n s ON s.name = edge.src JOIN n d ON d.name = edge.dst WHERE s.scc <> d.scc AND EXISTS (SELECT 1 FROM n c WHERE c.scc = s.scc AND c.cand)),
relevant AS (SELECT scc FROM n WHERE cand AND NOT entry AND (works OR uses) AND scc NOT IN (SELECT scc FROM entered) GROUP BY scc)
SELECT name FROM n WHERE entry OR (cand AND scc IN (SELECT scc FROM relevant))""")
def scc_roots_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(_all_nodes(spark, sf_dir), _all_edges(spark, sf_dir)).select("name")


@register(f"""WITH {_LINES}, {_FLAGS},
n AS (SELECT node.*, EXISTS (SELECT 1 FROM edge JOIN node d ON d.name = edge.dst WHERE edge.src = node.name AND d.works) AS uses, EXISTS (SELECT 1 FROM edge WHERE edge.dst = node.name) AS called FROM node),
f AS (SELECT *, (entry AND works) OR (NOT called AND (works OR uses)) AS first FROM n)
SELECT name FROM f WHERE first OR ((works OR uses) AND NOT EXISTS (SELECT 1 FROM f g WHERE g.first))""")
def in_degree_roots_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree_roots(_all_nodes(spark, sf_dir), _all_edges(spark, sf_dir)).select("name")


@register(r"""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS name FROM benchmark),
tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS name FROM documents)
SELECT tok.name, CAST(count(*) AS BIGINT) AS n_refs FROM tok JOIN names ON names.name = tok.name GROUP BY 1""")
def token_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t(spark, sf_dir, "benchmark").select(F.lit("docs").alias("package_id"), F.explode(text.tokens(F.lower("text"))).alias("name")).distinct()
    owners = t(spark, sf_dir, "documents").select(F.lit("docs").alias("package_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), text.tokens(F.lower("text")).alias("refs"))
    return graph.reference_counts(graph.reference_edges(owners, names)).select("name", "n_refs")


@register("""WITH i(iface, method) AS (VALUES ('Buyer', 'click'), ('Buyer', 'purchase'), ('Member', 'signup'), ('Member', 'view'), ('Member', 'purchase'), ('Faulty', 'error')),
s AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS struct, event_type FROM events)
SELECT struct, iface FROM s JOIN i ON i.method = s.event_type GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM i j WHERE j.iface = i.iface)""")
def structural_implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"Buyer": ("click", "purchase"), "Member": ("signup", "view", "purchase"), "Faulty": ("error",)}
    ifaces = spark.createDataFrame([("e", i, m) for i, ms in sets.items() for m in ms], "package_id string, name string, method string")
    day = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))  # a user's day is a struct
    structs = t(spark, sf_dir, "events").select(F.lit("e").alias("package_id"), day.alias("name"), F.col("event_type").alias("method"))
    return graph.structural_implements(structs, ifaces).select("struct", "iface")


@register("""WITH s AS (SELECT DISTINCT s_nationkey AS owner, p_type AS name, p_brand AS sig FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
e AS (SELECT n_nationkey AS owner, (n_nationkey + 1) % 25 AS embedded FROM nation)
SELECT e.owner, s.name, s.sig FROM e JOIN s ON s.owner = e.embedded WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.owner = e.owner AND o.name = s.name AND o.sig = s.sig)""")
def embedded_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    methods = lines.select(F.lit("p").alias("package_id"), F.col("s_nationkey").alias("owner"), F.col("p_type").alias("name"), F.col("p_brand").alias("sig"), F.lit("void").alias("ret")).distinct()
    structs = t(spark, sf_dir, "nation").select(F.lit("p").alias("package_id"), F.col("n_nationkey").alias("name"), F.array(((F.col("n_nationkey") + 1) % 25).cast("int")).alias("embeds"))
    return graph.promoted_methods(structs, methods).select("owner", "name", "sig")


# --- diagnostics and indexes --------------------------------------------------------------


def _part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("package_id"), F.concat("p_type", F.lit("."), "p_name").alias("type_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_type")).when(F.col("p_size") > 5, F.lit(" \t")).alias("doc"), (F.col("p_size") > 45).alias("deprecated"), "p_partkey")


@register("""SELECT p_brand AS package_id, 'SDK001' AS id, 'Type ''' || p_name || ''' has no documentation.' AS text, 1 AS level, p_type || '.' || p_name AS target_type FROM part WHERE p_size <= 10""")
def diag_missing_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.missing_docs(_part_types(spark, sf_dir)).drop("target_member")


@register(r"""WITH d AS (SELECT DISTINCT p_brand, unnest(regexp_extract_all(p_name, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM part WHERE p_size > 45),
d2 AS (SELECT * FROM d UNION SELECT DISTINCT p_brand, p_type || '.' || string_split(p_name, ' ')[1] FROM part WHERE p_size > 45),
m AS (SELECT p_partkey, p_brand, p_name, regexp_extract_all(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS toks FROM part),
x AS (SELECT m.*, t.tok, list_position(toks, t.tok) AS k FROM m, unnest(m.toks) AS t(tok)),
h AS (SELECT p_partkey, x.p_brand, x.p_name, min(k) AS k FROM x JOIN d ON d.p_brand = x.p_brand AND d.token = x.tok GROUP BY 1, 2, 3)
SELECT h.p_brand AS package_id, 'SDK003' AS id, 'Parameter ''arg'' of ''' || CAST(h.p_partkey AS VARCHAR) || ''' uses deprecated type ''' || m.toks[h.k] || '''.' AS text, 2 AS level, h.p_name AS target_type, h.p_name || '.' || CAST(h.p_partkey AS VARCHAR) AS target_member
FROM h JOIN m ON m.p_partkey = h.p_partkey""")
def diag_deprecated_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _part_types(spark, sf_dir)
    key = F.col("p_partkey").cast("string")
    calls = types.select("package_id", F.col("name").alias("type_id"), F.concat("name", F.lit("."), key).alias("member_id"), key.alias("name"), F.array(F.struct(F.lit("arg").alias("name"), F.col("name").alias("type"))).alias("params"))
    return diagnostics.deprecated_parameters(calls, diagnostics.deprecated_tokens(types))


def _index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An API index in JSON for each brand: types of parts, with members by size."""
    part = t(spark, sf_dir, "part")
    member = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit("()").alias("sig"), F.lit("string").alias("ret"))
    members = F.when(F.col("p_size") % 3 == 0, F.array(member("run", "method"))).when(F.col("p_size") % 3 == 1, F.array(member("size", "property"))).otherwise(F.array().cast("array<struct<name: string, kind: string, sig: string, ret: string>>"))
    base = F.when(F.col("p_size") % 7 == 0, F.lit("ValueError"))
    type_ = F.struct(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.lit("class").alias("kind"), base.alias("base"), (F.col("p_size") > 25).alias("entry_point"), members.alias("members"))
    boxes = part.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list(type_)).alias("types"))
    packages = boxes.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct(F.col("p_type").alias("name"), "types"))).alias("containers"))
    return packages.select(F.to_json(F.struct(F.col("p_brand").alias("package"), "containers")).alias("json"))


@register("""SELECT p_brand AS package_id, CASE WHEN p_size > 25 AND p_size % 3 = 0 THEN 0 WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 ELSE 3 END AS priority, CAST(count(*) AS BIGINT) AS n_types FROM part GROUP BY 1, 2""")
def api_graph_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = api_index.types(api_index.parse_indexes(_index_json(spark, sf_dir)))
    return types.groupBy("package_id", classify.truncation_priority("python").alias("priority")).agg(F.count("*").alias("n_types"))


@register("""SELECT p_brand AS package_id, p_type || '.' || p_name || ' ' || CAST(p_partkey AS VARCHAR) AS type_id, CASE WHEN p_size % 3 = 0 THEN 'run' ELSE 'size' END AS name, CASE WHEN p_size % 3 = 0 THEN 'method' ELSE 'property' END AS kind FROM part WHERE p_size % 3 < 2""")
def api_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_index.members(api_index.parse_indexes(_index_json(spark, sf_dir))).select("package_id", "type_id", "name", "kind")


@register("""SELECT p_brand AS package_id, md5('class ' || p_name || ' ' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size % 7 = 0 THEN '(ValueError)' ELSE '' END || ':' || chr(10) ||
  CASE p_size % 3 WHEN 0 THEN '    def run() -> string: ...' WHEN 1 THEN '    size: string' ELSE '    ...' END || chr(10)) AS stub_md5 FROM part""")
def stub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_index.stubs(api_index.parse_indexes(_index_json(spark, sf_dir)), "python").select("package_id", F.md5("stub").alias("stub_md5"))


# --- messages and sessions ----------------------------------------------------------------


@register("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", text.json_int(F.col("props"), "k").alias("k"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as message lines: users ask, assistants answer, systems notify."""
    id_ = F.when(F.col("role") != "system", F.concat("conv_id", F.lit("-"), "turn"))
    method = F.when(F.col("role") != "assistant", F.when(F.col("role") == "user", "session/prompt").otherwise("session/update"))
    result = F.when(F.col("role") == "assistant", F.struct("text"))
    rows = t(spark, sf_dir, "conversations")
    return rows.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), id_.alias("id"), method.alias("method"), result.alias("result"))).alias("value"))


@register("""SELECT CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'response' ELSE 'notification' END AS kind, CASE role WHEN 'user' THEN 'agent' WHEN 'system' THEN 'client' END AS side, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1, 2""")
def msg_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.dispatch(messages.parse(_lines(spark, sf_dir))).groupBy("kind", "side").agg(F.count("*").alias("n"))


@register("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, role, md5(text) AS text_md5 FROM conversations""")
def chunked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations")
    line = F.concat(F.to_json(F.struct("role", "text")), F.lit(",\n```\n"))
    half = F.floor(F.length(line) / 2).cast("int")
    chunks = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.explode(F.array(F.struct((F.col("turn") * 2).alias("seq"), F.left(line, half).alias("chunk")), F.struct((F.col("turn") * 2 + 1).alias("seq"), F.substr(line, half + 1).alias("chunk")))).alias("c")).select("stream_id", "c.*")
    made = objects.objects(chunks)
    return made.select("stream_id", F.get_json_object("json", "$.role").alias("role"), F.md5(F.get_json_object("json", "$.text")).alias("text_md5"))


_STEPS = ("hello", "not a folder", "/sdk", "", "31", "4", "maybe", "yes", "code", "more")


@register("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS k, conv_id % 7 = 3 AS stops FROM conversations)
SELECT session_id, seq, CASE WHEN stops AND k >= 5 THEN CASE WHEN k = 5 THEN 'cancelled' ELSE 'done' END ELSE CASE k WHEN 1 THEN 'Which SDK folder?' WHEN 2 THEN 'Not a folder. Which SDK folder?' WHEN 3 THEN 'Which output folder?' WHEN 4 THEN 'How many samples?' WHEN 5 THEN 'A number from 1 to 20?' WHEN 6 THEN 'Generate?' WHEN 7 THEN 'Generate?' WHEN 8 THEN 'prompt' WHEN 9 THEN 'saved' ELSE 'done' END END AS reply,
CASE WHEN stops AND k >= 5 THEN 'Complete' ELSE CASE k WHEN 1 THEN 'AwaitingSdkPath' WHEN 2 THEN 'AwaitingSdkPath' WHEN 3 THEN 'AwaitingOutputFolder' WHEN 4 THEN 'AwaitingSampleCount' WHEN 5 THEN 'AwaitingSampleCount' WHEN 6 THEN 'AwaitingPromptConfirmation' WHEN 7 THEN 'AwaitingPromptConfirmation' WHEN 8 THEN 'AwaitingSamples' ELSE 'Complete' END END AS state FROM n""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation is the next step of a session; some cancel at the fifth."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    said = F.coalesce(F.get(F.array(*map(F.lit, _STEPS)), k - 1), F.lit("more"))
    turns = t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.when((F.col("conv_id") % 7 == 3) & (k == 5), " Cancel ").otherwise(said).alias("text"))
    return sessions.sessions(turns).select("session_id", "seq", "reply", "state")
