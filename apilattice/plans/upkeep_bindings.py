"""Keeping indexes up to date and watching runs, bound to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.operators import detect, incremental, metrics, packing
from apilattice.operators.graph import cut
from apilattice.plans import facade
from apilattice.plans.bindings import t
from apilattice.plans.more_bindings import _FILES, _files
from apilattice.registry import register

SNAPSHOT = "1999-01-01"


def _order_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as files of their order: those of the snapshot, those that came since, and those of the snapshot that have gone (returned)."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("package_id"), F.col("l_partkey").cast("string").alias("rel_path"), F.col("l_quantity").cast("bigint").alias("size"), F.col("l_suppkey").alias("mtime_ticks"), (F.col("l_shipdate") < F.lit(SNAPSHOT).cast("timestamp")).alias("old"), (F.col("l_returnflag") == "R").alias("gone"))
    return lines.where("old"), lines.where("not old and not gone"), lines.where("old and gone")


def _sums(files: DataFrame, made: str) -> DataFrame:
    """An index of orders: their files and their size, and when it was computed."""
    return files.groupBy("package_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.lit(made).alias("computed"))


_PRINT = "left(sha256(concat_ws(',', count(*), " + ", ".join(f"sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT))" for k in range(8)) + ")), 32) AS fingerprint, count(*) AS n_files, sum(size) AS total_size"
_ORDERS = f"""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS package_id, CAST(l_quantity AS BIGINT) AS size, l_shipdate < TIMESTAMP '{SNAPSHOT}' AS old, l_returnflag = 'R' AS gone,
  sha256(CAST(l_partkey AS VARCHAR) || '|' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem),
b AS (SELECT package_id, {_PRINT} FROM l WHERE old GROUP BY 1),
n AS (SELECT package_id, {_PRINT} FROM l WHERE NOT gone GROUP BY 1)
"""


def _order_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    before, came, gone = _order_files(spark, sf_dir)
    states = incremental.file_states(before)
    now = incremental.merge_states(states, incremental.file_states(came), incremental.retracted(incremental.file_states(gone)))
    return before, before.where("not gone").unionByName(came), incremental.changes(states, now)


@register(_ORDERS + """SELECT coalesce(n.package_id, b.package_id) AS package_id, n.fingerprint AS fingerprint,
  CASE WHEN b.package_id IS NULL THEN 'added' WHEN n.package_id IS NULL THEN 'removed' WHEN b.fingerprint = n.fingerprint THEN 'same' ELSE 'changed' END AS change
FROM n FULL JOIN b ON b.package_id = n.package_id""")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's fingerprints are the snapshot's with the new files added and the gone ones retracted."""
    return _order_changes(spark, sf_dir)[2].select("package_id", "change", "fingerprint")


@register(_ORDERS + """SELECT n.package_id, n.n_files, CAST(n.total_size AS BIGINT) AS total_size, CASE WHEN b.fingerprint = n.fingerprint THEN 'before' ELSE 'now' END AS computed
FROM n LEFT JOIN b ON b.package_id = n.package_id""")
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now, changed = _order_changes(spark, sf_dir)
    return incremental.refresh(_sums(before, "before"), changed, now, lambda files: _sums(files, "now"))


@register("""WITH e AS (SELECT user_id, event_type, max(CASE WHEN ts < TIMESTAMP '2024-01-04 00:00:00' THEN 1 ELSE 0 END) AS done FROM events GROUP BY 1, 2),
c AS (SELECT user_id, sum(done) AS covered, count(*) AS total FROM e GROUP BY 1)
SELECT 'scan' AS step, 'rows' AS metric, count(*) AS value FROM events
UNION ALL SELECT 'scan', 'early', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-04 00:00:00'
UNION ALL SELECT 'operations', 'rows', count(*) FROM e UNION ALL SELECT 'operations', 'covered', CAST(sum(done) AS BIGINT) FROM e
UNION ALL SELECT 'clients', 'rows', count(*) FROM c UNION ALL SELECT 'clients', 'whole', count(*) FROM c WHERE covered = total""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of coverage, counted while the table of clients is written."""
    run, early = metrics.Run(), F.col("ts") < F.lit("2024-01-04").cast("timestamp")
    events = run.watch("scan", t(spark, sf_dir, "events").select("user_id", "event_type", "ts"), early=F.count_if(early))
    operations = run.watch("operations", events.groupBy("user_id", "event_type").agg(F.max(early.cast("int")).alias("done")), covered=F.sum("done"))
    clients = operations.groupBy("user_id").agg(F.sum("done").alias("covered"), F.count("*").alias("total"))
    cut(run.watch("clients", clients, whole=F.count_if(F.col("covered") == F.col("total"))))
    return run.table(spark)


@register("""WITH n AS (SELECT s_nationkey AS package_id, s_suppkey AS name, s_acctbal > 8000 AS is_client, s_suppkey % 4 AS priority FROM supplier),
e AS (SELECT a.package_id, a.name AS src, b.name AS dst, row_number() OVER (PARTITION BY a.package_id, a.name ORDER BY b.name DESC) AS ord FROM n a JOIN n b ON a.package_id = b.package_id AND a.name % 10 = b.name % 10 AND a.name <> b.name WHERE a.is_client),
f AS (SELECT package_id, dst, min({'src': src, 'ord': ord}) AS first FROM e GROUP BY 1, 2),
x AS (SELECT n.*, CASE WHEN is_client THEN 0 WHEN first IS NOT NULL THEN 1 ELSE priority + 2 END AS tier, CASE WHEN NOT is_client THEN first END AS place_of FROM n LEFT JOIN f ON f.package_id = n.package_id AND f.dst = n.name)
SELECT CAST(package_id AS VARCHAR) AS package_id, name, CAST(row_number() OVER (PARTITION BY package_id ORDER BY tier, place_of.src NULLS FIRST, place_of.ord NULLS FIRST, name) AS INTEGER) AS place FROM x""")
def client_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation, rich ones as clients, which refer to those with their last digit, the highest number first."""
    rows = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("package_id"), F.col("s_suppkey").alias("name"), (F.col("s_acctbal") > 8000).alias("is_client"), (F.col("s_suppkey") % 4).alias("priority"), (F.col("s_suppkey") % 10).alias("digit"))
    client = rows.where("is_client").select("package_id", "digit", F.col("name").alias("src"))
    edges = client.join(rows.select("package_id", "digit", F.col("name").alias("dst")), ["package_id", "digit"]).where("src <> dst").select("package_id", "src", "dst", (-F.col("dst")).alias("ord"))
    return packing.client_order(rows, edges).select("package_id", "name", "place")


@register(f"""WITH {_FILES}, g AS (SELECT f.package_id || '-' || f.p_size AS package_id, f.rel_path, f.p_size, CASE WHEN f.rel_path LIKE 'sdk/%' THEN 0 WHEN f.rel_path LIKE 'src/%' THEN 1 ELSE 2 END AS rank FROM files f),
b AS (SELECT *, min(rank) OVER (PARTITION BY package_id) AS best FROM g),
k AS (SELECT DISTINCT package_id FROM b WHERE rank = best AND p_size > 45 AND rel_path NOT LIKE 'tests/%' AND rel_path NOT LIKE 'samples/%' AND rel_path NOT LIKE 'node_modules/%'),
r AS (SELECT package_id FROM g UNION SELECT p_brand || '-' || (p_size + 25) FROM part)
SELECT package_id, CASE WHEN package_id NOT IN (SELECT package_id FROM g) THEN 'ROOT_NOT_FOUND' ELSE 'NO_PACKAGES_FOUND' END AS error_code FROM r WHERE package_id NOT IN (SELECT package_id FROM k)""")
def batch_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of a brand and a size; half of those asked for are beyond the largest size."""
    files = _files(spark, sf_dir).withColumn("package_id", F.concat_ws("-", "package_id", "size"))
    asked = t(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_size") + 25).alias("package_id"))
    return facade.batch_errors(files.select("package_id").unionByName(asked), files)


@register(f"""WITH {_FILES}, m AS (SELECT DISTINCT package_id, regexp_replace(rel_path, '/[^/]*$', '') AS root FROM files)
SELECT package_id, root, root LIKE 'tests/%' OR root LIKE 'samples/%' OR root LIKE '%/test' OR root LIKE '%/doc' AS auxiliary FROM m""")
def auxiliary_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _files(spark, sf_dir).select("package_id", F.regexp_replace("rel_path", "/[^/]*$", "").alias("root")).distinct()
    return roots.select("package_id", "root", detect.under_auxiliary(F.col("root")).alias("auxiliary"))
