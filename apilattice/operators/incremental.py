"""Indexes kept up to date: fingerprints of file sets that add up, and a refresh that computes changed packages only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = [f"lane{k}" for k in range(8)]


def file_states(files: DataFrame) -> DataFrame:
    """(package_id, n_files, lane0 to lane7): what a package's files(package_id, rel_path, size, mtime_ticks) add up to.

    A file's digest over path, size and ticks is cut into eight lanes of 32 bits, each summed over
    the package: no order is needed, nothing is gathered, and sums of parts merge.  A null counts
    as empty, a file listed twice counts twice, rows without a package are left out.  A package
    may have 2^31 files.
    """
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rel_path", "size", "mtime_ticks")])
    rows = files.where("package_id is not null").select("package_id", F.sha2(row, 256).alias("_digest"))
    lane = lambda k: F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("bigint")
    return rows.groupBy("package_id").agg(F.count("*").alias("n_files"), *[F.sum(lane(k)).alias(c) for k, c in enumerate(LANES)])


def retracted(states: DataFrame) -> DataFrame:
    """The states of files that have gone, to be merged with the rest."""
    return states.select("package_id", *[(-F.col(c)).alias(c) for c in ("n_files", *LANES)])


def merge_states(*parts: DataFrame) -> DataFrame:
    """The states of all files of several tables together; packages left without files have no row."""
    rows = parts[0].select("package_id", "n_files", *LANES)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(rows.columns))
    return rows.groupBy("package_id").agg(*[F.sum(c).alias(c) for c in ("n_files", *LANES)]).where("n_files > 0")


def fingerprints(states: DataFrame) -> DataFrame:
    """(package_id, fingerprint): 32 hex digits over the number of files and the lanes."""
    return states.select("package_id", F.left(F.sha2(F.concat_ws(",", "n_files", *LANES), 256), F.lit(32)).alias("fingerprint"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(package_id, change, fingerprint): added, changed, removed or same between two tables of states; null for removed ones."""
    old = fingerprints(before).withColumnRenamed("fingerprint", "_old")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("fingerprint").isNull(), "removed").when(F.col("_old") == F.col("fingerprint"), "same").otherwise("changed")
    return fingerprints(now).join(old, "package_id", "full").select("package_id", change.alias("change"), "fingerprint")


def refresh(index: DataFrame, changed: DataFrame, files: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index of today's files: rows of packages that stayed the same as they are, those of others from ``compute``.

    index and what ``compute`` makes of files have the same columns, package_id among them;
    ``changed`` comes from :func:`changes`.  ``compute`` sees the files of added and changed
    packages only; rows of removed packages go.
    """
    kept = index.join(changed.where("change = 'same'"), "package_id", "left_semi")
    todo = files.join(changed.where("change in ('added', 'changed')"), "package_id", "left_semi")
    return kept.unionByName(compute(todo).select(index.columns))
