"""Cutting lineage through the folder that every machine of the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch where rows hold texts, so that a task's batches stay small.
BATCH_ROWS = 250

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is set only where none is and all runs on this machine (tests)."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(known)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows for each Arrow batch to BATCH_ROWS; batches of long texts are large.

    The setting stays, since Spark reads it when a lazy result runs.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextmanager
def smaller_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what runs inside, where texts are read only to write tables; then the setting is what it was."""
    before = spark.conf.get(_BATCH)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: replicated storage, no lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again (keeps column pruning)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def n_written() -> int:
    """How many tables are there to release; what is written later can be released alone."""
    return len(_written)


@atexit.register
def release(since: int = 0, but: int = 0) -> None:
    """Deletes the tables written after the first ``since``, without the last ``but``, when their results are no longer needed."""
    keep = _written[len(_written) - but :]
    gone = _written[since : len(_written) - but]
    _written[since:] = keep
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            return
