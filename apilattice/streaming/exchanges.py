"""Requests with what became of them, timeouts included, and a sink that writes each batch of a stream once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

TIMEOUT = "5 minutes"


def exchanges(requests: DataFrame, responses: DataFrame, timeout: str = TIMEOUT, delay: str = TIMEOUT) -> DataFrame:
    """(id, method, sent, status, result, error, answered): a row for each of requests(id, method, ts), batch and streaming alike.

    The first of responses(id, result, error, ts) within the timeout answers it; of those at one
    time the one with the least ``ord``, where responses have that column.  Without one its status is ``timeout``.  On streams an outer interval join holds a request until both watermarks,
    ``delay`` behind the latest events, pass its timeout; rows that come later than that are dropped.
    Rows without id or time are left out; requests that agree in id, method and time are one.
    """
    left = requests.where("id is not null and ts is not null").select("id", "method", F.col("ts").alias("sent")).withWatermark("sent", delay)
    right = responses.where("id is not null and ts is not null").select(F.col("id").alias("r_id"), F.struct("ts", *(c for c in ("ord",) if c in responses.columns), "result", "error").alias("answer"), F.col("ts").alias("answered")).withWatermark("answered", delay)
    in_time = (F.col("id") == F.col("r_id")) & (F.col("answered") >= F.col("sent")) & (F.col("answered") <= F.col("sent") + F.expr(f"interval {timeout}"))
    first = left.join(right, in_time, "left_outer").groupBy("id", "method", "sent").agg(F.min("answer").alias("answer"))
    status = F.when(F.col("answer").isNull(), "timeout").otherwise("answered")
    return first.select("id", "method", "sent", status.alias("status"), "answer.result", "answer.error", F.col("answer.ts").alias("answered"))


def _written(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_batch(lines: DataFrame, batch_id: int, path: str) -> None:
    """Writes lines(value) as batch ``batch_id``, unless that batch is there; one that stopped half-way is written anew."""
    folder = f"{path.rstrip('/')}/batch_id={batch_id}"
    if not _written(lines.sparkSession, folder):
        lines.select("value").write.mode("overwrite").text(folder)


def sink(lines: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of lines(value) into a folder for each batch; the ledger is the commit mark of each folder, so a replay writes nothing twice."""
    return lines.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path)).option("checkpointLocation", checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """(value, batch_id) of the batches that are complete."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch_id=*/_SUCCESS"))
    folders = [f.getPath().getParent().toString() for f in found or []]
    if not folders:
        return spark.createDataFrame([], "value string, batch_id bigint")
    return spark.read.option("basePath", path).text(folders).select("value", F.col("batch_id").cast("bigint").alias("batch_id"))
