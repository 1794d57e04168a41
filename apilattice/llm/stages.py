"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.llm import bpe, mixing, ngram_join, toxicity
from apilattice.llm.staging import table

MOST_BROADCAST = 32 << 20


def _small(decisions: DataFrame) -> DataFrame:
    """A written table of decisions (id, text hash, ...), broadcast while it is small; else the join shuffles."""
    return F.broadcast(decisions) if decisions.count() * 48 <= MOST_BROADCAST else decisions


def _named(decisions: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``decisions`` under names that no column of ``docs`` has, and the names."""
    taken, names = {c.lower() for c in docs.columns}, []
    for c in decisions.columns:
        while c.lower() in taken:
            c += "_"
        names.append(c)
    return decisions.toDF(*names), names


def _same(docs: DataFrame, id_: str, th: str):
    return docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(th))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all columns, that are not predicted toxic; labels come from the table beside them.

    Null and empty texts have no votes and stay, as do null ids; equal rows share their fate;
    without toxic labels, or without documents, nothing is dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.trained(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, all columns: the smallest id, then the smallest text hash.

    A null id comes before all others.  Documents without words are in no group and stay.  Of
    rows with equal id and text one stays.
    """
    found = table(ngram_join.classes(docs).where("label is not null").select("label", "doc_id", "th"), "groups")
    first = table(found.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("first")), "group-firsts")
    mark = found.join(first, "label").groupBy("doc_id", "th")
    mark = mark.agg(F.max(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))).alias("stays"), F.count("*").alias("many"))
    mark, (id_, th, stays, _) = _named(table(mark.where("not stays or many > 1"), "group-marks"), docs)
    gone = _small(mark.where(~F.col(stays)).select(id_, th))
    kept = docs.join(gone, _same(docs, id_, th), "left_anti")
    again = mark.where(stays).select(id_, th)
    if again.isEmpty():
        return kept
    again = _small(again)
    once = kept.join(again, _same(kept, id_, th), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, _same(kept, id_, th), "left_anti").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, all columns: each as many times as the mix takes it, the last time whole.

    Equal rows share what the mix takes of them evenly, rounded up.  Null and empty texts have
    no words to take and are left out; null ids and null sources are taken like others.
    """
    times = F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))
    taken = mixing.mixed(docs).groupBy("doc_id", "text_hash").agg(F.ceil(F.avg(times)).cast("int").alias("times")).where("times > 0")
    taken, (id_, th, times) = _named(table(taken, "mix-times"), docs)
    taken = _small(taken)
    rows = docs.join(taken, _same(docs, id_, th))
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of the mix; null and empty texts have no tokens."""
    return bpe.digests(docs)
