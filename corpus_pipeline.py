"""The corpus pipeline: toxicity, near duplicates, mixing, tokens; each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apilattice.llm import stages
from apilattice.llm.staging import n_written, release, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("mixing", stages.mix_sources),
    ("byte_bpe", stages.encode),
]

#: The trained stage and the token ids have no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token digests of the mix.  What a stage wrote on its way goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), n_written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"pipeline-{name}")
            release(before, but=1)
    return docs
