import hashlib
import random

import brute
import numpy as np
import pytest
import tiktoken
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from apilattice.llm import bpe, queries, stages

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(4)
    plain = ["w" + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: [rnd.choice(plain) for _ in range(n)]
    docs, labels = [], []
    for k in range(400):
        words = text(rnd.randint(30, 90))
        toxic = k % 6 == 0
        if toxic:
            words[3:5] = ["vileword", "nastyword"]
        docs.append((k, " ".join(words), "en", f"s{k % 4}", 0))
        labels.append((k, 1, int(toxic)))
    docs += [(1000 + k, docs[k + 1][1] + " end", "en", "s1", 0) for k in range(3)] + [(2000, docs[7][1], "en", "s0", 0), (3000, None, "en", None, None), (3001, "", None, "s2", 0)]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), docs


def test_stages_in_turn(spark, tables):
    where, docs = tables
    df = spark.read.parquet(f"{where}/documents.parquet")
    clean = stages.drop_toxic(spark, df, where)
    assert clean.columns == df.columns
    ids = {r.doc_id for r in clean.collect()}
    assert ids == {d[0] for d in docs if "vileword" not in (d[1] or "")}
    once = stages.one_of_each_group(spark, clean, where)
    assert once.columns == df.columns and {r.doc_id for r in once.collect()} == ids - {1000, 1001, 1002, 2000}
    mix = stages.mix_sources(spark, once, where)
    assert mix.columns == df.columns
    sizes = {r.doc_id: len((r.text or "").split()) for r in once.collect()}
    total = sum(sizes[r.doc_id] for r in mix.collect())
    assert abs(total - sum(sizes.values())) <= 4 * max(sizes.values())
    coded = stages.encode(spark, mix, where).collect()
    enc = tiktoken.Encoding("t", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    texts = {d[0]: d[1] or "" for d in docs}
    for r in coded:
        raw = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
    want = sorted((r.doc_id, r.ids_sha256) for r in coded)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, where).collect()) == want


@pytest.mark.parametrize("which", ["made", SF])
def test_run_equals_plain_python(spark, tables, which):
    where = tables[0] if which == "made" else which
    docs = [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    want = [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest()) for i, ids in brute.pipeline(docs, labels)]
    got = corpus_pipeline.run(spark, where).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_clashing_names_and_nulls(spark, tables):
    where, docs = tables
    df = spark.createDataFrame([docs[1], docs[2], docs[3], (None, None, None, None, None), (None, docs[4][1], "en", None, 3), (7000, "", "en", "s1", 0), (7001, "long word " * 50_000, "en", "s1", 0)], DOCS)
    for name in ("k_id", "k_th", "k_times", "k_time", "doc_id_", "th", "th_", "times", "label", "size", "stays", "score", "id"):
        df = df.withColumn(name, F.lit(1))
    for stage in (stages.drop_toxic, stages.one_of_each_group, stages.mix_sources):
        made = stage(spark, df, where)
        assert made.columns == df.columns
        rows = made.collect()
        assert len(stages.encode(spark, made, where).collect()) == len(rows)
    assert stages.drop_toxic(spark, df, where).count() == 7 == stages.one_of_each_group(spark, df, where).count()
    for stage in (stages.drop_toxic, stages.one_of_each_group, stages.mix_sources, stages.encode):
        assert stage(spark, df.limit(0), where).count() == 0


def test_repeated_rows_and_empty(spark, tables):
    where, docs = tables
    df = spark.createDataFrame([docs[1], docs[1], docs[2], docs[2], docs[2], (None, docs[3][1], None, None, None)], DOCS)
    assert stages.one_of_each_group(spark, df, where).count() == 3
    for stage in (stages.one_of_each_group, stages.mix_sources, stages.encode):
        assert stage(spark, df.limit(0), where).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
