import random

import pytest

from apilattice.llm import graph, ngram_join
from apilattice.llm.staging import n_written, release, table


def classes(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for a, b in links:
        if a != b:
            out.setdefault(find(a), set()).update((a, b))
    return sorted(map(sorted, out.values()))


def found(spark, links):
    df = table(spark.createDataFrame(links, "a bigint, b bigint"), "test-links")
    groups = {}
    for r in graph.components(df).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert all(label in nodes for label, nodes in groups.items())
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("links", [
    [],
    [(1, 1)],
    [(k, k + 1) for k in range(200)],  # a chain in the order of its ids
    [(0, k) for k in range(1, 300)] + [(500, 501)],  # a hub
    [(k, (k * 7) % 60) for k in range(60)] * 2,
    [(random.Random(k).randrange(400), random.Random(k + 1000).randrange(400)) for k in range(260)],
])
def test_components(spark, links):
    assert found(spark, links) == classes(links)


def test_rounds_grow_slowly(spark):
    before = n_written()
    found(spark, [(k, k + 1) for k in range(3000)])
    assert n_written() - before < 60  # two tables a round


def test_release_keeps_what_is_asked(spark):
    before = n_written()
    made = [table(spark.range(k + 1).toDF("a"), "test") for k in range(3)]
    release(before, but=1)
    assert n_written() == before + 1 and made[2].count() == 3
    with pytest.raises(Exception):
        made[0].count()


def test_more_ranges_than_partitions(spark, monkeypatch):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 40)))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "777")
    want = sorted(map(tuple, ngram_join.near_duplicates(df).collect()))
    assert spark.conf.get(name) == "777"
    spark.conf.unset(name)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 64)
    assert ngram_join._n_ranges(df.select("text")) > 100
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == want
