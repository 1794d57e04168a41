import random

import pytest
from pyspark.sql import functions as F

from apilattice.llm import topk_search as T

SCHEMA = "vec_id bigint, embedding array<float>"


def by_hand(rows, k=5, every=3):
    import math

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    return sorted(map(tuple, T.search(df, F.col("vec_id") % 3 == 0, **kw).collect()))


@pytest.mark.parametrize("wave", [T.WAVE_BYTES, 2000])
def test_equals_brute_force(spark, wave, monkeypatch):
    monkeypatch.setattr(T, "WAVE_BYTES", wave)
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(k, [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]) for k in range(150)]
    rows = [(k, [float(__import__("numpy").float32(x)) for x in v]) for k, v in rows]
    assert run(spark, rows) == by_hand(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (9, [1.0]), (12, [2.0]), (15, []), (18, []), (21, [0.0, 0.0])]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_repeated_query_rows(spark):
    rnd = random.Random(8)
    rows = [(k, [float(rnd.randint(-3, 3)) for _ in range(6)]) for k in range(40)]
    rows += [rows[0], rows[3], (6, [1.0, 0.0, 2.0, 0.0, 0.0, 1.0]), rows[7], rows[7]]
    assert run(spark, rows) == by_hand(rows)
    found = [r for r in run(spark, rows) if r[0] == 0]
    assert sorted(r[1] for r in found) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


@pytest.mark.parametrize("first", [0, 3, 32])
def test_any_number_of_first_pivots(spark, first, monkeypatch):
    monkeypatch.setattr(T, "FIRST", first)
    rnd = random.Random(first)
    rows = [(k, [float(rnd.randint(-9, 9)) for _ in range(4)]) for k in range(120)]
    assert run(spark, rows) == by_hand(rows)


def test_large_components(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, 5.0]), (2, [-1e12, 5.0])]
    assert [(r[2], r[1]) for r in run(spark, rows)] == [(1, 1), (2, 2)]
