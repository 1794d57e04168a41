import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from apilattice.llm import queries
from apilattice.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def check(rows, got, components=32):
    """Holds the result against a plain eigendecomposition of the same vectors."""
    ok = [(i, v) for i, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in ok], np.int64)
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums).astype(float) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {i for i, _ in ok}
    deviation = ((n * x - sums).astype(object) ** 2).sum(axis=1)
    mine = np.array([[by[i][m + 1].whitened for m in range(k)] for i, _ in ok])
    for row, (i, _) in enumerate(ok):
        assert all(r.n == n and r.deviation == deviation[row] for r in by[i].values())
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-8
    assert got[0].identity_error < 1e-8
    assert np.allclose([by[ok[0][0]][m + 1].explained for m in range(k)], values[:k] / values.sum(), rtol=1e-9)
    want = c @ vectors[:, :k] / np.sqrt(values[:k])
    gaps = np.abs(values[:k, None] - values[None, :])
    gaps[np.arange(k), np.arange(k)] = np.inf
    for m in range(k):
        if gaps[m].min() > 1e-6 * values[0]:  # else the eigenvector is not determined
            sign = np.sign(mine[:, m] @ want[:, m])
            assert np.abs(mine[:, m] * sign - want[:, m]).max() < 1e-6


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumns({"n": F.lit(1), "v": F.lit("x"), "i": F.lit(0)})
    return W.whitened(df, **kw).collect()


def vectors(seed, n, d, decay):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * decay ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + 3
    return [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(x)]


@pytest.mark.parametrize("d, decay", [(64, 1.0), (64, 0.9), (12, 0.7), (33, 0.99)])
def test_equals_eigendecomposition(spark, d, decay):
    rows = vectors(d, 400, d, decay)
    check(rows, run(spark, rows))


def test_power_passes_stand_without_the_full_dimension(spark, monkeypatch):
    """Of 60 dimensions three vary much: the block of 12 finds them, and no pass takes the full dimension."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 3)) * [900, 500, 300] @ np.linalg.qr(rng.standard_normal((60, 3)))[0].T + rng.standard_normal((500, 60)) * 0.02
    rows = [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(x)]
    widths, plain = [], W._ritz

    def seen(fit, found, components):
        widths.append(fit.basis.shape[1])
        plain(fit, found, components)

    monkeypatch.setattr(W, "_ritz", seen)
    monkeypatch.setattr(W, "OVERSAMPLE", 9)
    check(rows, run(spark, rows, components=3), components=3)
    assert len(widths) > 1 and set(widths) == {12}
    widths.clear()
    rows = vectors(1, 300, 60, 1.0)
    check(rows, run(spark, rows, components=3), components=3)
    assert widths[-1] == 60


def test_edges(spark):
    rows = vectors(3, 50, 4, 0.8)
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0, 1.0]), (104, []), (105, [1e30, 0.0, 0.0, 0.0])]
    got = run(spark, rows)
    check(rows[:-1], got)
    assert run(spark, rows + [(None, [1.0, 2.0])]) and not [r for r in run(spark, rows + [(None, [1.0, 2.0])]) if r.vec_id is None]
    assert run(spark, []) == [] == run(spark, [(1, [1.0, 2.0])]) == run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    twice = run(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [0.0, 0.0])])
    assert sorted((str(r.vec_id), r.component, r.n, round(abs(r.whitened), 9)) for r in twice) == [("1", 1, 4, 1.0), ("1", 1, 4, 1.0), ("2", 1, 4, 1.0), ("None", 1, 4, 1.0)]


def test_lengths_are_fits_of_their_own(spark):
    short, long_ = vectors(1, 40, 2, 0.5), vectors(2, 60, 5, 0.5)
    long_ = [(1000 + i, v) for i, v in long_]
    got = run(spark, short + long_)
    check(short, [r for r in got if r.vec_id < 1000])
    check(long_, [r for r in got if r.vec_id >= 1000])


def test_large_values_stay_exact():
    x = np.array([[1 << 57, 3], [-(1 << 57), 5], [1 << 57, 5]], np.int64)
    fit = W.Fit(3, [int(v) for v in x.astype(object).sum(axis=0)])
    assert W.offsets(x, 3, fit.sums).tolist() == [[3 * int(v) - s for v, s in zip(row, fit.sums)] for row in x]
    assert W.deviations(x, fit) == [None] * 3
    small = np.array([[1 << 30, 3], [1, 5]], np.int64)
    fit = W.Fit(2, [(1 << 30) + 1, 8])
    assert W.deviations(small, fit) == [sum((2 * int(v) - s) ** 2 for v, s in zip(row, fit.sums)) for row in small]


def test_query_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op12_embedding_whitening"](spark, SF).collect())
