import math
import random

import numpy as np
from pyspark.sql import functions as F

from apilattice.llm import embedding_lsh as L

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows):
    ok = [None if v is None or lab is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, lab in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k in range(n):
        if rows[k][0] is not None:
            low[find(k)] = min(rows[k][0], low.get(find(k), rows[k][0]))
    out = [(rows[k][0], links[k], low.get(find(k)), rows[k][0] is not None and rows[k][0] == low.get(find(k))) for k in range(n)]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "n_links": F.lit(1), "v": F.lit(2)})
    return sorted(map(tuple, L.near_duplicates(df).collect()), key=str)


def clustered(seed, n, noise):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(24)] for _ in range(6)]
    return [(k, [float(np.float32(x + rnd.gauss(0, noise))) for x in rnd.choice(centres)], rnd.randint(0, 1)) for k in range(n)]


def test_tight_clusters_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    rows = clustered(1, 200, 0.08)
    rows += rows[:20]
    assert run(spark, rows) == by_hand(rows)


def test_recall_near_the_threshold(spark):
    rows = clustered(2, 300, 0.22)
    got, want = run(spark, rows), by_hand(rows)
    assert sum(r[1] for r in want) > 500
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0])))


def test_edges(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 1.0], None), (6, [1.0, 1.0], 1), (7, [2.0, 2.0], 1), (7, [2.0, 2.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], 2), (9, [], 1), (10, [1.0, 1.0, 0.0], 1)]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == []


def test_extreme_doubles(spark):
    """Squares of these overflow or vanish; the second list's lengths fall into one cell of a label."""
    rows = [(1, [1e200, 2e200], 1), (2, [2e200, 4e200], 1), (3, [1e-200, 2e-200], 1), (4, [1e-200, 2e-200], 1), (5, [5e-324, 0.0], 1), (6, [1e308, 0.0], 1), (7, [1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(tuple, L.near_duplicates(df).collect()))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_lengths_that_share_a_cell(spark, monkeypatch):
    monkeypatch.setattr(L, "buckets", lambda x: np.zeros((len(x), L.TABLES), np.int32))
    rows = [(k, [1.0] * (2 + k % 3), 1) for k in range(12)]
    assert run(spark, rows) == by_hand(rows)
