from collections import defaultdict

import pytest
from brute import taken as taken_by_hand
from brute import targets
from pyspark.sql import functions as F

from apilattice.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("rows", [
    [(k, "w " * (k % 37), f"s{k % 5}") for k in range(400)],
    [(k, "w " * 10, "hot" if k else "tiny") for k in range(200)] + [(900, "a b c", None)],
    [(1, "one two", "a"), (2, None, "b"), (3, "", None), (None, "x", "c")],
    [(1, None, "a")],
])
def test_targets_and_totals(spark, rows):
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1.001
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for found in by.values():  # whole epochs first: only one document may stop inside an epoch
        whole = [r for r in found if r.size and r.taken % r.size == 0]
        assert len([r for r in found if r.size]) - len(whole) <= 1


def test_equals_brute_force(spark):
    rows = [(k, f"{'word' if k % 3 else 'x'} " * (k % 41), None if k % 11 == 0 else f"s{k % 5}") for k in range(700)]
    rows += [(5000 + k, f"hot {k} " * 9, "s1") for k in range(300)] + [(None, "no id here", "s2"), (9000, None, "s2"), (9001, "", "only")]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text_hash", "taken").collect()
    from brute import xx

    assert sorted(map(tuple, got), key=str) == sorted(((i, xx(t), n) for i, t, n in taken_by_hand(rows)), key=str)


def test_reruns_ties_and_clashes(spark):
    rows = [(k % 3, "w " * 20, "a") for k in range(50)] + [(100 + k, "w " * 20, "b") for k in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "key": F.lit(2), "range": F.lit(3), "src": F.lit(4)})
    one, two = (sorted(map(tuple, mixing.mixed(d).collect())) for d in (df, df.repartition(7)))
    assert one == two
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_better_documents_come_first_more_often(spark):
    rows = [(k, "word " * 40 if k % 2 else "x " * 40, "a" if k < 1000 else "b") for k in range(2000)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).where("source = 'a'").collect()
    good = sum(r.taken > 0 for r in got if r.doc_id % 2)
    assert good > 1.3 * sum(r.taken > 0 for r in got if r.doc_id % 2 == 0)


def test_plan_is_native(spark):
    plan = mixing.mixed(spark.createDataFrame([(1, "a", "b")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
