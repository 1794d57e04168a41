import random

import pytest
from pyspark.sql import functions as F

from apilattice.operators import incremental as inc
from apilattice.operators.metrics import Run

FILES = "package_id string, rel_path string, size bigint, mtime_ticks bigint"


def prints(states):
    return {r.package_id: r.fingerprint for r in inc.fingerprints(states).collect()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    return [(f"p{rnd.randint(0, 9)}", f"d/{k}.py", rnd.randint(0, 99), rnd.randint(0, 10**12)) for k in range(400)]


def test_order_parts_and_retraction_do_not_matter(spark, rows):
    whole = inc.file_states(spark.createDataFrame(rows, FILES))
    shuffled = inc.file_states(spark.createDataFrame(rows[::-1], FILES).repartition(7))
    assert prints(whole) == prints(shuffled) and len(set(prints(whole).values())) == 10
    extra = spark.createDataFrame(rows[:50], FILES)
    parts = inc.merge_states(inc.file_states(spark.createDataFrame(rows[:150], FILES)), inc.file_states(spark.createDataFrame(rows[100:], FILES)), inc.retracted(inc.file_states(spark.createDataFrame(rows[100:150], FILES))))
    assert prints(parts) == prints(whole)
    left = inc.merge_states(whole, inc.retracted(inc.file_states(extra)))
    assert prints(left) == prints(inc.file_states(spark.createDataFrame(rows[50:], FILES)))
    assert inc.merge_states(whole, inc.retracted(whole)).count() == 0


def test_any_field_counts_and_nulls_are_empty(spark):
    base = ("p", "a.py", 1, 2)
    others = [("p", "b.py", 1, 2), ("p", "a.py", 3, 2), ("p", "a.py", 1, 4), ("p", None, 1, 2), ("p", "a.py", None, 2), ("p", "a.py|1", 2, None)]
    seen = [prints(inc.file_states(spark.createDataFrame([r], FILES)))["p"] for r in [base, *others]]
    seen.append(prints(inc.file_states(spark.createDataFrame([base, base], FILES)))["p"])  # listed twice
    assert len(set(seen)) == len(seen)
    assert prints(inc.file_states(spark.createDataFrame([(None, "a", 1, 1)], FILES))) == {}
    assert prints(inc.file_states(spark.createDataFrame([], FILES))) == {}


@pytest.mark.parametrize("seed", range(3))
def test_refresh_equals_a_full_run(spark, rows, seed):
    rnd = random.Random(seed)
    now = [r if rnd.random() > 0.02 else (*r[:3], r[3] + 1) for r in rows if r[0] != "p3" and rnd.random() > 0.005] + [("new", "x.py", 1, 1)]
    compute = lambda files: files.groupBy("package_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("mtime_ticks").alias("ticks"))
    before, after = spark.createDataFrame(rows, FILES), spark.createDataFrame(now, FILES)
    changed = inc.changes(inc.file_states(before), inc.file_states(after))
    asked = []

    def watched(files):
        asked.extend(r.package_id for r in files.select("package_id").distinct().collect())
        return compute(files)

    got = inc.refresh(compute(before), changed, after, watched)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compute(after).collect()))
    kinds = {r.package_id: r.change for r in changed.collect()}
    old, new = ({p: sorted(r for r in x if r[0] == p) for p, *_ in x} for x in (rows, now))
    assert kinds == {p: "added" if p not in old else "removed" if p not in new else "same" if old[p] == new[p] else "changed" for p in {**old, **new}}
    assert sorted(asked) == sorted(p for p, k in kinds.items() if k in ("added", "changed"))


def test_metrics_equal_the_results_without_a_second_pass(spark, tmp_path):
    run, read = Run(), spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    scanned = run.watch("scan", spark.range(1000).mapInPandas(count, "id bigint"), odd=F.count_if(F.col("id") % 2 == 1))
    kept = run.watch("kept", scanned.where("id % 10 = 0"), top=F.max("id"))
    kept.write.parquet(str(tmp_path / "kept"))
    got = {(r.step, r.metric): r.value for r in run.table(spark).collect()}
    assert got == {("scan", "rows"): 1000, ("scan", "odd"): 500, ("kept", "rows"): 100, ("kept", "top"): 990}
    assert read.value == 1000
    with pytest.raises(ValueError, match="watched already"):
        run.watch("scan", scanned)


def test_metrics_of_nothing(spark):
    run = Run()
    assert run.watch("none", spark.range(0), top=F.max("id")).collect() == []
    assert {(r.metric, r.value) for r in run.table(spark).collect()} == {("rows", 0), ("top", 0)}
