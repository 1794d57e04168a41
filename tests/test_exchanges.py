import shutil

import duckdb
from pyspark.sql import functions as F
from test_streaming import drain

from apilattice import registry
from apilattice.streaming import exchanges as X

REQUEST, RESPONSE = "id string, method string, ts timestamp", "id string, result string, error string, ts timestamp"


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def tables(spark, requests, responses):
    req = spark.createDataFrame([(i, m, None if t is None else at(t)) for i, m, t in requests], "id string, method string, ts string").withColumn("ts", F.to_timestamp("ts"))
    res = spark.createDataFrame([(i, r, e, at(t)) for i, r, e, t in responses], "id string, result string, error string, ts string").withColumn("ts", F.to_timestamp("ts"))
    return req, res


REQUESTS = [("1", "a", 0), ("2", "b", 0), ("3", "c", 1), ("4", "d", 2), ("5", "e", 3), ("5", "e", 3), ("6", "f", 30), (None, "g", 0), ("7", "h", None)]
RESPONSES = [("1", "ok", None, 1), ("1", "again", None, 2), ("2", "late", None, 9), ("3", None, "failed", 6), ("9", "lost", None, 1), ("4", "early", None, 1), ("6", "second", None, 33), ("6", "first", None, 31)]
WANT = {("1", "answered", "ok", None), ("2", "timeout", None, None), ("3", "answered", None, "failed"), ("4", "timeout", None, None), ("5", "timeout", None, None), ("6", "answered", "first", None)}


def found(rows):
    return {(r.id, r.status, r.result, r.error) for r in rows if r.id != "end"}


def test_batch(spark):
    rows = X.exchanges(*tables(spark, REQUESTS, RESPONSES)).collect()
    assert found(rows) == WANT and len(rows) == 6


def test_stream_equals_batch(spark, tmp_path):
    """Answers come before their requests, after them, twice, too late or never; an end far off lets all timeouts pass."""
    end = [[("end", "z", 600)], [("end", "z", 601)]], [[("end", "x", None, 600)], [("end", "x", None, 601)]]
    batches = [REQUESTS[:2], REQUESTS[2:6], REQUESTS[6:], *end[0]], [RESPONSES[:1] + RESPONSES[4:6], RESPONSES[1:4], RESPONSES[6:], *end[1]]
    for name, parts, k in (("req", batches[0], 0), ("res", batches[1], 1)):
        for part in parts:
            tables(spark, part if k == 0 else [], part if k == 1 else [])[k].coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    rows = drain(X.exchanges(stream("req", REQUEST), stream("res", RESPONSE), delay="20 minutes"), "exchanged")
    assert found(rows) == WANT and len([r for r in rows if r.id != "end"]) == 6


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert X.read_batches(spark, path).collect() == []
    X.write_batch(lines("a", "b"), 0, path)
    X.write_batch(lines("c"), 1, path)
    X.write_batch(lines("b", "a", "other"), 0, path)  # a replay, even with other rows
    assert sorted(map(tuple, X.read_batches(spark, path).collect())) == [("a", 0), ("b", 0), ("c", 1)]
    (tmp_path / "out" / "batch_id=1" / "_SUCCESS").unlink()  # stopped before its commit
    assert sorted(r.value for r in X.read_batches(spark, path).collect()) == ["a", "b"]
    X.write_batch(lines("c"), 1, path)
    assert sorted(r.value for r in X.read_batches(spark, path).collect()) == ["a", "b", "c"]


def test_sink_after_a_lost_commit(spark, tmp_path):
    """A stream whose commit log is lost runs its batches again; the folders stay as they were."""
    for k in range(3):
        spark.createDataFrame([(f"line {k}",)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        X.sink(stream, str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    first = sorted(map(tuple, X.read_batches(spark, str(tmp_path / "out")).collect()))
    assert sorted(v for v, _ in first) == ["line 0", "line 1", "line 2"]
    shutil.rmtree(tmp_path / "log" / "commits")
    run()
    assert sorted(map(tuple, X.read_batches(spark, str(tmp_path / "out")).collect())) == first


def test_of_two_answers_at_one_time_the_first_event_counts(spark, tmp_path):
    kinds = ["view", "signup", "click", "view", "error", "click"]
    rows = [(k, at(k // 3), kind) for k, kind in enumerate(kinds)]  # three events a minute, later ones of them before others by name
    made = spark.createDataFrame(rows, "event_id long, ts string, event_type string").select("event_id", F.to_timestamp("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    made.coalesce(1).write.parquet(str(tmp_path / "written"))
    shutil.copy(next((tmp_path / "written").glob("*.parquet")), tmp_path / "events.parquet")
    got = {int(r.id): r.result for r in registry.load()["message_exchanges"](spark, str(tmp_path)).collect()}
    assert got == {k: kinds[k + 1] if k < 5 else None for k in range(6)}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert got == {int(i): r for i, _, _, r in con.sql(registry.ORACLES["message_exchanges"]).fetchall()}
