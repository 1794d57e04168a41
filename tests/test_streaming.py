import json

from pyspark.sql import functions as F

from apilattice.streaming import messages, objects, sessions


def drain(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_messages_from_a_stream(spark, tmp_path):
    lines = ['{"id": 1, "method": "initialize"}', "", "{broken", '{"id": "1", "result": {}}', '{"method": "session/update"}', '{"other": 1}']
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    got = drain(messages.dispatch(messages.parse(messages.read_lines(spark, str(tmp_path)))), "msgs")
    assert sorted((r.kind, r.id, r.side) for r in got if r.id) == [("request", "1", "agent"), ("response", "1", None)]
    assert [r.side for r in got if r.kind == "notification"] == ["client"]


def test_correlation(spark):
    req = spark.createDataFrame([("1", "a", "2024-01-01 00:00:00"), ("2", "b", "2024-01-01 00:00:00")], "id string, method string, ts string").withColumn("ts", F.to_timestamp("ts"))
    res = spark.createDataFrame([("1", "ok", None, "2024-01-01 00:01:00"), ("2", "late", None, "2024-01-01 00:09:00"), ("3", "lost", None, "2024-01-01 00:00:01")], "id string, result string, error string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.id, r.result) for r in messages.correlate(req, res).collect()] == [("1", "ok")]


def pieces(text, n):
    return [text[k : k + n] for k in range(0, len(text), n)]


def test_scanner_across_chunks():
    want = [{"a": "}{\"x"}, {"b": {"c": [1]}}]
    text = "```json\n" + ",\r\n".join(map(json.dumps, want)) + "\n{bad}\n```"
    for n in (1, 3, 1000):
        s = objects.Scanner()
        assert [json.loads(j) for c in pieces(text, n) for j in s.feed(c)] == want


def test_object_stream(spark, tmp_path):
    rows = [("s", k, c) for k, c in enumerate(pieces('{"a": 1}x{"b": "}"}', 4))]
    batch = spark.createDataFrame(rows, "stream_id string, seq int, chunk string")
    assert [r.json for r in objects.objects(batch).collect()] == ['{"a": 1}', '{"b": "}"}']
    for k in range(2):
        batch.where(f"seq % 2 >= 0 and (seq < 2) = {str(k == 0).lower()}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r.json for r in drain(objects.stream_objects(stream), "objs")) == ['{"a": 1}', '{"b": "}"}']


def test_sample_arrays(spark):
    rows = spark.createDataFrame([('[{"name": "a", "code": "c"}]',), ("nonsense",), ('```json\n[{"name": "b"}]\n```',)], "response string")
    got = objects.array_samples(rows).collect()
    assert [r.needs_correction for r in got] == [False, True, False] and got[2].samples[0].name == "b"


def test_sessions(spark, tmp_path):
    texts = ["hello", "nope", "/sdk", "", "99", "", "yes", "thanks", "more"]
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)] + [("t", 0, "cancel")], "session_id string, seq bigint, text string")
    want = ["AwaitingSdkPath", "AwaitingSdkPath", "AwaitingOutputFolder", "AwaitingSampleCount", "AwaitingSampleCount", "AwaitingPromptConfirmation", "AwaitingSamples", "Complete", "Complete"]
    assert [r.state for r in sessions.sessions(rows).where("session_id = 's'").orderBy("seq").collect()] == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(sessions.stream_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "sess")
    assert [r.state for r in sorted(got, key=lambda r: r.seq) if r.session_id == "s"] == want
