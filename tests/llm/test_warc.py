import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from apilattice.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def trip(spark, rows, **kw):
    return [r.asDict() for r in warc.read(warc.write(spark.createDataFrame(rows, SCHEMA), **kw)).orderBy("page_id").collect()]


def test_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ \n", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 200_000), (9, "u", "same"), (9, "u", "same")]
    got = trip(spark, rows)
    assert all(r["error"] is None for r in got)
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", None), (5, "response", None), (9, "response", None), (9, "response", None)]
    assert [r["payload_bytes"] for r in got] == [4, 4, 0, 0, 400_000, 4, 4]
    assert got[4]["payload"] == ("é" * 200_000).encode() and got[0]["payload_digest"] == warc.digest(b"same")


def test_small_payloads_may_stay_responses(spark):
    assert {r["record_type"] for r in trip(spark, [(1, "u", "x"), (2, "u", "x")], revisit_from=2)} == {"response"}


def test_nulls_and_empty(spark):
    assert trip(spark, []) == []
    got = trip(spark, [(None, None, "x"), (None, None, "x")])
    assert [(r["page_id"], r["record_type"]) for r in got] == [(None, "response")] * 2


def test_dictionary_frame():
    raw = warc.dictionary([b"<p>%d some words of a page</p>" % k * 20 for k in range(300)])
    one = warc.record(7, "u", b"<p>8 some words of a page</p>", None)
    dict_ = zstd.ZstdCompressionDict(raw)
    body = zstd.ZstdCompressor(dict_data=dict_).compress(one)
    for lead in (warc.skippable(raw), warc.skippable(zstd.ZstdCompressor().compress(raw))):
        (r,) = warc.records(lead + body)
        assert r["error"] is None and r["page_id"] == 7


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"XARC/1.1"), lambda r: r.replace(b"Content-Length: 5\r\n", b"Content-Length: 6\r\n"), lambda r: r[:-1], lambda r: r.replace(b"hello", b"hallo"), lambda r: r.replace(b"WARC-Date", b"WARC-Dato"), lambda r: r.replace(b"WARC-Type: ", b"WARC-Type ")])
def test_checks(change):
    frame = zstd.ZstdCompressor().compress(change(warc.record(1, "u", b"hello", None)))
    (r,) = warc.records(frame)
    assert r["error"]


def test_broken_frames():
    good = zstd.ZstdCompressor().compress(warc.record(1, "u", b"hello", None))
    assert [bool(r["error"]) for r in warc.records(good + good[:-4])] == [False, True]
    assert [bool(r["error"]) for r in warc.records(b"not an archive")] == [True]


def test_a_damaged_archive_stops_the_query(spark):
    good = zstd.ZstdCompressor().compress(warc.record(1, "u", b"hello", None))
    bad = zstd.ZstdCompressor().compress(warc.record(2, "u", b"hello", None).replace(b"hello", b"hallo"))
    made = lambda *frames: spark.createDataFrame([("one", bytearray(b"".join(frames)))], "archive string, content binary")
    assert [r.page_id for r in warc.sound(warc.read(made(good))).select("page_id").collect()] == [1]
    for frames in ((good, bad), (good, good[:-4])):
        with pytest.raises(Exception, match="a broken record: one: "):
            warc.sound(warc.read(made(*frames), payloads=False)).select("page_id").collect()


def test_query_on_whole_pages(spark):
    import base64
    import hashlib

    from apilattice.llm import queries

    where = "/root/testdata/sf0.01"
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{where}/pages.parquet").collect()]
    last = {}
    for page, html in pages:
        last[html] = max(page, last.get(html, page))
    want = [(page, len(html), base64.b32encode(hashlib.sha1(html).digest()).decode(), "response" if last[html] == page else "revisit", None if last[html] == page else last[html]) for page, html in pages]
    assert sorted(map(tuple, queries.QUERIES["op3_warc_zstd"](spark, where).collect())) == sorted(want)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "x", "s", 3)], SCHEMA + ", sha string, bytes bigint").withColumn("first", F.lit(1))
    assert warc.read(warc.write(df)).count() == 1
