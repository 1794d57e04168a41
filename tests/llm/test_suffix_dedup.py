import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apilattice.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string"


def by_hand(rows, n=50):
    low = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - n + 1 if i is not None else 0):
            s = b[p : p + n]
            low[s] = min(low.get(s, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1 if i is not None else 0):
            if low[b[p : p + n]] < i:
                gone[p : p + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"th": F.lit(1), "part": F.lit("x"), "kind": F.lit(0), "pos": F.lit(2)})
    return sorted(map(tuple, S.deduplicated(df).collect()), key=str)


def prose(rnd, n, letters="abcdé ſ"):
    return "".join(rnd.choice(letters) for _ in range(n))


def made(seed):
    rnd = random.Random(seed)
    rows = [(k, prose(rnd, rnd.randint(0, 300))) for k in range(80)]
    passages = [prose(rnd, n) for n in (30, 49, 50, 51, 60, 75, 76, 77, 100, 250)]
    for k in range(80, 200):
        text = prose(rnd, rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            text += rnd.choice(passages) + prose(rnd, rnd.choice([0, 1, 5, 40]))
        rows.append((rnd.randint(0, 400), text))
    for k in range(30):  # near copies
        i, text = rows[rnd.randrange(len(rows))]
        at = rnd.randint(0, len(text))
        rows.append((500 + k, text[:at] + rnd.choice(["", "x", "yz"]) + text[at + 1 :]))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, flush, bucket", [(1, 1 << 17, 24 << 20), (2, 500, 400), (3, 50, 2000)])
def test_equals_brute_force(spark, monkeypatch, seed, flush, bucket):
    monkeypatch.setattr(S, "FLUSH", flush)
    monkeypatch.setattr(S, "FLUSH_HASHES", flush)
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(S, "STEP", 1 << 10)
    rows = made(seed)
    assert run(spark, rows) == by_hand(rows)


def test_a_very_common_passage_over_many_buckets(spark, monkeypatch):
    """Most documents hold one passage, each between words of its own; its runs are split by document."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 3000)
    rnd = random.Random(5)
    common = prose(rnd, 70)
    rows = [(k, prose(rnd, rnd.randint(0, 30)) + common + prose(rnd, rnd.randint(0, 30))) for k in range(150)]
    rows += [(1000 + k, common) for k in range(60)] + [(-5, "x" + common[:52])]
    assert run(spark, rows) == by_hand(rows)


def test_edges(spark):
    long_ = "0123456789" * 30
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, long_), (4, long_), (4, long_), (4, long_ + "x"), (5, long_[3:]), (6, "a" * 50), (7, "a" * 49), (8, "a" * 400), (9, "a\0b" * 40), (10, "\0" * 60), (11, "\0" * 80), (12, "q" + "\0" * 49), ((1 << 63) - 1, "a" * 60), (-(1 << 63), "\0b" * 30), (13, "é" * 25 + "z"), (14, "é" * 25)]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows + rows) == by_hand(rows + rows)
    for few in ([], [(None, None)], [(1, "x")]):
        assert run(spark, few) == by_hand(few)


def test_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 1 << 12)
    rnd = random.Random(9)
    long_ = prose(rnd, 40_000)
    rows = [(2, long_), (1, long_[9000:9400]), (3, long_[100:20_000] + "!" + long_[20_000:])]
    assert run(spark, rows) == by_hand(rows)


def test_every_string_has_its_anchor():
    rnd = random.Random(2)
    for n in (0, 10, 49, 50, 51, 200, 5000):
        raw = np.frombuffer(prose(rnd, n, "ab").encode(), np.uint8)
        at = np.array([0, n // 3, n])
        places, _ = S.anchors(raw, at)
        for lo, hi in zip(at[:-1], at[1:]):
            for p in range(lo, hi - 49):
                assert ((places >= p) & (places <= p + S.BEFORE)).any()


def test_multikey_sorts():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    assert (words[S.multikey(words)] == words[np.lexsort(words.T[::-1])]).all()
    assert len(S.multikey(words[:0])) == 0
