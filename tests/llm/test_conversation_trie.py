import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from apilattice.llm import conversation_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], ([], []))[0].append(c)
        nodes[turns][1].append(c)
    words = lambda s: len([w for w in s.translate(str.maketrans("\t\n\v\f\r", " " * 5)).split(" ") if w])
    kids = {p: 0 for p in nodes}
    total = {p: [0, 0] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            total[p[:d]][0] += not kids[p]
            total[p[:d]][1] += (len(nodes[p][0]) - 1) * words(p[-1][1]) if p else 0
    return sorted(((min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), kids[p], *total[p], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for p, (m, e) in nodes.items()), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "path": F.lit("x"), "conv": F.lit(2)})
    return sorted(map(tuple, T.trie(df).collect()), key=str)


def made(seed, n, texts=4):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]) if t else "user", rnd.choice(["a b", " c\td ", "e", "f g h", "f\u00a0g"][:texts]) if t else "hello all") for c in range(n) for t in range(rnd.randint(1, 6))]


@pytest.mark.parametrize("parts, fan, run_bytes", [(4, 4096, 1 << 20), (7, 4096, 200), (40, 16, 2000)])
def test_equals_brute_force(spark, monkeypatch, parts, fan, run_bytes):
    monkeypatch.setattr(T, "FAN", fan)
    monkeypatch.setattr(T, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(T, "PIECE", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = made(parts, 300)
        assert run(spark, rows) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_groups_of_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 10)
    rows = [(c, t, "user", text) for c in range(0, 400) for t, text in enumerate(["hi", "there", "now"])]
    rows += [(1000, t, "user", f"turn {t}") for t in range(700)] + [(1001, t, "user", f"turn {t}") for t in range(500)]
    rows += [(2000 + c, 0, "user", "hi") for c in range(150)]
    assert run(spark, rows) == by_hand(rows)


def test_edges(spark):
    rows = [(0, None, None, None), (0, 2, "user", ""), (0, 2, "user", ""), (None, 1, "user", "x"), (20, None, "user", "a"), (20, None, "user", "b"), (21, 1, "user", "c"), (45, 0, "u", "long " * 50_000), (-3, 1, "user", "neg"), (-23, 0, "user", "neg"), (7, 5, "us", "er"), (7, 6, "use", "r")]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows + rows) == by_hand(rows + rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_loser_tree_skips_shared_turns():
    rnd = random.Random(1)
    turn = [bytes([k]) * 16 for k in range(3)]
    paths = [b"".join(rnd.choice(turn) for _ in range(rnd.randint(0, 5))) for _ in range(200)]
    for k in (1, 2, 3, 5, 8, 13):
        runs = []
        for r in range(k):
            mine = sorted((p, i) for i, p in enumerate(paths) if i % k == r)
            runs.append([(p, i, T.shared(p, mine[j - 1][0]) if j else 0) for j, (p, i) in enumerate(mine)])
        got = list(T.LoserTree(runs))
        assert [x[:2] for _, x in got] == sorted((p, i) for i, p in enumerate(paths))
        assert [h for h, _ in got] == [0] + [T.shared(a[1][0], b[1][0]) for a, b in zip(got[:-1], got[1:])]
    assert list(T.LoserTree([])) == []
