import random
import re

import pytest

from apilattice.llm import ngram_join


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def by_hand(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(s), low.get(find(k), i) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["tea", "Zug", "né", "a,", "b.", "x", "yy", "run"]) + str(rnd.randint(0, 40))
    line = " ".join(word() for _ in range(30))
    base = [" ".join(word() for _ in range(rnd.choice([3, 7, 30, 120]))) for _ in range(12)]
    rows = []
    for k in range(90):
        text = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            text[rnd.randrange(len(text))] = word()
        rows.append((k, " ".join(text) + (f" {line}" if rnd.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed, rare", [(1, 8), (2, 1), (3, 3)])
def test_equals_all_pairs(spark, seed, rare, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = corpus(seed)
    assert run(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("bitmap, frequent", [(64, 3), (1 << 10, 0), (1 << 20, 40)])
def test_bounds_do_not_change_the_result(spark, monkeypatch, bitmap, frequent):
    monkeypatch.setattr(ngram_join, "RARE", 2)
    monkeypatch.setattr(ngram_join, "MOST_BITMAP", bitmap)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "MOST_BYTES", -1)
    rows = corpus(5)
    assert run(spark, rows) == by_hand(rows)


def test_edges(spark):
    long_ = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Two words"), (5, "two  WORDS"), (None, "two words"), (6, long_), (7, long_ + " more"), (7, long_ + " more"), (8, "a b a b a b a b"), (9, "a b a b a b a b a b")]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == []


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id bigint, text string, n bigint, component_id bigint, key bigint")
    assert ngram_join.near_duplicates(df).collect() == [(1, 1, 1)]


def test_a_thousand_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(600):
        text = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            text[rnd.randrange(60)] = f"z{rnd.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    assert run(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("rare", [8, 1])
def test_four_shingles_against_five(spark, monkeypatch, rare):
    """Eight words next to nine, and repetitive texts of four and five distinct shingles; with RARE = 1 all shared shingles are frequent."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rows = []
    for k in range(12):
        w = [f"{x}{k}" for x in "abcdefgh"]
        for text in (w, [*w, "end"], ["start", *w], [*w, *w[:4]]):
            rows.append((len(rows), " ".join(text)))
    four, five = "p q r s", "p q r s t"
    rows += [(100, f"{four} {four} {four}"), (101, f"{four} {four} {four} u"), (102, f"u {four} {four} {four}"), (103, f"{five} {five} {five}"), (104, f"{five} {five}"), (105, "p q r s p q r")]
    assert {len(shingles(t)) for _, t in rows} >= {3, 4, 5}
    assert run(spark, rows) == by_hand(rows)
