import random
import re

import pytest
from pyspark.sql import functions as F

from apilattice.llm import url_cascade as U

URLS = [("http://a.org/x", "a.org", "/x", "org/", "allow"), ("https://EXAMPLE.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"), ("https://m.example.org/es/", "m.example.org", "/es/", "example.org/es/", "block"), ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("x://b.com/fr/y", "b.com", "/fr/y", "com/fr/", "allow"), ("x://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("x://b.com/de", "b.com", "/de", None, "allow"), ("x://s.ads-track.example.com#z", "s.ads-track.example.com", "", None, "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://org", "org", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://x.org?a/b", "x.org", "", None, "allow"), ("http://org/", "org", "/", "org/", "allow")]


@pytest.mark.parametrize("most", [U.MOST_BITS, 16])
def test_verdicts(spark, most, monkeypatch):
    monkeypatch.setattr(U, "MOST_BITS", most)
    rows = [(k, u[0]) for k, u in enumerate(URLS)] + [(0, URLS[0][0]), (None, "http://" + "a." * 5000 + "org/" + "p" * 100_000)]
    got = {r.page_id: tuple(r)[1:] for r in U.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert [got[k] for k in range(len(URLS))] == [u[1:] for u in URLS]
    assert got[None][2:] == ("org/", "allow")


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("inside"))
    listed, others = (U._hashed(keys.where(c)) for c in ("inside", "not inside"))
    made = U.build(listed, others, listed.count(), others.count())
    assert len(made.levels) > 1
    for part, want in ((listed, True), (others, False)):
        pdf = part.toPandas()
        assert (made.holds(pdf["a"].to_numpy(), pdf["b"].to_numpy()) == want).all()


def by_hand(url, rules, listed):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    under = lambda name: host == name or host.endswith("." + name)
    fits = []
    for action, rule in rules:
        name, _, start = rule.partition("/")
        if under(name) and path.startswith("/" + start):
            fits.append((len(rule), len(name), rule, action))
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if any(map(under, listed)) else "allow"


@pytest.mark.parametrize("most", [U.MOST_BITS, 2000])
def test_long_lists_as_tables(spark, most, monkeypatch):
    monkeypatch.setattr(U, "MOST_BITS", most)
    monkeypatch.setattr(U, "SEGMENT", 1 << 9)
    rnd = random.Random(6)
    name = lambda: ".".join(rnd.choice("abcde") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 4))) + "." + rnd.choice(["com", "org"])
    path = lambda: "".join("/" + rnd.choice("xyz") for _ in range(rnd.randint(0, 4)))
    rules = sorted({name() + "/" + path()[1:]: rnd.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(action, rule) for rule, action in rules] + [("allow", "com/x/y"), ("block", "a.com/x")]  # of equal length
    listed = sorted({name() for _ in range(300)})
    urls = [(k, f"http://{name()}{path()}{rnd.choice(['', '?q', '#f'])}") for k in range(2500)] + [(3000, "http://a.com/x/y"), (3001, None)]
    given = spark.createDataFrame(rules + [("block", None), rules[0]], "action string, rule string"), spark.createDataFrame([(x,) for x in [*listed, None, listed[0]]], "host string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(spark.createDataFrame(urls, "page_id bigint, url string"), *given).collect()}
    want = {k: by_hand(u, rules, listed) for k, u in urls}
    assert got == want and {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}
    assert got[3000][2:] == ("a.com/x", "block")


def test_no_lists(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert tuple(U.judge(df, [], []).first()) == (1, "a.org", "/", None, "allow")


def test_empty_and_clashing(spark):
    assert U.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []
    df = spark.createDataFrame([(1, "http://a.org/", "h", "p", "r", "v")], "page_id bigint, url string, host string, path string, rules string, verdict string")
    assert tuple(U.judge(df).first()) == (1, "a.org", "/", "org/", "allow")
