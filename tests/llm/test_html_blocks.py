import html
import re
import time

import numpy as np
import pytest
from hand_pages import HAND

from apilattice.llm import html_blocks as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">home</a></li><li><a href="/b">news</a></li></ul></nav><!-- ad --><div class="ad">buy</div>
<article><h1>Title &amp; more</h1><p><b>First   para<br><p>Sec&eacute;nd <i>in</i>line.</p><div class="ad">advert here</div></article>
<div id="comments" class="comments"><p>nice post</p></div><footer>&copy; site</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return H.trained()


def texts(page):
    return [b[1] for b in H.blocks(page, H._Paths())]


def test_blocks():
    assert texts(PAGE) == ["T", "home", "news", "buy", "Title & more", "First para", "Secénd inline.", "advert here", "nice post", "© site"]
    assert texts("") == [] and texts("plain") == ["plain"]
    assert texts('<p data-x="a>b">x<p>y') == ["x", "y"]
    assert texts("<p>a</div>b<script>no") == ["a", "b"]
    assert texts("a < b <!-- open") == ["a < b"]
    assert texts("<p class='x>y") != ["<never>"]


def test_held_out_pages(model):
    made = list(H.generated(150, 12345))
    xs = H.features([b for b, _, _ in made], made[0][2])
    right = total = 0
    for x, (_, y, _) in zip(xs, made):
        if len(x):
            got = model.scores(*H.padded([x]))[:, 0] >= 0.5
            right, total = right + int((got == np.array(y)).sum()), total + len(y)
    assert right / total > 0.97


def test_padding_does_not_matter(model):
    made = list(H.generated(6, 5))
    xs = [x for x in H.features([b for b, _, _ in made], made[0][2]) if len(x)]
    together = model.scores(*H.padded(xs))
    for k, x in enumerate(xs):
        assert np.allclose(model.scores(*H.padded([x]))[:, 0], together[: len(x), k], atol=1e-5)


def test_training_repeats():
    one, two = H.trained.__wrapped__(40, 1), H.trained.__wrapped__(40, 1)
    assert all((one.w[k] == two.w[k]).all() for k in one.w)


def test_extract(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (1, "u", PAGE), (4, "u", "<article><p>" + "word " * 60_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", H.F.lit("clash")).withColumn("n_chars", H.F.lit(0))
    got = {r.page_id: r for r in H.extract(df, model).collect()}
    assert got[1].text == got[None].text == "Title & more First para Secénd inline."
    assert got[1].n_chars == len(got[1].text) and (got[2].text, got[3].n_chars) == ("", 0)
    assert H.extract(df.limit(0), model).collect() == []


@pytest.mark.parametrize("k", range(len(HAND)))
def test_hand_written_pages(model, k):
    page, want = HAND[k]
    assert H.main_texts(model, [page]) == [want]


def test_query_on_whole_pages(spark):
    """Every page of the table has one article, and all of it is main text."""
    from apilattice.llm import queries

    where = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    got = queries.QUERIES["op7_html_block_lstm"](spark, where).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner.group(1))).split()) if inner else ""
        assert (r.text, r.n_chars) == (want, len(want))


def test_deep_markup(model):
    assert isinstance(H.main_texts(model, ["<div>" * 3000 + "x" + "<p>y" * 300])[0], str)
    began = time.perf_counter()
    paths = H._Paths()
    assert len(H.blocks("<div>" * 100_000 + "x" + "</p>" * 100_000 + "<li>y" * 100_000 + "</td></div>" * 100_000, paths)) == 100_001
    assert time.perf_counter() - began < 20 and len(paths.vectors) < 50


def test_closing_and_implied_ends():
    paths = H._Paths()
    path = lambda page: [(b[1], b[0]) for b in H.blocks(page, paths)]
    assert path("<ul><li>a<li>b</ul>c") == path("<ul><li>a</li><li>b</li></ul>c")
    assert path("<ul><li>a<ul><li>b</ul><li>c</ul>") == path("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>")
    assert path("<table><tr><td>a<td>b<tr><td>c</table>") == path("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert path("<div><p>a</div>b</div>c") == path("<div><p>a</p></div>b c".replace("b c", "b<div></div>c"))


def test_huge_pages_in_pieces(model, monkeypatch):
    paths = H._Paths()
    page = H.blocks("".join(H._Writer(__import__("random").Random(k)).page() for k in range(30)).replace("\x01", ""), paths)
    whole = model.scores(*H.padded(H.features([page], paths)))[:, 0]
    monkeypatch.setattr(H, "MOST_BLOCKS", 37)
    assert len(page) > 300 and np.allclose(model.long_scores(page, paths), whole, atol=1e-4)
