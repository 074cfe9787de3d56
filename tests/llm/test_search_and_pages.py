"""Top-k against all products; page text against known pages."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import topk
from riskloom.llm.htmltext import extract_text, text_under
from riskloom.llm.topk import exact_top_k, nra_block, whole_vectors


def brute(ids, vectors, query_ids, queries, k):
    rows = []
    for q, v in zip(query_ids, queries, strict=True):
        scores = [(-int(v @ x), int(i)) for i, x in zip(ids, vectors, strict=True) if i != q]
        rows += [(int(q), r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows)


@pytest.mark.parametrize("kind", ["normal", "few values", "one vector", "long tail"])
def test_block(kind):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(700, 12)) * 30)
    if kind == "few values":
        x = np.sign(x)
    if kind == "one vector":
        x[:500] = x[0]
    if kind == "long tail":
        x[:, 0] += np.where(rng.random(700) < 0.05, 5000, 0)
    ids = np.arange(700) * 3
    got = nra_block(x[::7], ids[::7], x, ids, 20)
    want = [(q, i, s) for q, _, i, s in brute(ids, x, ids[::7], x[::7], 20)]
    assert sorted(got) == sorted(want)


def test_blocks_together(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (300, 5))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<int>")
    got = sorted(tuple(r) for r in exact_top_k(frame, frame.where("id % 5 = 0"), 7).collect())
    assert got == brute(np.arange(300), x, np.arange(0, 300, 5), x[::5], 7)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [-inf, 1.0], 1), (6, [0.5, 0.5], None),
            (7, [], 1), (None, [9.0, 9.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    whole = whole_vectors(table, "vec_id", F.col("embedding"))
    assert sorted(r.id for r in whole.collect()) == [0, 6, 7, 20]
    got = sorted(tuple(r) for r in exact_top_k(whole, whole.where("id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, 5), (0, 2, 6, 1), (20, 1, 0, 5), (20, 2, 6, 1)]
    assert exact_top_k(whole.where("false"), whole.where("false"), 20).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><div class="cookie-notice">ok?</div>
<article class="post-12"><h1>Head &amp; line</h1><p><b>Bold   text.<br><p>Second <i>para</i>graph &lt;b&gt; &copy; x &#233;</p><ul><li>one<li>two</ul>
<div class="comments"><p>first!</p></div><form><input> send</form></article><aside>more</aside><footer>foot</footer></body></html>"""
TEXT = "Head & line\nBold text.\nSecond paragraph <b> © x é\none\ntwo"


def test_known_page(spark):
    cut = "<html><body><header>h</header><main><p>" + "words and more words. " * 20
    plain = "just text, no markup"
    rows = [(1, "http://a.org/1", PAGE, "p"), (2, "http://a.org/2", PAGE, "p"), (3, None, cut, "p"), (4, "x", None, None), (5, "http://b.org", "", "p"),
            (None, "http://c.org", plain, "p"), (6, "http://d.org", "<p>a<p>b" * 3000, "p"), (7, "http://e.org", "<div " * 2000 + "<<>>", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert len(got) == len(rows)
    assert got[1].text == got[2].text == TEXT and got[1].n_chars == len(TEXT)
    assert got[3].text == ("words and more words. " * 20).strip()
    assert got[4].text == got[5].text == "" and got[None].text == plain
    assert got[6].text == "\n".join(["a", "b"] * 3000)
    assert extract_text(pages.where("false")).collect() == []


def test_path_that_a_page_lacks():
    assert text_under("<div><p>x</p></div>", "/article") == "x"
    assert text_under("<div><p>x</p></div><article>y</article>", "/article") == "y"


def test_given_pages(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    import html

    for r in extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", article))
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in want if b)
