"""Page text where scripts compare, articles nest and hosts have several templates."""

import pytest

from riskloom.llm.htmltext import blocks_of, extract_text, parsed, text_under


def texts(page):
    return [t for _, t, _ in blocks_of(page)]


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<script>if(a<b){g(\"it's\")}</SCRIPT >",
        "<script>x='</scripted>';y=i<n</script>",
        "<style>a<b{}</style>",
        "<textarea>a<b 'x</textarea>",
        "<script>'<!--'</script>",
        "<title>a<b</title>",
    ],
)
def test_raw_content_ends_at_its_end_tag(raw):
    page = f"<html><head>{raw}</head><body><article><h1>T</h1>{raw}<p>one {raw}two</p></article></body></html>"
    assert texts(page) == ["T", "one two"]
    assert text_under(page, "/html/body/article") == "T\none two"


def test_raw_content_without_end():
    assert texts("<p>a</p><script>for(i<n)</p> <p>b</p>") == ["a"]


LONG = "<p>many words of a long text</p>" * 20
LINES = "\n".join(["many words of a long text"] * 20)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>T</h1><p>lead</p><div class=body>{LONG}</div><section><p>end</p></section></article>", f"T\nlead\n{LINES}\nend"),
        (f"<div class=wrap><h1>T</h1><div class=body>{LONG}</div></div><div>x</div>", f"T\n{LINES}"),
        (f"<article><blockquote>{LONG}</blockquote><p>after</p></article>", f"{LINES}\nafter"),
        ("<article class='form-guide'><h1>T</h1><p>words</p></article>", "T\nwords"),
        ("<article class='search'><p>words</p></article>", "words"),
        ("<div class='side-story'><p>the story</p></div><div class='nav-menu'>a b</div>", "the story"),
        (f"<main><p>the story is told</p><div class=comments>{LONG}</div><article class=comment>me too</article></main>", "the story is told"),
        ("<ul><li>a<li>b</ul></div></p>stray", "a\nb\nstray"),
        ("", ""),
        ("<nav>a</nav>", ""),
    ],
)
def test_nothing_of_an_article_is_lost(page, text):
    assert text_under(f"<html><body><nav><a href=x>x</a></nav>{page}</body></html>", None) == text


def test_another_template_of_a_host_keeps_its_article(spark):
    usual = f"<body><div class=t12>{LONG}</div></body>"
    other = "<body><main><p>long article of another template</p></main><div class=t3><p>teaser</p></div></body>"
    rows = [(i, f"http://a.org/{i}", usual) for i in range(5)] + [(9, "http://a.org/9", other), (None, None, None), (None, None, None)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = sorted(((r.page_id, r.text, r.n_chars) for r in out), key=repr)
    want = [(i, LINES, len(LINES)) for i in range(5)] + [(9, "long article of another template", 32), (None, "", 0), (None, "", 0)]
    assert found == sorted(want, key=repr)


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    def peak(depth):
        tracemalloc.start()
        assert text_under("<div>" * depth + "deep" + "</div>" * depth, None) == "deep"
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(8000) < 3 * peak(4000)
    page = parsed("<div class=a1><div id=b>x</div></div>")
    assert page.name(page.blocks[0][0].path) == "/div.a/div" and page.number("/div.a/div") == 2 and page.number("/p") is None
