import html as html_lib
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.functions.html import with_page
from pagemill.functions.text import decode_entities, word_count
from pagemill.plans.extraction import analyze_columns, extract_articles, visible_words

RIVER = """<!doctype html><html lang="en"><body><div class="breadcrumbs"><p>Home &gt; Rivers</p></div>
<main id="river"><h1>Old <i>river</i> bridges</h1>
<h2>Building</h2><p>Stone came by boat.<br>Oak piles held it.</p>
<table><tr><td>span</td><td>12 m</td></tr></table>
<h2>FAQ</h2><p>Who paid? The town did.</p><ul><li>by toll</li><li>by tax</li></ul>
<h2>Repairs</h2><blockquote>Every spring.</blockquote><div class="promo newsletter"><p>Join our list.</p></div>
<h2>Conclusion</h2><p>They lasted.</p>
<ol><li>stone</li></ol></main>
<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"no"},{"@type":["NewsArticle","Thing"],"headline":"Bridges","author":[{"name":"R. Ode"}],
"datePublished":"2025-11-30","dateModified":"2025-12-02","articleSection":"Rivers","image":["https://r.org/b.jpg"],"keywords":["river","stone"]}]}</script>
<title>Bridges &mdash; Rivers</title><meta content="About 'bridges'" property="og:description"></body></html>"""

RIVER_BODY = (
    "[H2] Building\n\nStone came by boat. Oak piles held it.\nspan | 12 m\n\n[H2] FAQ\n\nWho paid? The town did.\n- by toll\n- by tax\n\n"
    "[H2] Repairs\n\n> \"Every spring.\"\n\n[H2] Conclusion\n\nThey lasted.\n1. stone"
)


def extract(spark, page, url="https://e.com/blog/x"):
    df = spark.createDataFrame([(url, page)], "url string, html string")
    return extract_articles(df).first()


def test_whole_page(spark):
    a = extract(spark, RIVER, "https://r.org/news/bridges")
    assert (a.title, a.meta_title, a.meta_description, a.h1) == ("Bridges", "Bridges \u2014 Rivers", "About 'bridges'", "Oldriverbridges")
    assert (a.author, a.author_url, a.category, a.tags) == ("R. Ode", None, "Rivers", ["river", "stone"])
    assert (a.published_date, a.modified_date, a.featured_image) == ("2025-11-30", "2025-12-02", "https://r.org/b.jpg")
    assert a.canonical_url == "https://r.org/news/bridges"
    assert a.introduction == "[H1] Oldriverbridges" and a.main_content == RIVER_BODY
    assert a.structured_content == f"[H1] Oldriverbridges\n\n\n{RIVER_BODY}"
    assert a.h2_headings == ["Building", "FAQ", "Repairs", "Conclusion"] and a.h3_headings == []
    assert a.faq_content == "Who paid? The town did.\n- by toll\n- by tax"
    assert a.conclusion == "[H2] Conclusion\n\nThey lasted.\n1. stone"
    assert a.word_count == len(a.structured_content.split()) and not a.quality_ok


def test_thin_page_has_warning(spark):
    a = extract(spark, "<html><body><article><h1>Empty</h1></article></body></html>")
    assert not a.quality_ok and a.word_count == 2 and len(a.warnings) == 1


@pytest.mark.parametrize("page, expected", [
    ("<main><p>" + "m " * 150 + "</p></main><div class=content><p>c</p></div>", "m " * 149 + "m"),
    ("<div class='my-content'><p>" + "s" * 210 + "</p></div><div id=content2><p>" + "l" * 250 + "</p></div>", "l" * 250),
    ("<div class='content'><p>short</p></div><p>other</p>", "short\nother"),
    ("<h2>First</h2><p>t</p>", "[H2] First\n\nt"),
    ("<p><b>x<br><p>y &ampz", "x\ny &z"),
    ("<p>a<script>var x='</p>'</script>b</p><p>c <!-- </p> --> d", "a b\nc d"),
    ("<body class='no-sidebar'><p>gone</p></body>", ""),
    ("<table><tr><td><p>cell</p><td>two</table><p>after</p>", "cell | two\nafter"),
    ("<ul><li>a<li>b</ul></div></section><p>stray ends</p>", "- a\n- b\nstray ends"),
    ("<p>1 < 2 && 3 > 2</p>", "1 < 2 && 3 > 2"),
])
def test_container_and_repair(spark, page, expected):
    df = spark.createDataFrame([("u", page)], "url string, html string")
    got = df.select(analyze_columns("html", "url", ("content",))["content"].alias("c")).first().c
    if expected:
        assert got.structured_content == expected
    else:
        assert got.structured_content == "" and got.main_content == ""


class _Shown(HTMLParser):
    """Plain model of the quick word count: texts outside the page shell."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "nav", "footer", "header")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "nav", "footer", "header")

    def handle_data(self, data):
        self.words += 0 if self.hidden else len(data.split())


def test_visible_words_match_plain_parser_on_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in visible_words(pages).join(pages.select("page_id", F.col("html").alias("h")), "page_id").collect():
        parser = _Shown()
        parser.feed(row.h)
        parser.close()
        assert row.visible_words == parser.words, row.page_id


def test_large_page_with_deep_nesting(spark):
    """Thousands of tags cross the fold's buffer limit several times."""
    n = 3000
    page = "<article>" + "".join(f"<p>para {i} <b>bold</b>" for i in range(n)) + "<ul>" + "<li>x" * n + "</ul></article>"
    c = extract(spark, page)
    lines = c.structured_content.split("\n")
    assert lines == [f"para {i} bold" for i in range(n)] + ["- x"] * n


def test_entities_and_words(spark):
    texts = ["a &amp;lt; b", "&#233;&#xE9;&eacute;", "&nbsp;x&copy;", "&bogus; &", "&notit;", "&#0;&#x110000;", "a b c  d\x1ce", "", "&amp &lt"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", decode_entities(F.col("t")).alias("d"), word_count(F.col("t")).alias("n")).orderBy("i").collect()
    for r, t in zip(rows, texts):
        assert r.d == html_lib.unescape(t), t
        assert r.n == len(t.split()), t


@pytest.mark.parametrize("script, field, value", [
    ('{"@type":["Thing","Article"],"author":[{"name":"L"}]}', "author", "L"),
    ('{"@graph":[{"@type":"Article","author":"S"}]}', "author", "S"),
    ('[{"@type":"Article","headline":"one"},{"@type":"NewsArticle","headline":"two"}]', "title", "two"),
    ('{"@type":"Article","keywords":["a ","b"]}', "tags", ["a", "b"]),
    ('{"@type":"Article","image":{"url":"o"}}', "featured_image", "o"),
    ('{"@type":"Article","image":["f"]}', "featured_image", "f"),
    ('{"@type":"Article","articleSection":["s","t"]}', "category", "s"),
    ('{"@type":"Product","headline":"no"}', "title", "H"),
    ('{bad', "title", "H"),
    ('{"@type":"Article","headline":""}', "title", "H"),
])
def test_json_ld_shapes(spark, script, field, value):
    page = f'<html><head><script type="application/ld+json">{script}</script></head><body><h1>H</h1><p class="Author-x">By</p></body></html>'
    df = spark.createDataFrame([("u", page)], "url string, html string")
    got = df.select(analyze_columns("html", "url", ("metadata",))["metadata"].alias("m")).first().m
    assert got[field] == value
    if field != "author":
        assert got.author == "By"


LONG = "<p>" + "long words " * 9 + "</p>"
SIGNALS = {
    "<p>x</p>": 0.5, f"{LONG}{LONG}": 0.5, f"{LONG}{LONG}{LONG}": 0.75, "<article>x</article>": 0.7, "<h1>a</h1><h2>b</h2>": 0.6, "<h1>a</h1>": 0.5,
    '<meta property="og:type" content="article">': 0.7, '<meta property="og:type" content="website">': 0.5,
    '<meta\n itemprop="x"\n name="pubdate"\n content="1">': 0.65, '<meta content="2025" property="article:published_time">': 0.65,
    '<script type="application/ld+json">{"@type":"Product"}</script>': 0.2, '<script type="application/ld+json">[{"@type":"Article"}]</script>': 0.9,
    '<script type="application/ld+json">{"@type":"Product","@type":"Article"}</script>': 0.9,
}


def test_each_signal_of_the_score(spark):
    rows = [("https://r.org/a/b", h) for h in SIGNALS] + [("https://r.org/blog/b", "<p>x</p>"), ("https://r.org/login", "<article>x</article>")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, html string")
    got = df.select("i", analyze_columns("html", "url", ("score",))["score"].alias("s")).orderBy("i").collect()
    assert [round(r.s.confidence, 9) for r in got] == [*SIGNALS.values(), 0.8, 0.05]
    assert [r.s.is_candidate for r in got] == [True] * (len(rows) - 1) + [False]


def test_repeated_json_keys_keep_the_last(spark):
    a = extract(spark, '<script type="application/ld+json">{"@type":"Article","headline":"first","headline":"last"}</script><h1>H</h1>')
    assert a.title == "last"


def test_elements_of_a_long_page_cost_no_square(spark):
    """A fold copies what it carries: 20,000 elements that a step carries along took minutes."""
    n = 10_000
    df = spark.createDataFrame([("<body>" + "<div><p>a</div>" * n,)], "html string")
    begin = time.perf_counter()
    elements = df.select(with_page(F.col("html"), lambda page: page.elements)).first()[0]
    assert time.perf_counter() - begin < 30
    assert [(e.open, e.close, e.n, e.kids, e.up, e.tag) for e in elements] == [
        (1, 3 * n + 2, 0, 2 * n, -1, "body"),
        *[x for i in range(n) for x in ((3 * i + 2, 3 * i + 4, 2 * i + 1, 1, 1, "div"), (3 * i + 3, 3 * i + 4, 2 * i + 2, 0, 3 * i + 2, "p"))],
    ]
