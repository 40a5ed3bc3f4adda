import gzip
import ipaddress
import urllib.robotparser
from datetime import datetime

from pyspark.sql import functions as F

from pagemill.functions.urls import ARTICLE_HINT_RE, URL_RE, has_article_hint, is_pagination, resolve_link, url_path
from pagemill.operators import accounting, robots, safety
from pagemill.operators.ordering import first_per_key, number_rows
from pagemill.plans import discovery, export
from pagemill.plans.commits import KeyIndex, Store
from pagemill.sources import feeds, fetches, seeds, sitemaps
from pagemill.sources.links import page_links

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*locs):
    return f"<?xml version='1.0'?><urlset {NS}>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def test_sitemap_parsing(spark):
    bodies = [
        f"<urlset {NS}><url><loc> https://e.com/1 </loc><lastmod>2026-01-01</lastmod></url><url><loc>https://e.com/2</loc></url><url><loc></loc></url></urlset>",
        index("https://e.com/a.xml", "https://e.com/b.xml"), "<urlset <broken", "<urlset><url><loc>x</loc></url></urlset>",
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    rows = df.select("i", sitemaps.page_entries(F.col("body")).alias("p"), sitemaps.child_sitemaps(F.col("body")).alias("c")).orderBy("i").collect()
    assert [tuple(e) for e in rows[0].p] == [("https://e.com/1", "2026-01-01"), ("https://e.com/2", None)] and not rows[0].c
    assert rows[1].c == ["https://e.com/a.xml", "https://e.com/b.xml"] and not rows[1].p
    assert not rows[2].p and not rows[2].c and not rows[3].p


def test_gzip_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(urlset("https://e.com/z").encode()))
    got = sitemaps.read_sitemap_files(spark, str(tmp_path)).select(sitemaps.page_entries(F.col("body")).alias("p")).first()
    assert got.p[0].loc == "https://e.com/z"


def test_feed_links(spark):
    bodies = [
        "<rss><channel><link> https://e.com </link><item><link>https://e.com/a?x=1&amp;y=2</link></item><item><link><![CDATA[https://e.com/c]]></link></item></channel></rss>",
        '<feed><link href="https://e.com/b"/><!-- <link>no</link> --></feed>', "<rss><link>x</link>",
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    assert [(r.i, r.url) for r in feeds.feed_urls(df).orderBy("i", "pos").collect()] == [
        (0, "https://e.com"), (0, "https://e.com/a?x=1&y=2"), (0, "https://e.com/c")
    ]


def test_links(spark):
    page = "<a href=' x '>1</a><a>no</a><a href='mailto:a@b'>m</a><a href='#t'>t</a><A HREF=\"../y?a=1&amp;b=2\">2</A><a href=''>self</a>"
    df = spark.createDataFrame([("https://e.com/a/b", page)], "url string, html string")
    assert [r.link for r in page_links(df).orderBy("pos").collect()] == ["https://e.com/a/x", "https://e.com/y?a=1&b=2", "https://e.com/a/b"]


def walk_sitemaps(spark, files, robots_text=None, **options):
    sites = spark.createDataFrame([("a.org", "https://a.org")], "site string, base string")
    maps = spark.createDataFrame(files, "url string, body string")
    told = spark.createDataFrame([("a.org", robots_text)], "site string, body string") if robots_text else None
    return [r.url for r in discovery.expand_sitemaps(sites, maps, told, **options).orderBy("level", "ord", "pos").collect()]


def test_sitemap_walk_order(spark):
    """A file named by robots comes before the usual places; children come a round later; a file is opened once."""
    a = "https://a.org"
    files = [
        (f"{a}/hidden.xml", urlset(f"{a}/r1", f"{a}/r2")),
        (f"{a}/sitemap.xml", index(f"{a}/deep.xml", f"{a}/hidden.xml")),
        (f"{a}/blog-sitemap.xml", urlset(f"{a}/b1", f"{a}/r1")),
        (f"{a}/deep.xml", index(f"{a}/deeper.xml", f"{a}/sitemap.xml")),
        (f"{a}/deeper.xml", urlset(f"{a}/b1", f"{a}/d1")),
        (f"{a}/unnamed.xml", urlset(f"{a}/lost")),
    ]
    text = "User-agent: *\nSITEMAP: https://a.org/hidden.xml\n"
    assert walk_sitemaps(spark, files, text) == [f"{a}/{x}" for x in ("r1", "r2", "b1", "d1")]
    assert walk_sitemaps(spark, files) == [f"{a}/{x}" for x in ("b1", "r1", "r2", "d1")]
    assert walk_sitemaps(spark, files, text, max_urls=3) == [f"{a}/{x}" for x in ("r1", "r2", "b1")]


def test_sitemap_loop_and_many_urls(spark):
    """Two files that name each other end the walk; a site of 20,001 addresses keeps them all."""
    a = "https://a.org"
    many = [f"{a}/p{i}" for i in range(20_001)]
    files = [(f"{a}/sitemap.xml", index(f"{a}/x.xml")), (f"{a}/x.xml", index(f"{a}/sitemap.xml", f"{a}/y.xml")), (f"{a}/y.xml", urlset(*many))]
    assert walk_sitemaps(spark, files) == many


def crawl(spark, pages, **options):
    rows = [(u, 200, "text/html; charset=utf-8", "".join(f"<a href='{x}'>x</a>" for x in links)) for u, links in pages]
    sites = spark.createDataFrame([("a.org", "https://a.org", "a.org")], "site string, base string, root string")
    return discovery.crawl_links(sites, spark.createDataFrame(rows, "url string, http_status int, content_type string, html string"), **options)


def test_link_crawl_order(spark):
    """Home first, then index pages, then the pages they lead to, each opened once; articles are not opened."""
    a = "https://a.org"
    pages = [
        (a, [f"{a}/news/one", "/news/page/2", "/contact"]),
        (f"{a}/news", ["/news/two#top", f"{a}/news/one", "/news/page/2", "https://other.org/news/x"]),
        (f"{a}/news/page/2", ["/news/three", "/news/page/2", "/news/page/3"]),
        (f"{a}/news/page/3", ["/news/page/2", "/blog/four"]),
        (f"{a}/news/one", ["/news/never"]),
    ]
    order = lambda df: [r.url.removeprefix(a) for r in df.orderBy("level", "ord", "pos").collect()]
    assert [x for x in order(crawl(spark, pages)) if "page" not in x] == ["/news/one", "/news/two", "/news/three", "/blog/four"]
    assert [x for x in order(crawl(spark, pages, max_depth=1)) if "page" not in x] == ["/news/one", "/news/two", "/news/three"]
    assert order(crawl(spark, pages, max_urls=1)) == ["/news/one"]


def test_crawl_reads_only_html_answers(spark):
    sites = spark.createDataFrame([("a.org", "https://a.org", "a.org")], "site string, base string, root string")
    rows = [("https://a.org/blog", 404, "text/html", "<a href='/blog/x'>"), ("https://a.org/press", 200, "text/plain", "<a href='/blog/y'>"), ("https://a.org/news", 200, "text/html", "<a href='/blog/z'>")]
    got = discovery.crawl_links(sites, spark.createDataFrame(rows, "url string, http_status int, content_type string, html string"))
    assert [r.url for r in got.collect()] == ["https://a.org/blog/z"]


def test_new_urls_are_safe_without_addresses(spark):
    urls = ["http://localhost/a", "http://10.1.2.3/a", "ftp://e.com/a", "https://e.com/a", "https://e.com/a/"]
    found = spark.createDataFrame([("j", u, "sitemap", None, 0, 0, 0, i) for i, u in enumerate(urls)],
                                  "job_id string, url string, source string, lastmod string, rank int, level int, ord long, pos int")
    assert [r.raw_url for r in discovery.new_urls(found).collect()] == ["https://e.com/a"]


def test_sitemap_spellings(spark):
    body = "<url><loc>https://e.com/1</loc></url>"
    bodies = [
        f"\ufeff<?xml version='1.0'?><urlset {NS}>{body}</urlset>",
        "<sm:urlset xmlns:sm='http://www.sitemaps.org/schemas/sitemap/0.9'><sm:url><sm:loc>https://e.com/1</sm:loc></sm:url></sm:urlset>",
        f"<!DOCTYPE urlset [<!ELEMENT url ANY>\n<!ENTITY x 'y'>]><urlset {NS}>{body}</urlset>",
        f"<!DOCTYPE urlset><!-- c --><urlset {NS}>{body}</urlset>",
    ]
    other = ["<sm:urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sm:url><sm:loc>x</sm:loc></sm:url></sm:urlset>", "<a", "", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies + other)], "i int, body string")
    rows = df.select("i", sitemaps.page_entries(F.col("body")).alias("p")).orderBy("i").collect()
    assert [[e.loc for e in r.p] for r in rows[:4]] == [["https://e.com/1"]] * 4
    assert not any(r.p for r in rows[4:])


def test_feed_with_a_very_long_link_text(spark):
    long = "https://e.com/" + "x" * 1_000_000
    df = spark.createDataFrame([(0, f"<rss><channel><link>{long}</link><link><![CDATA[{long}]]></link></channel></rss>")], "i int, body string")
    assert [r.url for r in feeds.feed_urls(df).collect()] == [long, long]


def test_anchor_spellings(spark):
    forms = [
        '<a href="/1">', '<a  href="/2">', '<a\n   href="/3">', '<a class="b"  href="/4">', "<a class=b href=/5>", "<a download href='/6'>", '<a data-href="/no" href = "/7">',
        '<a\n class="x"\n title="a > b"\n href="/8"\n>', "<A HREF=/9 target=_blank>", '<a xhref="/no">', "<a name=href>", '<a ' + "y=1 " * 20_000 + 'href="/10">', "<a href>",
    ]
    df = spark.createDataFrame([("https://e.com/p", "".join(f"{f}t</a>" for f in forms))], "url string, html string")
    assert [r.link for r in page_links(df).orderBy("pos").collect()] == [f"https://e.com/{i}" for i in range(1, 11)] + ["https://e.com/p"]


def test_error_texts(spark):
    rows = [(0, ""), (0, None), (0, "Timeout"), (503, "x"), (200, "x")]
    got = fetches.fetch_results(spark.createDataFrame([(s, e, "h") for s, e in rows], "http_status int, error string, html string"))
    assert [r.error for r in got.collect()] == ["Unknown fetch error", "Unknown fetch error", "Timeout", "HTTP 503", None]


def test_robots_match_standard_library(spark):
    files = [
        "User-agent: *\nDisallow: /private\nAllow: /private/open\n", "User-agent: *\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n",
        "User-agent: moz\nDisallow: /x\nCrawl-delay: 7\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /y\n",
        "User-agent: a\n\nDisallow: /x\n", "User-agent: *\nDisallow:\n", "Disallow: /\n# c\nUser-agent: *\nfoo: bar\n  \nDisallow: /x # no\nDisallow: /q?a=1\n",
        "User-agent: *\nUser-agent: mozilla\nDisallow: /x\n\nUser-agent: Mozilla\nDisallow: /y\n", "User-agent: *\nDisallow: /%7Ex\nDisallow: *\nDisallow: /sp%20ace\n", "",
    ]
    paths = ["/", "", "/x", "/x/1", "/y", "/a/b/c", "/a/c", "/private/open", "/private", "/q?a=12", "/~x", "/sp ace/1", "/%78"]
    rows = [(f"https://h{i}.com", 200, body) for i, body in enumerate(files)] + [("https://gone.com", 404, "User-agent: *\nDisallow: /\n")]
    rules = robots.robots_rules(spark.createDataFrame(rows, "site_root string, http_status int, body string"))
    urls = [f"https://h{i}.com{p}" for i in range(len(files)) for p in paths] + ["https://gone.com/x", "https://none.com/x"]
    gated = robots.robots_gate(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    got = {r.url: r.allowed for r in gated.collect()}
    for i, body in enumerate(files):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        for p in paths:
            url = f"https://h{i}.com{p}"
            assert got[url] == parser.can_fetch(robots.USER_AGENT, url), (body, url)
    assert got["https://gone.com/x"] and got["https://none.com/x"]
    assert {r.site_root: r.crawl_delay for r in rules.collect()}["https://h2.com"] == 7.0


def test_safety(spark):
    ips = ["10.0.0.1", "8.8.8.8", "192.0.0.9", "192.0.0.8", "172.31.255.255", "172.32.0.0", "100.64.0.1", "::", "::2", "fe80::1", "2606:4700::1111",
           "2001:db8::1", "2001:20::1", "ff02::1", "1:2:3:4:5:6:7:8", "255.255.255.255", "224.0.0.1", "3000::1", "64:ff9b:1::1", "2002::1"]
    texts = ["1.2.3", "256.1.1.1", ":::", "1::2::3", "g::1", "1:2:3:4:5:6:7", "host", "01.2.3.4"]
    df = spark.createDataFrame([(x,) for x in ips + texts], "ip string")
    got = {r.ip: r.u for r in df.select("ip", safety.is_unsafe_ip(F.col("ip")).alias("u")).collect()}
    for text in ips:
        ip = ipaddress.ip_address(text)
        want = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
        assert got[text] == want, text
    assert [got[t] for t in texts] == [None] * len(texts)
    urls = ["http://localhost/b", "http://127.0.0.1/b", "http://0.0.0.0/b", "http://169.254.169.254/x", "ftp://e.com/b", "https:///x", "https://e.com/b",
            "https://E.com:8/b", "https://in.com/", "https://missing.com/", "http://[::1]:80/", "http://8.8.8.8/"]
    dns = spark.createDataFrame([("e.com", "93.184.216.34"), ("in.com", "93.184.216.34"), ("in.com", "10.0.0.5")], "host string, ip string")
    ok = safety.public_urls(spark.createDataFrame([(u,) for u in urls], "url string"), dns)
    assert {r.url for r in ok.collect()} == {"https://e.com/b", "https://E.com:8/b", "http://8.8.8.8/"}


def test_fetch_choice_and_attempts(spark):
    many = "w " * 90
    schema = "url string, html string, http_status int, error string"
    static = spark.createDataFrame([("a", many, 200, None), ("b", "thin", 200, None), ("c", "thin", 200, None), ("d", None, 404, "HTTP 404"), ("f", None, 0, "Timeout")], schema)
    rendered = spark.createDataFrame([("b", "drawn", 403, None), ("c", None, 0, "x"), ("d", None, 0, "y"), ("e", "r", 200, None)], schema)
    got = {r.url: (r.rendered, r.html) for r in fetches.choose_fetch(static, rendered, ["url"]).collect()}
    assert got == {"a": (False, many), "b": (True, "drawn"), "c": (False, "thin"), "d": (True, None), "e": (True, "r"), "f": (False, None)}
    tries = spark.createDataFrame([("a", 0, 500, None), ("a", 1, 200, "x"), ("a", 2, 200, "y"), ("b", 0, 500, None), ("b", 3, 0, None), ("b", 4, 200, "late")],
                                  "url string, attempt int, http_status int, html string")
    assert {r.url: r.attempt for r in fetches.final_attempts(tries, ["url"]).collect()} == {"a": 1, "b": 4}
    assert {r.url: r.attempt for r in fetches.final_attempts(tries, ["url"], max_retries=3).collect()} == {"a": 1, "b": 3}
    assert [r.backoff_seconds for r in fetches.with_backoff(tries.where("url = 'b'")).orderBy("attempt").collect()] == [1.0, 8.0, 10.0]


def test_hot_key_numbering_and_dedup(spark):
    """One key holds most rows: numbers stay exact and dedup keeps the first row."""
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    rows = number_rows(df, ["o"], "n", ["k"]).collect()
    for key in {r.k for r in rows}:
        part = sorted((r.o, r.n) for r in rows if r.k == key)
        assert [n for _, n in part] == list(range(1, len(part) + 1))
    first = {r.k: r.o for r in first_per_key(df, ["k"], [F.col("o")]).collect()}
    assert first == {k: min(r.o for r in rows if r.k == k) for k in first}


def test_progress_and_states(spark):
    rows = [(0, 5), (16, 1), (400, 9), (3, 5), (80, 5)]
    df = spark.createDataFrame(rows, "identified int, processed int").select("*", *accounting.progress_columns(F.col("identified"), F.col("processed")))
    assert [(r.remaining, r.progress_percent) for r in df.collect()] == [
        (max(i - p, 0), round(p / i * 100, 1) if i else 0.0) for i, p in rows
    ]
    fails = spark.createDataFrame([("j", "u")] * 4 + [("j", "v")] * 3, "job_id string, url string")
    urls = spark.createDataFrame([("j", x, "queued", 0) for x in "uvw"], "job_id string, raw_url string, status string, retry_count int")
    assert {r.raw_url: (r.status, r.retry_count) for r in accounting.url_status_from_log(urls, fails).collect()} == {
        "u": ("permanently_failed", 4), "v": ("failed", 3), "w": ("queued", 0)
    }


def test_csv_exports(spark, tmp_path):
    import csv

    extracted = spark.createDataFrame(
        [("j", "e.com", f"u{i}", f"https://e.com/{i}", 200, datetime(2026, 1, 3 - i), f'Post "{i}", x', "line\nbreak", 500, True) for i in range(2)],
        "job_id string, domain string, raw_url string, url string, http_status int, extraction_date timestamp, title string, structured_content string, word_count int, quality_ok boolean",
    )
    for name in ("canonical_url", "meta_title", "meta_description", "author", "author_url", "published_date", "modified_date", "category", "featured_image", "h1",
                 "introduction", "conclusion", "faq_content"):
        extracted = extracted.withColumn(name, F.lit(None).cast("string"))
    for name in ("tags", "h2_headings", "h3_headings", "warnings"):
        extracted = extracted.withColumn(name, F.array().cast("array<string>"))
    export.write_articles_csv(export.article_rows(extracted), str(tmp_path / "articles"))
    rows = []
    for part in sorted((tmp_path / "articles").glob("part-*.csv")):
        rows += list(csv.reader(part.open(newline="", encoding="utf-8")))
    header, body = rows[0], [r for r in rows if r[0] != "ID"]
    assert len(header) == 27 and header[4] == "Blog Title"
    assert [(r[0], r[4], r[19]) for r in body] == [("1", 'Post "1", x', "line\nbreak"), ("2", 'Post "0", x', "line\nbreak")]
    failures = spark.createDataFrame([("j", "https://e.com/broken", "Timeout", 0, 3, datetime(2026, 1, 1, 2, 3, 4, 500))],
                                     "job_id string, url string, error string, http_status int, retry_count int, timestamp timestamp")
    export.write_failures_csv(failures, str(tmp_path / "failed"))
    rows = [r for p in (tmp_path / "failed").glob("part-*.csv") for r in csv.reader(p.open(newline=""))]
    assert rows[:2] == [["URL", "Error", "HTTP Status", "Retry Count", "Timestamp"], ["https://e.com/broken", "Timeout", "0", "3", "2026-01-01T02:03:04.000500"]]


def test_seeds_are_dealt_out_and_resolved_like_links(spark):
    bases = ["https://a.com", "HTTP://A.b:80/x/y?z#f", "https://a.com/", "//h", "a/b", "", "mailto:x", " https://u@v.org\n", None, "https://a.com"]
    sites = spark.createDataFrame([(str(i), b) for i, b in enumerate(bases)], "site string, base string").coalesce(1)
    for made, paths in ((seeds.sitemap_seeds, seeds.SITEMAP_PATHS), (seeds.feed_seeds, seeds.FEED_PATHS), (seeds.index_seeds, [None, *seeds.INDEX_PATHS])):
        listed = F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("seq", "path")
        wanted = sites.select("site", "base", listed).select("site", "seq", F.coalesce(resolve_link(F.col("base"), F.col("path")), F.when(F.col("path").isNull(), F.col("base"))))
        rows = made(sites)
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, rows.select("site", "seq", "url").collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)
        assert "RoundRobinPartitioning" in rows._jdf.queryExecution().executedPlan().toString()
    relative = seeds.seed_urls(sites.where("site = '1'"), ["w/../v", "/p/../q", "?a", "/r#s"])
    assert [r.url for r in relative.orderBy("seq").collect()] == ["http://A.b:80/x/v", "http://A.b:80/q", "http://A.b:80/x/y?a", "http://A.b:80/r#s"]


def test_links_of_a_page_read_it_once(spark):
    html = "<A HREF='x#t'>&amp;</a><abbr href=no></abbr><a name=n href>e</a><a/href=y?b=1&amp;c>z</A href=no><!--<a href=no>--><a>no</a><a href='/..//z' href=no>"
    pages = spark.createDataFrame([("https://e.com/d/f?q", html), (None, html), ("https://e.com", None)], "url string, html string")
    found = page_links(pages)
    got = [(r.pos, r.href, r.link) for r in found.where("url is not null").orderBy("pos").collect()]
    assert got == [(0, "x#t", "https://e.com/d/x#t"), (1, "", "https://e.com/d/f?q"), (2, "y?b=1&c", "https://e.com/d/y?b=1&c"), (3, "/..//z", "https://e.com//z")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_a_url_is_taken_apart_once_for_its_verdict(spark):
    urls = spark.createDataFrame([("https://1.2.3.4/",), ("http://10.0.0.1:8/",), ("http://u@A.org/",), ("https://[::1]/",), ("https://b.org",), (None,), ("ftp://x",)], "url string")
    dns = spark.createDataFrame([("a.org", "10.0.0.1"), ("B.org", "8.8.8.8")], "host string, ip string")
    checked = safety.with_reject_reason(urls, dns)
    assert {r.url: r.reject_reason for r in checked.collect()} == {
        "https://1.2.3.4/": None, "http://10.0.0.1:8/": "Blocked internal/private IP: 10.0.0.1", "http://u@A.org/": "Blocked internal/private IP: 10.0.0.1",
        "https://[::1]/": "Blocked host: ::1", "https://b.org": None, None: None, "ftp://x": "Unsupported scheme: ftp"}
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(URL_RE + ", 3") <= 1


def test_crawl_looks_up_and_keeps_only_pages_that_can_be_met_again(spark, tmp_path, monkeypatch):
    """Seeds and articles fill neither the runs of seen pages nor the look-up; sites given twice count once."""
    a, asked, look_up = "https://a.org", [], KeyIndex.looked_up
    monkeypatch.setattr(KeyIndex, "looked_up", lambda self, rows: asked.extend(r.url for r in rows.collect()) or look_up(self, rows))
    pages = [(f"{a}/blog", [f"/blog/{i}" for i in range(5)] + ["/blog/page/2", "/contact"]), (f"{a}/blog/page/2", ["/blog/7", "/blog/page/2#x", "/blog"])]
    rows = [(u, 200, "text/html", "".join(f"<a href='{x}'>x</a>" for x in links)) for u, links in pages]
    sites = spark.createDataFrame([("a.org", a, "a.org")] * 2, "site string, base string, root string")
    store = Store(spark, str(tmp_path / "crawl"))
    found = discovery.crawl_links(sites, spark.createDataFrame(rows, "url string, http_status int, content_type string, html string"), store=store)
    assert [(r.url.removeprefix(a), r.level, r.ord, r.pos) for r in found.orderBy("level", "ord", "pos").collect()] == [
        *[(f"/blog/{i}", 0, 2, i) for i in range(5)], ("/blog/7", 1, 1, 0), ("/blog/page/2", 1, 1, 1)]
    assert asked == [f"{a}/blog/page/2"] * 2
    assert sum(store.open_part(p).count() for p in store.parts("links.seen.keys")) == 1
    assert store.read("links.seen").where("level = 0").count() == 17


def test_links_tested_before_they_are_rows(spark):
    """Plain links take a short way; every link gives what it gives on the long one, and tests say the same as on rows."""
    hrefs = [
        "/a", "/", "//x.org/b", "/.", "/./a", "/a/../b", "/a/.b", "/a//b", "/a?", "/a?q#", "/a#", "/a?b#c", "?x", "#f", "", " /s ", "b/c", "../d", "/t\tu", "/a\nb", "https://x.org", "HTTPS://X.org/a",
        "https://x.org/./a", "http://x.org//blog/", "https://x.org?blog", "https://blog/", "https:/blog/x", "https:blog/news/1", "/blog/x#/page/2", "x?/blog/", "http:///blog/a", "ftp://x/blog/", "/BLOG/é", "/blog/&amp;a",
        "https://x.org/a?page=2#t", "/q?paged=3", "news:/blog/a", "/a/..", "/a/.", "http://x.org/a/..", "https://x.org?", "https://x.org#", "https://x.org/ ",
    ]
    bases = ["https://e.com/p/q?r#s", "HTTP://E.com", "e.com/x", ""]
    anchors = "".join(f'<a href="{h}">' for h in hrefs) + "<a class=c href=/blog/plain><A HREF='/blog/big'><a href><a href=''><a hreflang='/blog/no'>"
    pages = spark.createDataFrame([(b, anchors) for b in bases], "url string, html string")
    plain = page_links(pages)
    every = plain.select("url", "pos", "href", "link", resolve_link(F.col("url"), F.col("href")).alias("long")).collect()
    assert len(every) > 100 and [(r.url, r.href, r.link) for r in every] == [(r.url, r.href, r.long) for r in every]
    hint = lambda u: F.rlike(url_path(u), F.lit(ARTICLE_HINT_RE))
    rows = plain.withColumn("link", F.substring_index("link", "#", 1)).withColumn("paging", is_pagination(F.col("link"))).withColumn("hinted", hint(F.col("link")))
    got = page_links(pages, tests={"paging": is_pagination, "hinted": has_article_hint})
    key = lambda r: (r["url"], r["pos"])
    assert sorted(got.collect(), key=key) == sorted(rows.where("paging OR hinted").collect(), key=key)
