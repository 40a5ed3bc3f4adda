from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import urls as U

# Address and its normal form, written down by hand.
NORMAL_FORMS = {
    "https://news.site.org/a/b/": "https://news.site.org/a/b",
    "HTTP://WWW.Site.org:8080/A/?b=2&a=1&b=1#frag": "http://site.org/A?a=1&b=1&b=2",
    "https://www.site.org?utm_medium=mail&fbclid=z&q=1": "https://site.org/?q=1",
    "https://site.org": "https://site.org/",
    "https://site.org//": "https://site.org/",
    "  https://site.org/a b/ ": "https://site.org/a b",
    "https://site.org/?Ref=2": "https://site.org/",
    "https://site.org/x?q=a+b&r=%7E%zz*&s&&t=é": "https://site.org/x?q=a+b&r=~%25zz%2A&s=&t=%C3%A9",
    "//host/path/": "https://host/path",
    "ftp://site.org/y?a=%20": "ftp://site.org/y?a=+",
}


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [r.x for r in df.select("i", fn(F.col("url")).alias("x")).orderBy("i").collect()]


def test_normal_forms(spark):
    got = apply(spark, list(NORMAL_FORMS), U.normalize_url)
    assert got == list(NORMAL_FORMS.values())
    assert apply(spark, got, U.normalize_url) == got


def test_pairs_that_must_be_equal(spark):
    pairs = [("https://e.com/b/t/", "https://e.com/b/t"), ("https://www.e.com/t?utm_source=f&id=1", "https://e.com/t?id=1"),
             ("https://e.com", "https://e.com/")]
    left, right = zip(*pairs)
    assert apply(spark, left, U.normalize_url) == apply(spark, right, U.normalize_url)


HOSTS, PATHS = st.from_regex(r"\Ahttps?://[a-z]{1,5}\.com\Z"), st.from_regex(r"\A(/[a-z.~]{1,4}){0,3}\Z")
PAIRS = st.lists(st.tuples(st.from_regex(r"\A[a-z]{1,3}x\Z"), st.from_regex(r"\A[a-z0-9]{0,3}\Z")), max_size=3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(HOSTS, PATHS, PAIRS), min_size=20, max_size=40))
def test_what_does_not_change_the_normal_form(spark, parts):
    """Order of parameters, fragment, closing slash, www and port say nothing; the form is its own form."""
    plain = [f"{h}{p}?" + "&".join(f"{k}={v}" for k, v in q) for h, p, q in parts]
    turned = [h.replace("://", "://www.") + ":80" + (p or "") + "/?" + "&".join(f"{k}={v}" for k, v in reversed(q)) + "#x" for h, p, q in parts]
    got = apply(spark, plain, U.normalize_url)
    assert got == apply(spark, turned, U.normalize_url) and got == apply(spark, got, U.normalize_url)


def test_resolve_link_matches_standard_library(spark):
    base = "https://e.com/a/b/c?q=1"
    hrefs = ["x", "../x", "../../../x", "./", "..", "/r/./s/../t", "?p=2", "#f", "", "//h.org/p", "http://o.org/z", "a/b/../c/", "mailto:x@y", "https:d"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string")
    got = [r.x for r in df.select("i", U.resolve_link(F.lit(base), F.col("h")).alias("x")).orderBy("i").collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_site_and_path_rules(spark):
    assert apply(spark, ["https://www.example.com:80/blog"], U.get_domain) == ["example.com"]
    same = apply(spark, ["https://blog.example.com/p", "https://other.com/p", "https://notexample.com"], lambda c: U.is_same_site(c, F.lit("example.com")))
    assert same == [True, False, False]
    paths = ["https://e.com/login", "https://e.com/cart", "https://e.com/", "https://e.com/blog/my-post", "https://e.com/Tag/x", "https://e.com/tagged"]
    assert apply(spark, paths, U.is_non_article_path) == [True, True, True, False, True, False]
    assert apply(spark, ["e.com", " http://e.com ", "HTTPS://e.com"], U.add_scheme) == ["https://e.com", "http://e.com", "https://HTTPS://e.com"]
    assert apply(spark, ["https://e.com/page/2", "https://e.com/?page=x", "https://e.com/?a=1&paged=3"], U.is_pagination) == [True, False, True]
    assert apply(spark, ["https://e.com/blog/x", "https://e.com/blog", "https://e.com/News/"], U.has_article_hint) == [True, False, True]
