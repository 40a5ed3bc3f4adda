"""URL functions: split, normalise, domain, site tests, path tests, relative links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import any_of, blank_to_null, form_encode, let, percent_decode, strip, word_array

# Query keys that never change what a page shows.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "source", "amp",
]

# Path segments of pages that are no articles.
NON_ARTICLE_SEGMENTS = [
    "login", "signin", "sign-in", "signup", "sign-up", "register",
    "contact", "contact-us", "privacy", "privacy-policy", "terms",
    "terms-of-service", "terms-and-conditions", "careers", "jobs",
    "cart", "checkout", "account", "my-account", "wp-admin", "wp-login",
    "search", "tag", "tags", "author", "page", "category-listing",
]

# Patterns for pagination links and for article paths.
PAGINATION_RE = r"/page/\d+|[?&]page=\d+|[?&]paged=\d+"
ARTICLE_HINT_RE = (
    r"(?i)/(blog|article|articles|post|posts|news|insights?|resources?|guides?|"
    r"case-studies?|stories|updates?)/"
)

# A hint in the path of a URL as ``URL_RE`` takes it apart.
_HINT_IN_PATH_RE = r"(?i)^(?:[a-z][a-z0-9+.-]*+:)?+(?://[^/?#]*+)?+[^?#]*?" + ARTICLE_HINT_RE.removeprefix("(?i)")

# RFC 3986, appendix B, with the scheme held to its grammar.
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:(\?)([^#]*))?(?:#(.*))?"

_CONTROL_OR_SPACE = "".join(chr(i) for i in range(33))


def clean_url(url: Column) -> Column:
    """Drop leading control characters and any tab or newline, as URL parsers do."""
    return F.translate(F.ltrim(url, F.lit(_CONTROL_OR_SPACE)), "\t\r\n", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean_url(url), URL_RE, 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(clean_url(url), URL_RE, 3)


def url_path(url: Column) -> Column:
    return F.regexp_extract(clean_url(url), URL_RE, 4)


def url_query(url: Column) -> Column:
    return F.regexp_extract(clean_url(url), URL_RE, 6)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(clean_url(url), URL_RE, 7)


def _bare_host(netloc: Column) -> Column:
    host = F.regexp_replace(F.lower(netloc), r"^www\.", "")
    return F.substring_index(host, ":", 1)


def get_domain(url: Column) -> Column:
    """Lower-case host without a leading ``www.`` and without a port."""
    return _bare_host(url_netloc(url))


def _normalized_query(query: Column) -> Column:
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            percent_decode(F.substring_index(p, "=", 1), form=True).alias("k"),
            percent_decode(
                F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise(""), form=True
            ).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda kv: ~any_of(F.lower(kv["k"]), TRACKING_KEYS))
    return F.array_join(
        F.transform(F.sort_array(kept), lambda kv: F.concat(form_encode(kv["k"]), F.lit("="), form_encode(kv["v"]))), "&"
    )


def normalize_url(url: Column) -> Column:
    """Dedup key of a URL: same page, same key."""
    raw = strip(url)
    scheme = F.coalesce(blank_to_null(url_scheme(raw)), F.lit("https"))
    host = _bare_host(url_netloc(raw))
    path = url_path(raw)
    path = F.when(path == "", "/").when(
        (F.length(path) > 1) & F.endswith(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - 1)
    ).otherwise(path)
    rooted = F.startswith(path, F.lit("/"))
    authority = (
        F.when(host != "", F.concat(F.lit("//"), host, F.when(rooted, "").otherwise("/")))
        .when(rooted, "//").otherwise("")
    )
    query = url_query(raw)
    query = F.when(query == "", "").otherwise(
        let(_normalized_query(query), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    )
    return F.concat(scheme, F.lit(":"), authority, path, query)


def is_same_site(url: Column, root: Column) -> Column:
    return let(get_domain(url), lambda d: (d == root) | F.endswith(d, F.concat(F.lit("."), root)))


def is_non_article_path(url: Column) -> Column:
    path = F.trim(F.lower(url_path(url)), F.lit("/"))
    return (path == "") | F.arrays_overlap(F.split(path, "/"), word_array(NON_ARTICLE_SEGMENTS))


def looks_like_article(url: Column) -> Column:
    return ~is_non_article_path(url)


def is_pagination(url: Column) -> Column:
    return F.rlike(url, F.lit(PAGINATION_RE))


def has_article_hint(url: Column) -> Column:
    return F.rlike(clean_url(url), F.lit(_HINT_IN_PATH_RE))


def add_scheme(url: Column) -> Column:
    text = strip(url)
    known = F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://"))
    return F.when(known, text).otherwise(F.concat(F.lit("https://"), text))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def site_root(url: Column) -> Column:
    """``scheme://netloc`` of a URL, the key of its robots file."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    def finish(done: Column, segs: Column) -> Column:
        last = F.try_element_at(segs, F.lit(-1))
        tail = F.when(F.startswith(path, F.lit("/")) & (F.size(done) == 0), "/").when(last.isin(".", ".."), "/").otherwise("")
        return F.concat(F.lit("/"), F.array_join(done, "/"), F.when(F.size(done) == 0, "").otherwise(tail))

    def run(segs: Column) -> Column:
        empty = F.array().cast("array<string>")
        return let(F.aggregate(segs, empty, step), lambda done: finish(done, segs))

    inner = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.when(F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)")), let(inner, run)).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute URL of a link found on page ``base``."""
    return let(_taken_apart(base), lambda b: let(_taken_apart(href), lambda ref: _resolve(b, ref, href)))


# The rest of a link that stays as it is: no dot segment begins in its path, no query or fragment is empty, nothing in it is dropped.
_PLAIN_REST = r"(?:/(?!\.)[^/?#\t\r\n]*+)*+(?:\?[^#\t\r\n]++)?+(?:#[^\t\r\n]++)?+\z"
_PLAIN_LINK_RE = r"^https?://[^/?#\t\r\n]++" + _PLAIN_REST
_PLAIN_ROOTED_RE = r"^(?=/(?!/))" + _PLAIN_REST


def resolve_links(base: Column, hrefs: Column) -> Column:
    """array<struct<href, link>> of the links of a page, whose address is taken apart once. Plain links are taken as they are or put after scheme and host."""

    def one(b: Column, h: Column) -> Column:
        odd = let(_taken_apart(h), lambda ref: _resolve(b, ref, h))
        link = F.when(F.rlike(h, F.lit(_PLAIN_LINK_RE)), h).when(F.rlike(h, F.lit(_PLAIN_ROOTED_RE)), F.concat(b["root"], h)).otherwise(odd)
        return F.struct(h.alias("href"), link.alias("link"))

    root = lambda b: F.concat(F.lower(b["p1"]), F.lit("://"), b["p3"])
    page = let(_taken_apart(base), lambda b: F.struct(root(b).alias("root"), b["all"].alias("all"), *[b[f"p{i}"].alias(f"p{i}") for i in range(1, 8)]))
    return let(page, lambda b: F.transform(hrefs, lambda h: one(b, h)))


def _taken_apart(url: Column) -> Column:
    return let(clean_url(url), lambda u: F.struct(u.alias("all"), *[F.regexp_extract(u, URL_RE, i).alias(f"p{i}") for i in range(1, 8)]))


def _resolve(base: Column, ref: Column, href: Column) -> Column:
    part = lambda i: ref[f"p{i}"]
    of_base = lambda i: base[f"p{i}"]
    scheme, own_scheme = F.lower(of_base(1)), F.lower(part(1))
    query = F.when(part(6) != "", F.concat(F.lit("?"), part(6))).otherwise("")
    fragment = F.when(part(7) != "", F.concat(F.lit("#"), part(7))).otherwise("")
    prefix = F.concat(scheme, F.lit("://"), of_base(3))
    folder = F.concat(
        F.when(F.startswith(of_base(4), F.lit("/")), "").otherwise("/"), F.regexp_extract(of_base(4), r"(?s)^(.*/)?", 0)
    )
    base_query = F.when(of_base(6) != "", F.concat(F.lit("?"), of_base(6))).otherwise("")
    return (
        F.when(ref["all"] == "", base["all"])
        .when((own_scheme != "") & ~own_scheme.isin("http", "https"), href)
        .when(
            (part(2) == "//") & (part(3) != ""),
            F.concat(
                F.when(own_scheme != "", own_scheme).otherwise(scheme), F.lit("://"), part(3),
                _remove_dot_segments(part(4)), query, fragment,
            ),
        )
        .when((own_scheme != "") & (own_scheme != scheme), href)
        .when((part(4) == "") & (part(5) == ""), F.concat(prefix, of_base(4), base_query, fragment))
        .when(part(4) == "", F.concat(prefix, of_base(4), query, fragment))
        .when(F.startswith(part(4), F.lit("/")), F.concat(prefix, _remove_dot_segments(part(4)), query, fragment))
        .otherwise(F.concat(prefix, _remove_dot_segments(F.concat(folder, part(4))), query, fragment))
    )
