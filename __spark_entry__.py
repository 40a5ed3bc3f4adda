
from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import derived_inputs as inputs
from pagemill.functions import urls as U
from pagemill.functions.html import first_element, own_texts, text_of, tokenize, with_page
from pagemill.functions.text import let
from pagemill.operators import accounting, ranges, robots, safety
from pagemill.operators.ordering import first_per_key, frontier_batches, number_rows, page_of_rows, stored_page, write_numbered
from pagemill.plans import batch_run, discovery, export
from pagemill.plans.commits import KeyIndex, Store
from pagemill.plans.extraction import analyze_columns, extract_articles
from pagemill.session import apply_defaults, cut_lineage, ensure_checkpoint_dir
from pagemill.sources import feeds as feed_source
from pagemill.sources import fetches as fetch_source
from pagemill.sources import links as link_source
from pagemill.sources import seeds, sitemaps
from pagemill.streaming import incremental
from oracle_queries import ORACLE

URL = F.col  # readability below: URL("url")
Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return inputs.table(spark, sf_dir, "pages")


def _dealt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.dealt(_pages(spark, sf_dir))


def _joined(column: Column, separator: str = "|") -> Column:
    return F.coalesce(F.array_join(column, separator), F.lit(""))


def article_url_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct article URLs per site."""
    keyed = _pages(spark, sf_dir).select("page_id", "url", U.normalize_url(URL("url")).alias("normalized_url"))
    once = first_per_key(keyed, ["normalized_url"], [F.col("page_id")])
    return once.where(U.looks_like_article(URL("url"))).groupBy(U.get_domain(URL("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("article_urls")
    )


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.normalize_url(URL("url")).alias("normalized_url"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = URL("url")
    return _pages(spark, sf_dir).select(
        "page_id", U.url_scheme(u).alias("scheme"), U.url_netloc(u).alias("netloc"), U.url_path(u).alias("path"),
        U.url_query(u).alias("query"), U.url_fragment(u).alias("fragment"), U.get_domain(u).alias("domain"),
        U.site_root(u).alias("site_root"), U.strip_fragment(u).alias("no_fragment"),
    )


def url_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _pages(spark, sf_dir).select("page_id", "url", U.normalize_url(URL("url")).alias("normalized_url"))
    return first_per_key(keyed, ["normalized_url"], [F.col("page_id")])


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = URL("url")
    return _pages(spark, sf_dir).select(
        "page_id", U.is_non_article_path(u).alias("non_article"), U.looks_like_article(u).alias("article"),
        U.is_pagination(u).alias("pagination"), U.has_article_hint(u).alias("hinted"),
    )


def same_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.substring_index(U.get_domain(URL("url")), ".", -3)
    return _pages(spark, sf_dir).select(
        "page_id", root.alias("root"), U.is_same_site(URL("url"), root).alias("same"),
        U.is_same_site(URL("url"), F.lit("ample.com")).alias("other"),
    )


def add_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.concat(F.lit(" "), F.regexp_replace("url", "^http://", ""))
    return _pages(spark, sf_dir).select("page_id", U.add_scheme(bare).alias("full_url"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_source.page_links(_dealt_pages(spark, sf_dir))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "link")


def link_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_source.page_links(_dealt_pages(spark, sf_dir)).where(U.is_same_site(URL("link"), U.get_domain(URL("url"))))
    return found.groupBy(U.get_domain(URL("link")).alias("domain")).agg(
        F.count(F.lit(1)).alias("links"), F.count_if(U.is_pagination(URL("link"))).alias("pagination_links")
    )


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _dealt_pages(spark, sf_dir).select(F.explode(F.transform(tokenize(F.col("html")), lambda t: F.struct(t["tag"], t["closing"]))).alias("t"))
    return tags.where("t.tag <> ''").groupBy(F.col("t.tag").alias("tag"), F.col("t.closing").alias("closing")).agg(F.count(F.lit(1)).alias("n"))


def title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(page):
        return let(own_texts(page), lambda t: F.struct(
            text_of(first_element(page, "title"), t, "").alias("title"), text_of(first_element(page, "h1"), t, "").alias("h1")
        ))

    return _dealt_pages(spark, sf_dir).select("page_id", with_page(F.col("html"), both).alias("x")).select("page_id", "x.title", "x.h1")


def visible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = fetch_source.with_thin_flag(_dealt_pages(spark, sf_dir))
    return flagged.select("page_id", F.col("visible_words").cast("bigint").alias("visible_words"), "needs_render")


def structured_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analyze_columns("html", "url", ("content",))
    return _dealt_pages(spark, sf_dir).select("page_id", x["content"].alias("c")).select(
        "page_id", "c.structured_content", "c.introduction", F.col("c.word_count").cast("bigint").alias("word_count"), "c.quality_ok"
    )


def body_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analyze_columns("html", "url", ("content",))
    return _dealt_pages(spark, sf_dir).select("page_id", x["content"].alias("c")).select(
        "page_id", "c.main_content", F.concat_ws("; ", "c.warnings").alias("warnings")
    )


def classify_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analyze_columns("html", "url", ("score",))
    return _dealt_pages(spark, sf_dir).select("page_id", x["score"].alias("s")).select(
        "page_id", "s.is_candidate", F.round("s.confidence", 6).alias("confidence")
    )


def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    x = analyze_columns("html", "url", ("metadata",))
    return inputs.article_pages(spark, sf_dir).select("doc_id", x["metadata"].alias("m")).select(
        "doc_id", "m.title", "m.meta_title", "m.meta_description", "m.canonical_url", "m.author", "m.author_url",
        "m.published_date", "m.modified_date", "m.category", _joined(F.col("m.tags")).alias("tags"), "m.featured_image", "m.h1",
    )


def article_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    x = analyze_columns("html", "url", ("content",))
    return inputs.article_pages(spark, sf_dir).select("doc_id", x["content"].alias("c")).select(
        "doc_id", "c.structured_content", "c.introduction", "c.conclusion", "c.faq_content",
        _joined(F.col("c.h2_headings")).alias("h2_headings"), _joined(F.col("c.h3_headings")).alias("h3_headings"),
        F.col("c.word_count").cast("bigint").alias("word_count"), "c.quality_ok",
    )


def article_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    x = analyze_columns("html", "url", ("score",))
    return inputs.article_pages(spark, sf_dir).select("doc_id", x["score"].alias("s")).select(
        "doc_id", "s.is_candidate", F.round("s.confidence", 6).alias("confidence")
    )


def site_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    sites = inputs.sites(spark, sf_dir)
    kinds = {"sitemap": seeds.sitemap_seeds(sites), "feed": seeds.feed_seeds(sites), "index": seeds.index_seeds(sites)}
    out = None
    for kind, rows in kinds.items():
        part = rows.select("site", F.lit(kind).alias("kind"), F.col("seq").cast("bigint").alias("seq"), "url")
        out = part if out is None else out.unionByName(part)
    return out


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    files = inputs.sitemap_files(spark, sf_dir)
    return files.select(
        "url", F.coalesce(F.size(sitemaps.page_entries(F.col("body"))), F.lit(0)).cast("bigint").alias("pages"),
        F.coalesce(F.size(sitemaps.child_sitemaps(F.col("body"))), F.lit(0)).cast("bigint").alias("children"),
    ).select("url", F.greatest("pages", F.lit(0)).alias("pages"), F.greatest("children", F.lit(0)).alias("children"))


def sitemap_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of sitemap responses, some packed; what was packed without a word is no sitemap."""
    apply_defaults(spark)
    files = sitemaps.response_bodies(inputs.sitemap_responses(spark, sf_dir))
    return files.select("url", F.greatest(F.coalesce(F.size(sitemaps.page_entries(F.col("body"))), F.lit(0)), F.lit(0)).cast("bigint").alias("pages"))


def sitemap_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large urlset files read entry by entry, in splits; those that break off give nothing."""
    apply_defaults(spark)
    path = _scratch(spark, "urlsets")
    inputs.write_nation_urlsets(spark, sf_dir, path)
    found = sitemaps.read_large_urlsets(spark, path + "/*/*.txt")
    return found.select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("bigint").alias("nation"), "loc", "lastmod")


def _sitemap_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.sites(spark, sf_dir).select(
        "site", F.concat(F.lit("User-agent: *\r\nSITEMAP: "), "base", F.lit("/sitemap.xml \nSitemap: "), "base", F.lit("/none.xml")).alias("body")
    )


def _expand(spark: SparkSession, sf_dir: str, cap: int | None = None) -> DataFrame:
    apply_defaults(spark)
    found = discovery.expand_sitemaps(
        inputs.sites(spark, sf_dir), inputs.sitemap_files(spark, sf_dir), _sitemap_robots(spark, sf_dir), cap
    )
    return found.select("site", "url", "lastmod", F.col("level").cast("bigint").alias("level"))


def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir)


def sitemap_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, 3)


def bfs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    found = discovery.crawl_links(inputs.sites(spark, sf_dir), inputs.index_pages(spark, sf_dir))
    return found.select("site", "url", F.col("level").cast("bigint").alias("level"))


def bfs_links_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    found = discovery.crawl_links(inputs.sites(spark, sf_dir), inputs.index_pages(spark, sf_dir), max_depth=2)
    return found.select("site", "url", F.col("level").cast("bigint").alias("level"))


def bfs_links_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that was stopped after two levels and went on by its committed levels."""
    apply_defaults(spark)
    store = _store(spark, "crawl")
    for depth in (1, None):
        found = discovery.crawl_links(inputs.sites(spark, sf_dir), inputs.index_pages(spark, sf_dir), max_depth=depth, store=store)
    return found.select("site", "url", F.col("level").cast("bigint").alias("level"))


def sitemap_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    store = _store(spark, "maps")
    for depth in (1, None):
        found = discovery.expand_sitemaps(
            inputs.sites(spark, sf_dir), inputs.sitemap_files(spark, sf_dir), _sitemap_robots(spark, sf_dir), max_depth=depth, store=store)
    return found.select("site", "url", "lastmod", F.col("level").cast("bigint").alias("level"))


def bfs_links_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that opens no page of a site once three links are found."""
    apply_defaults(spark)
    found = discovery.crawl_links(inputs.sites(spark, sf_dir), inputs.index_pages(spark, sf_dir), max_urls=3)
    return found.select("site", "url", F.col("level").cast("bigint").alias("level"))


def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    found = feed_source.feed_urls(inputs.feeds(spark, sf_dir).drop("url"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


def discover_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    found = discovery.discover(
        inputs.sites(spark, sf_dir), inputs.sitemap_files(spark, sf_dir), inputs.index_pages(spark, sf_dir),
        inputs.site_feeds(spark, sf_dir), _sitemap_robots(spark, sf_dir),
    )
    return found.select("site", "url", "source")


def discover_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and feeds only where the sitemaps gave fewer than five URLs."""
    apply_defaults(spark)
    found = discovery.discover(
        inputs.sites(spark, sf_dir), inputs.sitemap_files(spark, sf_dir), inputs.index_pages(spark, sf_dir),
        inputs.site_feeds(spark, sf_dir), _sitemap_robots(spark, sf_dir), sparse=5,
    )
    return found.select("site", "url", "source")


def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    found = inputs.found_urls(spark, sf_dir)
    stored = found.where(F.contains("url", F.lit("://m."))).select("job_id", U.normalize_url(URL("url")).alias("normalized_url")).distinct()
    return discovery.new_urls(found, stored).select("job_id", "raw_url", "normalized_url", "is_candidate", "status")


def new_urls_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as new_urls, with the stored keys in an index that the new rows then join."""
    apply_defaults(spark)
    found = inputs.found_urls(spark, sf_dir)
    index = KeyIndex(_store(spark, "known"), "urls", ["job_id", "normalized_url"], buckets=8)
    mobile = discovery.new_urls(found.where(F.contains("url", F.lit("://m."))), index=index)
    index.append("mobile", mobile)
    index.append("rest", discovery.new_urls(found, index=index))
    return index.read().select("job_id", "raw_url", "normalized_url", "is_candidate", "status")


def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rules = robots.robots_rules(inputs.robots_files(spark, sf_dir))
    return robots.robots_gate(inputs.order_urls(spark, sf_dir), rules).select("order_key", "allowed")


def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rules = robots.robots_rules(inputs.robots_files(spark, sf_dir))
    return rules.select("site_root", F.size("rules").cast("bigint").alias("rules"), "crawl_delay")


def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    checked = safety.with_reject_reason(inputs.literal_urls(spark, sf_dir), inputs.dns(spark, sf_dir))
    kind = F.when(F.col("reject_reason").isNull(), "ok").otherwise(F.regexp_extract("reject_reason", r"^(\w+ \w+)", 1))
    return checked.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "url", kind.alias("verdict"))


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of many thousand networks for each address; of one network given twice the smallest name."""
    apply_defaults(spark)
    lo, hi = ranges.network_ends(F.col("network"))
    table = inputs.ip_ranges(spark, sf_dir).select(lo.alias("lo"), hi.alias("hi"), "kind")
    return ranges.innermost_range(inputs.addresses(spark, sf_dir), table).select("l_orderkey", "l_linenumber", "kind")


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    done = fetch_source.with_backoff(fetch_source.fetch_results(inputs.attempts(spark, sf_dir)))
    return done.select("order_key", F.col("attempt").cast("bigint").alias("attempt"), "error", F.coalesce("html", F.lit("")).alias("html"), "backoff_seconds")


def final_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    last = fetch_source.final_attempts(inputs.attempts(spark, sf_dir), ["order_key"])
    return last.select("order_key", F.col("attempt").cast("bigint").alias("attempt"), F.col("http_status").cast("bigint").alias("http_status"))


def fetch_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _dealt_pages(spark, sf_dir).select("page_id", "html", F.lit(200).alias("http_status"))
    drawn = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.when(F.col("lang") != "de", F.concat(F.lit("<p>"), "source")).alias("html"),
        F.when(F.col("lang") == "es", 404).otherwise(200).alias("http_status"),
    )
    chosen = fetch_source.choose_fetch(pages, drawn, ["page_id"])
    return chosen.select("page_id", "rendered", F.col("http_status").cast("bigint").alias("http_status"), F.col("html").isNotNull().alias("has_html"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    t = inputs.crawl_tables(spark, sf_dir)
    return accounting.job_progress(t["jobs"].select("job_id"), t["urls"], t["articles"], t["failures"])


def url_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    t = inputs.crawl_tables(spark, sf_dir)
    states = accounting.url_status_from_log(t["urls"], t["failures"], max_retries=1)
    return states.select("order_key", "status", F.col("retry_count").cast("bigint").alias("retry_count"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    t = inputs.crawl_tables(spark, sf_dir)
    resumed = accounting.resume_jobs(t["jobs"]).select("job_id", F.col("status").alias("resumed"), "error_message")
    cancelled = accounting.cancel_jobs(t["jobs"]).select("job_id", F.col("status").alias("cancelled"))
    counts = t["jobs"].select("job_id").join(accounting.url_counts(t["urls"]), "job_id", "left")
    pending = F.coalesce("pending", F.lit(0))  # a job without URLs is done
    after = counts.select("job_id", accounting.job_status_after_run(pending, F.lit(False)).alias("after_run"))
    return resumed.join(cancelled, "job_id").join(after, "job_id")


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a URL after its page was tried, by whether it has HTML, its path and its words."""
    pages = _dealt_pages(spark, sf_dir)
    x = analyze_columns("html", "url", ("score", "content"))
    tried = pages.select("page_id", F.startswith("url", F.lit("https")).alias("has_html"), x.alias("x"))
    state = accounting.url_status_after_fetch(
        F.col("has_html"), F.col("x.score.is_candidate"), F.col("x.content.quality_ok"), F.col("page_id") % 5
    )
    return tried.select("page_id", state.alias("status"))


def _crawl_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as queued URLs, fetched in two attempts of which the second gives HTML for https; mobile hosts block /de/."""
    pages = _dealt_pages(spark, sf_dir)
    urls = pages.select(
        F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("job_id"), F.col("url").alias("raw_url"), F.lit("queued").alias("status"),
        (F.col("page_id") % 5).cast("int").alias("retry_count"),
    )
    good = F.startswith("url", F.lit("https"))
    second = pages.select(
        "url", F.lit(1).alias("attempt"), F.when(good, 200).otherwise(503).alias("http_status"), F.when(good, F.col("html")).alias("html"), F.lit(None).cast("string").alias("error")
    )
    first = second.select("url", F.lit(0).alias("attempt"), F.lit(0).alias("http_status"), F.lit(None).cast("string").alias("html"), F.lit("Timeout").alias("error"))
    mobile = pages.where(F.contains("url", F.lit("://m."))).select(U.site_root(URL("url")).alias("site_root")).distinct()
    files = mobile.select("site_root", F.lit(200).alias("http_status"), F.lit("User-agent: *\nDisallow: /de/\n").alias("body"))
    return urls, first.unionByName(second), robots.robots_rules(files)


def _crawl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run.run_urls(*_crawl_inputs(spark, sf_dir))


def crawl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl_run(spark, sf_dir).select(
        "job_id", "raw_url", "status", F.round("confidence", 6).alias("confidence"), F.col("http_status").cast("bigint").alias("http_status"),
        F.col("retry_count").cast("bigint").alias("retry_count"), "error",
    )


def crawl_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run.run_counts(_crawl_run(spark, sf_dir))


def _store(spark: SparkSession, kind: str) -> Store:
    return Store(spark, _scratch(spark, kind))


def crawl_run_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a run, appended twice: the second time adds nothing."""
    found = batch_run.run_articles(_crawl_run(spark, sf_dir)).select("job_id", "raw_url", F.col("word_count").cast("bigint").alias("word_count"))
    index = KeyIndex(_store(spark, "run-articles"), "articles", ["job_id", "raw_url"], buckets=8)
    for batch in ("1", "2"):
        index.append(batch, found)
    return index.read(found.schema).select("job_id", "raw_url", "word_count")


def urls_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of pages that overlap in two thirds of their pages, the second one run twice: each URL stays with its first batch."""
    found = inputs.found_urls(spark, sf_dir).withColumn("normalized_url", U.normalize_url(URL("url")))
    store = _store(spark, "urls")
    for batch in (0, 1, 1, 2):
        # Batch b holds the pages whose number leaves up to b by three.
        rows = found.where(F.col("ord") % 3 <= batch).select("job_id", "normalized_url", "ord", F.lit(batch).cast("bigint").alias("batch"))
        KeyIndex(store, "urls", ["job_id", "normalized_url"], buckets=8, fanout=2).append(f"urls-{batch}", rows, ["ord"])
    return store.read("urls")


def crawl_run_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in two batches; the second is lost between two tables, runs again and is asked for once more: every row is there once."""
    store = _store(spark, "resumed")
    urls, attempts, rules = _crawl_inputs(spark, sf_dir)
    half = F.crc32("raw_url") % 2 == 0
    batch_run.run_batch(store, "first", urls.where(half), attempts, rules)
    store.write_part("articles", store.read("articles"))  # written, never committed
    left = batch_run.urls_to_do(store, urls).where("status = 'queued'")
    for _ in range(2):
        batch_run.run_batch(store, "second", left, attempts, rules)
    shown = {"articles": F.col("status"), "failures": F.col("error"), "states": F.concat_ws(" ", "status", "retry_count")}
    parts = [store.read(t).select(F.lit(t).alias("kind"), "job_id", F.col("url" if t == "failures" else "raw_url").alias("raw_url"), what.alias("what")) for t, what in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def crawl_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that was committed in three batches."""
    store = _store(spark, "totals")
    urls, attempts, rules = _crawl_inputs(spark, sf_dir)
    for i in range(3):
        batch_run.run_batch(store, f"b{i}", urls.where(F.crc32("raw_url") % 3 == i), attempts, rules)
    return batch_run.counts_so_far(store)


def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    articles = inputs.crawl_tables(spark, sf_dir)["articles"]
    page = page_of_rows(articles, ["extraction_date", "raw_url", "word_count", "job_id"], limit=100, offset=200)
    return page.select("job_id", "raw_url", "word_count")


def results_page_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from rows that were stored in numbered parts: one part is read."""
    apply_defaults(spark)
    articles = inputs.crawl_tables(spark, sf_dir)["articles"]
    path = _scratch(spark, "numbered")
    write_numbered(articles, ["extraction_date", "raw_url", "word_count", "job_id"], path, rows_per_part=500)
    return stored_page(spark, path, limit=100, offset=200, rows_per_part=500).select("job_id", "raw_url", "word_count")


def article_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return export.article_summary(_stored_articles(spark, sf_dir)).select(
        "blog_url", "blog_title", "author", "publication_date", F.col("word_count").cast("bigint").alias("word_count"), "extraction_status")


def failure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rows = export.failure_summary(inputs.crawl_tables(spark, sf_dir)["failures"])
    return rows.select("url", "error", F.col("http_status").cast("bigint").alias("http_status"), F.col("retry_count").cast("bigint").alias("retry_count"),
                       F.col("timestamp").cast("date").alias("day"))


def jobs_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose exports can be fetched: completed, with a path."""
    apply_defaults(spark)
    jobs = inputs.crawl_tables(spark, sf_dir)["jobs"].withColumn("path", F.when(F.col("error_message").isNull(), F.concat(F.lit("/x/"), "job_id")))
    return jobs.select("job_id", accounting.exports_ready(F.col("status"), F.col("path")).alias("ready"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    urls = accounting.pending_urls(inputs.crawl_tables(spark, sf_dir)["urls"])
    return frontier_batches(urls.select("job_id", "order_key"), ["order_key"]).select("order_key", "batch_id")


def batches_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    urls = inputs.crawl_tables(spark, sf_dir)["urls"].select("job_id", "order_key")
    return number_rows(urls, ["order_key"], "n", ["job_id"]).select("job_id", "order_key", "n")


def config_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    part = inputs.table(spark, sf_dir, "part")
    snapshot = accounting.config_snapshot(
        F.col("p_size") % 3, F.when(F.col("p_size") > 25, F.col("p_retailprice")), F.col("p_size") % 2
    )
    return part.select("p_partkey", F.array_join(F.sort_array(F.map_keys(snapshot)), ",").alias("kept"),
                       F.col("p_retailprice").alias("price"))


def failure_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rows = export.failure_export_rows(inputs.crawl_tables(spark, sf_dir)["failures"])
    return rows.select("url", "error", F.col("http_status").cast("bigint").alias("http_status"),
                       F.col("retry_count").cast("bigint").alias("retry_count"), "timestamp")


def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    tried = fetch_source.fetch_results(inputs.attempts(spark, sf_dir)).select(
        F.lit("j").alias("job_id"), F.col("order_key").cast("string").alias("url"), "html", "error", "http_status",
        F.col("attempt").alias("retry_count"), F.lit(None).cast("timestamp").alias("fetched_at"),
    )
    rows = accounting.failure_rows(tried)
    return rows.select("url", "error", F.col("http_status").cast("bigint").alias("http_status"), F.col("retry_count").cast("bigint").alias("retry_count"))


def _stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") % 100)
    pages = inputs.article_pages(spark, sf_dir).select(
        "url", "html", F.lit("job").alias("job_id"), F.lit("example.com").alias("domain"), F.col("url").alias("raw_url"),
        F.lit(200).alias("http_status"), day.alias("extraction_date"),
    )
    return cut_lineage(export.article_rows(extract_articles(pages)))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rows = export.export_rows(_stored_articles(spark, sf_dir))
    return rows.select("id", "website", "blog_url", "canonical_url", "blog_title", "author", "tags",
                       F.col("word_count").cast("bigint").alias("word_count"), "h2_headings", "extraction_status",
                       F.col("http_status").cast("bigint").alias("http_status"), "extraction_date", "error_message", "subcategory")


def _scratch(spark: SparkSession, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the article CSV and read it back."""
    apply_defaults(spark)
    path = _scratch(spark, "csv") + "/example.com_blog_extraction_" + datetime(2026, 1, 1).strftime("%Y-%m-%d")
    export.write_articles_csv(_stored_articles(spark, sf_dir), path)
    back = spark.read.csv(path, header=True, escape='"', multiLine=True, schema=", ".join(f"`{c}` string" for c in export.EXPORT_COLUMNS.values()))
    return back.select(F.col("ID").cast("bigint").alias("id"), F.col("`Blog URL`").alias("blog_url"), F.col("`Main Content`").alias("main_content"),
                       F.col("`FAQ Content`").alias("faq_content"))


def export_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of all jobs exported by job; then some jobs once more, with other rows. The other jobs' files stay as they were."""
    apply_defaults(spark)
    failures, folder = inputs.crawl_tables(spark, sf_dir)["failures"], _scratch(spark, "exports")
    export.write_job_failures(failures, folder)
    export.write_job_failures(failures.where("job_id like '%7' and retry_count = 1"), folder)
    back = export.read_job_exports(spark, folder, export.FAILURE_COLUMNS)
    return back.select("export", F.col("URL").alias("url"), F.col("`Retry Count`").cast("bigint").alias("retry_count"), F.col("Timestamp").alias("at"))


def export_articles_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles exported by job under the names of their sites, numbered within each job."""
    apply_defaults(spark)
    job = F.concat(F.lit("job-"), F.regexp_extract("raw_url", r"(\d)$", 1))
    articles = _stored_articles(spark, sf_dir).withColumn("job_id", job)
    folder = _scratch(spark, "exports")
    names = articles.select("job_id").distinct().withColumn("name", export.export_name(F.concat(F.lit("https://"), "job_id", F.lit(".example.com")), datetime(2026, 1, 5)))
    export.write_job_exports(articles, names, folder)
    back = export.read_job_exports(spark, folder, export.EXPORT_COLUMNS)
    return back.select("export", F.col("ID").cast("bigint").alias("id"), F.col("`Blog URL`").alias("blog_url"), F.col("`Main Content`").alias("main_content"))


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id", export.export_name(URL("url"), datetime(2026, 1, 5)).alias("articles_name"),
        export.failure_export_name(F.col("page_id").cast("string")).alias("failures_name"),
    )


def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the incremental job over the same folder: the second finds nothing new."""
    schema = _pages(spark, sf_dir).schema
    out, checkpoint = _scratch(spark, "articles"), _scratch(spark, "progress")
    for _ in range(2):
        stream = incremental.read_page_stream(spark, f"{sf_dir}/pages*.parquet", schema)
        incremental.extract_new_pages(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("page_id", "title", F.col("word_count").cast("bigint").alias("word_count"))


def stream_distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _pages(spark, sf_dir).schema
    stream = incremental.read_page_stream(spark, f"{sf_dir}/pages*.parquet", schema)
    urls = stream.select(F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("job_id"), "url")
    store = _store(spark, "urls")
    incremental.append_distinct(urls, store, _scratch(spark, "progress")).awaitTermination()
    return store.read("urls").select("job_id", "normalized_url")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _pages(spark, sf_dir).schema
    stream = incremental.read_page_stream(spark, f"{sf_dir}/pages*.parquet", schema)
    urls = stream.select(F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("job_id"), U.looks_like_article(URL("url")).alias("is_candidate"))
    store = _store(spark, "counts")
    incremental.publish_counts(urls, store, _scratch(spark, "progress")).awaitTermination()
    incremental.compact_counts(store, "compact-1")
    return incremental.read_counts(store)


_QUERIES: list[Query] = [
    article_url_counts, url_normalize, url_parts, url_dedup_first, path_filter, same_site, add_scheme, link_extract,
    link_domain_counts, tag_counts, title_h1, visible_words, structured_content, body_fallback, classify_confidence,
    article_metadata, article_content, article_score, site_seeds, sitemap_entries, sitemap_bodies, sitemap_large, sitemap_expand, sitemap_capped, bfs_links,
    bfs_links_depth, feed_links, discover_union, discover_sparse, new_urls, new_urls_indexed, crawl_run, crawl_run_counts, crawl_run_stored,
    urls_appended, crawl_run_resumed, crawl_run_totals, bfs_links_resumed, sitemap_resumed, bfs_links_capped,
    robots_gate, robots_delay, url_safety, fetch_results, final_attempts,
    fetch_choice, job_progress, url_states, job_states, fetch_outcomes, results_page, batches, batches_per_job, config_snapshot,
    failure_export, failure_log, export_rows, export_csv, export_names, export_jobs, export_articles_by_job, ip_ranges,
    results_page_stored, article_summaries, failure_summaries, jobs_ready, stream_extract, stream_distinct_urls, stream_counts,
]


def entry(spark: SparkSession) -> DataFrame:
    """Distinct article URLs per site on the smallest tables."""
    return article_url_counts(spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries of the training-data operators; none where that subpackage or what it needs cannot be imported."""
    try:
        import corpus_pipeline
        from pagemill.llm import queries as llm
    except ImportError:
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return llm.QUERIES | {"pipeline": corpus_pipeline.run}, llm.ORACLE | sql


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES} | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE) | _training_data()[1]
