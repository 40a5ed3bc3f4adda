"""Pages to articles: one narrow projection per page, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import jsonld
from pagemill.functions.html import Page, own_texts, visible_word_count, with_page
from pagemill.functions.text import let
from pagemill.operators.classify import page_score
from pagemill.operators.content import page_content
from pagemill.operators.metadata import meta_tags, page_metadata

VIEWS = ("metadata", "content", "score", "visible_words")


def analyze(html: Column, url: Column, views: tuple[str, ...] = VIEWS) -> Column:
    """Struct with one field per asked view; the page is parsed once for all of them."""

    def build(page: Page) -> Column:
        shared = F.struct(
            jsonld.documents(page).alias("docs"), meta_tags(page).alias("metas"), own_texts(page).alias("texts")
        )

        def fields(s: Column) -> Column:
            made = {
                "metadata": lambda: page_metadata(page, url, s["docs"], s["metas"], s["texts"]),
                "score": lambda: page_score(page, url, s["docs"], s["metas"], s["texts"]),
                "content": lambda: page_content(page, s["texts"]),
                "visible_words": lambda: visible_word_count(page),
            }
            return F.struct(*[made[v]().alias(v) for v in views])

        return let(shared, fields)

    return with_page(html, build)


_BUILT: dict[tuple, Column] = {}


def analyze_columns(html: str = "html", url: str = "url", views: tuple[str, ...] = VIEWS) -> Column:
    """``analyze`` over named columns, built once per Spark application and reused."""
    key = (SparkSession.active().sparkContext.applicationId, html, url, views)
    if key not in _BUILT:
        _BUILT[key] = analyze(F.col(html), F.col(url), views)
    return _BUILT[key]


def extract_articles(pages: DataFrame, html: str = "html", url: str = "url", partitions: int | None = None) -> DataFrame:
    """Add the extracted fields to a table of pages (html and url columns).

    Pages are parsed where they were read. ``partitions`` deals them out first, for files with few large row groups.
    """
    pages = pages.repartition(partitions) if partitions else pages
    keep = [c for c in pages.columns if c != html]
    seen = pages.select(*keep, analyze_columns(html, url, ("metadata", "content", "score")).alias("_x"))
    return seen.select(*keep, "_x.metadata.*", "_x.content.*", "_x.score.*")


def visible_words(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("visible_words", with_page(F.col(html), visible_word_count))
