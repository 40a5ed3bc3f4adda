"""Article score of a page from its URL, JSON-LD and structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import jsonld
from pagemill.functions.html import Page, attribute, text_length
from pagemill.functions.text import let
from pagemill.functions.urls import is_non_article_path

# Weights of the signals, in the order they are added, and limits.
REJECTED_CONFIDENCE = 0.05
BASELINE = 0.5
LONG_PARAGRAPH_CHARS = 80
LONG_PARAGRAPHS = 3
DATE_NAME_RE = "(?i)date|publish"
ARTICLE_URL_RE = "/blog|/article|/post"


def _named_like_date(page: Page) -> Column:
    return F.exists(
        page.tokens,
        lambda t: ~t["closing"] & F.contains(t["mark"], F.lit("=")) & F.rlike(t["mark"], F.lit("(?is)^<.*(date|publish)"))
        & (
            F.rlike(attribute(t["mark"], "name"), F.lit(DATE_NAME_RE))
            | (attribute(t["mark"], "property") == "article:published_time")
        ),
    )


def page_score(page: Page, url: Column, docs: Column, metas: Column, texts: Column) -> Column:
    """struct<is_candidate, confidence>; only the URL decides the label."""
    tags = F.transform(page.elements, lambda e: e["tag"])
    og_type = F.get(F.filter(metas, lambda m: m["property"] == "og:type"), 0)["content"]
    paragraphs = F.filter(
        page.elements, lambda e: (e["tag"] == "p") & (text_length(e, texts) > LONG_PARAGRAPH_CHARS)
    )

    def score(t: Column) -> Column:
        signals = [
            (F.array_contains(t, "article"), 0.2),
            (F.lower(og_type) == "article", 0.2),
            (_named_like_date(page), 0.15),
            (F.size(paragraphs) >= LONG_PARAGRAPHS, 0.25),
            (F.rlike(F.lower(url), F.lit(ARTICLE_URL_RE)), 0.3),
            (F.array_contains(t, "h1") & F.array_contains(t, "h2"), 0.1),
        ]
        total = jsonld.type_score(jsonld.plain_objects(docs))
        for found, weight in signals:
            total = total + F.when(found, weight).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total + BASELINE))

    rejected = is_non_article_path(url)
    return F.struct(
        (~rejected).alias("is_candidate"),
        F.when(rejected, REJECTED_CONFIDENCE).otherwise(let(tags, score)).alias("confidence"),
    )
