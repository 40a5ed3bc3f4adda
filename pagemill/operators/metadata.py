"""Article metadata of a page: meta tags, JSON-LD, headline, author, tags, image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import jsonld
from pagemill.functions.html import AUTHOR, Page, attribute, first_element, has, own_texts, text_of
from pagemill.functions.text import blank_to_null, first_filled, let, strip


def meta_tags(page: Page) -> Column:
    """array<struct<name, property, content>> of the meta tags in order."""
    found = F.filter(page.tokens, lambda t: (t["tag"] == "meta") & ~t["closing"])
    return F.transform(
        found,
        lambda t: F.struct(
            attribute(t["mark"], "name").alias("name"),
            attribute(t["mark"], "property").alias("property"),
            attribute(t["mark"], "content").alias("content"),
        ),
    )


def meta_content(metas: Column, field: str, value: str) -> Column:
    """Content of the first meta tag whose name or property is ``value``."""
    first = F.get(F.filter(metas, lambda m: m[field] == value), 0)["content"]
    return strip(blank_to_null(first))


def canonical_link(page: Page) -> Column:
    links = F.filter(
        page.tokens,
        lambda t: (t["tag"] == "link") & ~t["closing"]
        & F.rlike(attribute(t["mark"], "rel"), F.lit(r"(?:^|\s)canonical(?:\s|$)")),
    )
    return strip(blank_to_null(attribute(F.get(links, 0)["mark"], "href")))


def _author(objs: Column, metas: Column, byline: Column) -> Column:
    def read(value: Column) -> Column:
        person = F.when(jsonld.is_kind(value, "OBJECT"), value).when(
            jsonld.is_kind(value, "ARRAY"), let(jsonld.first_of(value), lambda f: F.when(jsonld.is_kind(f, "OBJECT"), f))
        )
        name = F.when(jsonld.is_kind(value, "STRING"), jsonld.as_text(value)).otherwise(
            jsonld.as_text(jsonld.member(person, "name"))
        )
        return F.struct(
            first_filled(name, meta_content(metas, "name", "author"), byline).alias("author"),
            jsonld.as_text(jsonld.member(person, "url")).alias("author_url"),
        )

    return let(jsonld.merged(objs, "author"), read)


def _category(objs: Column, metas: Column) -> Column:
    value = jsonld.merged(objs, "articleSection")
    own = let(
        value,
        lambda v: F.when(jsonld.is_kind(v, "ARRAY"), jsonld.as_text(jsonld.first_of(v)))
        .when(jsonld.is_kind(v, "STRING"), jsonld.as_text(v)),
    )
    return F.coalesce(blank_to_null(own), meta_content(metas, "property", "article:section"))


def _tags(objs: Column, metas: Column) -> Column:
    def read(v: Column) -> Column:
        split = F.filter(F.transform(F.split(jsonld.as_text(v), "[,;]"), strip), lambda t: t != "")
        listed = F.transform(jsonld.items(v), lambda t: strip(F.coalesce(jsonld.as_text(t), F.to_json(t))))
        return F.when(jsonld.is_kind(v, "STRING"), split).when(jsonld.is_kind(v, "ARRAY"), listed)

    from_meta = F.transform(
        F.filter(metas, lambda m: (m["property"] == "article:tag") & (m["content"] != "")), lambda m: strip(m["content"])
    )
    return let(let(jsonld.merged(objs, "keywords"), read), lambda own: F.when(F.size(own) > 0, own).otherwise(from_meta))


def _image(objs: Column, metas: Column) -> Column:
    def read(v: Column) -> Column:
        url = lambda o: jsonld.as_text(jsonld.member(o, "url"))
        of_first = lambda f: F.when(jsonld.is_kind(f, "STRING"), jsonld.as_text(f)).otherwise(url(f))
        return (
            F.when(jsonld.is_kind(v, "OBJECT"), url(v))
            .when(jsonld.is_kind(v, "ARRAY"), let(jsonld.first_of(v), of_first))
            .when(jsonld.is_kind(v, "STRING"), jsonld.as_text(v))
        )

    return F.coalesce(blank_to_null(let(jsonld.merged(objs, "image"), read)), meta_content(metas, "property", "og:image"))


def _dated(objs: Column, metas: Column, key: str, fallback: str) -> Column:
    own = blank_to_null(jsonld.as_text(jsonld.merged(objs, key)))
    return F.coalesce(own, meta_content(metas, "property", fallback))


def page_metadata(page: Page, url: Column, docs: Column, metas: Column, texts: Column) -> Column:
    """Struct of metadata, read from the page before noise is removed."""
    element_text = lambda e: F.when(e.isNotNull(), text_of(e, texts, ""))
    byline = let(F.get(F.filter(page.elements, lambda e: has(e["own"], AUTHOR)), 0), element_text)
    facts = F.struct(
        jsonld.article_objects(docs).alias("objs"),
        let(first_element(page, "title"), element_text).alias("title"),
        let(first_element(page, "h1"), element_text).alias("h1"),
    )

    def build(f: Column) -> Column:
        headline = jsonld.as_text(jsonld.merged(f["objs"], "headline"))
        return let(
            _author(f["objs"], metas, byline),
            lambda author: F.struct(
                F.coalesce(blank_to_null(headline), blank_to_null(f["h1"]), f["title"]).alias("title"),
                f["title"].alias("meta_title"),
                F.coalesce(
                    blank_to_null(meta_content(metas, "name", "description")),
                    meta_content(metas, "property", "og:description"),
                ).alias("meta_description"),
                F.coalesce(canonical_link(page), url).alias("canonical_url"),
                author["author"].alias("author"),
                author["author_url"].alias("author_url"),
                _dated(f["objs"], metas, "datePublished", "article:published_time").alias("published_date"),
                _dated(f["objs"], metas, "dateModified", "article:modified_time").alias("modified_date"),
                _category(f["objs"], metas).alias("category"),
                _tags(f["objs"], metas).alias("tags"),
                _image(f["objs"], metas).alias("featured_image"),
                f["h1"].alias("h1"),
            ),
        )

    return let(facts, build)
