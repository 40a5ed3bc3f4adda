"""JSON-LD objects of a page as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.html import Page, attribute
from pagemill.functions.text import any_of, let

# Schema.org types of articles, and types that speak against one.
ARTICLE_TYPES = ["Article", "BlogPosting", "NewsArticle", "TechArticle"]
SCORED_ARTICLE_TYPES = [*ARTICLE_TYPES, "Report"]
OTHER_TYPES = [
    "WebSite", "Organization", "Product", "CollectionPage", "SearchResultsPage",
    "ContactPage", "AboutPage", "BreadcrumbList",
]

_NO_VARIANTS = "array<variant>"


def kind(value: Column) -> Column:
    """'STRING', 'ARRAY', 'OBJECT', 'VOID', ... ; NULL when the value is absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def is_kind(value: Column, name: str) -> Column:
    return F.coalesce(kind(value) == name, F.lit(False))


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_text(value: Column) -> Column:
    """Text of a scalar; NULL for objects, arrays and null."""
    scalar = kind(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN")
    return F.when(scalar, F.try_variant_get(value, "$", "string"))


def member(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$['{key}']", "variant")


def documents(page: Page) -> Column:
    """Parsed JSON-LD scripts in order; scripts that do not parse are left out."""
    scripts = F.filter(
        page.tokens,
        lambda t: (t["tag"] == "script") & F.contains(t["mark"], F.lit("ld+json"))
        & (F.lower(attribute(F.regexp_extract(t["mark"], r"(?s)^<[^>]*>", 0), "type")) == "application/ld+json"),
    )
    bodies = F.transform(
        scripts, lambda t: F.regexp_replace(F.regexp_replace(t["mark"], r"(?s)^<[^>]*>", ""), r"(?is)</script[^>]*>?$", "")
    )
    parsed = F.transform(bodies, lambda b: F.try_parse_json(F.when(b == "", "{}").otherwise(b)))
    return F.filter(parsed, lambda v: v.isNotNull())


def _top_objects(doc: Column) -> Column:
    return F.when(is_kind(doc, "ARRAY"), items(doc)).otherwise(F.array(doc))


def _only_objects(values: Column) -> Column:
    return F.filter(values, lambda v: is_kind(v, "OBJECT"))


def objects(docs: Column) -> Column:
    """Objects of every document: the document, its list, or its ``@graph``."""

    def one(doc: Column) -> Column:
        graph = member(doc, "@graph")
        opened = (
            F.when(is_kind(doc, "OBJECT") & graph.isNotNull(), F.coalesce(items(graph), F.array().cast(_NO_VARIANTS)))
            .otherwise(_top_objects(doc))
        )
        return _only_objects(opened)

    return F.flatten(F.transform(docs, one))


def plain_objects(docs: Column) -> Column:
    """Objects without opening ``@graph``, as the article score reads them."""
    return F.flatten(F.transform(docs, lambda d: _only_objects(_top_objects(d))))


def has_type(obj: Column, types: list[str]) -> Column:
    found = member(obj, "@type")
    names = F.when(is_kind(found, "ARRAY"), items(found)).otherwise(F.array(found))
    return F.coalesce(F.exists(names, lambda n: any_of(as_text(n), types)), F.lit(False))


def article_objects(docs: Column) -> Column:
    return F.filter(objects(docs), lambda o: has_type(o, ARTICLE_TYPES))


def merged(objs: Column, key: str) -> Column:
    """Value of a key after merging all objects, later ones winning."""
    having = F.filter(F.transform(objs, lambda o: member(o, key)), lambda v: v.isNotNull())
    return F.try_element_at(having, F.lit(-1))


def type_score(objs: Column) -> Column:
    """+0.4 for each article object and -0.3 for each object of another known type."""
    def add(total: Column, obj: Column) -> Column:
        return (
            F.when(has_type(obj, SCORED_ARTICLE_TYPES), total + 0.4)
            .when(has_type(obj, OTHER_TYPES), total - 0.3).otherwise(total)
        )

    return F.aggregate(objs, F.lit(0.0), add)


def first_of(value: Column) -> Column:
    return let(items(value), lambda a: F.get(a, 0))
