"""Article content of a page: container, blocks, structured text, sections, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.html import (
    CONTENT, LIST_TAGS, WRAPPING_BLOCKS, WRAPS, Page, descendants, first_element, has, live_texts, noisy, text_length,
    text_of,
)
from pagemill.functions.text import any_of, blank_to_null, let, strip, word_count

# Heading marks, block elements and the smallest text of a main container.
HEADING_MARKS = {"h1": "[H1]", "h2": "[H2]", "h3": "[H3]", "h4": "[H3]"}
BLOCKS = [*HEADING_MARKS, "p", *WRAPPING_BLOCKS]
MIN_CONTAINER_CHARS = 200
MIN_ARTICLE_WORDS = 50
# Headings of question lists and of closing sections.
FAQ_RE = r"(?iuU)\bfaq\b|frequently asked questions"
CONCLUSION_RE = r"(?iuU)\bconclusion\b|final thoughts|wrapping up|in summary|to summarize"
# Warning texts.
SHORT_BODY_WARNING = "Fell back to whole-page text (article body was too short)"
LOW_QUALITY_WARNING = "Extracted word count below quality threshold (possible extraction failure)"


def main_container(page: Page, texts: Column) -> Column:
    """Element that holds the article; NULL stands for the whole page."""
    live = lambda test: F.filter(page.elements, lambda e: test(e) & ~noisy(e))
    first = lambda tag: F.slice(live(lambda e: e["tag"] == tag), 1, 1)
    long_enough = lambda one: F.get(F.filter(one, lambda e: text_length(e, texts) > MIN_CONTAINER_CHARS), 0)

    measured = F.transform(
        live(lambda e: has(e["own"], CONTENT)),
        lambda e: F.struct(text_length(e, texts).alias("length"), (-e["open"]).alias("order"), e.alias("element")),
    )
    densest = F.array_max(F.filter(measured, lambda m: m["length"] > MIN_CONTAINER_CHARS))["element"]
    return F.coalesce(long_enough(first("article")), long_enough(first("main")), densest, F.get(first("body"), 0))


def _list_text(element: Column, elements: Column, texts: Column) -> Column:
    items = F.filter(
        descendants(element, elements), lambda e: (e["tag"] == "li") & (e["up"] == element["open"]) & ~noisy(e)
    )
    shown = F.filter(F.transform(items, lambda e: text_of(e, texts, " ")), lambda t: t != "")
    mark = F.when(element["tag"] == "ul", "- ").otherwise("1. ")
    return blank_to_null(F.array_join(F.transform(shown, lambda t: F.concat(mark, t)), "\n"))


def _table_text(element: Column, elements: Column, texts: Column) -> Column:
    rows = F.filter(descendants(element, elements), lambda e: (e["tag"] == "tr") & ~noisy(e))

    def row(tr: Column) -> Column:
        cells = F.filter(descendants(tr, elements), lambda e: any_of(e["tag"], ["td", "th"]) & ~noisy(e))
        return let(
            F.transform(cells, lambda c: text_of(c, texts, " ")),
            lambda shown: F.when(F.size(shown) > 0, F.array_join(shown, " | ")),
        )

    lines = F.filter(F.transform(rows, row), lambda r: r.isNotNull())
    return let(lines, lambda l: F.when(F.size(l) > 0, F.array_join(l, "\n")))


def block_lines(page: Page, container: Column, texts: Column) -> Column:
    """array<struct<tag, text, line>> of the blocks that give a line, in order."""
    inside = F.when(container.isNull(), page.elements).otherwise(descendants(container, page.elements))
    blocks = F.filter(
        inside,
        lambda e: any_of(e["tag"], BLOCKS) & ~noisy(e) & (has(e["own"], WRAPS) | ~has(e["inside"], WRAPS)),
    )
    mark = F.create_map(*[F.lit(x) for pair in HEADING_MARKS.items() for x in pair])

    def render(e: Column) -> Column:
        is_heading = any_of(e["tag"], list(HEADING_MARKS))
        text = (
            F.when(is_heading, blank_to_null(text_of(e, texts, "")))
            .when(any_of(e["tag"], LIST_TAGS), _list_text(e, page.elements, texts))
            .when(e["tag"] == "table", _table_text(e, page.elements, texts))
            .otherwise(blank_to_null(text_of(e, texts, " ")))
        )
        line = lambda t: (
            F.when(is_heading, F.concat(F.lit("\n"), F.try_element_at(mark, e["tag"]), F.lit(" "), t, F.lit("\n")))
            .when(e["tag"] == "blockquote", F.concat(F.lit('> "'), t, F.lit('"'))).otherwise(t)
        )
        return let(text, lambda t: F.struct(e["tag"].alias("tag"), t.alias("text"), line(t).alias("line")))

    return F.filter(F.transform(blocks, render), lambda b: b["text"].isNotNull())


def _headings(lines: Column, tags: list[str]) -> Column:
    return F.transform(F.filter(lines, lambda b: any_of(b["tag"], tags)), lambda b: b["text"])


def faq_text(lines: Column) -> Column:
    """Paragraphs and lists between a question heading and the next heading of any level."""
    starts = F.filter(
        F.transform(
            lines,
            lambda b, i: F.when(
                any_of(b["tag"], list(HEADING_MARKS)), F.struct(i.alias("at"), F.rlike(b["text"], F.lit(FAQ_RE)).alias("faq"))
            ),
        ),
        lambda h: h.isNotNull(),
    )

    def spans(heads: Column) -> Column:
        bounded = F.transform(
            heads,
            lambda h, i: F.struct(h["at"].alias("at"), h["faq"].alias("faq"),
                                  F.coalesce(F.get(heads, i + 1)["at"], F.size(lines)).alias("end")),
        )
        parts = F.flatten(
            F.transform(
                F.filter(bounded, lambda s: s["faq"]), lambda s: F.slice(lines, s["at"] + 2, s["end"] - s["at"] - 1)
            )
        )
        shown = F.filter(parts, lambda b: any_of(b["tag"], ["p", *LIST_TAGS]))
        return strip(F.array_join(F.transform(shown, lambda b: b["text"]), "\n"))

    return let(starts, spans)


def split_sections(structured: Column) -> Column:
    """struct<introduction, body> of a structured text."""

    def split(at: Column) -> Column:
        return F.struct(
            F.when(at > 1, strip(F.substring(structured, F.lit(1), at - 1)))
            .otherwise(strip(F.substring_index(structured, "\n\n", 1))).alias("introduction"),
            F.when(at > 1, strip(F.substring(structured, at, F.length(structured)))).otherwise(structured).alias("body"),
        )

    return let(F.locate("[H2]", structured), split)


def _conclusion(body: Column) -> Column:
    sections = F.split(body, r"(?=\[H2\]|\[H3\])")
    closing = F.filter(
        F.transform(sections, strip), lambda s: F.rlike(F.substring_index(s, "\n", 1), F.lit(CONCLUSION_RE))
    )
    return F.coalesce(F.try_element_at(closing, F.lit(-1)), F.lit(""))


def page_content(page: Page, own: Column) -> Column:
    """Struct of article content, read from the page after noise is removed; ``own``: its ``own_texts``."""

    def with_texts(texts: Column) -> Column:
        return let(main_container(page, texts), lambda c: let(block_lines(page, c, texts), lambda lines: from_lines(lines, texts)))

    def from_lines(lines: Column, texts: Column) -> Column:
        structured = strip(F.array_join(F.transform(lines, lambda b: b["line"]), "\n"))
        return let(structured, lambda s: let(split_sections(s), lambda parts: assemble(lines, texts, s, parts)))

    def assemble(lines: Column, texts: Column, structured: Column, parts: Column) -> Column:
        def compare(body_words: Column) -> Column:
            fallback = F.when(body_words < MIN_ARTICLE_WORDS, _whole_text(page, texts))
            return let(
                fallback,
                lambda f: let(
                    F.coalesce(word_count(f) > body_words, F.lit(False)),
                    lambda longer: _finish(lines, structured, parts, f, longer),
                ),
            )

        return let(word_count(parts["body"]), compare)

    return let(live_texts(page, own), with_texts)


def _whole_text(page: Page, texts: Column) -> Column:
    """All text of the body outside noise elements."""
    def pick(body: Column) -> Column:
        return F.when(body.isNotNull(), text_of(body, texts, " ")).otherwise(
            F.array_join(F.filter(texts, lambda t: t != ""), " ")
        )

    return let(first_element(page, "body"), pick)


def _finish(lines: Column, structured: Column, parts: Column, fallback: Column, fell_back: Column) -> Column:
    def build(text: Column, words: Column) -> Column:
        warnings = F.filter(
            F.array(
                F.when(fell_back, SHORT_BODY_WARNING),
                F.when(words < MIN_ARTICLE_WORDS, LOW_QUALITY_WARNING),
            ),
            lambda w: w.isNotNull(),
        )
        return F.struct(
            _headings(lines, ["h2"]).alias("h2_headings"),
            _headings(lines, ["h3", "h4"]).alias("h3_headings"),
            text.alias("structured_content"),
            parts["introduction"].alias("introduction"),
            F.when(fell_back, fallback).otherwise(parts["body"]).alias("main_content"),
            _conclusion(parts["body"]).alias("conclusion"),
            faq_text(lines).alias("faq_content"),
            words.alias("word_count"),
            (words >= MIN_ARTICLE_WORDS).alias("quality_ok"),
            warnings.alias("warnings"),
        )

    full = F.when(fell_back & (structured == ""), fallback).otherwise(structured)
    return let(word_count(full), lambda words: build(full, words))
