"""HTML pages as arrays of tokens and elements, built with column expressions only.

``parse_page`` turns one HTML text into tokens (a mark such as ``<p class=x>`` with the
text that follows it) and elements (spans of tokens, in document order). A page stays one
row from scan to result, so nothing here shuffles: every page is handled by a narrow,
JVM-side projection and no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import decode_entities, let, strip, word_count

# One token: a comment, a whole script or style, a tag, or other markup; then its text.
_ATTRS = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
TOKEN_RE = (
    r"(?is)(<!--.*?(?:-->|\z)"
    r"|<(?=(/?[a-z][^\s/>]*+))(?:(?:script|style)(?![^\s/>])" + _ATTRS
    + r"(?:>.*?(?:</\2(?![^\s/>])[^>]*+(?:>|\z)|\z)|\z)"
    r"|/?[a-z]" + _ATTRS + r"(?:>|\z))"
    r"|<[!?/][^>]*+(?:>|\z))"
    r"((?:[^<]++|<(?![a-z/!?]))*+)"
)

_NAME_RE = r"(?i)^<(/?[a-z][^\s/>]*+)"

# Elements without content.
VOID_TAGS = [
    "area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex",
    "keygen", "link", "meta", "param", "source", "track", "wbr",
]
# Elements kept as structure. Others count only when their class or id matters.
BLOCK_TAGS = [
    "html", "body", "title", "div", "section", "article", "main", "nav", "footer", "header", "aside",
    "form", "fieldset", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "ul", "ol", "li",
    "dl", "dt", "dd", "blockquote", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure", "figcaption",
    "address", "noscript", "iframe", "svg", "template", "rt", "rp", "center", "details", "summary",
]
# Elements whose text is never shown as page text.
MUTED_TAGS = ["template", "rt", "rp"]
# Elements left out of the quick word count of a page.
SHELL_TAGS = ["nav", "footer", "header"]
# Elements that are never article content.
NOISE_TAGS = ["script", "style", "noscript", "iframe", "svg", "form", "nav", "footer", "header", "aside"]
# Parts of class and id values that mark an element as noise.
NOISE_CLASS_RE = (
    "cookie|newsletter|subscribe|advert|advertisement|sidebar|related-post|related_posts|"
    "you-may-like|share|social-share|comment|popup|modal|breadcrumb"
)
NOISE_ID_RE = "cookie|advert|sidebar|comment"
# Parts of class and id values that mark a content wrapper.
CONTENT_CLASS_RE = "post-content|entry-content|article-content|article-body|content"
CONTENT_ID_RE = "content"
AUTHOR_CLASS_RE = "(?i)author"
LIST_TAGS = ["ul", "ol"]
WRAPPING_BLOCKS = ["blockquote", "table", "ul", "ol"]

# Rules for end tags the author left out: a start tag on the left ends open elements on the right.
_ENDS_PARAGRAPH = [t for t in BLOCK_TAGS if t not in ("html", "title", "noscript", "iframe", "svg", "template", "rt", "rp")]
_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_CELLS = ["td", "th"]
_ROW_GROUPS = ["thead", "tbody", "tfoot"]
ALSO_ENDED_BY = {
    **{h: _HEADINGS for h in _HEADINGS},
    **{t: _HEADINGS for t in ("form", "fieldset", "table")},
    "p": _HEADINGS,
    "li": ["li", *_HEADINGS],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "tr": ["tr", *_CELLS],
    **{t: _CELLS for t in _CELLS},
    **{t: ["tr", *_CELLS, *_ROW_GROUPS, "caption"] for t in _ROW_GROUPS},
}
# An end tag never ends an element that binds more strongly than its own.
_STRENGTH = {"div": 150, "td": 160, "th": 160, "tr": 170, **{t: 180 for t in _ROW_GROUPS}, "table": 190,
             "body": 200, "html": 220}

# Bits of an element: what it is itself (``own``) and what it lies in (``inside``).
NOISE, MUTED, SHELL, WRAPS, CONTENT, AUTHOR, VOID = 1, 2, 4, 8, 16, 32, 64
_INHERITED = NOISE | MUTED | SHELL | WRAPS

# While elements are matched, tags are numbers: a fold copies what it carries at every step, and texts are the dear part.
_MATCHED = "struct<open:int,close:int,n:int,kids:int,up:int,own:int,inside:int>"
_ENTRY = "struct<i:int,n:int,up:int,id:int,bit:bigint,strength:int,own:int,inside:int>"
_OTHER = 1000  # numbers from here on are tags without a place in the tables above


@dataclass
class Page:
    """A parsed page inside a column expression.

    ``tokens``: array of (mark, tag, closing, text), in order.
    ``elements``: array of spans ``[open, close)`` over tokens; ``n`` is the 0-based place
    in the array and the ``kids`` elements after it are its descendants.
    """

    tokens: Column
    elements: Column


def _up_to_attribute(name: str) -> str:
    """Expression from the start of a tag to the name of its first attribute ``name``; steps over other attributes without going back."""
    return (
        r"(?is)^<[^\s/>]++(?:[\s/]++(?!" + name + r"(?![^\s=>/]))[^\s=>/]++"
        r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+[\s/]++" + name + r"(?![^\s=>/])"
    )


def attribute(mark: Column, name: str) -> Column:
    """Value of an attribute of a start tag; '' when it is empty or absent."""
    walk = _up_to_attribute(name) + r"\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"

    def unquote(value: Column) -> Column:
        quoted = F.rlike(value, F.lit("^[\"']"))
        return decode_entities(
            F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value), in_attribute=True
        )

    present = F.contains(mark, F.lit("=")) & F.rlike(mark, F.lit("(?i)" + name))
    return F.when(present, let(F.regexp_extract(mark, walk, 1), unquote)).otherwise("")


def has_attribute(mark: Column, name: str) -> Column:
    """True if a start tag has the attribute, with a value or without."""
    return F.rlike(mark, F.lit(_up_to_attribute(name)))


def tokenize(html: Column) -> Column:
    """array<struct<mark, tag, closing, text>>; text is decoded and stripped."""
    page = F.concat(F.lit("<!---->"), html)

    def token(mark: Column, name: Column, text: Column) -> Column:
        return F.struct(
            mark.alias("mark"),
            F.ltrim(F.lower(name), F.lit("/")).alias("tag"),
            F.startswith(name, F.lit("/")).alias("closing"),
            F.when(text == "", text).otherwise(strip(decode_entities(text))).alias("text"),
        )

    # Two passes over the page: a token's name begins its mark, and what follows the mark is its text.
    part = lambda i: F.regexp_extract_all(page, F.lit(TOKEN_RE), F.lit(i))

    def split(mark: Column, whole: Column) -> Column:
        name, text = F.regexp_extract(mark, _NAME_RE, 1), F.substring(whole, F.length(mark) + 1, F.length(whole))
        return let(F.struct(name.alias("name"), text.alias("text")), lambda p: token(mark, p["name"], p["text"]))

    return let(part(0), lambda wholes: F.transform(part(1), lambda m, i: split(m, F.get(wholes, i))))


def _tag_facts() -> Column:
    """Literal map: tag -> number, bit, strength and bits, and as one mask the bits of the open elements its start tag ends."""
    facts = []
    tags = list(dict.fromkeys([*BLOCK_TAGS, *VOID_TAGS, "script", "style"]))
    bit_of = {tag: 1 << i for i, tag in enumerate(BLOCK_TAGS)}  # fewer than 64; no other tag is ended by a start tag
    for i, tag in enumerate(tags):
        bits = (
            NOISE * (tag in NOISE_TAGS) | MUTED * (tag in MUTED_TAGS) | SHELL * (tag in SHELL_TAGS)
            | WRAPS * (tag in WRAPPING_BLOCKS) | VOID * (tag in VOID_TAGS or tag in ("script", "style"))
        )
        ends = sum(bit_of[t] for t in {*(["p"] if tag in _ENDS_PARAGRAPH else []), *ALSO_ENDED_BY.get(tag, [])})
        facts.append(f"'{tag}', named_struct('id', {i}, 'bit', {bit_of.get(tag, 0)}L, 'bits', {bits}, "
                     f"'strength', {_STRENGTH.get(tag, 100)}, 'ends', {ends}L)")
    return F.expr(f"map({', '.join(facts)})")


def has(bits: Column, flag: int) -> Column:
    return bits.bitwiseAND(F.lit(flag)) != 0


def noisy(element: Column) -> Column:
    return has(element["own"].bitwiseOR(element["inside"]), NOISE)


def outermost(element: Column, flag: int) -> Column:
    """True for an element that carries the flag and lies in no other one that does."""
    return has(element["own"], flag) & ~has(element["inside"], flag)


def _class_bits(mark: Column) -> Column:
    """Bits set by the class and id of a start tag."""
    bit = lambda test, flag: F.when(test, flag).otherwise(0)
    by_class = let(
        attribute(mark, "class"),
        lambda c: F.when(c == "", 0).otherwise(
            bit(F.rlike(c, F.lit(NOISE_CLASS_RE)), NOISE)
            .bitwiseOR(bit(F.rlike(c, F.lit(CONTENT_CLASS_RE)), CONTENT))
            .bitwiseOR(bit(F.rlike(c, F.lit(AUTHOR_CLASS_RE)), AUTHOR))
        ),
    )
    by_id = let(
        attribute(mark, "id"),
        lambda c: F.when(c == "", 0).otherwise(
            bit(F.rlike(c, F.lit(NOISE_ID_RE)), NOISE).bitwiseOR(bit(F.rlike(c, F.lit(CONTENT_ID_RE)), CONTENT))
        ),
    )
    named = F.contains(mark, F.lit("=")) & F.rlike(mark, F.lit(r"(?i)(?:class|id)\s*="))
    return F.when(named, by_class.bitwiseOR(by_id)).otherwise(0)


def _structure_marks(tokens: Column) -> Column:
    """Tokens that open or close structure, with the facts the element builder needs.

    Inline tags count only on pages where such a tag carries a class or id that matters.
    """

    def facts(tok: Column, i: Column) -> Column:
        opening = ~tok["closing"]

        def known(f: Column) -> Column:
            own = F.coalesce(f["bits"], F.lit(0))
            usable = tok["closing"] | ~(has(own, VOID) | F.endswith(tok["mark"], F.lit("/>")))
            return F.when(
                usable,
                F.struct(
                    i.cast("int").alias("i"), tok["tag"].alias("tag"), opening.alias("opening"),
                    F.coalesce(f["id"], F.lit(_OTHER)).alias("id"), F.coalesce(f["bit"], F.lit(0).cast("bigint")).alias("bit"),
                    F.when(opening, own.bitwiseOR(_class_bits(tok["mark"]))).otherwise(0).alias("own"),
                    F.coalesce(f["strength"], F.lit(100)).alias("strength"),
                    F.coalesce(f["ends"], F.lit(0).cast("bigint")).alias("ends"),
                    f.isNotNull().alias("block"),
                ),
            )

        return F.when(tok["tag"] != "", let(F.try_element_at(_tag_facts(), tok["tag"]), known))

    def keep(marks: Column) -> Column:
        special = F.array_distinct(
            F.transform(F.filter(marks, lambda m: ~m["block"] & (m["own"] != 0)), lambda m: m["tag"])
        )
        blocks = lambda s: F.filter(marks, lambda m: m["block"] | F.array_contains(s, m["tag"]))
        numbered = lambda s: F.transform(
            blocks(s),
            lambda m: m.withField("id", F.when(m["block"], m["id"]).otherwise((F.array_position(s, m["tag"]) + _OTHER).cast("int"))),
        )
        return let(special, lambda s: F.when(F.size(s) == 0, F.filter(marks, lambda m: m["block"])).otherwise(numbered(s)))

    return let(F.filter(F.transform(tokens, facts), lambda m: m.isNotNull()), keep)


def build_elements(marks: Column, tokens: Column) -> Column:
    """Match start and end tags with a stack; array of elements in document order.

    A fold copies what it carries at every step, so the marks are taken in pieces of about the square root of their number:
    within a piece the fold carries the elements that end there, and those of the pieces before are copied once a piece.
    """

    def closed(entries: Column, at: Column, seen: Column) -> Column:
        return F.transform(
            entries,
            lambda e: F.struct(
                e["i"].alias("open"), at.alias("close"), e["n"].alias("n"), (seen - e["n"] - 1).alias("kids"),
                e["up"].alias("up"), e["own"].alias("own"), e["inside"].alias("inside"),
            ),
        )

    def kept_depth(stack: Column, top: Column, depth: Column, m: Column) -> Column:
        """Open elements that stay open; mostly the innermost one decides."""
        ended = lambda e: e["bit"].bitwiseAND(m["ends"]) != 0
        # Of the open elements that a tag does not pass, the last one tells.
        by_start_tag = F.array_max(F.transform(stack, lambda e, i: F.when(ended(e), 0).otherwise(i + 1)))
        by_end_tag = F.array_max(F.transform(
            stack,
            lambda e, i: F.when(e["id"] == m["id"], F.struct(i.alias("at"), i.alias("kept")))
            .when(e["strength"] > m["strength"], F.struct(i.alias("at"), depth.alias("kept"))),
        ))["kept"]
        return (
            F.when(depth == 0, 0)
            .when(m["opening"], F.when(ended(top), by_start_tag).otherwise(depth))
            .when(top["id"] == m["id"], depth - 1).when(top["strength"] > m["strength"], depth)
            .otherwise(F.coalesce(by_end_tag, depth))
        )

    def entry(m: Column, top: Column, seen: Column) -> Column:
        inside = F.coalesce(top["own"].bitwiseOR(top["inside"]).bitwiseAND(F.lit(_INHERITED)), F.lit(0))
        return F.struct(
            m["i"].alias("i"), seen.alias("n"), F.coalesce(top["i"], F.lit(-1)).alias("up"), m["id"].alias("id"),
            m["bit"].alias("bit"), m["strength"].alias("strength"), m["own"].alias("own"), inside.alias("inside"),
        )

    empty = lambda t: F.array().cast(t)

    def step(acc: Column, m: Column) -> Column:
        stack, seen = acc["stack"], acc["seen"]

        def advance(depth: Column, k: Column) -> Column:
            nothing_ends = k == depth
            base = F.when(nothing_ends, stack).otherwise(F.slice(stack, F.lit(1), k))
            ended = closed(F.slice(stack, k + 1, depth - k), m["i"], seen)
            top = F.when(k > 0, F.get(stack, k - 1))
            return F.struct(
                F.when(m["opening"], F.concat(base, F.array(entry(m, top, seen)))).otherwise(base).alias("stack"),
                F.when(m["opening"], seen + 1).otherwise(seen).alias("seen"),
                F.when(nothing_ends, acc["ended"]).otherwise(F.concat(acc["ended"], ended)).alias("ended"),
            )

        depth = F.size(stack)
        return let(kept_depth(stack, F.try_element_at(stack, F.lit(-1)), depth, m), lambda k: advance(depth, k))

    def piece_step(acc: Column, piece: Column) -> Column:
        start = F.struct(
            acc["stack"].alias("stack"), acc["seen"].alias("seen"), empty(f"array<{_MATCHED}>").alias("ended"))
        done = lambda after: F.struct(
            after["stack"].alias("stack"), after["seen"].alias("seen"),
            F.concat(acc["done"], F.array(after["ended"])).alias("done"),
        )
        return F.aggregate(piece, start, step, done)

    def finish(acc: Column) -> Column:
        rest = closed(acc["stack"], F.size(tokens), acc["seen"])
        return F.transform(
            F.sort_array(F.concat(F.flatten(acc["done"]), rest)),
            lambda e: F.struct(
                e["open"].alias("open"), e["close"].alias("close"), e["n"].alias("n"), e["kids"].alias("kids"),
                e["up"].alias("up"), F.get(tokens, e["open"])["tag"].alias("tag"), e["own"].alias("own"),
                e["inside"].alias("inside"),
            ),
        )

    def fold(all_marks: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(all_marks) + 1)).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(all_marks) / length).cast("int")),
            lambda i: F.slice(all_marks, i * length + 1, length),
        )
        start = F.struct(
            empty(f"array<{_ENTRY}>").alias("stack"), F.lit(0).alias("seen"),
            empty(f"array<array<{_MATCHED}>>").alias("done"),
        )
        return F.aggregate(pieces, start, piece_step, finish)

    return let(marks, fold)


def with_page(html: Column, body) -> Column:
    """Parse once and hand the page to ``body``; the result is one column expression."""

    def bind(tokens: Column) -> Column:
        elements = build_elements(_structure_marks(tokens), tokens)
        return let(elements, lambda e: body(Page(tokens, e)))

    return let(tokenize(html), bind)


def own_texts(page: Page) -> Column:
    """Texts by token, with texts inside muted elements blanked."""
    texts = F.transform(page.tokens, lambda t: t["text"])
    spans = F.filter(page.elements, lambda e: outermost(e, MUTED))
    return _blank_if_any(texts, spans)


def _blank_if_any(texts: Column, spans: Column) -> Column:
    return let(spans, lambda s: F.when(F.size(s) == 0, texts).otherwise(blank(texts, s)))


def blank(texts: Column, spans: Column) -> Column:
    """Replace the texts inside disjoint, ordered spans by ''."""

    def bound(t: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["close"])
            return F.concat(
                F.slice(t, before + 1, span["open"] - before),
                F.array_repeat(F.lit(""), span["close"] - span["open"]),
            )

        last = F.coalesce(F.try_element_at(spans, F.lit(-1))["close"], F.lit(0))
        return F.concat(F.flatten(F.transform(spans, piece)), F.slice(t, last + 1, F.size(t) - last))

    return let(texts, bound)


def live_texts(page: Page, texts: Column) -> Column:
    """``texts`` (of ``own_texts``) with noise elements blanked."""
    return _blank_if_any(texts, F.filter(page.elements, lambda e: outermost(e, NOISE)))


def shown_texts(page: Page) -> Column:
    """Texts by token outside navigation, header and footer."""
    return _blank_if_any(own_texts(page), F.filter(page.elements, lambda e: outermost(e, SHELL)))


def texts_of(element: Column, texts: Column) -> Column:
    """The non-empty texts inside an element."""
    return F.filter(F.slice(texts, element["open"] + 1, element["close"] - element["open"]), lambda t: t != "")


def text_of(element: Column, texts: Column, separator: str) -> Column:
    return F.array_join(texts_of(element, texts), separator)


def text_length(element: Column, texts: Column) -> Column:
    window = F.slice(texts, element["open"] + 1, element["close"] - element["open"])
    return F.aggregate(window, F.lit(0), lambda n, t: n + F.length(t))


def descendants(element: Column, elements: Column) -> Column:
    return F.slice(elements, element["n"] + 2, element["kids"])


def first_element(page: Page, tag: str) -> Column:
    return F.get(F.filter(page.elements, lambda e: e["tag"] == tag), 0)


def visible_word_count(page: Page) -> Column:
    return let(shown_texts(page), lambda texts: word_count(F.array_join(texts, " ")))
