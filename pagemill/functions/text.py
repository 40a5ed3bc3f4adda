"""Text helpers as column expressions: strip, word counts, entity decoding."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as white space for stripping and splitting.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
WHITESPACE = "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))
# The low code points stand one by one and the high ones behind a range test: the regex
# engine then answers most characters with one bit lookup.
_LOW = "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE if ord(c) < 256)
_HIGH = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in WHITESPACE_RANGES if lo >= 256)
SPACES_RE = f"[{_LOW}[\\x{{1680}}-\\x{{3000}}&&[{_HIGH}]]]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Lambda bodies get no common-subexpression elimination, so a costly value that is
    needed twice is bound to a lambda variable instead: the start value of a fold over
    nothing. A transform of one element would copy its whole result at every use.
    """
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def word_count(text: Column) -> Column:
    """Number of pieces between runs of white space."""
    return let(strip(text), lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, SPACES_RE))))


def blank_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def first_filled(*texts: Column) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def word_array(words: list[str]) -> Column:
    """Literal array, made with one call to the JVM however long the list is."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def any_of(text: Column, words: list[str]) -> Column:
    return F.array_contains(word_array(words), text)


def percent_decode(text: Column, form: bool = False) -> Column:
    """Decode ``%XX`` runs, leaving broken escapes as they are. ``form`` also reads + as space."""
    escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    if not form:
        escaped = F.replace(escaped, F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(text, F.lit("%")) | F.contains(text, F.lit("+")), F.try_url_decode(escaped)).otherwise(text)


def form_encode(text: Column) -> Column:
    """Query-string encoding: letters, digits and ``_.-~`` stay, a space becomes ``+``."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


# Names that may stand without a closing semicolon, taken from the standard library.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_NAMED = {n: html5[n + ";"] for n in sorted({*name2codepoint, *_BARE_NAMES, "apos"})}
_BARE_RE = "^(?:" + "|".join(_BARE_NAMES) + ")"
_REF_RE = "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)"


def _named_map() -> Column:
    pairs = "\x02".join(f"{name}\x01{char}" for name, char in _NAMED.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))


def _lookup(name: Column) -> Column:
    return (
        F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">")
        .when(name == "quot", '"').when(name == "nbsp", "\xa0")
        .otherwise(F.try_element_at(_named_map(), name))
    )


def _numeric_char(ref: Column) -> Column:
    """Character of ``#123`` or ``#x1F``; anything that is no character becomes U+FFFD."""
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.when(is_hex, F.substring(ref, F.lit(3), F.length(ref))).otherwise(F.substring(ref, F.lit(2), F.length(ref)))
    digits = F.regexp_replace(digits, "^0+(?=.)", "")

    def to_char(d: Column) -> Column:
        hex8 = F.lpad(F.when(is_hex, F.upper(d)).otherwise(F.hex(F.try_to_number(d, F.lit("999999999999")).cast("bigint"))), 8, "0")
        valid = (
            (F.length(d) <= 8)
            & hex8.between("00000001", "0010FFFF")
            & ~hex8.between("0000D800", "0000DFFF")
        )
        return F.when(valid, F.decode(F.unhex(hex8), "UTF-32")).otherwise("\ufffd")

    return let(digits, to_char)


def _decode_part(part: Column, in_attribute: bool) -> Column:
    """Decode the text after one ``&``."""

    def rest(used: Column) -> Column:
        return F.substring(part, used + 1, F.length(part))

    def without_semicolon(used: Column) -> Column:
        return rest(F.when(F.substring(part, used + 1, F.lit(1)) == ";", used + 1).otherwise(used))

    def bare(name: Column) -> Column:
        found = F.regexp_extract(part, _BARE_RE, 0)

        def use(hit: Column) -> Column:
            ok = hit != ""
            if in_attribute:
                ok = ok & ~F.rlike(rest(F.length(hit)), F.lit("^[A-Za-z0-9=]"))
            return F.when(ok, F.concat(_lookup(hit), rest(F.length(hit)))).otherwise(F.concat(F.lit("&"), part))

        return let(found, use)

    def by_name(name: Column) -> Column:
        closed = F.substring(part, F.length(name) + 1, F.lit(1)) == ";"
        return (
            F.when(name == "", F.concat(F.lit("&"), part))
            .when(F.startswith(name, F.lit("#")), F.concat(_numeric_char(name), without_semicolon(F.length(name))))
            .when(closed & (name == "amp"), F.concat(F.lit("&"), F.substring(part, F.lit(5), F.length(part))))
            .when(closed & _lookup(name).isNotNull(), F.concat(_lookup(name), rest(F.length(name) + 1)))
            .otherwise(bare(name))
        )

    return let(F.regexp_extract(part, _REF_RE, 1), by_name)


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Decode character references in one pass, so that ``&amp;lt;`` gives ``&lt;``."""

    def decode(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: _decode_part(p, in_attribute))
        return F.concat(F.get(parts, 0), F.array_join(tail, ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&", -1), decode)).otherwise(text)
