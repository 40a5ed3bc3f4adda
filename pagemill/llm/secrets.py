"""Secret scans over a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams is derived from it: every text it can
match holds, in lower case, the trigrams of one of its mandatory strings. The index keeps, for each trigram that a
rule asks for, the documents that hold it (``postings``); the postings of a document meet under its key,
where the queries are decided, and only the candidates of a rule are searched with its expression. Rules without a
mandatory trigram (runs of hexadecimal digits) search every text. Only built-in functions are used; the
texts are read in place and joined with their candidates by key, so no hot key arises.

Spans are in code points, end exclusive, leftmost and non-overlapping per rule. They come from one lazy
expression that splits the text into gaps and hits.

Cases: a NULL or empty text has no spans; repeated rows are searched each; a NULL ``doc_id`` is a key like
any other; very long texts are searched whole; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import packed, stored, whole_text


@dataclass(frozen=True)
class Rule:
    """``group`` and ``least``: a hit whose group is shorter than ``least`` code points is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Order of kinds matters where two spans start at one place. The first three are the base rules.
RULES = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s:@/]++:[^\s:@/]++@"),
]
CANDIDATES = 500_000  # documents that texts meet where they lie
_MOST = 64  # strings held at once while a query is derived


def _grams(strings: set[str]) -> tuple | None:
    """Query that one of the strings occurs; None: says nothing."""
    if any(len(s) < 3 for s in strings):
        return None
    options = {tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in strings}
    return ("or", [("and", list(o)) for o in sorted(options)])


def _all_of(parts: list) -> tuple | None:
    known = [p for p in parts if p is not None]
    return ("and", known) if known else None


def _characters(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 10:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 10 else None


def _one(kind, value) -> tuple[set[str] | None, tuple | None]:
    """Strings that a node can be (lower case; None: too many), and the query that holds where it matched."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN:
        return _characters(value), None
    if kind is op.AT:
        return {""}, None
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind is op.BRANCH:
        branches = [_sequence(b) for b in value[1]]
        if all(e is not None for e, _ in branches) and sum(len(e) for e, _ in branches) <= _MOST:
            return set().union(*[e for e, _ in branches]), None
        queries = [q if e is None else _grams(e) for e, q in branches]
        return None, None if None in queries else ("or", queries)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        exact, query = _sequence(body)
        if exact is not None and high == 1:
            return exact | {""} if low == 0 else exact, None
        if low == 0:
            return None, None
        return None, query if exact is None else _grams(exact)
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, tuple | None]:
    current, parts, exact_all = {""}, [], True
    for kind, value in nodes:
        exact, query = _one(kind, value)
        if exact is not None and len(current) * len(exact) <= _MOST:
            current = {a + b for a in current for b in exact}
            continue
        exact_all = False
        parts.append(_grams(current))
        parts.append(query)
        current = exact if exact is not None else {""}
    if exact_all:
        return current, None
    return None, _all_of([*parts, _grams(current)])


def trigram_query(pattern: str) -> tuple | None:
    """Nested ("and" | "or", parts) over trigrams in lower case; None if the pattern has no mandatory trigram."""
    exact, query = _sequence(parser.parse(pattern))
    return query if exact is None else _grams(exact)


def _leaves(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*[_leaves(p) for p in query[1]])


def _decided(query, grams: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, query)
    out = None
    for part in query[1]:
        c = _decided(part, grams)
        out = c if out is None else (out & c if query[0] == "and" else out | c)
    return out


def _keys(text: Column, doc_id: Column) -> list[Column]:
    return [doc_id.alias("d"), F.xxhash64(text).alias("t")]


def postings(docs: DataFrame, rules: list[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``gram, d, t``: the documents that hold each trigram the rules ask for."""
    asked = sorted(set().union(set(), *[_leaves(q) for r in rules if (q := trigram_query(r.pattern)) is not None]))
    whole = whole_text(F.col(text))
    # lower() folds more than A-Z; what it adds can only make more candidates.
    held = let(F.lower(whole), lambda low: F.filter(F.array(*[F.lit(g) for g in asked]).cast("array<string>"), lambda g: F.contains(low, g)))
    return docs.select(F.explode(held).alias("gram"), *_keys(whole, F.col(doc_id)))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``d, t, kinds``: the indexed rules whose query a document's trigrams satisfy."""
    held = index.groupBy("d", "t").agg(F.collect_set("gram").alias("grams"))
    kinds = [
        F.when(_decided(q, F.col("grams")), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern)) is not None
    ]
    out = held.select("d", "t", F.array_compact(F.array(*kinds)).alias("kinds"))
    return out.where(F.size("kinds") > 0)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of the rule's hits."""
    split = rf"(?s)\G(.*?)(?:({rule.pattern})|\z)"
    gaps, hits = (F.regexp_extract_all(text, F.lit(split), F.lit(i)) for i in (1, 2))

    def place(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        good = pair["hit"] != ""
        if rule.least and rule.group:
            good = good & (F.length(F.regexp_extract(pair["hit"], rule.pattern, rule.group)) >= rule.least)
        elif rule.least:
            good = good & (F.length(pair["hit"]) >= rule.least)
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(state["found"], found)).otherwise(state["found"]).alias("found"))

    kind = "array<struct<start: int, rank: int, end: int, kind: string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, empty, place, lambda s: s["found"])


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc`` (struct of all columns) and ``spans``, ordered by start and then by the order of the rules."""
    found = stored(candidates(postings(docs, rules, f"`{text}`", f"`{doc_id}`"), rules), "candidates")
    # Few candidates go to the texts; many, by their count, meet them in a shuffle.
    found = F.broadcast(found) if found.count() <= CANDIDATES else found
    whole = packed(docs).withColumn("text", whole_text(F.col(f"doc.`{text}`")))
    left = whole.select("doc", "text", *_keys(F.col("text"), F.col(f"doc.`{doc_id}`"))).alias("l")
    right = found.alias("r")
    joined = left.join(right, F.col("l.d").eqNullSafe(F.col("r.d")) & (F.col("l.t") == F.col("r.t")), "left").select("doc", "text", "kinds")
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    parts = []
    for rank, rule in enumerate(rules):
        indexed = trigram_query(rule.pattern) is not None
        worth = F.array_contains("kinds", rule.kind) if indexed else F.col("text").rlike(rule.pattern)
        parts.append(F.when(worth, spans(F.col("text"), rule, rank)).otherwise(none))
    every = F.sort_array(F.concat(*parts))
    return joined.select("doc", F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def as_text(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
