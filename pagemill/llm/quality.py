"""Quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Nine rules look at one document each and vote 1 (good), -1 (bad) or 0 (abstain). A model with a
hidden class per document explains the votes: each rule that does vote has, for good and for bad
documents, its own probability of voting bad; abstaining says nothing. Expectation-maximisation fits
these accuracies and the share of bad documents on the votes of all documents that pass the base
rule, without labels; such a document is kept if its posterior probability of being good is at least 0.5. A rule may turn out
useless but never reversed: its bad vote never speaks for a document.

Votes are counted per pattern (at most 3^9) before EM, so an iteration reads a tiny table however
large the corpus is, and only the fitted probabilities come to the driver. Only built-in functions are used.

Cases: a NULL or empty text has no words and fails the base rule; repeated rows are judged one by
one; an empty table gives an empty result; a column of documents may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import ASCII_SPACE, packed, stored, whole_text, words_of

SYMBOLS = "#*$%&|<>"
ITERATIONS = 20
# Where EM starts: share of bad documents, and by class the probability that a vote is "bad".
START_BAD = 0.15
START = {"bad": 0.35, "good": 0.02}
SMOOTH = 1.0
# Rule: (statistic, bad if, good if), as SQL over the statistics below.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    ("plain_words", "n_plain < 0.5 * n_words", "n_plain >= 0.8 * n_words"),
    ("repeats", "n_repeat_words > 0.4 * n_words", "n_repeat_words <= 0.3 * n_words"),
    ("stutter", "n_stutter > 0.2 * n_words", "n_stutter <= 0.05 * n_words"),
    ("shouting", "n_upper > 0.4 * word_chars", "n_upper <= 0.15 * word_chars"),
    ("exclaiming", "n_exclaim > 0.2 * n_words", "n_exclaim <= 0.05 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("same_lines", "n_dup_lines > 0.3 * n_full_lines", "n_full_lines > 1 AND n_dup_lines <= 0.1 * n_full_lines"),
    ("sentences", "n_stops = 0", "n_stops BETWEEN 0.02 * n_words AND 0.4 * n_words"),
]
PLAIN_WORD = r"^[\"'(]*[\p{L}\p{M}][\p{L}\p{M}'-]*[.,;:?)\"']*!?$"
STATS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_plain n_stutter n_upper n_exclaim n_full_lines n_stops".split()
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first occurrences included.

    The windows are sorted with their places, so equal ones become neighbours: n log n steps.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

    def repeated(ordered: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            same = lambda j: F.get(ordered, j)["w"] == x["w"]
            return F.when(F.coalesce(same(i - 1), F.lit(False)) | F.coalesce(same(i + 1), F.lit(False)), x["p"])

        return F.sort_array(F.filter(F.transform(ordered, place), lambda p: p.isNotNull()))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("p")),
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(
        let(F.sort_array(windows), lambda o: let(repeated(o), covered))
    )


def statistics(text: Column) -> Column:
    """Struct of the statistics that the rules read, each a long."""

    def per_word(words: Column) -> list[Column]:
        return [
            F.size(words).alias("n_words"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.rlike(PLAIN_WORD))).alias("n_plain"),
            F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w)).alias("n_stutter"),
        ]

    def per_line(lines: Column) -> list[Column]:
        return [(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), F.size(lines).alias("n_full_lines")]

    def parts(words: Column, lines: Column) -> Column:
        plain = [
            F.length(F.translate(text, ASCII_SPACE, "")).alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            _count(text, "!").alias("n_exclaim"),
            _count(text, ".?!").alias("n_stops"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).alias("n_upper"),
        ]
        named = {c: c for c in STATS}
        made = F.struct(*per_word(words), *per_line(lines), *plain)
        return let(made, lambda m: F.struct(*[m[c].cast("bigint").alias(c) for c in named]))

    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != "")
    return let(words_of(text), lambda w: let(lines, lambda x: parts(w, x)))


def with_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (all columns), ``stats``, ``votes`` (array of -1, 0, 1 in the order of RULES), ``base_failed``."""
    with_stats = packed(docs).withColumn("stats", statistics(whole_text(F.col(f"doc.`{text}`"))))
    # One row in, one row out: keeps the costly statistics from being worked out once per use.
    flat = with_stats.select("doc", F.inline(F.array("stats")))
    votes = [F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, bad, good in RULES]
    return flat.select(
        "doc", F.struct(*STATS).alias("stats"), F.array(*votes).alias("votes"), F.expr(BASE_FAILED).alias("base_failed")
    )


@dataclass
class VoteModel:
    """Share of bad documents and, per rule, the probability that its vote is "bad", by class."""

    bad_share: float
    bad: list[float]
    good: list[float]

    def good_probability(self, votes: Column) -> Column:
        terms = F.lit(math.log((1 - self.bad_share) / self.bad_share))
        for j, (b, g) in enumerate(zip(self.bad, self.good, strict=True)):
            v = F.get(votes, j)
            terms = terms + F.when(v == -1, F.lit(math.log(g / b))).when(v == 1, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms))


def _next_model(patterns: Column, model: Column) -> Column:
    """One round of EM as an expression: ``patterns`` is an array of (v, n), ``model`` a struct (bad_share, bad, good)."""
    zero, each_rule = F.lit(0.0), F.sequence(F.lit(0), F.lit(len(RULES) - 1))

    def expected(weights: Column, prior: Column) -> Column:
        """Per pattern the number of documents that are good by the model."""
        def good_mass(p: Column) -> Column:
            logit = F.aggregate(each_rule, prior, lambda a, j: a + F.get(F.get(weights, j), F.get(p["v"], j) + 1))
            return F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] / (1 + F.exp(-logit))).alias("q"))

        return F.transform(patterns, good_mass)

    def total(masses: Column) -> Column:
        return F.aggregate(
            masses, F.struct(zero.alias("n"), zero.alias("q")),
            lambda a, p: F.struct((a["n"] + p["n"]).alias("n"), (a["q"] + p["q"]).alias("q")),
        )

    def rate(masses: Column, j: Column) -> Column:
        """Share of bad votes among the votes of rule ``j``, for bad (b) and good (g) documents."""
        def shares(no: Column, voted: Column) -> Column:
            b = (no["n"] - no["q"] + SMOOTH) / (voted["n"] - voted["q"] + 2 * SMOOTH)
            g = (no["q"] + SMOOTH) / (voted["q"] + 2 * SMOOTH)
            return F.struct(b.alias("b"), g.alias("g"))

        def never_reversed(r: Column) -> Column:
            mean = (r["b"] + r["g"]) / 2
            return F.when(r["b"] < r["g"], F.struct(mean.alias("b"), mean.alias("g"))).otherwise(r)

        bad_votes = total(F.filter(masses, lambda p: F.get(p["v"], j) == -1))
        votes = total(F.filter(masses, lambda p: F.get(p["v"], j) != 0))
        return let(let(bad_votes, lambda no: let(votes, lambda voted: shares(no, voted))), never_reversed)

    def assembled(masses: Column) -> Column:
        def make(t: Column, rates: Column) -> Column:
            return F.struct(
                ((t["n"] - t["q"] + SMOOTH) / (t["n"] + 2 * SMOOTH)).alias("bad_share"),
                F.transform(rates, lambda x: x["b"]).alias("bad"), F.transform(rates, lambda x: x["g"]).alias("good"))

        rates = F.transform(each_rule, lambda j: rate(masses, j))
        return let(total(masses), lambda t: let(rates, lambda r: make(t, r)))

    weights = F.zip_with(model["bad"], model["good"], lambda b, g: F.array(F.ln(g / b), zero, F.ln((1 - g) / (1 - b))))
    prior = F.ln((1 - model["bad_share"]) / model["bad_share"])
    return let(weights, lambda w: let(prior, lambda x: let(expected(w, x), assembled)))


def fit_votes(votes: DataFrame, column: str = "votes", iterations: int = ITERATIONS) -> VoteModel:
    """Fit the model on every row's votes. Patterns (3^9 at most) are counted first; EM is one fold over them."""
    counted = votes.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    patterns = counted.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    start = F.struct(
        F.lit(START_BAD).alias("bad_share"), *[F.array_repeat(F.lit(START[c]), len(RULES)).alias(c) for c in ("bad", "good")]
    )
    rounds = F.sequence(F.lit(1), F.lit(iterations))
    row = patterns.select(F.aggregate(rounds, start, lambda m, _: _next_model(F.col("patterns"), m)).alias("m")).first()["m"]
    return VoteModel(row["bad_share"], list(row["bad"]), list(row["good"]))


def judge(votes: DataFrame, model: VoteModel) -> DataFrame:
    """Adds ``good_probability`` and ``kept``."""
    return votes.withColumn("good_probability", model.good_probability(F.col("votes"))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("good_probability") >= 0.5)
    )


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the model keeps, with their own columns. Their texts are written once with the votes."""
    votes = stored(with_votes(docs, text).select("doc", "votes", "base_failed"), "quality")
    return judge(votes, fit_votes(votes.where(~F.col("base_failed")))).where("kept").select("doc.*")
