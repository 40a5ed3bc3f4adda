"""Spelling variants of words, found by PartEnum signatures over letter multisets.

Vectors. A word is the set of its elements (letter, how often the letter came before in the word), a binary
vector. One inserted or deleted code point changes one element and one replaced code point two, so words one
edit apart have vectors at Hamming distance one or two.

Signatures. The elements are dealt over ``PARTS`` partitions by hash. Two vectors at distance two or less
differ in two partitions at most, so among all sets of ``PARTS - 2`` partitions there is one on which they
are equal. A word gives a signature for each such set: a hash of its elements there. One edit also leaves the
first or the last half of a word as it is, half the length of the shorter of the two; so each signature is given with
either half and for either role, the shorter or the longer word. That splits signatures that very many words share, and loses
no pair.

Join. Words meet by equal signatures in an equi-join, whose condition verifies each pair by its edit distance,
so only true pairs leave the join. Words are counted before, so none holds many rows, however often it is used. More
``PARTS`` mean more rows and fewer pairs to verify, never another result. Spark takes a table of words for as small as its file, which says
nothing of the 24 rows that a word becomes, so joins are told to merge: else it may broadcast all signatures through the driver.

Forms. A word's form is its most frequent near word, if that is used ``ratio`` times as often. Uses grow along forms, so chains
are short; their ends are found by doubling: each round joins the ends found so far with themselves.

Cases: a NULL or empty text has no words; a row without id keeps its words as they are; repeated rows count
each; ties of uses go to the smallest word in code-point order; very long texts are read in stretches that
end between runs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, stored

LEAST_LENGTH, LEAST_USES, RATIO = 5, 3, 2
PARTS = 4
STRETCH = 1 << 20
HELD = 200_000  # words that a task counts before it hands them on
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _stretches(text: str) -> Iterator[str]:
    """The text in stretches of about ``STRETCH`` code points that cut no run of letters."""
    at = 0
    while at < len(text):
        upto = min(len(text), at + STRETCH)
        if upto < len(text) and (rest := _RUN.match(text, upto)):
            upto = rest.end()
        yield text[at:upto]
        at = upto


def runs_of(text: str) -> Counter[str]:
    """Uses of each run of letters; only A-Z are lower-cased."""
    found: Counter[str] = Counter()
    for part in _stretches(text):
        found.update(_RUN.findall(part))
    lowered: Counter[str] = Counter()
    for run, n in found.items():
        lowered[run.encode().lower().decode()] += n
    return lowered


def with_slip(doc_id: int | None, run: str, every: int) -> str:
    """The run without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % every == 0 else run


def count_words(docs: DataFrame, text: str = "text", doc_id: str | None = None, slips: int | None = None) -> DataFrame:
    """``word, n`` of the words with ``LEAST_LENGTH`` code points and ``LEAST_USES`` uses or more.

    With ``slips`` words lose a code point as ``with_slip`` says, which plants variants to be found.
    """
    key = F.col(f"`{doc_id}`").cast("long") if doc_id else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for number, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in runs_of(whole.as_py() or "").items():
                    word = with_slip(number, word, slips) if slips else word
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    counted = map_arrow(docs.select(key.alias("doc_id"), F.col(f"`{text}`").alias("text")), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_USES)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str], parts: int = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all words; for each the place of its word, and whether it stands for a word one shorter.

    For every pair of partitions left out: with the first and with the last half, for a partner of the same length or longer, and for a shorter one.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    fresh = np.flatnonzero(np.r_[True, (owner[order][1:] != owner[order][:-1]) | (letters[order][1:] != letters[order][:-1])])
    before = np.arange(len(order)) - np.repeat(fresh, np.diff(np.r_[fresh, len(order)]))
    element = _mixed((letters[order] << np.uint64(32)) | before.astype(np.uint64))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (owner[order], ((element >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)), _mixed(element + np.uint64(1)))
    whole = sums.sum(1)
    kept = [_mixed(whole - sums[:, i] - sums[:, j] + _mixed(np.array([k + 1], np.uint64))) for k, (i, j) in enumerate(combinations(range(parts), 2))]
    # A sum over the letters of a stretch, each weighed by its place, is the difference of two running sums.
    place = np.arange(len(letters), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    forward = np.r_[np.uint64(0), np.cumsum(_mixed((letters << np.uint64(32)) | place))]
    from_end = np.repeat(lengths, lengths).astype(np.uint64) - np.uint64(1) - place
    backward = np.r_[np.uint64(0), np.cumsum(_mixed((letters << np.uint64(32)) | from_end))]
    keys, owners, longer = [], [], []
    for shorter in (0, 1):
        half = (lengths - shorter) // 2
        first = forward[starts + half] - forward[starts]
        last = backward[starts + lengths] - backward[starts + lengths - half]
        for side, end in enumerate((first, last)):
            mark = _mixed(end ^ _mixed(((lengths - shorter).astype(np.uint64) << np.uint64(1)) | np.uint64(side)))
            keys += [_mixed(rest ^ mark) for rest in kept]
            owners += [np.arange(len(words))] * len(kept)
            longer += [np.full(len(words), bool(shorter))] * len(kept)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(longer)


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``word, n, other, other_n``: every ordered pair of words exactly one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                rows = batch.slice(at, 5000)
                keys, owners, longer = signatures(rows.column(0).to_pylist(), parts)
                back = pa.array(owners)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(longer), rows.column(0).take(back), rows.column(1).take(back)], ["signature", "longer", "word", "n"])

    signed = map_arrow(words.select("word", "n"), run, "signature long, longer boolean, word string, n long")
    shorter = signed.where("not longer").select("signature", "word", "n")
    other = signed.select("signature", "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
    once = F.col("longer") | (F.col("word") < F.col("other"))
    near = once & (F.levenshtein("word", "other", 1) == 1)
    found = shorter.alias("a").join(other.alias("b").hint("merge"), (F.col("a.signature") == F.col("b.signature")) & near).select("word", "n", "other", "other_n")
    pairs = stored(found.dropDuplicates(["word", "other"]), "near-words")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def ends_of_chains(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word that forms lead to. Chains must not run in a ring."""
    ends = stored(links.select("word", F.col("form").alias("root")), "chains")
    while True:
        jump = ends.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = stored(ends.join(jump.hint("merge"), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "chains")
        ends = new.drop("moved")
        if new.where("moved").isEmpty():
            return ends


def group_spellings(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n`` (distinct words of five code points or more)."""
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words, parts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    judged = stored(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = ends_of_chains(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
