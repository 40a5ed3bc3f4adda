"""Language of words and documents by a linear-chain conditional random field.

A line is a chain of words. A word's features are its character n-grams (1 to 3) with its ends marked, its
affixes (up to four characters), itself, and the language in which a lexicon of the training sample has it;
all are hashed to 2^18 weights per language. Transition weights between the languages of neighbouring words
are learned with them. Forward-backward gives each word's probability of each language, so that text that switches
languages is labelled word by word; a document's language is the one with most letters by these probabilities.

Training takes a bounded sample: lines of about ``SAMPLE_DOCS`` documents per language, at most
``SAMPLE_SEGMENTS`` segments of 25 words each, chosen by hash. Chains of two segments, three in ten of them in
different languages, teach what a switch looks like. The fitted weights (4 MB for four languages, by their
fixed number) go to every task; texts are labelled where they are and nothing is shuffled.

Cases: a NULL text or one without a letter is ``und`` with score 0; without any training row every
text is ``und``; repeated rows are labelled each; a NULL language or id is never trained on; very long texts are
labelled whole; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, whole_text

FEATURES = 1 << 18
SAMPLE_DOCS, SAMPLE_SEGMENTS, SEGMENT, LINES_FROM_DOC = 400, 1200, 25, 8
STEPS, RATE, DECAY = 40, 0.15, 1e-4
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
SLICE_CHARS = 1 << 20  # characters labelled together


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Features:
    """Feature slots of a list of words: an array of slots per position, words laid out one after another.

    Each word has a row per character of ``^word$`` and one more; a row holds one slot per kind of
    feature that ends there, FEATURES (a weight that stays 0) where there is none.
    """

    def __init__(self, words: list[str], lexicon: dict[str, int]) -> None:
        cps = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lengths = np.array([len(w) + 2 for w in words], np.int64)
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]]
        first = np.repeat(self.starts, lengths)
        last = np.repeat(self.starts + lengths - 1, lengths)
        at = np.arange(len(cps))
        columns = []
        grams = {1: _mix(cps + np.uint64(1))}
        for n in (2, 3, 4, 5):
            grams[n] = grams[n - 1].copy()
            grams[n][n - 1 :] = _mix(grams[n - 1][: len(cps) - n + 1] * np.uint64(31) + cps[n - 1 :] + np.uint64(n)) if len(cps) >= n else 0
        for n in (1, 2, 3):
            columns.append(self._slot(grams[n], at - first >= n - 1))
        for n in (4, 5):
            columns.append(self._slot(grams[n], (at - first >= n - 1) & ((at == last) | (at - first == n - 1))))
        # The word itself and its lexicon entry stand at its last position.
        whole = np.full(len(cps), FEATURES, np.int32)
        entry = np.full(len(cps), FEATURES, np.int32)
        if words:
            sums = np.add.reduceat(grams[3] * _mix((at - first).astype(np.uint64) + np.uint64(7)), self.starts)
            whole[self.starts + lengths - 1] = self._slot(_mix(sums), np.ones(len(words), bool))
            known = np.array([lexicon.get(w, -1) for w in words], np.int64)
            entry[self.starts + lengths - 1] = self._slot(_mix(known.astype(np.uint64) + np.uint64(1 << 40)), known >= 0)
        self.slots = np.stack([*columns, whole, entry], 1)

    @staticmethod
    def _slot(h: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, (h % np.uint64(FEATURES)).astype(np.int32), FEATURES).astype(np.int32)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Words x languages: sums of the weights of each word's features."""
        if not len(self.starts):
            return np.zeros((0, weights.shape[1]), np.float32)
        return np.add.reduceat(weights[self.slots].sum(1), self.starts, 0)


@dataclass
class Chains:
    """Sequences of word numbers laid out one after another, longest first."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, sequences: list[list[int]]) -> tuple[Chains, np.ndarray]:
        """The chains and the order in which they stand."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        flat = np.fromiter((w for i in order for w in sequences[i]), np.int64, int(lengths.sum()))
        return cls(flat, np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else lengths, lengths), order

    def marginals(self, emission: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each language at each place, by forward-backward; expected transitions if asked."""
        n, k = len(self.words), transition.shape[0]
        e = np.exp(emission - emission.max(1, keepdims=True)) if n else emission
        a = np.exp(transition)
        forward, backward = np.empty((n, k)), np.ones((n, k))
        longest = int(self.lengths[0]) if len(self.lengths) else 0
        alive = np.searchsorted(-self.lengths, -np.arange(1, longest + 1), side="right")
        total = np.zeros((k, k))
        for t in range(longest):
            at = self.starts[: alive[t]] + t
            x = e[at] if t == 0 else (forward[at - 1] @ a) * e[at]
            forward[at] = x / x.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = self.starts[: alive[t + 1]] + t
            later = e[at + 1] * backward[at + 1]
            x = later @ a.T
            backward[at] = x / x.sum(1, keepdims=True)
            if pairs:
                joint = forward[at][:, :, None] * a[None] * later[:, None, :]
                total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        both = forward * backward
        return both / both.sum(1, keepdims=True), total


@dataclass
class LanguageModel:
    """Fitted weights; ``languages`` in order of their columns."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    lexicon: dict[str, int]


def fit(sample: list[tuple[str, list[str]]]) -> LanguageModel:
    """CRF weights from (language, words) segments, by Adam steps on the full conditional likelihood."""
    languages = sorted({lang for lang, _ in sample})
    k, number = len(languages), {lang: i for i, lang in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    coded = [(number[lang], [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for lang, words in sample]
    # Lexicon: words seen three times or more, nine in ten times in one language.
    counts = np.zeros((len(vocabulary), max(k, 1)))
    for lang, words in coded:
        np.add.at(counts[:, lang], words, 1)
    totals = counts.sum(1)
    sure = (totals >= 3) & (counts.max(1, initial=0) >= 0.9 * totals)
    lexicon = {w: int(counts[i].argmax()) for w, i in vocabulary.items() if sure[i]}
    weights, transition = np.zeros((FEATURES + 1, k)), np.zeros((k, k))
    if k < 2:
        return LanguageModel(languages, weights.astype(np.float32), transition, lexicon)
    random = np.random.default_rng(7)
    order = random.permutation(len(coded))
    by_language = [[i for i in order if coded[i][0] == lang] for lang in range(k)]
    sequences, gold = [], []
    for i in order:
        lang, words = coded[i]
        other = int(random.choice([x for x in range(k) if x != lang])) if random.random() < 0.3 else lang
        more = coded[by_language[other][random.integers(len(by_language[other]))]][1]
        sequences.append(words + more)
        gold.append([lang] * len(words) + [other] * len(more))
    chains, stand = Chains.of(sequences)
    truth = np.fromiter((y for i in stand for y in gold[i]), np.int64, len(chains.words))
    inner = np.ones(len(truth), bool)
    inner[chains.starts] = False
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    features = Features(list(vocabulary), lexicon)
    rows = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[features.starts, len(features.slots)]))
    flat, owner = features.slots.ravel(), np.repeat(rows, features.slots.shape[1])
    used = flat < FEATURES
    flat, owner = flat[used], owner[used]
    target = np.zeros((len(truth), k))
    target[np.arange(len(truth)), truth] = 1
    moment = [np.zeros_like(weights), np.zeros_like(transition)]
    square = [np.zeros_like(weights), np.zeros_like(transition)]
    for step in range(1, STEPS + 1):
        emission = features.scores(weights)[chains.words]
        p, pairs = chains.marginals(emission, transition, pairs=True)
        missing = np.stack([np.bincount(chains.words, (target - p)[:, y], len(vocabulary)) for y in range(k)], 1)
        up = np.stack([np.bincount(flat, missing[owner, y], FEATURES + 1) for y in range(k)], 1) / len(truth)
        for j, (value, g) in enumerate(((weights, up - DECAY * weights), (transition, (seen_pairs - pairs) / len(truth) - DECAY * transition))):
            moment[j] = 0.9 * moment[j] + 0.1 * g
            square[j] = 0.99 * square[j] + 0.01 * g * g
            value += RATE * (moment[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.99**step)) + 1e-8)
        weights[FEATURES] = 0
    return LanguageModel(languages, weights.astype(np.float32), transition, lexicon)


def training_sample(docs: DataFrame, text: str, lang: str, key: Column) -> list[tuple[str, list[str]]]:
    """Segments of words with the language of their document; bounded per language, chosen by hash of ``key``."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), key.alias("key"), whole_text(F.col(text)).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    wanted = None
    for name, n in sizes.items():
        part = (F.col("lang") == name) & (chance < max(1, int(1_000_000 * SAMPLE_DOCS / n)))
        wanted = part if wanted is None else wanted | part
    if wanted is None:
        return []
    lines = known.where(wanted).select("lang", "key", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.col("line").rlike(r"\p{L}"))
    few = Window.partitionBy("lang", "key").orderBy(F.xxhash64("line", "place"))
    most = Window.partitionBy("lang").orderBy(F.xxhash64("key", "line", "place"))
    chosen = lines.withColumn("r", F.row_number().over(few)).where(F.col("r") <= LINES_FROM_DOC).withColumn("q", F.row_number().over(most)).where(F.col("q") <= SAMPLE_SEGMENTS)
    out = []
    for row in chosen.select("lang", "q", "line").orderBy("lang", "q").toLocalIterator():
        words = words_of(row["line"])[:SEGMENT]
        if words:
            out.append((row["lang"], words))
    return out


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of whole lines; only a line longer than ``SLICE_CHARS`` is cut, before a space where it has one."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        upto = text.rfind("\n", at, at + SLICE_CHARS) + 1 or text.rfind(" ", at + 1, at + SLICE_CHARS)
        upto = upto if upto > at else at + SLICE_CHARS
        yield text[at:upto]
        at = upto
    yield text[at:]


class Labeller:
    """Labels texts in batches; scores of frequent words are kept between batches, up to a bound."""

    def __init__(self, model: LanguageModel, keep: int = 200_000) -> None:
        self.model, self.keep, self.known = model, keep, {}

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known = {}
        new = [w for w in words if w not in self.known]
        scores = np.concatenate([np.zeros((0, len(self.model.languages)), np.float32), *(Features(new[i : i + 20_000], self.model.lexicon).scores(self.model.weights) for i in range(0, len(new), 20_000))])
        self.known.update(zip(new, scores, strict=True))
        return np.array([self.known[w] for w in words], np.float64).reshape(len(words), -1)

    def measured(self, texts: list[str]) -> list[tuple[np.ndarray, list[dict]]]:
        """Letters in each language, by probability, and runs of words in one language, per text."""
        names = self.model.languages
        vocabulary: dict[str, int] = {}
        sequences, owner = [], []
        for i, text in enumerate(texts):
            for line in text.split("\n"):
                if words := words_of(line):
                    sequences.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
                    owner.append(i)
        if not sequences or not names:
            return [(np.zeros(len(names)), []) for _ in texts]
        chains, order = Chains.of(sequences)
        letters = np.array([len(w) for w in vocabulary], float)
        p, _ = chains.marginals(self.emissions(list(vocabulary))[chains.words], self.model.transition)
        weight = np.add.reduceat(p * letters[chains.words][:, None], chains.starts, 0)
        mass = np.zeros((len(texts), len(names)))
        np.add.at(mass, np.array(owner)[order], weight)
        best = p.argmax(1)
        stand = np.empty(len(order), np.int64)
        stand[order] = np.arange(len(order))
        runs: list[list[dict]] = [[] for _ in texts]
        for i, s in zip(owner, stand, strict=True):
            line = best[chains.starts[s] : chains.starts[s] + chains.lengths[s]]
            cuts = [0, *(np.flatnonzero(line[1:] != line[:-1]) + 1).tolist(), len(line)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if runs[i] and runs[i][-1]["lang"] == names[line[a]]:
                    runs[i][-1]["words"] += b - a
                else:
                    runs[i].append({"lang": names[line[a]], "words": b - a})
        return list(zip(mass, runs, strict=True))

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """Language, score and runs of words in one language, per text."""
        parts, owner, held, found = [], [], 0, []
        for i, text in enumerate(texts):
            for part in stretches(text):
                if held and held + len(part) > SLICE_CHARS:
                    found += self.measured(parts[len(found):])
                    held = 0
                parts.append(part)
                owner.append(i)
                held += len(part)
        found += self.measured(parts[len(found):])
        names = self.model.languages
        mass = np.zeros((len(texts), len(names)))
        runs: list[list[dict]] = [[] for _ in texts]
        for i, (m, part) in zip(owner, found, strict=True):
            mass[i] += m
            for run in part:
                if runs[i] and runs[i][-1]["lang"] == run["lang"]:
                    runs[i][-1]["words"] += run["words"]
                else:
                    runs[i].append(run)
        out: list[tuple[str, float, list[dict]]] = [(UNKNOWN, 0.0, []) for _ in texts]
        for i, m in enumerate(mass):
            if m.sum() > 0:
                out[i] = (names[int(m.argmax())], float(m.max() / m.sum()), runs[i])
        return out


def label_documents(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc`` (struct of ``keep``, or of all columns), ``lang_pred``, ``score``, ``runs`` (language and words, in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), whole_text(F.col(f"`{text}`")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                langs, scores, runs = zip(*labeller.label(part.column(1).to_pylist()), strict=True)
                made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc", "lang_pred", "score", "runs"])

    kind = source.schema["doc"].dataType.simpleString()
    return map_arrow(source, run, f"doc {kind}, lang_pred string, score double, runs array<struct<lang: string, words: int>>")
