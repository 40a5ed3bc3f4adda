"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Models. Each class has a model of its own, interpolated by absolute discounts: a pair of consecutive words gives up ``PAIR_DISCOUNT`` of
its uses in the class, and what is freed after a context goes to the word model. That counts continuations (different words before
a word in the class), gives up ``WORD_DISCOUNT`` of each, and backs off to the continuations in both classes together. So an
expression that a class has seen rarely is told by counts that both share, and what neither has seen speaks for neither.

Scores. A word's part is the log of its probability after the word before it in the toxic model over that in the ordinary one, less that
of an unknown word. Two signals are length-normalised sums of parts: over the whole text (``evidence``), and over the window of
``WINDOW`` words where it is largest (``passage``), since a long text with one toxic passage has little of it as a whole. A logistic curve
over both gives a score from 0 to 1. It is fitted on one fold of the training documents, scored by models that were not counted on it;
the models that score count all training folds.

Scale. One pass over the labelled texts counts pairs by class, for both kinds of models at once; words and pairs are known by
48-bit hashes. Pairs are summed in partitions by their hash, so no word is hot. Only what differs from an unknown word is kept: words above the
discount in a class, contexts and pairs above theirs; the rest follows from the totals, so nothing is lost. That model grows
with the corpus. Labels are broadcast where they are ``LABEL_ROWS`` at most, which is counted, so that texts stay where they are; beyond that a filter of
fixed size keeps texts without a label from the shuffled join. Tasks look up ``TABLE_ROWS`` rows of each table at once; a larger model takes more passes over the texts.

Cases: a NULL or empty text has evidence 0; repeated rows are scored and counted each; several labels of
one document are averaged; labels that are NULL or of unknown documents are left out; without labels of
both classes every score is the same; very long texts are scored whole; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, stored, whole_text

PAIR_DISCOUNT, WORD_DISCOUNT, WINDOW = 40, 2, 4
TABLE_ROWS = 10_000_000  # of a model, looked up at once
LABEL_ROWS = 2_000_000  # labels up to which texts meet them where they lie; with more, texts that may have one are shuffled
FILTER_BITS = 1 << 27  # of the filter that tells which texts may have a label: 16 MB, however many labels there are
HELD = 1 << 21  # pairs that a task counts before it hands them on
SLICE_CHARS = 1 << 20  # characters of text taken together
# For the calibration: column, range and width of bins.
BINS = (("evidence", -2.0, 2.0, 0.005), ("passage", -4.0, 8.0, 0.05))
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")
_MASK = (1 << 48) - 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Hashes(dict):
    """48-bit hash of each word; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) & _MASK
        return h


# No word has these characters.
_START, _END = "<", ">"
START, END = (np.uint64(xxhash.xxh3_64_intdigest(w) & _MASK) for w in (_START, _END))


def sequences(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text between ``START`` and ``END``, and where each text begins; one more for the end."""
    words, begins = [], [0]
    for text in texts:
        words.append(_START)
        words += words_of(text)
        words.append(_END)
        begins.append(len(words))
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), np.array(begins)


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    k = u * np.uint64(0x9E3779B97F4A7C15) + v
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def slices(lengths: list[int]) -> Iterator[slice]:
    """Consecutive texts of about ``SLICE_CHARS`` characters together, one at least."""
    begin = held = 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > SLICE_CHARS:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if lengths:
        yield slice(begin, len(lengths))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 for a NULL id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1))


def count_pairs(docs: DataFrame) -> DataFrame:
    """``u, v, c0, c1, k0, k1`` from ``text, kind``: uses of each pair in documents of kind 0 to 3 (ordinary, toxic, the same of the calibration fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, held = Hashes(), [], 0
        for batch in batches:
            texts, kinds = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.uint64)
            for some in slices([len(t) for t in texts]):
                h, begins = sequences(texts[some], hashes)
                doc = np.repeat(np.arange(some.start, some.stop), np.diff(begins))
                u, v = h[:-1], h[1:]
                inside = (doc[:-1] == doc[1:]) & ~((u == START) & (v == END))
                parts.append((u[inside], v[inside], kinds[doc[:-1][inside]]))
                held += int(inside.sum())
                if held >= HELD:
                    yield _packed(parts)
                    parts, held = [], 0
        if held:
            yield _packed(parts)

    # Two longs a row: the context with 16 bits of the word; the other 32 bits, the kind and the number of uses.
    counted = map_arrow(docs.select("text", "kind"), run, "a long, b long").repartition("a")
    bits = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << n) - 1))
    kind, uses = F.shiftright("b", 32).bitwiseAND(F.lit(3)), F.shiftright("b", 34)
    names = ("c0", "c1", "k0", "k1")
    sums = counted.groupBy("a", bits("b", 32).alias("w")).agg(*[F.sum(F.when(kind == i, uses).otherwise(0)).alias(c) for i, c in enumerate(names)])
    return sums.select(bits("a", 48).alias("u"), F.shiftrightunsigned("a", 48).bitwiseOR(F.shiftleft("w", 16)).alias("v"), *names)


def _packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    u, v, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    a = u | (v << np.uint64(48))
    b = (v >> np.uint64(16)) | (kind << np.uint64(32))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    uses = np.diff(np.r_[first, len(a)]).astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array((b[first] | (uses << np.uint64(34))).view(np.int64))], ["a", "b"])


def model_counts(pairs: DataFrame) -> DataFrame:
    """One stored table: per word its continuations and uses (``u`` NULL), and the pairs above the discount in a class.

    ``n*``: different words before it, in each class and in both; ``s*``: uses. The first three without the calibration fold, the others with it.
    """
    with_fold = {0: F.col("c0") + F.col("k0"), 1: F.col("c1") + F.col("k1")}
    without = {0: F.col("c0"), 1: F.col("c1")}
    sums = []
    for m, uses in enumerate((without, with_fold)):
        sums += [F.count_if(uses[0] > 0).alias(f"n0{m}"), F.count_if(uses[1] > 0).alias(f"n1{m}"), F.count_if(uses[0] + uses[1] > 0).alias(f"n{m}")]
        sums += [F.sum(uses[k]).alias(f"s{k}{m}") for k in (0, 1)]
    words = pairs.groupBy("v").agg(*sums).withColumn("u", F.lit(None).cast("long"))
    often = pairs.where(F.greatest(with_fold[0], with_fold[1]) > PAIR_DISCOUNT).select("u", "v", *[uses[k].alias(f"s{k}{m}") for m, uses in enumerate((without, with_fold)) for k in (0, 1)])
    return stored(words.unionByName(often, allowMissingColumns=True), "term-counts")


def build_model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tables of words (``key, after0, after1, before0, before1``) and of pairs (``key, more0, more1``), for both kinds of models.

    A word's part after a context is what it gives as a word (``after``), what its context gives (``before``, the ratio of the freed mass), and
    what the pair differs from these (``more``). All are 0 for what is not in the tables.
    """
    words, often = counts.where("u IS NULL").drop("u"), counts.where("u IS NOT NULL").select("u", "v", "s00", "s10", "s01", "s11")
    taken = lambda c: F.least(F.col(c), F.lit(WORD_DISCOUNT))
    total = words.agg(*[f(c).alias(f"{name}{c}") for m in (0, 1) for c in (f"n0{m}", f"n1{m}") for name, f in (("all", F.sum), ("freed", lambda c: F.sum(taken(c))))], *[F.sum(f"n{m}").alias(f"all{m}") for m in (0, 1)]).first()
    if any(not total[f"alln{k}{m}"] for k in (0, 1) for m in (0, 1)):
        nothing = [F.lit(0.0).cast("float").alias(c) for c in ("after0", "after1", "before0", "before1")]
        return words.select(F.col("v").alias("key"), *nothing).limit(0), often.select(F.col("v").alias("key"), F.lit(0.0).cast("float").alias("more0"), F.lit(0.0).cast("float").alias("more1")).limit(0)
    p, after = {}, []
    for m in (0, 1):
        rest = [total[f"freedn{k}{m}"] / total[f"alln{k}{m}"] for k in (0, 1)]
        shared = F.greatest(F.col(f"n{m}"), F.lit(0.5)) / F.lit(float(total[f"all{m}"]))  # half a use for a word that only the calibration fold has
        for k in (0, 1):
            c = f"n{k}{m}"
            p[k, m] = (F.col(c) - taken(c)) / F.lit(float(total[f"all{c}"])) + F.lit(rest[k]) * shared
        after.append(F.when(F.greatest(f"n0{m}", f"n1{m}") > WORD_DISCOUNT, F.ln(p[1, m] / p[0, m]) - F.lit(math.log(rest[1] / rest[0]))).otherwise(0.0).alias(f"after{m}"))
    telling = words.select(F.col("v").alias("key"), *after, *[x.alias(f"p{k}{m}") for (k, m), x in p.items()], "s00", "s10", "s01", "s11")
    # A word is as often a context as it is used; START begins as many texts as END ends.
    ends = F.when(F.col("key") == F.lit(int(END)), F.lit(int(START))).otherwise(F.col("key"))
    above = {(k, m): F.greatest(F.col(f"s{k}{m}") - PAIR_DISCOUNT, F.lit(0)) for k in (0, 1) for m in (0, 1)}
    excess = often.groupBy(F.col("u").alias("context")).agg(*[F.sum(x).alias(f"x{k}{m}") for (k, m), x in above.items()])
    uses = telling.select(ends.alias("context"), *[F.col(f"s{k}{m}").alias(f"uses{k}{m}") for k in (0, 1) for m in (0, 1)])
    # Of a context in which a class has no use or only frequent pairs, the freed mass is taken as that of half a use.
    left = {(k, m): F.when(F.col(f"uses{k}{m}") > 0, F.greatest(F.col(f"uses{k}{m}") - F.col(f"x{k}{m}"), F.lit(0.5)) / F.col(f"uses{k}{m}")).otherwise(1.0) for k in (0, 1) for m in (0, 1)}
    contexts = stored(excess.join(uses, "context").select("context", *[x.alias(f"left{k}{m}") for (k, m), x in left.items()], *[f"uses{k}{m}" for k in (0, 1) for m in (0, 1)]), "contexts")
    before = [F.ln(F.col(f"left1{m}") / F.col(f"left0{m}")).alias(f"before{m}") for m in (0, 1)]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("float").alias(c)
    known = telling.where("after0 <> 0 OR after1 <> 0").select("key", "after0", "after1")
    table = known.join(contexts.select(F.col("context").alias("key"), *before), "key", "full").select("key", *[zero(c) for c in ("after0", "after1", "before0", "before1")])
    joined = often.join(contexts.withColumnRenamed("context", "u"), "u").join(telling.select(F.col("key").alias("v"), *[f"p{k}{m}" for k in (0, 1) for m in (0, 1)]), "v")
    more = []
    for m in (0, 1):
        q = [F.when(F.col(f"uses{k}{m}") > 0, above[k, m] / F.col(f"uses{k}{m}")).otherwise(0.0) + F.col(f"left{k}{m}") * F.col(f"p{k}{m}") for k in (0, 1)]
        more.append((F.ln(q[1] / q[0]) - F.ln(F.col(f"p1{m}") / F.col(f"p0{m}")) - F.ln(F.col(f"left1{m}") / F.col(f"left0{m}"))).cast("float").alias(f"more{m}"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(u, v).view(np.int64)), batch.column(2), batch.column(3)], ["key", "more0", "more1"])

    return stored(table, "word-model"), stored(map_arrow(joined.select("u", "v", *more), keyed, "key long, more0 float, more1 float"), "pair-model")


def _table(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of a part of the model by ascending key."""
    found = rows.toArrow()
    key, *values = (c.to_numpy() for c in found.columns)
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], *(v[order] for v in values)


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Values of each key, 0 where it is not in the table."""
    if not len(table[0]) or not len(keys):
        return [np.zeros(len(keys), np.float32) for _ in table[1:]]
    wanted, back = np.unique(keys, return_inverse=True)  # ascending keys are found faster
    at = np.minimum(np.searchsorted(table[0], wanted), len(table[0]) - 1)
    hit = table[0][at] == wanted
    return [np.where(hit, v[at], np.float32(0))[back] for v in table[1:]]


def _best_window(values: np.ndarray) -> float:
    if not len(values):
        return 0.0
    sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    width = min(WINDOW, len(values))
    return float((sums[width:] - sums[:-width]).max() / WINDOW)


def evidence(docs: DataFrame, model: tuple[DataFrame, DataFrame], most: int = TABLE_ROWS) -> DataFrame:
    """``docs`` (with columns text and own) without them, and ``evidence, passage`` by the models of all folds; ``evidence0, passage0`` by the others where ``own``.

    One pass for each ``most`` rows of a model table. Passes but the last hand on the parts of each word.
    """
    context = docs.sparkSession.sparkContext
    passes = [max(1, math.ceil(table.count() / most)) for table in model]
    rest = [c for c in docs.columns if c not in ("text", "own")]
    numbers = ("evidence0", "passage0", "evidence", "passage")
    df = docs.select(*rest, "own", "text", F.lit(None).cast("binary").alias("parts"), *[F.lit(None).cast("double").alias(c) for c in numbers])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    for i in range(max(passes)):
        tables = [_table(t.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i)) if i < n else _table(t.limit(0)) for t, n in zip(model, passes, strict=True)]
        sent, last = context.broadcast(tables), i == max(passes) - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                lengths = [len(t) for t in batch.column(len(rest) + 1).to_pylist()]
                for some in slices(lengths):
                    yield _added(batch.slice(some.start, some.stop - some.start), len(rest), sent.value, hashes, last)

        df = map_arrow(df, run, schema)
        if not last:
            df = stored(df, "evidence")
            sent.destroy()
    return df.select(*rest, *numbers)


def _added(batch: pa.RecordBatch, at: int, tables: list[tuple[np.ndarray, ...]], hashes: Hashes, last: bool) -> pa.RecordBatch:
    """The batch after one pass; its columns from ``at`` on are own, text, parts and the four numbers."""
    own, texts, held = (batch.column(at + k).to_pylist() for k in range(3))
    h, begins = sequences(texts, hashes)
    after0, after1, before0, before1 = _looked_up(h, tables[0])
    more0, more1 = _looked_up(pair_keys(h[:-1], h[1:]), tables[1])
    # A word's part stands at the word; the first one of a text is START, which has none.
    parts = np.zeros((2, len(h)), np.float32)
    parts[0, 1:] = after0[1:] + before0[:-1] + more0
    parts[1, 1:] = after1[1:] + before1[:-1] + more1
    found: list[list[float | None]] = [[], [], [], []]
    kept = []
    for k, (a, b) in enumerate(zip(begins, begins[1:], strict=False)):
        values = parts[:, a + 1 : b]
        if held[k]:
            values = values + np.frombuffer(held[k], np.float32).reshape(2, -1)
        kept.append(None if last else values.tobytes())
        empty = b - a <= 2
        for m in (0, 1):
            known = last and (m == 1 or own[k])
            found[2 * m].append(None if not known else 0.0 if empty else float(values[m].sum(dtype=np.float64) / (b - a - 1)))
            found[2 * m + 1].append(None if not known else 0.0 if empty else _best_window(values[m]))
    text = pa.array([""] * len(texts)) if last else batch.column(at + 1)
    made = [text, pa.array(kept, pa.binary()), *(pa.array(x, pa.float64()) for x in found)]
    return pa.RecordBatch.from_arrays([*batch.columns[: at + 1], *made], schema=batch.schema)


def fit_curve(counts: list[tuple[list[float], float, float]]) -> list[float]:
    """Slopes and offset of the logistic curve from (signals, ordinary, toxic) counts; Newton steps with a weak prior."""
    x, n0, n1 = (np.array(c, float) for c in zip(*counts, strict=True)) if counts else (np.zeros((0, len(BINS))), *(np.zeros(0),) * 2)
    if not n0.sum() or not n1.sum():
        return [0.0] * (x.shape[1] + 1)
    x = np.c_[x, np.ones(len(x))]
    prior = np.r_[np.full(x.shape[1] - 1, 1e-3), 0.0]
    w = np.r_[np.zeros(x.shape[1] - 1), math.log(n1.sum() / n0.sum())]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r, v = n1 - (n0 + n1) * p, (n0 + n1) * p * (1 - p) + 1e-9
        step = np.linalg.solve((x.T * v) @ x + np.diag(prior), x.T @ r - prior * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def may_be_in(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` may be in ``known``: all that are, and few others. Nothing is shuffled but bits.

    Ids set bits by their hash; the bits lie in maps of 4 KB, of which there are at most ``FILTER_BITS / 32768``.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FILTER_BITS))
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = known.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    met = docs.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return met.where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).select(*docs.columns)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", held_out: int = 0, most: int = TABLE_ROWS) -> DataFrame:
    """``doc_id, held_out, evidence, passage, score, predicted`` per row. Fold ``held_out`` is never learned from, the fold after it calibrates."""
    key = F.col(f"`{doc_id}`")
    source = docs.select(key.alias("doc_id"), fold(key).alias("fold"), whole_text(F.col(f"`{text}`")).alias("text"))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("toxic"))
    known = known.where((fold(F.col("doc_id")) != held_out) & (fold(F.col("doc_id")) >= 0))
    calibrates = F.col("fold") == (held_out + 1) % FOLDS
    if known.count() <= LABEL_ROWS:
        labelled = source.join(F.broadcast(known), "doc_id")
    else:
        labelled = may_be_in(source, known).join(known, "doc_id")
    train = labelled.select("text", (F.col("toxic") + F.when(calibrates, 2).otherwise(0)).alias("kind"))
    model = build_model(model_counts(count_pairs(train)))
    scored = stored(evidence(source.select("doc_id", "fold", calibrates.alias("own"), "text"), model, most), "scored")
    bins = [F.floor(F.least(F.greatest(F.col(f"{c}0"), F.lit(low)), F.lit(high)) / width).alias(c) for c, low, high, width in BINS]
    seen = scored.where(calibrates).join(known, "doc_id")
    binned = seen.groupBy(*bins).agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).collect()
    *slopes, offset = fit_curve([([(r[c] + 0.5) * width for c, _, _, width in BINS], r["n0"], r["n1"]) for r in binned])
    sure = sum((F.lit(slope) * F.col(c) for slope, (c, *_) in zip(slopes, BINS, strict=True)), F.lit(offset))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-sure))
    return scored.select("doc_id", (F.col("fold") == held_out).alias("held_out"), "evidence", "passage", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
