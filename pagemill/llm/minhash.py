"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (one pass over the texts, per document): the distinct shingles are thrown into 150 bins in rounds
of fresh hashes; a bin keeps the smallest value of the first round that reaches it. After 150 rounds each
bin that is still empty gets a round of its own, so every coordinate fills. Equal coordinates estimate
Jaccard similarity with Chernoff-type bounds: a pair is passed over only if its sketches agree five
standard deviations less than a link's would. All 30 bands of 5 coordinates of a link differ about once in
40 million pairs at a similarity of 0.85 and once in 150,000 at 0.8.

Links: texts with the same words form a class, and only classes are compared. Classes that share a band
meet in a bucket. A bucket is not expanded into pairs: its most central class (the one that meets most
others over all bands) is the pivot, every member is compared with the pivot, by sketch and then by full
shingle sets. What remains in a bucket, members outside the pivot's component, is compared in blocks of
bounded size inside tasks, where pairs of one component are passed over; members far from the pivot
(over twice a link's Jaccard distance, so by the triangle inequality without a link to a direct
neighbour of the pivot) skip those neighbours. So no link is lost to the bucket's size, and no bucket is one task's work.

Components come from iterated smallest labels with pointer jumping. Every step is a written table.

Cases: a NULL text or one without words has no shingles, is linked with nothing and is kept; a text with
fewer words than a shingle is one shingle; repeated rows are one class; a NULL ``doc_id`` is larger than
any other, and a component with no other id has a NULL id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ASCII_SPACE, map_arrow, packed, stored, whole_text, workers_find_package

BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
BLOCK = 1000
HIGHEST = 2**63 - 1
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def least_agreement(percent: int) -> int:
    """Equal coordinates that a pair of this similarity has, less five standard deviations."""
    p = max(percent, 1) / 100
    return int(COORDINATES * p - 5 * (COORDINATES * p * (1 - p)) ** 0.5)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUNDS = _mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not words:
        return h
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out + h[i : len(words) - width + 1 + i] * np.uint64(2 * i + 1))
    return np.unique(out)


def words_of(text: pa.Scalar) -> list[bytes]:
    """Words between runs of ASCII white space; A-Z count as a-z (bytes know no other letters)."""
    return text.as_buffer().to_pybytes().lower().split()


def class_key(words: list[bytes]) -> bytes:
    """128-bit hash, the same for texts with the same words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketch(items: np.ndarray) -> np.ndarray:
    """The coordinates, 32 bits each; all filled unless the set is empty."""
    t, n = COORDINATES, len(items)
    best = np.full(t, _FULL)
    if not n:
        return np.zeros(t, np.uint32)
    at, some = 0, max(1, -(-4 * t // n))
    while at < t and (best == _FULL).any():
        upto = min(t, at + some)
        h = _mixed(items[None, :] ^ _ROUNDS[at:upto, None])
        value = (np.arange(at, upto, dtype=np.uint64)[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, ((h >> np.uint64(32)) % np.uint64(t)).ravel().astype(np.int64), value.ravel())
        at = upto
    for b in np.flatnonzero(best == _FULL):
        best[b] = (np.uint64(t + b) << np.uint64(32)) | (_mixed(items ^ _ROUNDS[t + b]).min() & np.uint64(0xFFFFFFFF))
    return _mixed(best).astype(np.uint32)


def keyed(text: str, doc_id: str) -> list[Column]:
    """Id ``d`` (NULL: the largest long), hash ``h`` of the raw text, text ``t`` as bytes."""
    t = whole_text(F.col(text))
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(HIGHEST)).alias("d"), F.xxhash64(t).alias("h"), t.cast("binary").alias("t")]


def _sketched(source: DataFrame, size: int) -> DataFrame:
    """``d, h, c, n, sketch`` per document: class, number of shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, counts, sketches = [], [], []
            for text in batch.column(2):
                words = words_of(text)
                items = shingle_set(words, size)
                classes.append(class_key(words))
                counts.append(len(items))
                sketches.append(sketch(items).tobytes())
            made = [pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["d", "h", "c", "n", "sketch"])

    return map_arrow(source.select("d", "h", "t"), run, "d long, h long, c binary, n long, sketch binary")


def _sets(source: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``c, items`` of the classes whose first row ``(d, h)`` is in ``wanted``: full sets, made anew from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, items = [], []
            for text in batch.column(0):
                words = words_of(text)
                classes.append(class_key(words))
                items.append(shingle_set(words, size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(items, pa.binary())], ["c", "items"])

    texts = source.join(wanted, ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    return map_arrow(texts.select("t"), run, "c binary, items binary")


def _agreement(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, same``: equal coordinates of each pair."""
    left = nodes.select(F.col("c").alias("a"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("c").alias("b"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).sum(1), pa.int32())], ["a", "b", "same"])

    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), run, "a binary, b binary, same int")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = _shared(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("c").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [
                _is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``c, comp``: the smallest node reachable over links ``(a, b)``; only nodes with links."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("c").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        least = labels.join(heard.withColumnRenamed("a", "c"), "c").select("c", "comp", F.least("comp", "heard").alias("near"))
        jump = labels.select(F.col("c").alias("near"), F.col("comp").alias("far"))
        new = stored(least.join(jump, "near").select("c", F.least("near", "far").alias("comp"), (F.least("near", "far") != F.col("comp")).alias("moved")), "labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def _remaining_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between what the pivots left apart. ``members``: key, c, comp, pivot_comp, near, mid, without the pivots."""
    apart = F.col("comp") != F.col("pivot_comp")
    marked = members.select("key", "c", "comp", "near", "mid", apart.alias("apart"))
    # A probe (apart) meets the others that are apart or no direct neighbours of the pivot; if it lies at middle distance, also those.
    sums = marked.groupBy("key").agg(
        F.count_if("apart").alias("probes"), F.count_if(F.expr("apart and mid")).alias("mids"),
        F.count_if(F.expr("apart or not near")).alias("others"), F.count_if(F.expr("near and not apart")).alias("nears"),
    ).where("probes > 0 and (others > 1 or (mids > 0 and nears > 0))")
    left = marked.join(sums, "key").where("apart or not near or mids > 0")
    targets = F.col("others") + F.when(F.col("mids") > 0, F.col("nears")).otherwise(0)
    rows, columns = (F.ceil(x / BLOCK).cast("int") for x in (F.col("probes"), targets))
    sized = stored(left.select("key", "c", "comp", "near", "mid", "apart", rows.alias("rows"), columns.alias("columns")), "remaining")
    if sized.isEmpty():
        return sized.select(F.col("c").alias("a"), F.col("c").alias("b"))
    loaded = sets.join(sized.select("c").distinct(), "c", "left_semi").join(nodes.select("c", "sketch"), "c")
    mine_row, mine_column = F.pmod(F.xxhash64("c"), F.col("rows")), F.pmod(F.xxhash64("c"), F.col("columns"))
    as_probe = sized.where("apart").select("key", "c", "comp", "near", "mid", F.lit(True).alias("probe"), mine_row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    as_target = sized.select("key", "c", "comp", "near", "mid", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), mine_column.alias("j"))
    dealt = as_probe.withColumn("i", F.col("i").cast("int")).unionByName(as_target.withColumn("j", F.col("j").cast("int")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = _block_links(frame[frame.probe], frame[~frame.probe], percent)
        return pd.DataFrame(found, columns=["a", "b"])

    workers_find_package(nodes.sparkSession)
    return dealt.join(loaded, "c").groupBy("key", "i", "j").applyInPandas(run, "a binary, b binary")


def _block_links(probes: pd.DataFrame, targets: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join components, among probes x targets of one block."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found, likely = [], least_agreement(percent)
    if not len(targets):
        return found
    y = np.frombuffer(b"".join(targets.sketch), np.uint32).reshape(-1, COORDINATES)
    near = targets.near.to_numpy(bool)
    items = [np.frombuffer(x, np.uint64) for x in targets["items"]]
    keys, comps = list(targets.c), list(targets.comp)
    for p in probes.itertuples():
        same = (y == np.frombuffer(p.sketch, np.uint32)).sum(1)
        mine = np.frombuffer(p.items, np.uint64)
        for k in np.flatnonzero((same >= likely) & (p.mid | ~near)):
            if root(p.comp) != root(comps[k]) and _is_link(mine, items[k], percent):
                parent[root(p.comp)] = root(comps[k])
                found.append((p.c, keys[k]))
    return found


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key, c, k``: classes by shared band, ``k`` to a bucket. Bands with the same classes are one bucket."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = nodes.select("c", F.explode(keys).alias("key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("x")).where("k > 1")
    once = sizes.groupBy("k", "x").agg(F.min("key").alias("key")).select("key", "k")
    return bands.join(once, "key")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``d, h, n, component_id, kept`` per row: id, text hash, shingle count, smallest id reachable, and whether it stays.

    ``size`` words a shingle; linked from ``percent`` hundredths of Jaccard similarity (80 or more: the bands are made for that).
    ``kept`` marks one (d, h) of each group, and every row without words.
    """
    if percent < 80:
        raise ValueError("bands and bounds hold from a similarity of 0.8 on")
    source = docs.select(*keyed(f"`{text}`", f"`{doc_id}`"))
    rows = stored(_sketched(source, size), "sketches")
    nodes = stored(rows.where("n > 0").groupBy("c").agg(F.min(F.struct("d", "h")).alias("rep"), F.first("sketch").alias("sketch")), "classes")
    met = stored(_buckets(nodes), "buckets")
    central = met.groupBy("c").agg(F.sum("k").alias("central"))
    pivots = met.join(central, "c").groupBy("key").agg(F.max(F.struct("central", "c")).alias("m")).select("key", F.col("m.c").alias("pivot"))
    met = stored(met.join(pivots, "key").where("c <> pivot").select("key", "c", "pivot"), "pivots")
    pairs = met.select(F.col("c").alias("a"), F.col("pivot").alias("b")).distinct()
    compared = stored(_agreement(pairs, nodes), "compared")
    likely = compared.where(F.col("same") >= least_agreement(percent)).select("a", "b")
    # Sets of all that may be compared: whoever agrees with a pivot, and whoever shares a bucket with others beside it.
    crowded = met.join(met.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "key").select("c")
    ends = likely.select(F.col("a").alias("c")).union(likely.select("b")).union(crowded).distinct()
    sets = stored(_sets(source, nodes.join(ends, "c", "left_semi").select("rep.d", "rep.h"), size), "sets")
    links = stored(_verified(likely, sets, percent), "direct-links")
    comps = components(links)
    with_comp = stored(nodes.select("c").join(comps, "c", "left").select("c", F.coalesce("comp", "c").alias("comp")), "node-components")
    near = compared.join(links.withColumn("near", F.lit(True)), ["a", "b"], "left").select(
        F.col("a").alias("c"), F.col("b").alias("pivot"), F.coalesce("near", F.lit(False)).alias("near"), (F.col("same") >= least_agreement(2 * percent - 100)).alias("mid")
    )
    members = (
        met.join(near, ["c", "pivot"]).join(with_comp, "c").join(with_comp.select(F.col("c").alias("pivot"), F.col("comp").alias("pivot_comp")), "pivot")
        .select("key", "c", "comp", "pivot_comp", "near", "mid")
    )
    more = stored(_remaining_links(members, nodes, sets, percent), "further-links")
    if not more.isEmpty():
        comps = components(links.union(more))
    named = nodes.select("c", "rep").join(comps, "c", "left").select("c", "rep", F.coalesce("comp", "c").alias("comp"))
    firsts = named.groupBy("comp").agg(F.min("rep").alias("first"))
    of_class = stored(named.join(firsts, "comp").select("c", "first.*").toDF("c", "id", "kept_h"), "components")
    out = rows.select("d", "h", "c", "n").join(of_class, "c", "left")
    component = F.when(F.col("n") == 0, F.col("d")).otherwise(F.col("id"))
    return out.select(
        "d", "h", "n", F.when(component != HIGHEST, component).alias("component_id"),
        ((F.col("n") == 0) | ((F.col("d") == F.col("id")) & (F.col("h") == F.col("kept_h")))).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group and every document without words, with their own columns."""
    kept = near_duplicates(docs, size, percent, text, doc_id).where("kept").select("d", "h").distinct()
    whole = packed(docs)
    d, h, _ = keyed(f"doc.`{text}`", f"doc.`{doc_id}`")
    rows = whole.select("doc", d, h).join(kept, ["d", "h"], "left_semi")
    # Rows without words are no group: each gets a mark of its own.
    empty = F.trim(whole_text(F.col(f"doc.`{text}`")), F.lit(ASCII_SPACE)) == ""
    marked = rows.withColumn("mark", F.when(empty, F.monotonically_increasing_id()))
    return marked.dropDuplicates(["d", "h", "mark"]).select("doc.*")
