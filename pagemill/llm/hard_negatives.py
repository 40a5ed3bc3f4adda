"""Hard negatives by maximum inner product search with cover trees.

Task. Of each anchor: its ``positives`` best rows of the same label, and for each of those the ``negatives`` best rows of
another label whose score lies in a window below the positive's, from ``low`` to ``high`` hundredths of it. Scores are integer
inner products of vectors whose components became floor(scale * x); ties go to the smaller id.

Cells. A bounded sample of rows (``CELLS``, by hash of the id) are the centres of the top level; each row belongs to the nearest
one of its dimension. Cells of more than ``BLOCK`` rows are dealt into several blocks by hash of the id, so copies of one vector
fill many blocks and no task. Every row is in exactly one block, and every block is searched: the sample decides only how well
blocks can be skipped.

Trees. Each block has a cover tree over its vectors, each augmented by sqrt(M^2 - |x|^2) for the block's largest norm M. Then
|x' - q'|^2 = M^2 + |q|^2 - 2 qx for an anchor q' = (q, 0), so the distance to a node's centre and the node's covering radius bound
the inner products of all below. Nodes of a level are chosen far apart, at half the radius of the level above; nodes of ``LEAF``
rows or of equal vectors are leaves. Centres are rows and are scored as they are met.

Descent. Level by level, nodes are taken best bound first, in slices, and tested again before they are scored: a node outside all
windows, or below what the anchor already has, is skipped with all below it. Anchors go through a tree together, as one matrix
product a slice. Rows of leaves are scored exactly, so results are exact.

Scale. The index is a table, read in place; anchors are broadcast in passes of ``PASS_BYTES``. A task carries what an anchor
has from block to block, and hands on a few rows an anchor. Anchors are the stated query set.

Cases: rows with a NULL id, label or vector, or a NULL or non-finite component take no part, nor does a component of 2^26 or
more after scaling (its scores could pass 64 bits); vectors of different lengths never meet; "other rows" are those with another id; an anchor
given twice is searched once, other repeated rows count each; fewer rows than asked for are all returned; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, stored, workers_find_package

CELLS, BLOCK, LEAF = 256, 4096, 24
SLICE, TOGETHER = 2048, 256  # nodes scored at once, anchors that descend together
PASS_BYTES = 32 << 20
LARGEST = 1 << 26
NONE = -(1 << 62)


def prepared_rows(rows: DataFrame, vec_id: Column, vector: Column, label: Column, scale: int = 256) -> DataFrame:
    """``vec_id, label, dim, v``: rows that take part; ``v`` holds the integer components, 4 bytes each."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * scale)) < LARGEST) & (F.abs(x) < float("inf")))
    taken = rows.where(vec_id.isNotNull() & label.isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    df = taken.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size(vector).alias("dim"), whole.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            packed = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["vec_id", "label", "dim", "v"])

    return map_arrow(df, run, "vec_id long, label long, dim int, v binary")


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    dim = a.shape[1]
    if not len(a) or not len(b) or not dim:
        return np.zeros((len(a), len(b)), np.int64)
    largest = [float(np.abs(x).max()) for x in (a, b)]
    if largest[0] * largest[1] * dim < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Tree:
    """Rows in the order of the tree; ``levels`` of nodes: row of the centre, radius, parent in the level above, rows below, leaf or not."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    norm: float  # M^2
    levels: list[dict[str, np.ndarray]]


def build_tree(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> Tree:
    """Cover tree by levels: centres of a node are chosen one by one among the rows that no centre covers yet."""
    x = v.astype(np.float64)
    norms = (x * x).sum(1)
    top = norms.max(initial=0.0)
    x = np.c_[x, np.sqrt(np.maximum(top - norms, 0.0))]
    order = np.argsort(ids, kind="stable")
    radius = _distances(x[order], x[order[0]]).max(initial=0.0)
    # A node: centre (a row), its other rows, covering radius, parent, whether the centre was met above.
    level = [(order[0], order[1:], radius, 0, False)]
    placed, levels, scale = [], [], radius
    while level:
        arrays = {k: [] for k in ("centre", "met", "radius", "parent", "first", "last", "leaf")}
        below, scale = [], scale / 2
        for n, (centre, rest, reach, parent, met) in enumerate(level):
            leaf = len(rest) <= LEAF or reach == 0.0
            for k, value in (("centre", centre), ("met", met), ("radius", reach), ("parent", parent), ("first", len(placed)), ("last", len(placed) + len(rest) * leaf), ("leaf", leaf)):
                arrays[k].append(value)
            if leaf:
                placed.extend(rest.tolist())
                continue
            chosen, met_above = centre, True
            while True:
                d = _distances(x[rest], x[chosen])
                near = d <= scale
                if near.any() or not met_above:
                    below.append((chosen, rest[near], float(d[near].max(initial=0.0)), n, met_above))
                rest = rest[~near]
                if not len(rest):
                    break
                chosen, met_above, rest = rest[0], False, rest[1:]
        levels.append({k: np.array(c) for k, c in arrays.items()})
        level = below
    # Leaf rows first, in the order of the tree; centres that lie in no leaf follow.
    inside = np.zeros(len(ids), bool)
    inside[placed] = True
    final = np.r_[np.array(placed, np.int64), np.flatnonzero(~inside)]
    where = np.empty(len(ids), np.int64)
    where[final] = np.arange(len(ids))
    for one in levels:
        one["centre"] = where[one["centre"]]
    return Tree(ids[final], labels[final], v[final], float(top), levels)


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - centre) ** 2).sum(1), 0.0))


def bounds(score: np.ndarray, radius: np.ndarray, norm: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product below nodes, from the scores of their centres; a little wide, for rounding."""
    both = norm + own[:, None]
    d = np.sqrt(np.maximum(both - 2.0 * score, 0.0))
    slack = 1e-9 * both + 1e-6
    return (both - (d + radius) ** 2) / 2 - slack, (both - np.maximum(d - radius, 0.0) ** 2) / 2 + slack


class Search:
    """What anchors of one pass have found: per anchor and window the best rows that the window takes.

    Window ``w`` of an anchor takes scores from ``low`` to ``high``, of rows with the anchor's label (``same``) or another.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.ids, self.labels, self.v, self.low, self.high, self.same = ids, labels, v, low, high, same
        self.own = (v.astype(np.float64) ** 2).sum(1)
        self.score = np.full((*low.shape, most), NONE)
        self.found = np.full((*low.shape, most), np.iinfo(np.int64).max)

    def _open(self, some: slice, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """Whether nodes with these bounds may hold a row for any window."""
        out = np.zeros(least.shape, bool)
        for w in range(self.low.shape[1]):
            need = np.maximum(self.low[some, w], self.score[some, w, -1])  # equal scores may have smaller ids
            out |= (largest >= need[:, None]) & (least <= self.high[some, w, None])
        return out

    def _offer(self, some: slice, tree: Tree, rows: np.ndarray, score: np.ndarray, met: np.ndarray) -> None:
        """Take from the scored rows (columns) what belongs to the best of each window; ``met`` tells which were reached."""
        fits = met & ((tree.labels[rows] == self.labels[some, None]) == self.same) & (tree.ids[rows] != self.ids[some, None])
        most = self.score.shape[2]
        for w in range(self.low.shape[1]):
            taken = fits & (score >= np.maximum(self.low[some, w], self.score[some, w, -1])[:, None]) & (score <= self.high[some, w, None])
            for i in np.flatnonzero(taken.any(1)):
                at = np.flatnonzero(taken[i])
                values = score[i, at]
                if len(at) > 4 * most:  # ties of the last place all stay
                    at = at[values >= np.partition(values, -most)[-most]]
                k = some.start + i
                values, names = np.r_[self.score[k, w], score[i, at]], np.r_[self.found[k, w], tree.ids[rows[at]]]
                best = np.lexsort((names, -values))[:most]
                self.score[k, w], self.found[k, w] = values[best], names[best]

    def through(self, tree: Tree) -> None:
        for begin in range(0, len(self.ids), TOGETHER):
            self._descend(slice(begin, min(begin + TOGETHER, len(self.ids))), tree)

    def _descend(self, some: slice, tree: Tree) -> None:
        v, own = self.v[some], self.own[some]
        # Of the level above: which anchors go on below a node, and the bounds they know.
        goes = np.ones((len(v), 1), bool)
        known = np.full((2, len(v), 1), np.inf) * np.array([-1.0, 1.0])[:, None, None]
        for level in tree.levels:
            parent, centre = level["parent"], level["centre"]
            here = np.zeros((len(v), len(parent)), bool)
            bound = np.zeros((2, len(v), len(parent)))
            first = np.argsort(-np.where(goes, known[1], -np.inf).max(0)[parent], kind="stable")  # best bound first
            for at in range(0, len(first), SLICE):
                nodes = first[at : at + SLICE]
                open_ = goes[:, parent[nodes]] & self._open(some, known[0][:, parent[nodes]], known[1][:, parent[nodes]])
                used = open_.any(0)
                nodes, open_ = nodes[used], open_[:, used]
                if not len(nodes):
                    continue
                score = scores(v, tree.v[centre[nodes]])
                self._offer(some, tree, centre[nodes], score, open_ & ~level["met"][nodes])
                bound[:, :, nodes] = bounds(score, level["radius"][nodes], tree.norm, own)
                here[:, nodes] = open_
            here &= self._open(some, *bound)
            leaves = np.flatnonzero(level["leaf"] & here.any(0) & (level["last"] > level["first"]))
            for at in range(0, len(leaves), SLICE // LEAF):
                self._verify(some, tree, level, leaves[at : at + SLICE // LEAF], here, bound)
            goes, known = here & ~level["leaf"], bound

    def _verify(self, some: slice, tree: Tree, level: dict[str, np.ndarray], leaves: np.ndarray, here: np.ndarray, bound: np.ndarray) -> None:
        open_ = here[:, leaves] & self._open(some, bound[0][:, leaves], bound[1][:, leaves])
        sizes = level["last"][leaves] - level["first"][leaves]
        rows = np.concatenate([np.arange(a, b) for a, b in zip(level["first"][leaves], level["last"][leaves], strict=True)])
        reached = np.repeat(open_, sizes, axis=1)
        some_row = np.flatnonzero(reached.any(0))
        for at in range(0, len(some_row), SLICE):
            part = some_row[at : at + SLICE]
            self._offer(some, tree, rows[part], scores(self.v[some], tree.v[rows[part]]), reached[:, part])

    def rows(self) -> pd.DataFrame:
        """``place`` of the anchor, window, score and id of all that was found."""
        place, window, slot = np.nonzero(self.score != NONE)
        return pd.DataFrame({"place": place, "window": window, "score": self.score[place, window, slot], "other_id": self.found[place, window, slot]})


def build_index(rows: DataFrame, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """The stored table ``dim, tree``: one cover tree a row, over at most about two ``block`` rows."""
    centres = rows.select("dim", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(cells).collect()  # bounded
    by_dim = {d: _matrix([bytes(r["v"]) for r in centres if r["dim"] == d], d).astype(np.float64) for d in {r["dim"] for r in centres}}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.full(batch.num_rows, -1, np.int64)
            for dim in np.unique(dims):
                if (mid := by_dim.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    x = _matrix(batch.column(3).take(pa.array(at)).to_pylist(), int(dim)).astype(np.float64)
                    cell[at] = ((mid * mid).sum(1) - 2 * x @ mid.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    dealt = stored(map_arrow(rows.select("vec_id", "label", "dim", "v"), assign, "vec_id long, label long, dim int, v binary, cell long"), "cells")
    sizes = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / block))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        tree = build_tree(frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), _matrix(list(frame["v"]), dim))
        return pd.DataFrame({"dim": [dim], "tree": [pickle.dumps(tree)]})

    workers_find_package(rows.sparkSession)
    grouped = dealt.join(sizes, ["dim", "cell"]).groupBy("dim", "cell", part.alias("part"))
    return stored(grouped.applyInPandas(grow, "dim int, tree binary"), "cover-trees")


def _search(index: DataFrame, anchors: DataFrame, same: bool, most: int, per_pass: int = PASS_BYTES) -> DataFrame:
    """``anchor_id, label, v, window, score, other_id``: the best rows of each window in every task's blocks, over all passes.

    ``anchors``: anchor_id, label, dim, v, low, high (arrays, one entry a window).
    """
    session = index.sparkSession
    sizes = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v") + 64 * F.size("low") + 32).alias("bytes")).first()
    passes = max(1, -(-(sizes["bytes"] or 0) // per_pass))
    out = []
    for i in range(passes):
        part = anchors.where(F.pmod(F.xxhash64("anchor_id", "v"), F.lit(passes)) == i).toArrow()
        held = {}
        for dim in set(part.column("dim").to_pylist()):
            rows = part.filter(pa.array(x == dim for x in part.column("dim").to_pylist()))
            low, high = (np.array(rows.column(c).to_pylist(), np.int64).reshape(rows.num_rows, -1) for c in ("low", "high"))
            held[dim] = [rows.column("anchor_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v").to_pylist(), dim), low, high]
        sent = session.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches: dict[int, Search] = {}
            for batch in batches:
                for dim, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if dim in sent.value:
                        search = searches.setdefault(dim, Search(*sent.value[dim], same, most))
                        search.through(pickle.loads(tree.as_buffer()))
            for dim, search in searches.items():
                found = search.rows()
                place = found["place"].to_numpy()
                ids, labels, v = (sent.value[dim][k] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[place]), pa.array(labels[place]), pa.array([v[p].tobytes() for p in place], pa.binary()), *(pa.array(found[c].to_numpy(np.int64)) for c in ("window", "score", "other_id"))],
                    ["anchor_id", "label", "v", "window", "score", "other_id"])

        schema = "anchor_id long, label long, v binary, window long, score long, other_id long"
        out.append(stored(map_arrow(index, run, schema), "search"))
        sent.destroy()
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("anchor_id", "label", "v", "window").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cells: int = CELLS, block: int = BLOCK, per_pass: int = PASS_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows as ``prepared_rows`` gives them.

    A negative's score times 100 is from ``low`` to ``high`` times the positive's.
    """
    rows = stored(rows, "vectors")
    index = build_index(rows, cells, block)
    anchors = stored(rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "dim", "v").distinct(), "anchors")
    ends = [F.array(F.lit(x)).cast("array<long>").alias(c) for c, x in (("low", NONE + 1), ("high", -NONE))]
    best = stored(_search(index, anchors.select("*", *ends), True, positives, per_pass), "positives")
    # 100 * score within the window, in whole numbers.
    down = lambda c: F.expr(f"{c} div 100 - if({c} % 100 < 0, 1, 0)")
    scaled = best.withColumn("l", F.col("score") * low).withColumn("h", F.col("score") * high)
    windows = scaled.withColumn("l", -down("(-l)")).withColumn("h", down("h"))
    grouped = windows.groupBy("anchor_id", "label", "v").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score", "l", "h"))).alias("w"))
    # Each anchor has as many windows; the missing ones take nothing.
    wide = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col("w"), i - 1)[c], F.lit(none))).cast("array<long>")
    asked = stored(grouped.join(anchors, ["anchor_id", "label", "v"]).select("anchor_id", "label", "dim", "v", wide("l", 1).alias("low"), wide("h", 0).alias("high")), "windows")
    found = _search(index, asked, False, negatives, per_pass)
    positive = best.select("anchor_id", "label", "v", (F.col("rank") - 1).cast("long").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["anchor_id", "label", "v", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
