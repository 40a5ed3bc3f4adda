"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that ``min_docs`` documents or more hold keep their lines in one
document only, the one with the largest ``doc_id``.

Documents come in batches, largest ids first. ``LineRuns`` holds what was seen so far as runs: tables of
``(h, n, top)`` bucketed and sorted by the 128-bit line hash, disjoint by key. A batch is anti-joined
with every run by a merge join that shuffles nothing but the batch; what is left is new and becomes a
run of level 0, its ``top`` the largest id that holds the line. Lines seen before only add to a table of
repeats. ``fan_out`` runs of one level are compacted into one run of the next, so a batch meets a number
of runs that grows with the logarithm of the number of batches. The work is the same for a first load and for
a batch that arrives later. Only built-in functions are used.

Cases: a NULL text is one empty line; each row counts as a document, so repeated rows with the largest
id of a key all keep the line; a NULL ``doc_id`` counts as smaller than any other; an empty table gives
an empty result; columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import ASCII_SPACE, ascii_lower, new_folder, packed, stored, whole_text

MIN_CHARS, MIN_DOCS, BATCHES, FAN_OUT = 20, 3, 4, 2
LOWEST = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def line_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Per line its hash, NULL for lines that are too short to count."""

    def one(line: Column) -> Column:
        return let(line_key(line), lambda k: F.when(F.length(k) >= min_chars, line_hash(k)))

    return F.transform(F.split(text, "\n"), one)


class LineRuns:
    """Disjoint runs of line hashes by level, and the table of repeats."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT) -> None:
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def _write(self, df: DataFrame, kind: str) -> DataFrame:
        name = f"line_{kind}_{uuid.uuid4().hex}"
        laid_out = df.repartition(self.buckets, "h").sortWithinPartitions("h")
        writer = laid_out.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", new_folder(self.spark, name))
        writer.saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add one batch of ``(h, n, top)``, one row per key."""
        batch = batch.repartition(self.buckets, "h")
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.select("h"), "h", "left_anti")
        seen_before = bool(self.runs())
        fresh = self._write(fresh, "run")
        if seen_before:
            self.repeats.append(self._write(batch.join(fresh.select("h"), "h", "left_anti").select("h", "n"), "repeats"))
        self._place(fresh, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for other in full[1:]:
                merged = merged.unionByName(other)
            self._place(self._write(merged, "run"), level + 1)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """``(h, top)`` of the keys that ``min_docs`` documents or more hold."""
        more = None
        for part in self.repeats:
            more = part if more is None else more.unionByName(part)
        out = None
        for run in self.runs():
            if more is None:
                found = run.where(F.col("n") >= min_docs)
            else:
                sums = more.groupBy("h").agg(F.sum("n").alias("more"))
                found = run.join(sums, "h", "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= min_docs)
            found = found.select("h", "top")
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], "h binary, top long")
        return stored(out, "frequent-lines")


def batch_bounds(docs: DataFrame, batches: int, doc_id: str) -> list[int]:
    """Ids that split the documents into batches of about one size."""
    shares = [i / batches for i in range(1, batches)]
    row = docs.agg(F.percentile_approx(F.col(f"`{doc_id}`").cast("long"), shares).alias("p")).first()
    return sorted(set(row["p"] or []))


def frequent_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    batches: int = BATCHES, fan_out: int = FAN_OUT,
) -> DataFrame:
    """Build the runs batch by batch and give ``(h, top)`` of the frequent lines."""
    bounds = batch_bounds(docs, batches, doc_id)
    d = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST))
    number = F.lit(0)
    for b in bounds:
        number = number + F.when(d <= b, 1).otherwise(0)
    keys = F.array_distinct(F.filter(hashes(whole_text(F.col(f"`{text}`")), min_chars), lambda h: h.isNotNull()))
    lines = docs.select(d.alias("d"), number.alias("batch"), F.explode(keys).alias("h"))
    # A line of a third of all documents is one row per task before the shuffle.
    counted = lines.groupBy("batch", "h").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("top"))
    folder = new_folder(docs.sparkSession, "line-batches")
    counted.write.partitionBy("batch").parquet(folder)
    written = docs.sparkSession.read.schema("h binary, n long, top long, batch int").parquet(folder)
    runs = LineRuns(docs.sparkSession, fan_out)
    for i in range(len(bounds) + 1):  # batch 0 has the largest ids
        runs.add(written.where(F.col("batch") == i).drop("batch"))
    return runs.frequent(min_docs)


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    batches: int = BATCHES, fan_out: int = FAN_OUT,
) -> DataFrame:
    """``doc`` (struct of all columns), ``kept_text``, ``n_lines``, ``n_dropped``.

    Places of dropped lines go back to their documents; no line's text is shuffled but within its document.
    """
    frequent = frequent_lines(docs, text, doc_id, min_chars, min_docs, batches, fan_out)
    d = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST))
    t = whole_text(F.col(f"`{text}`"))
    placed = docs.select(d.alias("d"), F.xxhash64(t).alias("t"), F.posexplode(hashes(t, min_chars)).alias("place", "h")).where("h IS NOT NULL")
    dropped = (
        placed.join(frequent, "h").where("d <> top").groupBy("d", "t").agg(F.collect_set("place").alias("places"))
    )
    whole = packed(docs).select(
        "doc", F.coalesce(F.col(f"doc.`{doc_id}`").cast("long"), F.lit(LOWEST)).alias("d"), F.xxhash64(whole_text(F.col(f"doc.`{text}`"))).alias("t")
    )
    lines = F.split(whole_text(F.col(f"doc.`{text}`")), "\n")

    def without(all_lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(all_lines) - 1)
        kept = F.transform(F.array_except(every, F.col("places")), lambda i: F.get(all_lines, i))
        return F.array_join(kept, "\n")

    n_dropped = F.when(F.col("places").isNull(), 0).otherwise(F.size("places"))
    kept_text = F.when(F.col("places").isNull(), whole_text(F.col(f"doc.`{text}`"))).otherwise(let(lines, without))
    return whole.join(dropped, ["d", "t"], "left").select(
        "doc", kept_text.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped")
    )
