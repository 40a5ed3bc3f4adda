"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard places.

Writing. Documents are range-partitioned by id (with a hash of the text behind it, so one id that many rows
share is split as well) and sorted; each task encodes its documents as they stream by and appends their ids
to one shard. A task writes under a name of its own and hands the name on in its result row, so a
repeated or lost task leaves at most an unread file. The manifest table (one row per shard) fixes the
order of shards and the ids before each.

Shard file: the magic ``PMTOK1`` and two digits for the bytes per id, the raw little-endian ids, then for each document its
first id (unsigned 64-bit, with one closing entry), and the number of documents in the last eight bytes.

Index. The keys (ids as text) are hashed to buckets of about 20,000; each bucket gets a minimal
perfect hash of its own: keys are hashed to cells, cells with several keys get a displacement that sends
all of them to free slots, largest cells first, and cells with one key name their slot outright. A slot stores a 32-bit
fingerprint, shard, place in the shard, number of rows and of shards they run over. A lookup reads two numbers and one slot, and a
foreign key is told by its fingerprint. Buckets are rows of a written table.

Reading. Keys find their bucket by hash; what the slots say is then read shard by shard from the raw files.

Cases: a NULL or empty text is the end id alone; repeated ids are stored one after another and a key
gives all of its rows; a NULL id comes first and has the key ``null``; an empty table gives an empty store.
Files are reached through pyarrow's file systems, so the folder may be local and shared, or in a store they know.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, new_folder, whole_text, workers_find_package
from pagemill.llm.tokens import Encoder

MAGIC, END_ID, BUCKET_KEYS = b"PMTOK1", 1, 20_000
_ENTRY = np.dtype([("print", "<u4"), ("shard", "<i4"), ("place", "<i8"), ("rows", "<i8"), ("span", "<i4")])


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:") or ":" not in folder:
        return fs.LocalFileSystem(), urlparse(folder).path
    return fs.FileSystem.from_uri(folder)


# The hash function: three numbers per key from one 128-bit hash.


def _hashed(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)
    a, b = raw[:, 0], raw[:, 1]
    return a, b, ((a >> np.uint64(32)) ^ b).astype(np.uint32)


def _slots(a: np.ndarray, b: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    x = a ^ ((displacement + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * (b | np.uint64(1))
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def build_hash(keys: list[str]) -> np.ndarray:
    """Displacement per cell for distinct keys; below zero: the slot itself, as -slot - 1."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    a, b, _ = _hashed(keys)
    cell = (b % np.uint64(n)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
    groups = [order[i:j] for i, j in zip(starts, [*starts[1:], n], strict=True)]
    table, taken = np.zeros(n, np.int64), np.zeros(n, bool)
    groups.sort(key=len, reverse=True)
    for i, g in enumerate(groups):
        if len(g) == 1:
            free = np.flatnonzero(~taken)
            singles = np.concatenate(groups[i:])
            table[cell[singles]] = -free - 1
            break
        d = 0
        while True:
            at = _slots(a[g], b[g], np.array([d], np.uint64), n)
            if not taken[at].any() and len(np.unique(at)) == len(g):
                break
            d += 1
        taken[at] = True
        table[cell[g[0]]] = d
    return table


def find_slots(keys: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and fingerprint of each key, known or not."""
    a, b, prints = _hashed(keys)
    n = len(table)
    d = table[(b % np.uint64(n)).astype(np.int64)]
    at = _slots(a, b, np.maximum(d, 0).astype(np.uint64), n)
    return np.where(d < 0, -d - 1, at), prints


# Shards.


class ShardWriter:
    """Appends documents to one shard file."""

    def __init__(self, folder: str, width: int) -> None:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.bin"
        self.out, self.width, self.starts = system.open_output_stream(f"{path}/{self.name}"), width, [0]
        self.out.write(MAGIC + b"%02d" % width)

    def add(self, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.starts.append(self.starts[-1] + len(ids))

    def close(self) -> None:
        self.out.write(np.array([*self.starts, len(self.starts) - 1], "<u8").tobytes())
        self.out.close()


class ShardReader:
    """Ids of the documents of one shard by place."""

    def __init__(self, folder: str, name: str) -> None:
        system, path = file_system(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        head = self.file.read_at(8, 0)
        if head[:6] != MAGIC:
            raise ValueError(f"{name} is no shard of token ids")
        self.width = int(head[6:])
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.starts = np.frombuffer(self.file.read_at(8 * (n + 1), size - 8 * (n + 2)), "<u8").astype(np.int64)

    def read(self, place: int) -> np.ndarray:
        first, last = int(self.starts[place]), int(self.starts[place + 1])
        return np.frombuffer(self.file.read_at((last - first) * self.width, 8 + first * self.width), f"<u{self.width}").astype("<u4")


def key_of(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


@dataclass
class TokenStore:
    """A written store: ``manifest`` (shard, name, n_docs, n_ids, before) and ``index`` (bucket, cells, slots)."""

    spark: SparkSession
    folder: str
    buckets: int

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.schema("shard int, name string, n_docs long, n_ids long, before long").parquet(f"{self.folder}/manifest")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema("bucket int, cells binary, slots binary").parquet(f"{self.folder}/index")

    def locate(self, keys: DataFrame) -> DataFrame:
        """``key, shard, place`` for each row of each key in ``keys`` (key string); unknown keys give no row.

        A key with more rows than one shard holds runs on into the next shards.
        """
        buckets = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for keys_here, cells, slots in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    at, prints = find_slots(keys_here, np.frombuffer(cells, "<i8"))
                    entry = np.frombuffer(slots, _ENTRY)[at]
                    known = entry["print"] == prints
                    names = ("shard", "place", "rows", "span")
                    out += [(k, *(int(e[x]) for x in names)) for k, e, y in zip(keys_here, entry, known, strict=True) if y]
                columns = list(zip(*out, strict=True)) or [()] * 5
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "shard", "place", "rows", "span"])

        # A bucket's keys come in lists of bounded length, each with the bucket's hash function once.
        part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, BUCKET_KEYS // 5000)))
        lists = keys.select("key").distinct().groupBy(buckets.alias("bucket"), part.alias("part")).agg(F.collect_list("key").alias("keys"))
        found = map_arrow(lists.join(self.index, "bucket").select("keys", "cells", "slots"), look_up, "key string, shard int, place long, rows long, span int")
        upto = self.manifest.select("shard", "n_docs", (F.sum("n_docs").over(_in_order()) - F.col("n_docs")).alias("begin"))
        # Rows of the store have one numbering; a key's rows are a stretch of it, mostly inside one shard.
        first = found.join(upto, "shard").select("key", "shard", (F.col("begin") + F.col("place")).alias("row"), "rows", "span")
        each = first.select("key", "row", "rows", F.explode(F.sequence(F.col("shard"), F.col("shard") + F.col("span") - 1)).alias("shard")).join(upto, "shard")
        low = F.greatest(F.lit(0), F.col("row") - F.col("begin"))
        high = F.least(F.col("n_docs"), F.col("row") + F.col("rows") - F.col("begin"))
        return each.select("key", "shard", F.explode(F.sequence(low, high - 1)).alias("place"))

    def read(self, keys: DataFrame) -> DataFrame:
        """``key, start, n_tokens, ids`` (little-endian unsigned 32-bit) for each stored row of the keys."""
        folder = f"{self.folder}/shards"

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, reader = None, None
            for batch in batches:
                ids, starts, counts = [], [], []
                size, first = 0, 0
                for i, (shard, place, before) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    if shard != name:
                        name, reader = shard, ShardReader(folder, shard)
                    got = reader.read(place)
                    ids.append(got.tobytes())
                    starts.append(before + int(reader.starts[place]))
                    counts.append(len(got))
                    size += 4 * len(got)
                    if size > 8 << 20 or i == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(first, len(ids)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_tokens", "ids"])
                        first, size, ids, starts, counts = i + 1, 0, [], [], []

        named = self.locate(keys).join(self.manifest.select("shard", "name", "before"), "shard")
        by_shard = named.repartitionByRange(F.col("shard"), F.col("place")).sortWithinPartitions("shard", "place").select("key", "name", "place", "before")
        return map_arrow(by_shard, fetch, "key string, start long, n_tokens long, ids binary")


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy("shard")  # over the manifest: one row per shard


def write_store(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, folder: str | None = None) -> TokenStore:
    """Encode, write shards in ascending id order, and index them."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-store")
    source_text = Path(tokenizer_path).read_text(encoding="utf-8")
    spec, end = spark.sparkContext.broadcast(source_text), np.array([end_id], "<u4")
    largest = max(Encoder(source_text).tokenizer.get_vocab_size() - 1, end_id)
    width = 2 if largest < 1 << 16 else 4
    shards = f"{folder}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, keys, place = Encoder.of(spec.value), None, [], 0
        run: list = []  # key, first place, rows so far: rows of one key stand together
        for batch in batches:
            writer = writer or ShardWriter(shards, width)
            for at in range(0, batch.num_rows, 256):
                keys += batch.column(0).slice(at, 256).to_pylist()
                for ids in encoder.encode(batch.column(1).slice(at, 256).to_pylist()):
                    writer.add(np.concatenate([np.frombuffer(ids, "<u4"), end]))
            done = []
            for k in keys:
                if run and run[0] == k:
                    run[2] += 1
                else:
                    if run:
                        done.append(run)
                    run = [k, place, 1]
                place += 1
            keys = []
            yield _key_rows(done, writer)
        if writer:
            yield _key_rows([run] if run else [], writer)
            writer.close()
        if place:
            yield pa.RecordBatch.from_arrays(
                [pa.array([writer.name]), pa.array([None], pa.string()), pa.array([place], pa.int64()), pa.array([writer.starts[-1]], pa.int64())], ["name", "key", "place", "rows"])

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), whole_text(F.col(f"`{text}`")).alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(F.col("d").asc_nulls_first(), tie).sortWithinPartitions(F.col("d").asc_nulls_first(), tie)
    laid_out = map_arrow(ordered.select(key_of("d").alias("key"), "text"), write, "name string, key string, place long, rows long")
    # Tasks of a range partitioning are in order of the ids; their number orders the shards.
    laid_out.withColumn("task", F.spark_partition_id()).write.parquet(f"{folder}/places")
    places = spark.read.schema("name string, key string, place long, rows long, task int").parquet(f"{folder}/places")
    per_shard = places.where("key IS NULL").select((F.row_number().over(_by_task()) - 1).alias("shard"), "name", F.col("place").alias("n_docs"), F.col("rows").alias("n_ids"))
    before = (F.sum("n_ids").over(_in_order()) - F.col("n_ids")).alias("before")
    per_shard.select("shard", "name", "n_docs", "n_ids", before).write.parquet(f"{folder}/manifest")
    buckets = max(1, -(-places.where("key IS NOT NULL").count() // BUCKET_KEYS))
    store = TokenStore(spark, folder, buckets)
    entries = places.where("key IS NOT NULL").join(store.manifest.select("name", "shard"), "name").groupBy("key").agg(
        F.min(F.struct("shard", "place")).alias("first"), F.sum("rows").alias("rows"), F.count(F.lit(1)).cast("int").alias("span")
    ).select("key", "first.shard", "first.place", "rows", "span")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = list(frame.key)
        cells = build_hash(keys)
        at, prints = find_slots(keys, cells)
        slots = np.zeros(len(keys), _ENTRY)
        for field, values in (("print", prints), ("shard", frame.shard), ("place", frame.place), ("rows", frame.rows), ("span", frame.span)):
            slots[field][at] = np.asarray(values)
        return pd.DataFrame({"bucket": [frame.bucket.iloc[0]], "cells": [cells.tobytes()], "slots": [slots.tobytes()]})

    workers_find_package(spark)
    by_bucket = entries.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket")
    by_bucket.applyInPandas(build, "bucket int, cells binary, slots binary").write.parquet(f"{folder}/index")
    return store


def _by_task():
    from pyspark.sql import Window

    return Window.orderBy("task")  # over one row per shard


def _key_rows(runs: list, writer: ShardWriter) -> pa.RecordBatch:
    keys, places, rows = zip(*runs, strict=True) if runs else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([writer.name] * len(runs), pa.string()), pa.array(keys, pa.string()), pa.array(places, pa.int64()), pa.array(rows, pa.int64())], ["name", "key", "place", "rows"])
