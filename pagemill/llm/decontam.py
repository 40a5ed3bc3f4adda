"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The test strings are the
windows of 10 consecutive words of the benchmark items; an item with fewer words is one string. Strings
of one length share a table: a block of the last two words of the text window says how far the window
may jump (nine words where the block stands in no test string); where the jump is zero the block selects
a suffix bucket, the first block of the window selects strings inside it, and comparing all words confirms.

The tables go to the tasks as a broadcast of proven size: the benchmark's bytes are summed first, and a
benchmark larger than ``chunk_bytes`` is searched in several passes, each with a part of the items and
the hits so far written in between. Tables take about 150 bytes of memory for each byte of text, so the default of 2 MB
is about 300 MB in the driver and in each Python worker. The documents stay where they are; nothing is shuffled.

Cases: a NULL text or one without words has no hits; items without words are no strings; an item id may
repeat (one item); a NULL item id marks words but names no item; very long texts are searched whole;
empty tables give an empty result or no hits; other columns are carried along unread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, stored, whole_text

WINDOW, CHUNK_BYTES = 10, 2 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes: only A-Z change


class ShiftTable:
    """Wu-Manber tables for strings of ``m`` words: shifts, suffix buckets, strings."""

    def __init__(self, m: int, strings: dict[tuple[bytes, ...], set[str | None]]) -> None:
        self.m = m
        self.block = min(m, 2 if len(strings) < 1 << 16 else 3)
        self.jump = m - self.block + 1
        self.shifts: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple]]] = {}
        for words, items in strings.items():
            for end in range(self.block, m + 1):
                b = words[end - self.block : end]
                self.shifts[b] = min(self.shifts.get(b, self.jump), m - end)
            by_prefix = self.buckets.setdefault(words[-self.block :], {})
            by_prefix.setdefault(words[: self.block], []).append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str | None]]]:
        """(first word, items) of each occurrence."""
        m, block, jump, shift, n = self.m, self.block, self.jump, self.shifts.get, len(words)
        end = m
        while end <= n:
            suffix = tuple(words[end - block : end])
            step = shift(suffix, jump)
            if step:
                end += step
                continue
            first = end - m
            for string, items in self.buckets[suffix].get(tuple(words[first : first + block]), ()):
                if words[first:end] == string:
                    yield first, items
            end += 1


def build_tables(rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[ShiftTable]:
    """One table per length of string in these items."""
    strings: dict[int, dict[tuple[bytes, ...], set[str | None]]] = {}
    for item, text in rows:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            strings.setdefault(size, {}).setdefault(tuple(words[at : at + size]), set()).add(item)
    return [ShiftTable(m, s) for m, s in sorted(strings.items())]


def find_overlaps(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
    window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``doc`` (struct of ``keep``, or of all columns), ``n_words``, ``spans`` (hit words, end exclusive), ``item_ids`` (sorted), ``longest``, ``alone``.

    ``longest`` is the number of words of the longest string that occurs, 0 if none does; ``alone`` whether some string is all the words of a line.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), whole_text(F.col(f"`{item_text}`")).alias("text")).distinct()
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    columns = docs.columns if keep is None else keep
    doc = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")
    none = "array<struct<start: int, end: int>>"
    df = docs.select(
        doc, whole_text(F.col(f"`{text}`")).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(none).alias("spans"), F.array().cast("array<string>").alias("item_ids"), F.lit(0).alias("longest"), F.lit(False).alias("alone"),
    )
    schema = df.schema
    for chunk in range(chunks):
        part = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == chunk)
        tables = spark.sparkContext.broadcast(build_tables([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], window))

        def search(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield _searched(batch.slice(at, 256), tables.value)

        df = map_arrow(df, search, schema)
        if chunk < chunks - 1:
            df = stored(df, "overlaps")
    return df.drop("text")


def _lines_of(text: bytes) -> set[tuple[int, int]]:
    """First word and end of each line that has words."""
    out, at = set(), 0
    for line in text.split(b"\n"):
        n = len(words_of(line))
        if n:
            out.add((at, at + n))
        at += n
    return out


def _searched(batch: pa.RecordBatch, tables: list[ShiftTable]) -> pa.RecordBatch:
    counts, spans, items, longest, lone = [], [], [], [], []
    for text, old, names, most, alone in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6)), strict=True):
        words, names = words_of(text), set(names)
        new = []
        for table in tables:
            for first, which in table.search(words):
                new.append((first, first + table.m))
                names.update(which)
                most = max(most, table.m)
        merged: list[dict] = []
        for start, end in sorted([*((s["start"], s["end"]) for s in old), *new]):
            if merged and start <= merged[-1]["end"]:
                merged[-1]["end"] = max(end, merged[-1]["end"])
            else:
                merged.append({"start": start, "end": end})
        counts.append(len(words))
        spans.append(merged)
        items.append(sorted(x for x in names if x is not None))
        longest.append(most)
        lone.append(alone or bool(new and not _lines_of(text).isdisjoint(new)))
    made = [pa.array(c, batch.schema.field(i).type) for i, c in ((2, counts), (3, spans), (4, items), (5, longest), (6, lone))]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=batch.schema)


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", least_words: int = 5, **options) -> DataFrame:
    """Documents without benchmark text, with their own columns.

    A document goes if a string of ``least_words`` or more occurs in it, or a shorter item is all the words of one of its
    lines. Elsewhere a few common words in a row are no evidence that an item was leaked; ``find_overlaps`` names them.
    """
    return find_overlaps(docs, items, text, **options).where((F.col("longest") < least_words) & ~F.col("alone")).select("doc.*")
