"""Packing by power-of-two decomposition.

A document of n ids (its end id included) is cut into n // L pieces of the full length L and, for the
rest, one piece for each binary digit of it, longest first. Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding. Pieces of one length form a bucket, from which
batches of equal length are drawn; ``write_buckets`` lays the buckets out in folders.

Tasks encode their own documents and number their own sequences (partition number in the high bits,
count in the low ones): nothing is shuffled, and a lost task repeats with the same numbers, since the
partitions of a scan are fixed by its files.

Cases: a NULL or empty text is the end id alone, one piece of length 1; repeated rows are packed each;
a document may be of any length (ids are made a stretch at a time); an empty table gives no pieces;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, whole_text
from pagemill.llm.tokens import Encoder

MAX_LENGTH, END_ID = 2048, 1
SCHEMA = "doc_id {id}, start long, length long, bucket int, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; ``max_length`` is a power of two."""
    full, rest = divmod(n, max_length)
    out = [(i * max_length, max_length) for i in range(full)]
    at = full * max_length
    for bit in range(max_length.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", max_length: int = MAX_LENGTH, end_id: int = END_ID
) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and the length bucket it belongs to."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    end = end_id.to_bytes(4, "little")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole_text(F.col(f"`{text}`")).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder.of(spec.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for i, ids in enumerate(encoder.encode(texts.slice(at, 256).to_pylist()), at):
                    ids += end
                    total = len(ids) // 4
                    for start, length in cuts(total, max_length):
                        rows.append((i, start, length, length.bit_length() - 1, ids[4 * start : 4 * (start + length)], total, sequence, 0))
                        sequence += 1
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                made = [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]
                names = ["doc_id", "start", "length", "bucket", "ids", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *made], names)

    return map_arrow(source, pieces, SCHEMA.format(id=dict(source.dtypes)["doc_id"]))


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Payloads in one folder per length, so that a reader draws equal lengths."""
    pieces.select("bucket", "sequence_id", "doc_id", "start", "ids").write.partitionBy("bucket").parquet(folder)
