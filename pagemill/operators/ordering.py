"""First-wins dedup and ordered numbering that no single task has to carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one that sorts first by ``order`` (which must be unique in a key).

    A partial aggregate keeps one row per key in every map task before anything is
    shuffled, so a key that holds a third of all rows costs no more than any other.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.select(*keys, rank.alias("_rank"), F.struct(*others).alias("_row"))
    return (
        picked.groupBy(*keys).agg(F.min_by("_row", "_rank").alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)
    )


def number_rows(
    df: DataFrame, order: list[str], name: str, by: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Number rows from 1 by ``order`` (within each ``by`` group), in parallel.

    Rows are range-partitioned by (group, order), so even one huge group is spread over
    all tasks. Row positions inside a partition plus the row counts of the partitions before
    it give the number. The sorted rows are checkpointed, since both passes must see the
    same partition bounds.
    """
    by = by or []
    sort_keys = [*by, *order]
    # Without a number given, adaptive execution merges small neighbouring ranges, which leaves them in order.
    ranged = df.repartitionByRange(partitions, *sort_keys) if partitions else df.repartitionByRange(*sort_keys)
    placed = ranged.sortWithinPartitions(*sort_keys).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    # One row per (group, partition): few, whatever the number of rows.
    sizes = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = {key: f"_by{i}" for i, key in enumerate(by)}
    offsets = sizes.select(
        F.col("_part").alias("_at"), *[F.col(k).alias(v) for k, v in keys.items()], "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    match = F.col("_part") == F.col("_at")
    for key, twin in keys.items():
        match = match & F.col(key).eqNullSafe(F.col(twin))
    number = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return placed.join(offsets, match).select(*df.columns, number.alias(name))


def frontier_batches(pending: DataFrame, order: list[str], concurrency: int = 20, by: list[str] | None = None) -> DataFrame:
    """Batch number of every pending row: batches of four times the concurrency."""
    numbered = number_rows(pending, order, "_n", by)
    return numbered.withColumn("batch_id", F.floor((F.col("_n") - 1) / (4 * concurrency)).cast("bigint")).drop("_n")


def page_of_rows(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of results; ``order`` should end in a unique column so pages never overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def write_numbered(df: DataFrame, order: list[str], path: str, rows_per_part: int = 100_000) -> None:
    """Store rows sorted by ``order`` and numbered (``row_no``), in folders of ``rows_per_part`` rows each, for paging."""
    numbered = number_rows(df, order, "row_no")
    part = F.floor((F.col("row_no") - 1) / rows_per_part).cast("long")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.withColumn("part", part).repartitionByRange(n, "part").sortWithinPartitions("part", "row_no")
    dealt.write.mode("overwrite").partitionBy("part").parquet(path)


def stored_page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0, rows_per_part: int = 100_000) -> DataFrame:
    """A page of rows that ``write_numbered`` stored. Row numbers tell the folders it lies in, so only those are read."""
    first, last = offset // rows_per_part, (offset + max(limit, 1) - 1) // rows_per_part
    rows = spark.read.parquet(path).where(F.col("part").between(first, last))
    return rows.where((F.col("row_no") > offset) & (F.col("row_no") <= offset + limit)).orderBy("row_no")
