"""Incremental runs with Structured Streaming: extract once, run and resume, dedup across runs, live counts.

Every batch is one commit to a ``Store`` under a name made of the stream's and the batch's number. A batch that Spark runs
again after a loss finds its commit and does nothing, or finds none and writes anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions.urls import normalize_url
from pagemill.plans.batch_run import run_batch, urls_to_do
from pagemill.plans.commits import KeyIndex, Store
from pagemill.plans.extraction import extract_articles


def read_page_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _each_batch(rows: DataFrame, write: Callable[[DataFrame, int], object], checkpoint: str) -> StreamingQuery:
    """Hand every new batch to ``write`` and stop."""
    return (
        rows.writeStream.foreachBatch(lambda batch, n: write(batch, n) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def extract_new_pages(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extract every page that was not extracted before and stop.

    Each batch writes its own folder and overwrites it when the batch is run again, so a
    lost executor or a restart never doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        extract_articles(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _each_batch(pages, write, checkpoint)


def run_new_attempts(attempts: DataFrame, urls: DataFrame, rules: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Run the URLs that new fetch attempts speak of: articles, failures, states and counters, one commit a batch.

    ``urls`` and ``rules`` are tables; a URL that ended in an earlier batch is not run again.
    """

    def write(batch: DataFrame, batch_id: int) -> bool:
        tried = batch.select(F.col("url").alias("raw_url")).distinct()
        return run_batch(store, f"attempts-{batch_id}", urls_to_do(store, urls).join(tried, "raw_url", "left_semi"), batch, rules)

    return _each_batch(attempts, write, checkpoint)


def append_distinct(urls: DataFrame, store: Store, checkpoint: str, url: str = "url") -> StreamingQuery:
    """Store the first row per (job_id, normalized_url) over all runs in the table ``urls``.

    The stored keys say what is known, so none is kept in stream state, and a batch reads only the buckets it touches.
    """

    def write(batch: DataFrame, batch_id: int) -> bool:
        keyed = batch.withColumn("normalized_url", normalize_url(F.col(url)))
        return KeyIndex(store, "urls", ["job_id", "normalized_url"]).append(f"urls-{batch_id}", keyed, [url])

    return _each_batch(urls, write, checkpoint)


def live_counts(urls: DataFrame) -> DataFrame:
    """Counters per job."""
    return urls.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("urls_discovered"), F.count_if("is_candidate").alias("blogs_identified")
    )


def publish_counts(urls: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Add what each batch counts to the table ``live_counts``; counters are not kept in stream state."""
    return _each_batch(urls, lambda batch, n: store.add(f"counts-{n}", {"live_counts": live_counts(batch)}), checkpoint)


def read_counts(store: Store) -> DataFrame:
    """The counters of all committed batches. Reads between any two commits see whole batches."""
    counts = store.read("live_counts", "job_id string, urls_discovered long, blogs_identified long")
    return counts.groupBy("job_id").agg(F.sum("urls_discovered").alias("urls_discovered"), F.sum("blogs_identified").alias("blogs_identified"))


def compact_counts(store: Store, name: str) -> bool:
    """Replace the parts counted so far by one; a reader sees the old parts or the new one."""
    parts = store.parts("live_counts")
    return store.commit(name, {"live_counts": store.write_part("live_counts", read_counts(store))}, {"live_counts": parts}) if parts else False
