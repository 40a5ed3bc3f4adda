"""Job counters, progress, and the states of URLs and jobs, derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.fetches import MAX_RETRIES, UNKNOWN_ERROR

# States of jobs and URLs.
JOB_STATES = ["pending", "discovering", "crawling", "completed", "failed", "paused", "cancelled"]
URL_STATES = [
    "discovered", "queued", "processing", "success", "partial", "failed", "permanently_failed", "skipped", "duplicate",
]
PENDING_STATES = ["queued", "failed"]
RESUMABLE_STATES = ["paused", "failed"]
CANCELLABLE_STATES = ["pending", "discovering", "crawling", "paused"]


def url_counts(urls: DataFrame) -> DataFrame:
    """Per job: URLs found, article candidates, and URLs still to do."""
    return urls.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("urls_discovered"),
        F.count_if("is_candidate").alias("blogs_identified"),
        F.count_if(F.col("status").isin(PENDING_STATES)).alias("pending"),
    )


def article_counts(articles: DataFrame) -> DataFrame:
    """Per job: articles, words, and the URL extracted last."""
    return articles.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("blogs_successful"),
        F.sum("word_count").alias("total_words_extracted"),
        F.max_by("raw_url", F.struct("extraction_date", "raw_url")).alias("current_url"),
    )


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("job_id").agg(F.count(F.lit(1)).alias("blogs_failed"))


def progress_columns(identified: Column, processed: Column) -> tuple[Column, Column]:
    """Articles left, and percent done to one digit (ties go to the even digit)."""
    remaining = F.greatest(identified - processed, F.lit(0))
    percent = F.when(identified > 0, F.bround(processed / identified * 100, 1)).otherwise(0.0)
    return remaining.alias("remaining"), percent.alias("progress_percent")


def job_progress(jobs: DataFrame, urls: DataFrame, articles: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per job with exact counters. Each table is aggregated before it is joined."""
    joined = (
        jobs.join(url_counts(urls), "job_id", "left").join(article_counts(articles), "job_id", "left")
        .join(failure_counts(failures), "job_id", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counted = joined.select(
        *jobs.columns, zero("urls_discovered"), zero("blogs_identified"), zero("pending"), zero("blogs_successful"),
        zero("blogs_failed"), zero("total_words_extracted"), "current_url",
    ).withColumn("blogs_processed", F.col("blogs_successful") + F.col("blogs_failed"))
    return counted.select("*", *progress_columns(F.col("blogs_identified"), F.col("blogs_processed")))


def url_status_after_fetch(has_html: Column, is_candidate: Column, quality_ok: Column, retry_count: Column,
                           max_retries: int = MAX_RETRIES) -> Column:
    """State of a URL after an attempt; ``retry_count`` is the count before it."""
    return (
        F.when(~has_html, F.when(retry_count < max_retries, "failed").otherwise("permanently_failed"))
        .when(~is_candidate, "skipped").when(quality_ok, "success").otherwise("partial")
    )


def url_status_from_log(urls: DataFrame, failures: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Retry counter and state of URLs that failed, from the append-only failure log."""
    counts = failures.groupBy("job_id", F.col("url").alias("raw_url")).agg(F.count(F.lit(1)).alias("_fails"))
    joined = urls.join(counts, ["job_id", "raw_url"], "left")
    fails = F.coalesce("_fails", F.lit(0))
    state = F.when(
        F.col("status").isin(PENDING_STATES) & (fails > 0), F.when(fails <= max_retries, "failed").otherwise("permanently_failed")
    ).otherwise(F.col("status"))
    return joined.select(*[c for c in urls.columns if c not in ("status", "retry_count")], state.alias("status"),
                         fails.cast("int").alias("retry_count"))


def job_status_after_run(pending: Column, failed: Column) -> Column:
    """State of a job after a run: failed on an error, paused while URLs are left."""
    return F.when(failed, "failed").when(pending > 0, "paused").otherwise("completed")


def resume_jobs(jobs: DataFrame) -> DataFrame:
    """Paused and failed jobs become pending again and lose their error."""
    can = F.col("status").isin(RESUMABLE_STATES)
    return jobs.withColumn("error_message", F.when(~can, F.col("error_message"))).withColumn(
        "status", F.when(can, "pending").otherwise(F.col("status"))
    )


def cancel_jobs(jobs: DataFrame) -> DataFrame:
    can = F.col("status").isin(CANCELLABLE_STATES)
    return jobs.withColumn("status", F.when(can, "cancelled").otherwise(F.col("status")))


def exports_ready(status: Column, export_path: Column) -> Column:
    return F.coalesce((status == "completed") & (export_path != ""), F.lit(False))


def pending_urls(urls: DataFrame) -> DataFrame:
    return urls.where(F.col("status").isin(PENDING_STATES))


def failure_rows(fetches: DataFrame) -> DataFrame:
    """Failure-log rows of fetches without HTML; ``retry_count`` counts this attempt."""
    lost = fetches.where(F.coalesce(F.col("html") == "", F.lit(True)))
    return lost.select(
        "job_id", "url", F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit(UNKNOWN_ERROR)).alias("error"),
        "http_status", (F.col("retry_count") + 1).alias("retry_count"), F.col("fetched_at").alias("timestamp"),
    )


def config_snapshot(concurrency: Column, delay: Column, max_urls: Column) -> Column:
    """Map of the settings a job was started with; zero counts and missing values are left out."""
    given = F.create_map(
        F.lit("max_concurrent_requests"), F.when(concurrency != 0, concurrency.cast("double")),
        F.lit("request_delay_seconds"), delay.cast("double"),
        F.lit("max_urls"), F.when(max_urls != 0, max_urls.cast("double")),
    )
    return F.map_filter(given, lambda k, v: v.isNotNull())
