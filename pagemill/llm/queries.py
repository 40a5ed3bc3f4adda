"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pagemill.llm import (
    decontam, hard_negatives, html_mincut, langid, line_dedup, minhash, oracle, packing, quality, secrets, spelling, token_files, toxicity, url_filter,
)
from pagemill.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out)
    model = langid.fit(langid.training_sample(train, "text", "lang", F.col("doc_id")))
    found = langid.label_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return found.select("doc.doc_id", "doc.held_out", "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_mincut.extract_text(pages, keep=["page_id", "url"])
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontam.find_overlaps(_documents(spark, sf_dir), items, keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    store = token_files.write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    got = store.read(docs.select(token_files.key_of("doc_id").alias("key")))
    return got.select(F.col("key").try_cast("long").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_documents(spark, sf_dir), size=3, percent=85)
    doc_id = F.when(F.col("d") != minhash.HIGHEST, F.col("d"))
    same = F.coalesce(doc_id == F.col("component_id"), doc_id.isNull() & F.col("component_id").isNull())
    return found.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", same.alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = quality.with_votes(_documents(spark, sf_dir))
    narrow = stored(votes.select("doc.doc_id", "stats", "votes", "base_failed"), "votes")
    base = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(narrow, quality.fit_votes(narrow.where(~F.col("base_failed")))).select("doc_id", *base, "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    base = [r.kind for r in secrets.RULES[:3]]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc.doc_id", *[count(k) for k in base], F.sha2(secrets.as_text(of_base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spelling.count_words(_documents(spark, sf_dir), doc_id="doc_id", slips=97))


# Host, path and verdict of the rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared_rows(table(spark, sf_dir, "embeddings"), vec_id, F.col("embedding"), label)
    return hard_negatives.mine_negatives(rows, vec_id % 50 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_language_id, op3_html_extraction, op4_decontamination, op5_token_files, op6_near_dedup, op7_line_dedup, op8_toxicity,
        op9_quality_rules, op10_secret_scan, op11_spelling, op12_url_filter, op13_hard_negatives,
    )
}
ORACLE: dict[str, str] = {
    "op4_decontamination": oracle.DECONTAMINATION, "op6_near_dedup": oracle.NEAR_DEDUP, "op7_line_dedup": oracle.LINE_DEDUP,
    "op9_quality_rules": oracle.quality_sql(), "op10_secret_scan": oracle.secrets_sql(),
    "op11_spelling": oracle.SPELLING, "op12_url_filter": oracle.url_filter_sql(URL_RULES), "op13_hard_negatives": oracle.HARD_NEGATIVES,
}
