"""URL filtering by hashed host-suffix and path-prefix expressions.

A rule is a host and the begin of a path; it fits its host and all subdomains. A URL is expanded into
expressions, host suffix + path prefix, cut where a rule can end: the host before any of its labels, the path after any
of its slashes, plus as many characters as rules have after their last slash (``tails``). Only suffixes and prefixes as short
as the longest of any rule are made, so a long URL costs no more than the rules can ask for.

Expressions meet rules by a short prefix of their SHA-256 in an equi-join; the whole digest confirms a hit, since
short prefixes collide. Before the join every expression is reduced to one row, so that a host or URL with a third of all rows
sends one row a task. Of the rules that fit, the longest text wins, then the longest host, then ``block``. Without a rule the
verdict is ``default``.

Rules are one row for each host and path; the join is left to Spark, which broadcasts them if their measured size
allows and else shuffles both sides.

Cases: a NULL URL or one without ``://`` has empty host and path and no rule fits; only A-Z are lower-cased, in hosts;
ports and users are part of the host; repeated rows each get their verdict; very long URLs are judged whole; an empty table
of URLs gives an empty result and one of rules the default; other columns stay in ``page``, whatever their names; rules with a
NULL or empty host or a path that does not begin with a slash fit nothing, and a NULL path counts as ``/``; a rule given twice
blocks if either does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, UPPER, packed, stored

SHORT = 8  # hex digits of the short prefix


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next slash, question mark or number sign; A-Z lower-cased. '' where there is none."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*+", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next question mark or number sign."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*+([^?#]*+)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``rule, host_chars, verdict, tail, short, digest`` from ``host, path, verdict``, one row per host and path."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit("/"))
    once = rules.select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").alias("block")).where(
        (F.col("host") != "") & F.startswith("path", F.lit("/"))).groupBy("host", "path").agg(F.max("block").alias("block"))
    rule, digest = F.concat("host", "path"), F.sha2(F.concat("host", "path"), 256)
    return once.select(
        rule.alias("rule"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"), F.when(F.col("block"), "block").otherwise("allow").alias("verdict"),
        F.length(F.substring_index("path", "/", -1)).alias("tail"), F.size(F.split("host", r"\.")).alias("labels"),
        F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"),
    )


def _suffixes(host: Column, labels: int) -> Column:
    """The host and what follows each of its dots, of at most ``labels`` labels."""
    parts = F.split(host, r"\.")
    least = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(least, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _prefixes(path: Column, longest: int, tails: list[int]) -> Column:
    """Prefixes of at most ``longest`` characters that end at a slash or ``tails`` characters after one, before the next."""
    begin = F.substring(path, 1, longest)
    pieces = F.split(begin, "/")
    # The piece after the k-th slash begins where the first k pieces and their slashes end.
    def at_slash(k: Column) -> Column:
        upto = F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, p: n + F.length(p) + 1)
        room = F.length(F.element_at(pieces, k + 1))
        lengths = F.filter(F.array(*[F.lit(t) for t in tails]), lambda t: t <= room)
        return F.transform(lengths, lambda t: F.substring(begin, F.lit(1), upto + t))

    return F.when(F.startswith(path, F.lit("/")), F.flatten(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), at_slash))).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``page`` (all columns), ``host, path, rule, verdict`` for each row."""
    known = stored(prepared_rules(rules), "url-rules")
    reach = known.agg(F.max("labels").alias("labels"), F.max("path_chars").alias("longest"), F.sort_array(F.collect_set("tail")).alias("tails")).first()
    address = F.col(f"page.`{url}`")
    split = packed(pages).withColumnRenamed("doc", "page").select("page", host_of(address).alias("host"), path_of(address).alias("path"))
    if reach["labels"] is None:
        return split.select("page", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # What rules can tell apart of a URL: the labels at the end of its host and the begin of its path.
    seen_host = F.substring_index("host", ".", -reach["labels"])
    asked = split.select("page", "host", "path", seen_host.alias("asked_host"), F.substring("path", 1, reach["longest"]).alias("asked_path"))
    distinct = asked.select("asked_host", "asked_path").distinct()
    expanded = distinct.select(
        "asked_host", "asked_path", F.explode(_suffixes(F.col("asked_host"), reach["labels"])).alias("suffix"))
    expanded = expanded.select(
        "asked_host", "asked_path", "suffix", F.explode(_prefixes(F.col("asked_path"), reach["longest"], reach["tails"])).alias("prefix"))
    digest = F.sha2(F.concat("suffix", "prefix"), 256)
    hashed = expanded.select("asked_host", "asked_path", digest.alias("own_digest"), F.substring(digest, 1, SHORT).alias("short"))
    hits = hashed.join(known.select("short", "digest", "rule", "host_chars", "verdict"), "short").where("own_digest = digest")
    order = F.struct(F.length("rule"), "host_chars", (F.col("verdict") == "block").alias("block"))
    best = hits.groupBy("asked_host", "asked_path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    judged = asked.join(best, ["asked_host", "asked_path"], "left")
    return judged.select("page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
