"""Robots files as a table of rules, and the gate that applies them to URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import percent_decode, strip
from pagemill.functions.urls import site_root, url_fragment, url_netloc, url_path, url_query
from pagemill.operators.joins import lookup

USER_AGENT = "Mozilla/5.0"


def _tidy(path: Column) -> Column:
    """Drop an empty query or fragment mark, as taking a URL apart and joining it again does."""
    return F.regexp_replace(F.regexp_replace(path, r"\?(?=#|$)", ""), "#$", "")


def robots_lines(files: DataFrame) -> DataFrame:
    """(site_root, line_no, field, value) of files that answered with 200; blank lines kept."""
    lines = files.where(F.col("http_status") == 200).select(
        "site_root", F.posexplode(F.split("body", "\r\n|\r|\n")).alias("line_no", "raw")
    )
    text = strip(F.regexp_replace("raw", "#.*$", ""))
    has_colon = F.contains(text, F.lit(":"))
    return lines.select(
        "site_root", "line_no", (F.col("raw") == "").alias("blank"),
        F.when(has_colon, F.lower(strip(F.substring_index(text, ":", 1)))).alias("field"),
        F.when(has_colon, percent_decode(strip(F.regexp_replace(text, "^[^:]*:", "")))).alias("value"),
    )


def robots_rules(files: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """One row per site: ordered rules that apply to the agent, and its crawl delay.

    A group is a run of agent lines with the rules after it. A blank line ends a group
    (a run of agent lines without rules is dropped by it). The first group that names the agent counts, and the
    first group that names ``*`` only if there is none. One robots file is one window.
    """
    in_file = Window.partitionBy("site_root").orderBy("line_no")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_file.rowsBetween(Window.unboundedPreceding, 0)
    kind = (
        F.when(F.col("blank"), "blank").when(F.col("field") == "user-agent", "agent")
        .when(F.col("field").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    marked = robots_lines(files).withColumn("kind", kind).where(F.col("kind").isNotNull())
    starts = (F.col("kind") == "agent") & (F.coalesce(F.last("kind").over(before), F.lit("blank")) != "agent")
    grouped = marked.withColumn("starts", starts).withColumn(
        "group_no", F.sum(F.col("starts").cast("int")).over(so_far)
    )
    # Lines after a blank one belong to no group until the next agent line.
    in_group = Window.partitionBy("site_root", "group_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    live = grouped.withColumn("ended", F.max((F.col("kind") == "blank").cast("int")).over(in_group)).where(
        (F.col("ended") == 0) & (F.col("group_no") > 0)
    )
    agent = user_agent.split("/")[0].lower()
    is_agent = F.col("kind") == "agent"
    is_path = F.col("field").isin("allow", "disallow")
    rule = F.struct(
        F.col("line_no"),
        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        _tidy(F.col("value")).alias("path"),
    )
    groups = live.groupBy("site_root", "group_no").agg(
        F.max(is_agent & (F.col("value") == "*")).alias("any_agent"),
        F.max(is_agent & F.contains(F.lit(agent), F.lower("value"))).alias("named"),
        F.max(F.col("kind") == "rule").alias("has_rules"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == "rule") & is_path, rule))).alias("rules"),
        F.max_by(
            F.when(F.rlike("value", F.lit(r"^\d+$")), F.col("value").cast("double")),
            F.when((F.col("field") == "crawl-delay") & F.rlike("value", F.lit(r"^\d+$")), F.col("line_no")),
        ).alias("crawl_delay"),
    ).where("has_rules AND (any_agent OR named)")
    order = F.struct(F.col("any_agent"), F.col("group_no"))
    return groups.groupBy("site_root").agg(
        F.min_by(F.struct("rules", "crawl_delay"), order).alias("_g")
    ).select("site_root", "_g.rules", "_g.crawl_delay")


def request_path(url: Column) -> Column:
    """Path, query and fragment of the percent-decoded URL, the text rules are matched with."""
    plain = percent_decode(url)
    query, fragment = url_query(plain), url_fragment(plain)
    joined = F.concat(
        url_path(plain), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(joined == "", "/").otherwise(joined)


def rule_index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site_root, lengths) and (site_root, prefix, line_no, allow): the lengths of a site's rules, and the first line of each path."""
    lines = rules.select("site_root", F.explode("rules").alias("_r")).select("site_root", F.col("_r.path").alias("prefix"), "_r.line_no", "_r.allow")
    first = lines.groupBy("site_root", "prefix").agg(F.min(F.struct("line_no", "allow")).alias("_f")).select("site_root", "prefix", "_f.line_no", "_f.allow")
    return first.groupBy("site_root").agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths")), first


def robots_gate(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``: the first matching rule of the site decides, no rule allows.

    A URL meets the rules by its own prefixes, of the lengths that rules of its site have, in an equi-join; the least line number
    decides. So a URL costs as many lookups as there are lengths, however many rules its site has. Paths that
    several URLs share are looked up once.
    """
    lengths, lines = rule_index(rules)
    asked = urls.withColumn("site_root", site_root(F.col(url))).withColumn("_path", request_path(F.col(url)))
    # A lone * was never a wildcard here: rules are compared as percent-encoded text.
    paths = lookup(asked.select("site_root", "_path").distinct(), lengths, "site_root").where("lengths IS NOT NULL")
    own = F.transform(F.filter("lengths", lambda n: n <= F.length("_path")), lambda n: F.substring("_path", F.lit(1), n))
    met = paths.select("site_root", "_path", F.explode(own).alias("prefix")).join(lines, ["site_root", "prefix"])
    first = met.groupBy("site_root", "_path").agg(F.min(F.struct("line_no", "allow")).alias("_hit"))
    joined = asked.join(first, ["site_root", "_path"], "left")
    return joined.withColumn("allowed", F.coalesce(F.col("_hit.allow"), F.lit(True))).select(*urls.columns, "allowed")
