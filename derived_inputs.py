"""Inputs the given tables lack, derived from them by Spark: article pages with metadata,
sitemap files, index pages, feeds, robots files, fetch attempts, addresses and jobs.

Everything grows with the tables, and no derived row gathers more than 1000 source rows:
sites are customers, and their files form a tree over the digits of the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"
FANOUT = 1000
TOP_LEVEL = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly: a given table is one row group, which one task would read and parse."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, url, html): documents as article pages with every kind of block and metadata.

    The language decides the shape of the JSON-LD: object, list, graph or plain meta tags.
    """
    docs = dealt(table(spark, sf_dir, "documents"))
    paras = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    title = F.concat(F.lit("Report "), F.col("doc_id"), F.lit(" of "), F.col("source"))
    author_url = F.concat(F.lit("https://example.com/authors/"), F.col("source"))
    base = {"headline": title, "datePublished": F.lit("2026-01-05"), "articleSection": F.col("lang")}

    def ld(types: Column, **more: Column) -> Column:
        fields = [types.alias("@type")] + [c.alias(k) for k, c in {**base, **more}.items()]
        return F.struct(*fields)

    person = F.struct(F.col("source").alias("name"), author_url.alias("url"))
    as_object = F.to_json(ld(F.lit("BlogPosting"), author=person, keywords=F.concat(F.col("lang"), F.lit(", "), F.col("source"))))
    as_list = F.to_json(F.array(ld(
        F.array(F.lit("Thing"), F.lit("NewsArticle")), author=F.array(person), keywords=F.array(F.col("source"), F.col("lang")),
        image=F.array(F.struct(F.concat(author_url, F.lit(".png")).alias("url"))),
    )))
    as_graph = F.to_json(F.struct(F.array(ld(F.lit("Article"), author=F.col("source"))).alias("@graph")))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    no_json = F.concat(
        F.lit('<script type="application/ld+json">{broken</script><meta property="article:published_time" content="2026-02-03">'
              '<meta name="author" content=" '), F.col("source"), F.lit(' "><meta property="article:section" content="'),
        F.col("lang"), F.lit('"><meta property="article:tag" content="a"><meta property="article:tag" content=" b ">'),
    )
    metadata = (
        F.when(F.col("lang") == "en", script(as_object)).when(F.col("lang") == "fr", script(as_list))
        .when(F.col("lang") == "de", script(as_graph)).otherwise(no_json)
    )
    parts = F.array_join(F.transform(paras, lambda p: F.concat(F.lit("<p>"), _escape(p), F.lit("<br>"))), "")
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit(" | Site</title>"
              '<meta name="description" content="About &quot;'), F.col("source"), F.lit('&quot;">'
              '<meta property="og:type" content="article"><meta property="og:image" content="/og.png">'
              '<link rel="canonical" href="https://example.com/blog/'), F.col("doc_id"), F.lit('">'), metadata,
        F.lit("</head><body><nav><ul><li><a href='/'>Home</a></ul></nav><header>Site header</header>"
              "<article class=post><header><p>Dateline</p></header><h1>"), title, F.lit("</h1>"), parts,
        F.lit("<h2>Facts <b>here</b></h2><ul><li>lang <b>"), F.col("lang"),
        F.lit("</b><li>nested<ol><li>one<li>two</ol></ul><blockquote><p>said "), F.col("source"),
        F.lit("</p></blockquote><table><tr><th>id<th>chars<tr><td>"), F.col("doc_id"), F.lit("<td>"), F.col("n_chars"),
        F.lit("</table><div class='x share-box'><p>Share this</div><h2>FAQ</h2><p>Why "), F.col("source"),
        F.lit("?</p><h3>Who?</h3><p>Nobody</p><h2>In Summary</h2><p>Done with "), F.col("doc_id"),
        F.lit("</p></article><aside>More</aside><footer>Foot</footer></body></html>"),
    )
    url = F.concat(F.lit("https://example.com/"), F.when(F.col("lang") == "es", "tag/").otherwise("docs/"), F.col("doc_id"))
    return docs.select("doc_id", url.alias("url"), html.alias("html"))


def site_of(cust: Column) -> Column:
    return F.concat(F.lit("c"), cust, F.lit(".example.com"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, base, root): one site per customer."""
    return table(spark, sf_dir, "customer").select(site_of(F.col("c_custkey")).alias("site")).select(
        "site", F.concat(F.lit("https://"), "site").alias("base"), F.col("site").alias("root")
    )


def _tree(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Per level: (site, node, entries) with at most 1000 entries; level 0 lists orders."""
    orders = table(spark, sf_dir, "orders").select(
        site_of(F.col("o_custkey")).alias("site"), F.col("o_orderkey").alias("key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    levels, below = [], orders
    for level in range(TOP_LEVEL + 1):
        below = below.withColumn("node", F.floor(F.col("key") / FANOUT).cast("bigint") if level < TOP_LEVEL else F.lit(0).cast("bigint"))
        nodes = below.groupBy("site", "node").agg(F.sort_array(F.collect_list(F.struct("key", "day"))).alias("entries"))
        levels.append(nodes)
        below = nodes.select("site", F.col("node").alias("key"), F.lit(None).cast("string").alias("day"))
    return levels


def _file_url(level: int, node: Column) -> Column:
    if level == TOP_LEVEL:
        return F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap.xml"))
    return F.concat(F.lit("https://"), F.col("site"), F.lit(f"/maps/{level}-"), node, F.lit(".xml"))


def _index_entry(level: int):
    return lambda e: F.concat(F.lit("<sitemap><loc>"), _file_url(level, e["key"]), F.lit("</loc></sitemap>"))


def _page_path(level: int, node: Column) -> Column:
    return F.concat(F.lit("/blog/page/"), F.lit(level * 10**12) + node)


def _page_link(level: int):
    return lambda e: F.concat(F.lit("<li><a href='"), _page_path(level, e["key"]), F.lit("'>x</a>"))


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, body): an index tree per customer over urlsets of orders. The root also names
    itself and a broken file, so the walk has a cycle and an error to pass."""
    made = []
    for level, nodes in enumerate(_tree(spark, sf_dir)):
        if level == 0:
            entry = lambda e: F.concat(
                F.lit("<url><loc> https://"), F.col("site"), F.lit("/blog/order-"), e["key"], F.lit("?a=1&amp;b=2 </loc><lastmod>"),
                e["day"], F.lit("</lastmod></url>"),
            )
            head, tail = f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{XMLNS}">', "<url><loc></loc></url></urlset>"
        else:
            entry = _index_entry(level - 1)
            head, tail = f'<sitemapindex xmlns="{XMLNS}">', "</sitemapindex>"
        more = F.lit("")
        if level == TOP_LEVEL:
            more = F.concat(F.lit("<sitemap><loc>"), _file_url(TOP_LEVEL, F.col("node")), F.lit("</loc></sitemap><sitemap><loc>https://"),
                            F.col("site"), F.lit("/sitemap_index.xml</loc></sitemap>"))
        body = F.concat(F.lit(head), F.array_join(F.transform("entries", entry), ""), more, F.lit(tail))
        made.append(nodes.select(_file_url(level, F.col("node")).alias("url"), body.alias("body")))
    broken = sites(spark, sf_dir).select(F.concat("base", F.lit("/sitemap_index.xml")).alias("url"), F.lit("not xml at all <<<").alias("body"))
    out = broken
    for m in made:
        out = out.unionByName(m)
    return out


def sitemap_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, http_status, content_type, content): the sitemap files as they come; the length of the name decides how.

    By its remainder by five: plain, packed and told so, packed but not told, plain but told to be packed, an error.
    """
    import gzip

    files = sitemap_files(spark, sf_dir).withColumn("kind", F.length("url") % 5)

    def packed(bodies):
        return bodies.map(lambda b: b if b is None else gzip.compress(bytes(b)))

    body = F.col("body").cast("binary")
    content = F.when(F.col("kind").isin(1, 2), F.pandas_udf(packed, "binary")(F.when(F.col("kind").isin(1, 2), body))).otherwise(body)
    return files.select(
        "url", F.when(F.col("kind") == 4, 500).otherwise(200).alias("http_status"),
        F.when(F.col("kind").isin(1, 3), "application/x-gzip").when(F.col("kind") == 0, "text/xml").alias("content_type"), content.alias("content"))


def write_nation_urlsets(spark: SparkSession, sf_dir: str, path: str) -> None:
    """One urlset file of all orders for each nation, written in the order of its lines. Every fifth one breaks off."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owned = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    entry = F.concat(F.lit("<url>\n <loc> https://n.example.com/blog/order-"), "o_orderkey", F.lit("?a=1&amp;b=2 </loc><lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    lines = owned.select(F.col("c_nationkey").alias("nation"), F.col("o_orderkey").alias("seq"), entry.alias("value"))
    nations = customer.select(F.col("c_nationkey").alias("nation")).distinct()
    head = nations.select("nation", F.lit(-1).cast("bigint").alias("seq"), F.lit(f'<?xml version="1.0"?><urlset xmlns="{XMLNS}">').alias("value"))
    tail = nations.where("nation % 5 <> 4").select("nation", F.lit(2**62).alias("seq"), F.lit("<url><loc/></url></urlset>").alias("value"))
    every = lines.unionByName(head).unionByName(tail)
    every.repartition("nation").sortWithinPartitions("nation", "seq").select("nation", "value").write.partitionBy("nation").text(path)


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, http_status, content_type, html): the same tree as HTML pages. Each page links
    back to the page above it, to another site, and to a mail address."""
    made = []
    for level, nodes in enumerate(_tree(spark, sf_dir)):
        if level == 0:
            link = lambda e: F.concat(F.lit("<li><a href='/blog/order-"), e["key"], F.lit("#top'>x</a>"))
        else:
            link = _page_link(level - 1)
        up_node = F.floor(F.col("node") / FANOUT).cast("bigint") if level + 1 < TOP_LEVEL else F.lit(0).cast("bigint")
        up = _page_path(level + 1, up_node) if level < TOP_LEVEL else F.lit("/blog/")
        html = F.concat(
            F.lit("<html><body><ul>"), F.array_join(F.transform("entries", link), ""), F.lit("</ul><a href='"), up,
            F.lit("'>up</a><a href='https://other.example.org/blog/x'>o</a><a href='mailto:a@b'>m</a><a>no</a><a href='/about'>a</a>"),
        )
        url = F.concat(F.lit("https://"), F.col("site"), _page_path(level, F.col("node")) if level < TOP_LEVEL else F.lit("/blog"))
        made.append(nodes.select(url.alias("url"), F.lit(200).alias("http_status"), F.lit("text/html; charset=utf-8").alias("content_type"), html.alias("html")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, body, page_id): one feed per page; feeds of plain http pages are cut off."""
    pages = table(spark, sf_dir, "pages")
    link = _escape(F.col("url"))
    whole = F.concat(
        F.lit("<rss><channel><title>t</title><link> "), link, F.lit(" </link><item><guid>g</guid><link>"), link,
        F.lit("/item</link></item><item><link href='x'/><atom:link xmlns:atom='http://www.w3.org/2005/Atom'>"), link,
        F.lit("/atom</atom:link></item></channel></rss>"),
    )
    return pages.select(
        "page_id", F.concat(F.lit("https://example.com/feed/"), "page_id").alias("url"),
        F.when(F.startswith("url", F.lit("http:")), F.replace(whole, F.lit("</channel></rss>"), F.lit("</channel>"))).otherwise(whole).alias("body"),
    )


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_root, http_status, body): the market segment of the customer decides the file."""
    bodies = {
        "BUILDING": "User-agent: *\nDisallow: /blog/order-1\nAllow: /blog/\n\nUser-agent: *\nDisallow: /\n",
        "AUTOMOBILE": "# hi\nUser-agent: other\nDisallow: /\n\nUser-agent: Mozilla\nUser-agent: x\nAllow: /blog/order-1\n"
                      "Disallow: /blog/order%2D\nCrawl-delay: 5\n\nUser-agent: *\nDisallow:\n",
        "MACHINERY": "User-agent: *\n\nDisallow: /\nUser-agent: *\nDisallow:\n",
        "HOUSEHOLD": "Disallow: /\nUser-Agent: *  # all\ndisallow: *\nDisallow: /blog/order-12?\nSitemap: /s.xml\nDisallow: /blog/order-2\n",
    }
    seg = F.col("c_mktsegment")
    body = F.lit("<html>gone</html>")
    for name, text in bodies.items():
        body = F.when(seg == name, text).otherwise(body)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://"), site_of(F.col("c_custkey"))).alias("site_root"),
        F.when(seg.isin(*bodies), 200).otherwise(404).alias("http_status"), body.alias("body"),
    )


def order_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, url, order_key): every order as a URL of its customer's job."""
    return dealt(table(spark, sf_dir, "orders")).select(
        F.concat(F.lit("job-"), "o_custkey").alias("job_id"),
        F.concat(F.lit("https://"), site_of(F.col("o_custkey")), F.lit("/blog/order-"), "o_orderkey").alias("url"),
        F.col("o_orderkey").alias("order_key"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, attempt, http_status, html, error): every line item as a fetch attempt of its order."""
    status = F.when(F.col("l_returnflag") == "N", 200).when(F.col("l_returnflag") == "R", 500).otherwise(0)
    turn = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), (F.row_number().over(turn) - 1).alias("attempt"), status.alias("http_status"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("<p>"), "l_partkey")).alias("html"),
        F.when(F.col("l_returnflag") == "A", F.when(F.col("l_partkey") % 2 == 0, "Timeout").otherwise("")).alias("error"),
    )


def literal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_key, url): line items give hosts of many kinds, from address literals to names."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    octet = lambda c: F.pmod(c, F.lit(256))
    v4 = F.concat_ws(".", octet(F.col("l_partkey")), octet(F.col("l_orderkey")), octet(F.col("l_suppkey")), octet(key))
    host = (
        F.when(F.col("l_returnflag") == "R", v4)
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("S"), "l_suppkey", F.lit(".Example.com:8080")))
        .when(F.col("l_linestatus") == "F", F.concat(F.lit("["), F.lower(F.hex(octet(F.col("l_partkey")) * 256)), F.lit("::"), octet(key), F.lit("]")))
        .otherwise(F.concat(F.lit("c"), "l_partkey", F.lit(".example.com")))
    )
    scheme = F.when(F.col("l_linenumber") == 7, "ftp").when(F.col("l_linenumber") > 3, "https").otherwise("http")
    return dealt(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(scheme, F.lit("://"), host, F.lit("/blog")).alias("url")
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, ip): suppliers with two addresses each, some of them private."""
    supplier = table(spark, sf_dir, "supplier")
    first = F.when(F.col("s_nationkey") < 5, "10.1.2.3").otherwise("93.184.216.34")
    second = F.when(F.col("s_nationkey") == 6, "fe80::1").when(F.col("s_nationkey") == 7, "::ffff:10.0.0.1").otherwise("2606:2800:220:1::1")
    return supplier.select(
        F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com")).alias("host"), F.explode(F.array(first, second)).alias("ip")
    )


def crawl_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """jobs (customers), urls (orders), articles and failures (line items)."""
    customer, orders, items = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    job = lambda c: F.concat(F.lit("job-"), c)
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    # Spark takes orders for as small as their packed file and may broadcast them through the driver.
    urls = order_urls(spark, sf_dir).join(orders.select(F.col("o_orderkey").alias("order_key"), "o_orderpriority", "o_orderstatus").hint("merge"), "order_key")
    urls = urls.select(
        "job_id", F.col("url").alias("raw_url"), "order_key", (F.col("o_orderpriority") != "5-LOW").alias("is_candidate"),
        status.alias("status"), F.lit(0).alias("retry_count"),
    )
    owned = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge"), "l_orderkey")
    url = F.concat(F.lit("https://"), site_of(F.col("o_custkey")), F.lit("/blog/order-"), "l_orderkey")
    return {
        "jobs": customer.select(job(F.col("c_custkey")).alias("job_id"),
                                F.when(F.col("c_nationkey") < 8, "paused").when(F.col("c_nationkey") < 16, "crawling").otherwise("completed").alias("status"),
                                F.when(F.col("c_acctbal") < 0, "boom").alias("error_message")),
        "urls": urls,
        "articles": owned.where("l_returnflag = 'N'").select(
            job(F.col("o_custkey")).alias("job_id"), url.alias("raw_url"), F.col("l_quantity").cast("bigint").alias("word_count"),
            F.col("l_shipdate").alias("extraction_date"),
        ),
        "failures": owned.where("l_returnflag = 'R'").select(
            job(F.col("o_custkey")).alias("job_id"), url.alias("url"), F.lit("HTTP 500").alias("error"), F.lit(500).alias("http_status"),
            F.col("l_linenumber").alias("retry_count"), F.col("l_shipdate").alias("timestamp"),
        ),
    }


def site_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, body): one feed per customer site."""
    body = F.concat(F.lit("<rss><channel><link>"), "base", F.lit("/blog/</link><item><link>https://news.example.org/"), "site",
                    F.lit("</link></item></channel></rss>"))
    return sites(spark, sf_dir).select(F.concat("base", F.lit("/rss.xml")).alias("url"), body.alias("body"))


def found_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, url, source, lastmod, rank, level, ord, pos): pages as discovered URLs of one job per language."""
    big = lambda c: c.cast("bigint")
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("job_id"), "url", F.lit("sitemap").alias("source"),
        F.lit(None).cast("string").alias("lastmod"), F.lit(0).alias("rank"), big(F.lit(0)).alias("level"),
        big(F.col("page_id")).alias("ord"), big(F.lit(0)).alias("pos"),
    )


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(network, kind): orders as IPv4 networks of many lengths, which nest, and IPv6 networks."""
    octet = lambda c: F.pmod(c, F.lit(256))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    v4 = F.concat_ws(".", octet(cust), octet(key), octet(key * 7), F.lit("0"))
    wide = F.concat(octet(cust), F.lit(".0.0.0/"), 8 + key % 9)
    narrow = F.concat(v4, F.lit("/"), 17 + key % 8)
    v6 = F.concat(F.lower(F.hex(octet(key) * 256)), F.lit("::/"), 16 + cust % 100)
    network = F.when(key % 3 == 0, wide).when(key % 3 == 1, narrow).otherwise(v6)
    return dealt(table(spark, sf_dir, "orders")).select(network.alias("network"), F.concat(F.lit("k"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("kind"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, ip): line items as addresses."""
    octet = lambda c: F.pmod(c, F.lit(256))
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    v4 = F.concat_ws(".", octet(F.col("l_partkey")), octet(F.col("l_orderkey")), octet(F.col("l_suppkey")), octet(key))
    v6 = F.concat(F.lower(F.hex(octet(F.col("l_partkey")) * 256)), F.lit("::"), octet(key))
    return dealt(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.when(F.col("l_linenumber") == 7, "no address").when(F.col("l_linenumber") % 2 == 0, v4).otherwise(v6).alias("ip"))
