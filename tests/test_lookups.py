"""Range joins, robots rules by prefix, exports by job, pages of stored rows, packed sitemap files."""

import gzip
import ipaddress
import random
import re

from pyspark.sql import functions as F

from pagemill.operators import ranges
from pagemill.operators.ordering import stored_page, write_numbered
from pagemill.operators.robots import robots_gate, robots_rules
from pagemill.plans import export
from pagemill.sources import sitemaps


def bits(ip):
    ip = ipaddress.ip_address(ip)
    return f"{int(ip):0{ip.max_prefixlen}b}"


def test_prefixes_cover_ranges_exactly(spark):
    rng = random.Random(1)
    pairs = [(a, b) for a in range(0, 64, 3) for b in range(64)] + [(0, 63), (5, 5)]
    rows = spark.createDataFrame([(f"{a:06b}", f"{b:06b}") for a, b in pairs], "lo string, hi string")
    for r in rows.withColumn("p", ranges.covering_prefixes(F.col("lo"), F.col("hi"))).collect():
        lo, hi = int(r.lo, 2), int(r.hi, 2)
        if lo > hi:
            assert r.p is None
            continue
        held = [x for p in r.p for x in range(64) if f"{x:06b}".startswith(p)]
        want = sum(1 for _ in ipaddress.summarize_address_range(ipaddress.ip_address(lo), ipaddress.ip_address(hi)))
        assert sorted(held) == list(range(lo, hi + 1)) and len(r.p) == want
    assert rng


def test_innermost_range_against_every_range(spark):
    rng = random.Random(2)
    nets = [f"{rng.choice([10, 11])}.{rng.randrange(4)}.{rng.randrange(256)}.0/{rng.randrange(6, 33)}" for _ in range(300)] + [f"2001:{rng.randrange(3):x}::/{rng.randrange(10, 129)}" for _ in range(40)]
    table = [(f"n{i:03}", ipaddress.ip_network(n, strict=False)) for i, n in enumerate(nets)]
    odd = [(bits("10.0.0.7"), bits("10.2.0.9"), "crossing"), (bits("11.0.0.9"), bits("11.0.0.3"), "turned"), (bits("1.1.1.1"), bits("::1"), "mixed"), (None, bits("::1"), "none")]
    rows = spark.createDataFrame([(bits(n[0]), bits(n[-1]), k) for k, n in table] + odd, "lo string, hi string, kind string").repartition(3)
    ips = [f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(200)] + [f"2001:{rng.randrange(3):x}::{rng.randrange(99):x}" for _ in range(50)] + ["10.0.0.7", "1.1.1.1", "x", "", None, "11.0.0.5"]
    found = ranges.innermost_range(spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "n int, ip string"), rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    spans = [(bits(n[0]), bits(n[-1]), k) for k, n in table] + odd[:1]
    for r in found.collect():
        try:
            own = bits(r.ip)
        except ValueError:
            own = None
        fits = [(lo, hi, k) for lo, hi, k in spans if own and len(lo) == len(own) and lo <= own <= hi]
        best = min(fits, key=lambda x: (-int(x[0], 2), x[1], x[2]), default=None)
        assert r.kind == (best and best[2]), r
    assert ranges.innermost_range(spark.createDataFrame([("10.0.0.1",)], "ip string"), rows.limit(0)).first().kind is None


def test_network_texts(spark):
    texts = ["10.0.0.0/8", "10.1.2.3", "::/0", "1.2.3.4/33", "x/3", "1.2.3.4/5/6", "fe80::1/64"]
    lo, hi = ranges.network_ends(F.col("n"))
    got = {r.n: (r.lo, r.hi) for r in spark.createDataFrame([(t,) for t in texts], "n string").select("n", lo.alias("lo"), hi.alias("hi")).collect()}
    for t in texts:
        try:
            net = ipaddress.ip_network(t, strict=False)
            assert got[t] == (bits(net[0]), bits(net[-1]))
        except ValueError:
            assert got[t] == (None, None)


def test_block_list_of_a_caller(spark):
    rows = spark.createDataFrame([(bits("9.0.0.0"), bits("9.255.255.255"), "ours")], "lo string, hi string, kind string")
    dns = spark.createDataFrame([("A.org", "9.1.1.1"), ("a.org", "8.8.8.8"), ("b.org", "8.8.8.8")], "host string, ip string")
    urls = spark.createDataFrame([(u,) for u in ("https://a.org/x", "https://b.org", "http://9.2.3.4:80/", "https://c.org", None)], "url string")
    got = {r.url: r.kind for r in ranges.with_blocking_range(urls, rows, dns).collect()}
    assert got == {"https://a.org/x": "ours", "https://b.org": None, "http://9.2.3.4:80/": "ours", "https://c.org": None, None: None}


def test_many_rules_of_one_site(spark):
    rng = random.Random(3)
    rules = [(rng.choice(["Allow", "Disallow"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 12)))) for _ in range(5000)] + [("Disallow", "")]
    body = "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rules)
    table = robots_rules(spark.createDataFrame([("https://r.org", 200, body), ("https://e.org", 200, "User-agent: *\nDisallow: /a\nAllow: /\n")], "site_root string, http_status int, body string"))
    paths = ["/" + "".join(rng.choice("abc/") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    urls = spark.createDataFrame([(f"https://r.org{p}",) for p in paths + paths[:5]] + [("https://e.org/ab",), ("https://e.org/b",), ("https://none.org/a",)], "url string")
    gated = robots_gate(urls, table)
    got = [(r.url, r.allowed) for r in gated.collect()]
    first = lambda p: next((k == "Allow" or q == "" for k, q in rules if p.startswith(q)), True)
    want = [(f"https://r.org{p}", first(p)) for p in paths + paths[:5]] + [("https://e.org/ab", False), ("https://e.org/b", True), ("https://none.org/a", True)]
    assert sorted(got) == sorted(want)


def test_exports_of_other_jobs_stay(spark, tmp_path):
    rows = [("j1", "u1", "e", 500, 1, "2026-01-01 00:00:02"), ("j1", "u2", "e\nf", 0, 2, "2026-01-01 00:00:01"), ("j2", "u3", 'say "x", y', 404, 1, "2026-01-01 00:00:00.5")]
    table = spark.createDataFrame(rows, "job_id string, url string, error string, http_status int, retry_count int, t string").withColumn("timestamp", F.to_timestamp("t"))
    folder = tmp_path / "out"
    export.write_job_failures(table, str(folder))
    files = {p.name: sorted(x.name for x in p.glob("part-*")) for p in folder.glob("export=*")}
    assert set(files) == {"export=j1_failed_urls", "export=j2_failed_urls"}
    export.write_job_failures(table.where("job_id = 'j1' and url = 'u2'"), str(folder))
    again = {p.name: sorted(x.name for x in p.glob("part-*")) for p in folder.glob("export=*")}
    assert again["export=j2_failed_urls"] == files["export=j2_failed_urls"] and again["export=j1_failed_urls"] != files["export=j1_failed_urls"]
    back = spark.read.csv(str(folder), header=True, escape='"', multiLine=True)
    assert sorted((r["export"], r.URL, r.Error, r.Timestamp) for r in back.collect()) == [
        ("j1_failed_urls", "u2", "e\nf", "2026-01-01T00:00:01"), ("j2_failed_urls", "u3", 'say "x", y', "2026-01-01T00:00:00.500000")]


def test_job_folders_hold_what_spark_writes_and_are_put_in_place_by_tasks(spark, tmp_path):
    odd = ["", None, " a ", 'say "x", y', "line\nbreak", "cr\r\nlf", "back\\slash", "#", "\u00fc\u2028", ","]
    jobs = ["j1", "a/b=c:d", "50% [x] {y}^", "", None, "\u00e9 \u00e8"]
    rows = [(j, u, e, 500 if i else None) for j in jobs for i, (u, e) in enumerate(zip(odd, odd[::-1]))]
    table = spark.createDataFrame(rows, "export string, url string, error string, http_status int")
    labels = {"url": "URL", "error": "Error", "http_status": "HTTP Status"}
    named = table.repartitionByRange(1, "export", "url").sortWithinPartitions("export", "url").select("export", *[F.col(c).alias(label) for c, label in labels.items()])
    named.write.partitionBy("export").csv(str(tmp_path / "spark"), header=True, escape='"', emptyValue="", encoding="UTF-8", lineSep="\n")
    calls = []
    kind, original = type(table), type(table).mapInArrow
    kind.mapInArrow = lambda self, run, *more, **options: calls.append(run.__name__) or original(self, run, *more, **options)
    try:
        for _ in range(2):
            export._write_folders(table, ["export", "url"], labels, str(tmp_path / "tasks"))
    finally:
        kind.mapInArrow = original
    content = lambda folder: {p.name: "".join(sorted(x.read_text(encoding="utf-8", newline="").removeprefix("URL,Error,HTTP Status\n") for x in p.glob("part-*"))) for p in folder.glob("export=*")}
    lines = lambda folder: {k: sorted(v.split("\n")) for k, v in content(folder).items()}
    assert lines(tmp_path / "tasks") == lines(tmp_path / "spark") and len(content(tmp_path / "tasks")) == 5
    assert calls == ["write", "replace"] * 2 and not list((tmp_path / "tasks").glob(".*"))


def test_job_folders_are_read_back_by_tasks(spark, tmp_path, monkeypatch):
    """What Spark's reader gives, without a list of files in the driver; files are read in pieces."""
    odd = ["", None, " a ", 'say "x", y', "line\nbreak", '"\n\n"', "cr\r\nlf", "cr\rlf", "back\\slash", "#", "\u00fc\u2028", ",", "'"]
    rows = [(j, u, e, 500 if i else None) for j in ["j1", "a/b=c:d", "50% [x] {y}^", "", None, "\u00e9 \u00e8"] for i, (u, e) in enumerate(zip(odd, odd[::-1]))]
    table = spark.createDataFrame(rows, "export string, url string, error string, http_status int")
    labels, folder = {"url": "URL", "error": "Error", "http_status": "HTTP Status"}, str(tmp_path / "out")
    export._write_folders(table, ["export", "url"], labels, folder)
    (tmp_path / "out" / ".staging-lost").mkdir()
    schema = ", ".join(f"`{c}` string" for c in [*labels.values(), "export"])
    want = spark.read.schema(schema).csv(folder, header=True, escape='"', multiLine=True)
    monkeypatch.setattr(export, "PIECE", 7)
    monkeypatch.setattr(export, "ROWS", 3)
    got = export.read_job_exports(spark, folder, labels)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(rows)
    assert not got.inputFiles() and "InMemoryFileIndex" not in got._jdf.queryExecution().toString()


def test_stored_pages_equal_offset_pages(spark, tmp_path):
    rows = spark.createDataFrame([(i * 37 % 101, f"v{i}") for i in range(101)], "k int, v string").repartition(4)
    path = str(tmp_path / "p")
    write_numbered(rows, ["k"], path, rows_per_part=10)
    want = [(r.k, r.v) for r in rows.orderBy("k").collect()]
    for limit, offset in ((7, 0), (10, 10), (10, 95), (25, 33), (5, 200)):
        page = stored_page(spark, path, limit, offset, rows_per_part=10)
        assert [(r.k, r.v) for r in page.collect()] == want[offset : offset + limit]
    one = stored_page(spark, path, 10, 30, rows_per_part=10)
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()


def test_packed_sitemap_responses(spark):
    body = b"<urlset>\xc3\xa9</urlset>"
    rows = [("a.xml", 200, "text/xml", body), ("b.xml.gz", 200, None, gzip.compress(body)), ("c.xml", 200, "application/x-gzip", gzip.compress(body)), ("d.xml.gz", 200, "text/xml", body),
            ("e.xml.gz", 200, None, gzip.compress(body)[:-9]), ("f.xml", 200, None, gzip.compress(body)), ("g.xml", 404, "text/xml", body), ("h.xml", 200, "gzip", None), ("i.xml", 200, "x", b"")]
    responses = spark.createDataFrame(rows, "url string, http_status int, content_type string, content binary")
    got = {r.url: r.body for r in sitemaps.response_bodies(responses).collect()}
    assert got == {u: body.decode() for u in ("a.xml", "b.xml.gz", "c.xml", "d.xml.gz")} | {"i.xml": ""}
    assert sitemaps.response_bodies(responses.limit(0)).count() == 0


def test_large_urlsets_in_splits(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    entry = lambda i: f"<url>\n<loc> https://e.com/{i} </loc><!-- x --><changefreq>daily</changefreq><lastmod>2026-01-0{i % 9 + 1}</lastmod></url>"
    body = "".join(map(entry, range(3000)))
    files = {
        "good": f'<?xml version="1.0"?><urlset {ns}>{body}<url><loc></loc></url></urlset>', "broken": f"<urlset {ns}>{body}", "other": f"<urlset>{body}</urlset>",
        "index": f"<sitemapindex {ns}><sitemap><loc>x</loc></sitemap></sitemapindex>", "open": f"<urlset {ns}><url><loc>a</loc></urlset>", "text": "no xml < at all", "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.xml").write_text(text)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = sitemaps.read_large_urlsets(spark, f"{tmp_path}/good.xml")
        assert found.rdd.getNumPartitions() > 3
        rows = [(r.loc, r.lastmod) for r in found.collect()]
        assert sorted(rows) == sorted((f"https://e.com/{i}", f"2026-01-0{i % 9 + 1}") for i in range(3000))
        assert {r.file.rsplit("/", 1)[1] for r in sitemaps.read_large_urlsets(spark, str(tmp_path)).collect()} == {"good.xml"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_an_address_meets_equal_and_nested_ranges_once(spark):
    ends = [("9.0.0.0", "9.255.255.255", f"w{i:04}") for i in range(2000)] + [("9.1.0.0", "9.1.255.255", f"n{i:04}") for i in range(2000)]
    rows = spark.createDataFrame([(bits(a), bits(b), k) for a, b, k in ends], "lo string, hi string, kind string")
    found = ranges.innermost_range(spark.createDataFrame([("9.1.2.3",), ("9.2.2.3",)], "ip string"), rows)
    assert {r.ip: r.kind for r in found.collect()} == {"9.1.2.3": "n0000", "9.2.2.3": "w0000"}
    plan = found._jdf.queryExecution().executedPlan()
    joins = [n for n in re.findall(r"(\w*Join)", plan.toString())]
    assert joins and _rows_of_joins(plan) <= 4


def test_more_blocks_than_the_bound_are_joined_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCKS", 0)
    test_innermost_range_against_every_range(spark)


def _rows_of_joins(plan) -> int:
    """Most rows that an inner join of an executed plan gave."""
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name and "Inner" in node.simpleString(1000) and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most
