import pytest
from pyspark.sql import functions as F

from pagemill.operators import ordering
from pagemill.operators.robots import robots_rules
from pagemill.plans import batch_run
from pagemill.plans.commits import KeyIndex, Store
from pagemill.session import cut_lineage
from pagemill.streaming import incremental

WORDS = "words of a river story told in the evening " * 8


def inputs(spark):
    urls = spark.createDataFrame(
        [("j", f"https://r.org/{p}", s, n) for p, s, n in (
            ("a", "queued", 0), ("b", "failed", 2), ("c", "failed", 3), ("d", "queued", 0), ("login", "queued", 0), ("no/e", "queued", 0), ("f", "success", 0), ("g", "queued", 1))],
        "job_id string, raw_url string, status string, retry_count int",
    )
    page = lambda text: f"<article><p>{text}</p></article>"
    tries = [
        ("a", 0, 500, None, None), ("a", 1, 200, page(WORDS), None), ("b", 0, 0, None, "Timeout"), ("c", 0, 404, None, None), ("d", 0, 200, page("few"), None),
        ("login", 0, 200, page(WORDS), None), ("no/e", 0, 200, page(WORDS), None), ("f", 0, 200, page(WORDS), None),
    ]
    attempts = spark.createDataFrame([(f"https://r.org/{p}", *x) for p, *x in tries], "url string, attempt int, http_status int, html string, error string")
    rules = robots_rules(spark.createDataFrame([("https://r.org", 200, "User-agent: *\nDisallow: /no/")], "site_root string, http_status int, body string"))
    return urls, attempts, rules


def run(spark, **options):
    return batch_run.run_urls(*inputs(spark), **options)


def test_states_of_a_run(spark):
    out = run(spark).cache()
    got = {r.raw_url.removeprefix("https://r.org/"): (r.status, r.retry_count) for r in out.collect()}
    assert got == {
        "a": ("success", 0), "b": ("failed", 3), "c": ("permanently_failed", 4), "d": ("partial", 0), "login": ("skipped", 0), "no/e": ("skipped", 0), "g": ("failed", 2),
    }
    counts = batch_run.run_counts(out).first()
    assert (counts.success, counts.partial, counts.skipped, counts.failed, counts.permanently_failed, counts.words) == (1, 1, 2, 2, 1, len(WORDS.split()) + 1)
    assert {(r.url[-1], r.error, r.retry_count) for r in batch_run.run_failures(out).collect()} == {("b", "Timeout", 3), ("c", "HTTP 404", 4), ("g", "Unknown fetch error", 2)}
    assert [r.raw_url[-1] for r in batch_run.run_articles(out).orderBy("raw_url").collect()] == ["a", "d"]
    strict = {r.raw_url.removeprefix("https://r.org/"): r.status for r in run(spark, score_threshold=0.99).collect()}
    assert strict["a"] == "skipped"


def test_appended_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for batch, numbers in (("1", [1, 2, None]), ("1", [9]), ("2", [2, 3, None]), ("3", []), ("4", [3, 4, 5]), ("5", [6]), ("6", [1, 6, 7])):
        rows = spark.createDataFrame([("j", n, b) for n in numbers for b in (batch, "z")], "k string, n int, batch string")
        KeyIndex(store, "t", ["k", "n"], ["batch"], buckets=3, fanout=2).append(batch, rows)
    want = {1: "1", 2: "1", None: "1", 3: "2", 4: "4", 5: "4", 6: "5", 7: "6"}
    index = KeyIndex(Store(spark.newSession(), str(tmp_path)), "t", ["k", "n"], ["batch"], fanout=2)
    assert index.buckets == 3 and {r.n: r.batch for r in index.read().collect()} == want and index.read().count() == len(want)
    levels = [p.level for p in store.parts("t.keys")]
    assert len(levels) < 6 and max(levels) > 0
    found = index.looked_up(index.store.spark.createDataFrame([("j", 3), ("j", None), ("j", 8), ("j", 3)], "k string, n int"))
    assert sorted((str(r.n), r.batch) for r in found.collect()) == [("3", "2"), ("3", "2"), ("8", None), ("None", "1")]


def test_batch_meets_runs_where_they_lie(spark, tmp_path):
    index = KeyIndex(Store(spark, str(tmp_path)), "t", ["n"], buckets=16)
    index.append("1", spark.range(1000).toDF("n"))
    index.append("2", spark.range(990, 1010).toDF("n"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = index.unseen(spark.createDataFrame([(5,), (2000,)], "n long"))
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert [r.n for r in new.collect()] == [2000]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert plan.count("SelectedBucketsCount: 2 out of 16") == 2
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1


def test_uncommitted_parts_do_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(3).toDF("n")
    store.write_part("a", rows)
    assert store.batches() == [] and store.read("a", "n long").count() == 0
    assert store.add("x", {"a": rows, "b": rows}) and not store.add("x", {"a": rows})
    store.commit("empty", {})
    assert store.read("a").count() == 3 and store.has("empty") and store.batches() == ["x", "empty"]
    old = store.parts("a")
    merged = store.write_part("a", store.read("a").limit(1))
    assert store.read("a").count() == 3
    store.commit("merge", {"a": merged}, {"a": old})
    assert Store(spark, str(tmp_path)).read("a").count() == 1
    with pytest.raises(ValueError):
        store.read("c")


def test_run_goes_on_after_a_loss(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    urls, attempts, rules = inputs(spark)
    first = urls.where("raw_url < 'https://r.org/c'")
    store.write_part("articles", urls)  # of a run that was lost
    assert batch_run.run_batch(store, "1", first, attempts, rules) and not batch_run.run_batch(store, "1", urls, attempts, rules)
    left = batch_run.urls_to_do(store, urls)
    assert {r.raw_url[-1]: (r.status, r.retry_count) for r in left.collect() if r.raw_url[-1] in "ab"} == {"a": ("success", 0), "b": ("failed", 3)}
    batch_run.run_batch(store, "2", left, attempts, rules)
    assert sorted(r.raw_url[-1] for r in store.read("articles").collect()) == ["a", "d"]
    assert sorted((r.url[-1], r.retry_count) for r in store.read("failures").collect()) == [("b", 3), ("b", 4), ("c", 4), ("g", 2)]
    total = batch_run.counts_so_far(store).first()
    assert (total.success, total.partial, total.failed, total.permanently_failed) == (1, 1, 2, 2)
    assert {r.raw_url[-1]: r.status for r in batch_run.urls_to_do(store, urls).collect()}["b"] == "permanently_failed"


def test_streams_leave_tables(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "job_id string, url string, is_candidate boolean"
    store = Store(spark, str(tmp_path / "store"))
    for i, urls in enumerate((["https://e.com/a", "https://e.com/a/"], ["https://e.com/a", "https://e.com/b"])):
        spark.createDataFrame([("j", u, u.endswith("b")) for u in urls], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.append_distinct(stream, store, str(tmp_path / "c1")).awaitTermination()
        incremental.publish_counts(stream, store, str(tmp_path / "c2")).awaitTermination()
        assert store.read("urls").count() == i + 1
    for _ in range(2):
        row = incremental.read_counts(store).first()
        assert (row.urls_discovered, row.blogs_identified) == (4, 1)
        incremental.compact_counts(store, "once")
    assert len(store.parts("live_counts")) == 1


def test_stream_of_attempts(spark, tmp_path):
    urls, attempts, rules = inputs(spark)
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    for part in (attempts.where("url like '%/a'"), attempts.where("url like '%/a' or url like '%/d' or url like '%/c'")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(attempts.schema).parquet(source)
        incremental.run_new_attempts(stream, urls, rules, store, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.raw_url[-1] for r in store.read("articles").collect()) == ["a", "d"]
    assert sorted((r.raw_url[-1], r.status) for r in store.read("states").collect()) == [("a", "success"), ("c", "permanently_failed"), ("d", "partial")]


def test_numbering_and_index_of_few_rows_use_few_partitions(spark, tmp_path, monkeypatch):
    """Small steps of a walk are merged whatever the number of shuffle partitions; a key is told apart before it is dealt."""
    placed = []
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: placed.append(cut_lineage(df)) or placed[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rows = spark.createDataFrame([("a" if i % 3 else None, f"u{i % 7}", i) for i in range(40)], "site string, url string, ord long")
        index = KeyIndex(Store(spark, str(tmp_path / "few")), "seen", ["site", "url"], buckets=4)
        index.add("one", spark.createDataFrame([(None, "u0"), ("a", "u1")], "site string, url string"))
        first = index.first_unseen(rows, [F.col("ord")])
        got = sorted(((r.site, r.url, r.ord, r.n) for r in ordering.number_rows(first, ["ord"], "n", ["site"]).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for i in range(40):
        key = ("a" if i % 3 else None, f"u{i % 7}")
        if key not in ((None, "u0"), ("a", "u1")):
            want.setdefault(key, i)
    n, numbered = {}, []
    for (site, url), i in sorted(want.items(), key=lambda x: x[1]):
        n[site] = n.get(site, 0) + 1
        numbered.append((site, url, i, n[site]))
    assert got == sorted(numbered, key=repr)
    assert placed[0].rdd.getNumPartitions() < 60
