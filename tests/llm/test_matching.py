"""Spelling variants, URL filters, hard negatives: brute force on small tables and odd rows."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import hard_negatives, spelling, url_filter

BIG = 10**9


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_spellings(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return rows


def test_spellings_against_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé÷") for _ in range(rng.randint(5, 7))) for _ in range(400)} | {"aaaaa", "aaaaaa", "x" * 3000, "x" * 2999 + "y", "ààààà", "àààà÷"}
    counts = {w: rng.choice([3, 4, 6, 9, 20, 50, 200]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = brute_spellings(counts)
    for parts in (3, 4, 6):
        got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_spellings(table, parts=parts).collect()}
        assert got == want
    assert spelling.group_spellings(table.limit(0)).collect() == []


def test_signatures_are_not_broadcast(spark, monkeypatch):
    """A small file of words becomes 24 rows a word, which Spark does not foresee; the driver holds none of them."""
    plans, write = [], spelling.stored

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling, "stored", planned)
    table = spark.createDataFrame([("hello", 9), ("hallo", 3), ("jello", 4), ("world", 5)], "word string, n long")
    out = spelling.group_spellings(table)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert {(r.word, r.form, r.n_near) for r in out.collect()} == {("hello", None, 2), ("hallo", "hello", 1), ("jello", "hello", 1), ("world", None, 0)}


def test_words_are_counted_with_their_slips(spark):
    rows = [(1, "Hello HELLO hello-World, Straße"), (2, None), (3, ""), (None, "hello WORLD world"), (4, "ÀHello àhello"), (4, "ÀHello àhello"), (4, "ÀHello")]
    rows += [(i, "wonderful plain words here") for i in range(10, 400)]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), doc_id="doc_id", slips=97).collect()}
    want = Counter()
    for i, text in rows:
        for run in spelling._RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and h % 97 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} and "Àhello" in got


def test_long_text_is_cut_between_runs(monkeypatch):
    text = "abc defgh " * 50 + "x" * 100 + " éa" * 20
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "STRETCH", 7)
    assert spelling.runs_of(text) == whole and "".join(spelling._stretches(text)) == text


def brute_verdict(url, rules):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((after.index(c) for c in "/?#" if c in after), default=len(after))
    host = "".join(c.lower() if c.isascii() else c for c in after[:cut])
    path = after[cut:].split("#")[0].split("?")[0]
    fits = [r for r in rules if r[0] and r[1].startswith("/") and (host == r[0].lower() or host.endswith("." + r[0].lower())) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0].lower() + best[1], best[2] if best else "allow"


def test_urls_against_every_rule(spark):
    rng = random.Random(4)
    hosts, paths = ["net", "a.net", "b.a.net", "A.net", "xa.net", "a.net:80", "u@a.net", "", "net.", "é.net", "c.b.a.net"], ["", "/", "/a", "/ab", "/a/", "/a/b", "/a//b/", "/a/bc", "/é/b\n/c", "//"]
    urls = [f"{rng.choice(['http', 'H', ''])}://{h}{p}{rng.choice(['', '?q=/a://x', '#/f'])}" for h, p in itertools.product(hosts, paths)]
    urls += [None, "", "a.net/a", "http:/a.net", "http://a.net/" + "a/" * 20_000, "http://" + "a." * 5000 + "net/a"] + urls[:5]
    rules = [(h, p, rng.choice(["block", "allow"])) for h in ("net", "a.net", "B.a.net", "") for p in ("/", "/a", "/a/b", "/a/", "/é/b\n/", "x") if rng.random() < 0.8]
    rules += [("a.net", "/a", "allow"), ("a.net", "/a", "block")]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "short int, url string, rule string").repartition(3)
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = {r.short: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table).select("page.short", "host", "path", "rule", "verdict").collect()}
    blocked = {(h.lower(), p) for h, p, v in rules if v == "block"}
    once = {(h, p, "block" if (h.lower(), p) in blocked else "allow") for h, p, _ in rules}
    assert got == {i: brute_verdict(u, once) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), table).collect() == []


def brute_negatives(rows):
    out = set()
    for a, la, va in {(i, lab, tuple(v)) for i, lab, v in rows if i % 50 == 0}:
        scored = [(int(np.dot(va, v)), i, lab == la) for i, lab, v in rows if i != a and len(v) == len(va)]
        positives = sorted((-s, i) for s, i, same in scored if same)[:5]
        for s, p in positives:
            fits = sorted((-t, i) for t, i, same in scored if not same and -50 * s <= 100 * t <= -95 * s)[:3]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)}
    return out


def mined(spark, rows, **sizes):
    table = spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, lab, v in rows], "vec_id long, label int, embedding array<float>").repartition(3)
    ready = hard_negatives.prepared_rows(table, F.col("vec_id"), F.col("embedding"), F.col("label"), scale=1)
    found = hard_negatives.mine_negatives(ready, F.col("vec_id") % 50 == 0, **sizes).collect()
    assert len(found) == len(set(found))
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found}


def test_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 40, (6, 8))
    rows = [(i, int(rng.integers(4)), (middles[rng.integers(6)] + rng.normal(0, rng.choice([1, 15]), 8)).astype(int).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 3, [7, 7, 7, 7, 0, 0, 0, 0]) for i in range(200)]  # copies: ties everywhere
    rows += [(1300 + 50 * i, 1, [3, 4]) for i in range(3)] + [(1500, 1, [0] * 8), (1501, 9, [2, 3])]
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, cells=3, block=50, per_pass=4000) == want


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [1.0, 1.0]), (None, 1, [1.0, 2.0]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [float("nan"), 1.0]),
            (7, 2, [float("inf"), 1.0]), (8, 2, [1e30, 1.0]), (0, 1, [1.0, 2.0]), (50, 1, []), (51, 1, []), (52, 2, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    ready = hard_negatives.prepared_rows(table, F.col("vec_id"), F.col("embedding"), F.col("label"), scale=1)
    assert {r.vec_id for r in ready.collect()} == {0, 1, 2, 50, 51, 52}
    got = {(r.anchor_id, r.positive_id, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine_negatives(ready, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1, 2, 5, 3), (50, 51, 52, 0, 0)}
    assert hard_negatives.mine_negatives(ready.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_trees_cover_and_bound():
    rng = np.random.default_rng(6)
    v = np.r_[rng.integers(-30, 30, (300, 5)), np.tile([[1, 2, 3, 4, 5]], (100, 1))].astype(np.int32)
    tree = hard_negatives.build_tree(np.arange(400), np.zeros(400, np.int64), v)
    assert sorted(tree.ids.tolist()) == list(range(400))
    q = rng.integers(-30, 30, (7, 5)).astype(np.int32)
    seen = set()
    for level in tree.levels:
        low, high = hard_negatives.bounds(hard_negatives.scores(q, tree.v[level["centre"]]), level["radius"], tree.norm, (q.astype(float) ** 2).sum(1))
        for n in np.flatnonzero(level["leaf"]):
            s = hard_negatives.scores(q, tree.v[level["first"][n] : level["last"][n]])
            assert (s >= low[:, n, None]).all() and (s <= high[:, n, None]).all()
            seen |= set(range(level["first"][n], level["last"][n]))
        seen |= set(level["centre"].tolist())
    assert seen == set(range(400))
    large = np.full((2, 3), 2**26 - 1, np.int32)
    assert hard_negatives.scores(large, large)[0, 0] == 3 * (2**26 - 1) ** 2
