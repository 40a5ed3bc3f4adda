"""Quality rules, line dedup, near-dedup, decontamination, packing: brute force on small tables and odd rows."""

import itertools
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagemill.llm import decontam, line_dedup, minhash, packing, quality
from pagemill.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, doc string, batch int, d long, h string, stats string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def table(spark, texts, first=0):
    """Rows with columns whose names the operators use themselves."""
    rows = [(first + i, t, "x", 1, 2, "y", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_rows(spark):
    same = "The same line of text in every one of these\nand another"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (None, same), (None, None), (5, LONG), (6, same.upper())]
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics_and_verdicts(spark):
    rng = random.Random(5)
    pool = ["a", "b", "#c", "d.", "e|f", "élan", "\x1c", "g"]
    texts = [rng.choice(["", "\n"]).join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = {r["doc"]["doc_id"]: r for r in quality.with_votes(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        s = got[i]["stats"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == brute_stats(t), t


def test_quality_model_separates_and_never_reverses(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "el", "is", "om", "ur", "enta", "oria")]
    good = [" ".join(rng.choice(words) + rng.choice(["", "", "", "", "", "", "."]) for _ in range(80)) + "." for _ in range(80)]
    bad = [" ".join(rng.choice(words) + "$$$" for _ in range(80)) for _ in range(15)]
    kept = {r.doc_id for r in quality.filter_quality(table(spark, good + bad)).collect()}
    assert kept == set(range(80))
    model = quality.fit_votes(quality.with_votes(table(spark, good + bad)).where(~F.col("base_failed")))
    assert all(b >= g for b, g in zip(model.bad, model.good, strict=True))
    out = quality.filter_quality(odd_rows(spark))
    assert out.columns == odd_rows(spark).columns and {r.doc_id for r in out.collect()} <= {5}
    assert quality.filter_quality(odd_rows(spark).limit(0)).count() == 0


def brute_lines(rows, min_docs=3):
    def key(x):
        return "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\r\x0b\x0c"))

    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append((n, -(2**63) if i is None else i))
    out = []
    for i, t in rows:
        mine = -(2**63) if i is None else i
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(h := holders.get(key(x), [])) >= min_docs and mine != max(d for _, d in h))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    shared = [f"  Shared line number {i} of some length\t" for i in range(6)] + ["short", "", "ÄÖÜ äöü in a line of letters", "äöü äöü in a line of letters"]
    texts = ["\n".join(rng.choice(shared) if rng.random() < 0.6 else f"own line {rng.random()} padding" for _ in range(rng.randint(0, 9))) for _ in range(50)]
    frame = table(spark, texts)
    got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(frame, batches=batches).collect()), key=repr)
    assert got == brute_lines(list(enumerate(texts)))
    rows = [(r.doc_id, r.text) for r in odd_rows(spark).collect()]
    got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(odd_rows(spark), batches=batches).collect()), key=repr)
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(odd_rows(spark).limit(0)).count() == 0


def test_line_runs_stay_few_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), 1, 9 - b) for k in range(b, b + 4)], "h binary, n long, top long"))
    keys = [bytes(r.h) for run in runs.runs() for r in run.collect()]
    assert len(keys) == len(set(keys)) == 8 and len(runs.runs()) <= 3
    assert {bytes(r.h): r.top for r in runs.frequent(3).collect()} == {bytes([2]): 9, bytes([3]): 9, bytes([4]): 8, bytes([5]): 7}


def shingles(text, size):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), 2**63), 2**63 if i is None else i)
    return sorted(((i, len(sets[x]), least[root(x)] if least[root(x)] < 2**63 else None) for x, (i, _) in enumerate(rows)), key=repr)


def near_copies(rng, count):
    """Families around one text (some members close to it, some farther off), chains, and loose texts."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for edits in (1, 2, 4, 6):
        base = [rng.choice(words) for _ in range(90)]
        for _ in range(count):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    chain = [rng.choice(words) for _ in range(120)]
    for _ in range(count):
        chain[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(chain))
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(count)]


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 1000), (5, 80, 3)])
def test_near_duplicates(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies(random.Random(size), 12)
    random.Random(2).shuffle(texts)
    rows = list(enumerate([*texts, *texts[:5], texts[0].upper()]))
    got = minhash.near_duplicates(table(spark, [t for _, t in rows]), size, percent).collect()
    assert sorted(((r.d, r.n, r.component_id) for r in got), key=repr) == brute_components(rows, size, percent)
    kept = [r.doc_id for r in minhash.keep_one(table(spark, [t for _, t in rows]), size, percent).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_components(rows, size, percent)})


def test_near_duplicates_of_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_rows(spark).collect()]
    got = minhash.near_duplicates(odd_rows(spark)).collect()
    assert sorted(((None if r.d == minhash.HIGHEST else r.d, r.n, r.component_id) for r in got), key=repr) == brute_components(rows, 5, 80)
    kept = minhash.keep_one(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, None), (2, ""), (3, " \n\t "), (4, rows[3][1]), (None, None), (5, LONG)], key=repr)
    assert minhash.keep_one(odd_rows(spark).limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 10, 200, 5000):
        items = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert len(minhash.sketch(items)) == minhash.COORDINATES and (minhash.sketch(items) != 0).all()
    close = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64))
        b = np.unique(np.r_[a[:720], rng.integers(0, 2**63, 80).astype(np.uint64)])
        close.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(close) - 720 / 880) < 0.03


def brute_overlaps(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    w, hit, names = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(10, len(v))
        strings = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in strings:
                hit.update(range(i, i + m))
                names.add(item)
    return len(w), len(hit), sorted(str(x) for x in names if x is not None)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 60])
def test_decontamination(spark, chunk_bytes):
    rng = random.Random(9)
    pool = ["a", "B", "ä", "Ä", "c1", "the", "of"]
    items = [(i % 7, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 8, 10, 12, 30])))) for i in range(12)]
    items += [(None, "a b c1 the of a b c1 the of ä"), (8, ""), (9, None)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [f"x-y, {t}! z" for _, t in items] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for kept in (items, [x for x in items if len((x[1] or "").split()) > 7]):
        bench = spark.createDataFrame(kept, "item_id long, text string")
        got = decontam.find_overlaps(table(spark, texts), bench, chunk_bytes=chunk_bytes).collect()
        for r in got:
            n, hit, names = brute_overlaps(texts[r.doc.doc_id], kept)
            assert (r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) == (n, hit, names)


def test_clean_documents(spark):
    bench = spark.createDataFrame([(1, LONG[:200]), (2, "and another")], "item_id long, text string")
    out = decontam.clean_documents(odd_rows(spark), bench)
    # Item 2 has two words: it costs a document only where it is a whole line.
    assert out.columns == odd_rows(spark).columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "None"]
    inside = odd_rows(spark).withColumn("text", F.regexp_replace("text", "(?i)\nand", " and"))
    assert decontam.clean_documents(inside, bench).count() == 8
    both = bench.union(bench.selectExpr("item_id + 10", "'x ' || text"))
    assert decontam.clean_documents(odd_rows(spark), both, chunk_bytes=50).count() == 4
    assert decontam.clean_documents(odd_rows(spark), bench.limit(0)).count() == 9
    assert decontam.clean_documents(odd_rows(spark).limit(0), bench).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_whole_text(name):
    spec = open(public_tokenizers.path(name), encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(spec)
    rng = random.Random(4)
    alphabet = " \n\t  aAbZé'sßÄ9１  ́ \x1c\x85İſK漢字🙂.,!'tll "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [LONG, "", "<|endoftext|> a", "x" * 5000, "hello <|endoftext|> world", "a<|endoftext|>b\n<|startoftext|> <|ENDOFTEXT|>", "<|endoftext|>" * 3]
    for literal in (False, True):
        tokenizer.encode_special_tokens = literal
        encoder = Encoder(spec, cache_size=500, literal=literal)
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert list(memoryview(ids).cast("I")) == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_cache_stays_bounded_within_one_text():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder, text = Encoder(spec, cache_size=10), " ".join(f"word{i},x{i}" for i in range(200))
    (ids,) = encoder.encode([text])
    assert list(memoryview(ids).cast("I")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.pieces) <= 10 and len(encoder.pieces.old) <= 10


def test_encoder_cuts_long_texts(monkeypatch):
    from pagemill.llm import tokens

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    whole = b"".join(Encoder(spec).encode([LONG]))
    monkeypatch.setattr(tokens, "_SEGMENT", 1000)
    assert b"".join(Encoder(spec).encode([LONG])) == whole


def test_packing(spark):
    assert packing.cuts(2048 * 2 + 5) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 1)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in odd_rows(spark).collect()]
    pieces = packing.pack(odd_rows(spark), path).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.length & (p.length - 1) == 0 and p.length <= 2048 for p in pieces)
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows), key=repr)
    got, at = [], {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id)):
        if p.start == 0:
            got.append([])
        got[-1] += list(memoryview(bytes(p.ids)).cast("I"))
        assert p.offset == 0 and len(p.ids) == 4 * p.length
    assert sorted(got, key=repr) == want
    assert packing.pack(odd_rows(spark).limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_rows(spark), path, max_length=1000)


def test_pipeline_stages(spark, tmp_path):
    """Every stage against its brute force on what the stage before left."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "el", "is", "om", "ur", "enta", "oria")]
    def text():
        return ".\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(8)) + "."
    leak = " ".join(rng.choice(words) for _ in range(30))
    notice = "This is a notice that many of the documents share, word for word."
    texts = [text() for _ in range(40)]
    texts += [texts[0].replace("ban", "lis", 1), texts[1] + " end.", texts[2]]
    texts += [f"{text()}\n{notice}" for _ in range(5)] + [f"{text()}\n{leak}." for _ in range(3)]
    texts += [" ".join(rng.choice(words) + "###" for _ in range(90)) for _ in range(6)] + [None, "", "too short"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    assert set(seen["quality_rules"]) == set(range(51))
    lines = brute_lines([(i, texts[i]) for i in range(51)])
    assert seen["line_dedup"] == {i: t for i, _, _, t in lines}
    comps = brute_components(sorted(seen["line_dedup"].items()), 5, 80)
    assert set(seen["near_dedup"]) == {c for _, _, c in comps}
    assert set(seen["decontamination"]) == {i for i, t in seen["near_dedup"].items() if not brute_overlaps(t, [(1, leak)])[1]}
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(seen["decontamination"])
