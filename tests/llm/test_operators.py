"""Every operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textspark.llm import bpe, fingerprints, licenses, mixing, neardup, quality, secrets, topk, toxicity, urls
from textspark.llm.graph import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the river runs past an old mill where people once ground grain for bread and sold it".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "word", None, "b", 4), (4, "  \n\t ", "en", "a", 5),
    (5, prose(1, 30000), "en", "a", None), (6, prose(2, 60), "en", "b", 1), (7, prose(2, 60), "en", "b", 1),
    (8, prose(3, 40) + "\n" + prose(4, 40), "en", None, 1), (8, prose(3, 40) + "\n" + prose(4, 40), "en", None, 1),
    (None, prose(5, 20), "en", "a", 1), (9, "日本語 😀 don't <|endoftext|> x", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 BPE


def test_bpe_equals_the_library_and_round_trips(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    rows = bpe.decode(bpe.encode(docs.withColumn("token_ids", F.lit("clash")))).withColumn("ids", bpe.unpack()).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        want = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == tok.decode(want, skip_special_tokens=False)


def test_bpe_on_random_texts():
    from tokenizers import Tokenizer

    tok, known, r = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path()), random.Random(5)
    texts = ["".join(r.choice("abTHE  \n'sé😀12!.-\t") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += [tok.decode([r.randrange(50257) for _ in range(6)], skip_special_tokens=False) for _ in range(1000)]
    for t, ids in zip(texts, known.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_bpe_takes_little_memory_for_repeated_and_for_new_words():
    import tracemalloc

    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=8))
    few = [word() for _ in range(1000)]
    texts = [" ".join(r.choices(few, k=1000)) for _ in range(300)], [" ".join(word() + "," for _ in range(1000)) for _ in range(150)]
    for part, most in zip(texts, (15, 62)):  # MB
        known = bpe.Vocabulary(bpe.default_path())
        tracemalloc.start()
        found = known.encode(part)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert [known.decode(x) for x in found] == part
        assert peak < most, peak


def test_bpe_in_small_groups_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "FRESH", 3)
    tok, known, r = Tokenizer.from_file(bpe.default_path()), bpe.Vocabulary(bpe.default_path()), random.Random(8)
    texts = ["".join(r.choices([*"abstv ,.!\n\u00a0é漢", " the", "'s", "<|endoftext|>"], k=r.randint(0, 40))) for _ in range(1000)]
    for t, ids in zip(texts, known.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_pipeline_encoding_sends_no_text_back(spark, docs):
    import corpus_pipeline as p

    docs = docs.withColumn("source", F.lit("a"))
    done = p.encode_tokens(spark, docs, "")
    assert done.columns == ["doc_id", "source", "n_tokens", "token_ids", "round_trip"]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    node = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "token_ids" in node and "text" not in node.split("[", 1)[1] and "decoded" not in node, node
    want = bpe.round_trip(docs).select("doc_id", "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same")).collect()
    assert sorted(((r["doc_id"], bytes(r["token_ids"]), r["round_trip"]) for r in done.collect()), key=repr) == sorted(((r["doc_id"], bytes(r["token_ids"]), r["same"]) for r in want), key=repr)


def test_bpe_digests_of_nothing(none):
    assert bpe.digests(none).count() == 0


# 2 licenses


def test_licenses_with_edits_and_edges(spark, docs, none):
    text = prose(9, 50) + "\nPermission is hereby granted, free of charge, to ANY person obtaining a copy of this nice software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, change, merge, publish\n" + prose(10, 20) + "\nReleased under the MIT License. "
    df = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, licenses int")
    (r,) = licenses.scan(df).collect()
    found = {m["license"]: m for m in r["licenses"]}
    assert set(found) == {"mit-text", "mit"} and 0.3 < found["mit-text"]["coverage"] < 1 and found["mit"]["coverage"] == 1
    assert text[found["mit"]["begin"] : found["mit"]["end"]] == "Released under the MIT License"
    assert licenses.matches(docs).count() == 0 and licenses.matches(none).count() == 0


# 3 toxicity


def test_toxicity_learns_marked_stems(spark, docs, none):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        ws = prose(1000 + i, r.randint(20, 90)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(4):
                ws.insert(r.randrange(len(ws)), "grumf" + r.choice(["a", "el", "ig", "ost"]))
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(bad)))
    df, lb = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(df, lb, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, net).collect()}
    held = [i for i in range(700) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) / len(held) > 0.9
    edge = toxicity.score(docs, net).collect()
    assert len(edge) == len(EDGE) and all(0 <= x["score"] <= 1 for x in edge)
    assert toxicity.score(none, net).count() == 0
    assert toxicity.train(df, lb.where("toxic = 0"), F.lit(True)) is None
    assert {x["score"] for x in toxicity.score(docs, None).collect()} == {0.0}


def test_windows_cover_every_word():
    for n in range(200):
        w = toxicity.windows(n)
        assert set(w[w >= 0]) == set(range(n))


# 4 fingerprints


def brute_fingerprint(text):
    exact, lanes, n = [0] * 8, [0] * 63, 0
    for p in (text or "").split("\n"):
        h = hashlib.sha256(p.encode()).hexdigest()
        exact = [(e + int(h[8 * i : 8 * i + 8], 16)) % 2**32 for i, e in enumerate(exact)]
        ws = p.split(" ")
        for i, w in enumerate(ws):
            v = xxhash.xxh64_intdigest((ws[i - 1] if i else "").encode(), seed=xxhash.xxh64_intdigest(w.encode(), seed=42))
            n += 1
            lanes = [x + (v >> j & 1) for j, x in enumerate(lanes)]
    return "".join(f"{e:08x}" for e in exact) + f":{n:x}:" + ".".join(f"{x % 2**21:x}" for x in lanes)


def test_fingerprints_equal_brute_force(docs, none):
    got = fingerprints.neighbours(docs).collect()
    assert len(got) == len(EDGE)
    order = sorted(((i, t or "") for i, t, *_ in EDGE), key=lambda x: (x[0] is None, -(x[0] or 0), [-ord(c) for c in x[1][:50]]))
    want = defaultdict(list)
    for k, (i, t) in enumerate(order):
        c = len(t) // 3
        want[i].append((brute_fingerprint(t), hashlib.sha256((t[: len(t) - c] + order[(k + 1) % len(order)][1][:c]).encode()).hexdigest(), len(t)))
    for r in got:
        assert (r["fingerprint"], r["edited_sha256"], r["n_chars"]) in want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.neighbours(none).count() == 0


def test_fingerprints_add_and_subtract_without_order(spark):
    df = spark.createDataFrame([(1, "one two\nthree"), (2, "three\none two"), (3, "three"), (4, "one two")], "k int, t string")
    f = {r["k"]: r["fingerprint"] for r in fingerprints.fingerprint(df, ["k"], "t").collect()}
    assert f[1] == f[2] != f[3]
    both = fingerprints.fingerprint(df, ["k"], "t").where("k > 2").groupBy().pivot("k", [3, 4]).agg(F.first("fingerprint"))
    r = both.select(fingerprints.add(F.col("3"), F.col("4")).alias("sum"), fingerprints.subtract(fingerprints.add(F.col("3"), F.col("4")), F.col("4")).alias("rest")).first()
    assert r["sum"] == f[1] and r["rest"] == f[3]


# 5 urls


def test_urls_rules_and_aliases(spark, none):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [
        (1, "http://a.NET/es/x?q", None), (2, "http://free.org/", link.format("http://a.net/es/y")), (3, "http://other.org/z#t", '<meta http-equiv="refresh" content="0; url=http://free.org/">'),
        (4, "http://www.example.com/en/1", link.format("http://a.net/fr/1")), (5, "http://shop.example.com/en/1", None), (6, None, "x"), (7, "no scheme", ""), (8, "http://com.evil.org/com/", None), (8, "http://com.evil.org/com/", None), (9, "http://anet/es/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got[1] == ("a.net", "/es/x", "net/es/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")  # aliases of a blocked url
    assert got[4][2:] == ("www.example.com/en/", "allow")  # an explicit allow goes before aliases
    assert got[5][2:] == ("example.com/en/", "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][3] == "allow" and got[9][3] == "allow"
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_urls_long_rule_lists_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://x.example.com/en/a", ""), (2, "http://www.example.com/en/", ""), (3, "http://b.net/es/", ""), (4, "http://b.org/", "")], "page_id long, url string, html string")
    want = sorted(map(tuple, urls.judge(df).collect()))
    monkeypatch.setattr(urls, "EXPRESSION", 0)
    assert sorted(map(tuple, urls.judge(df).collect())) == want


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 1), (7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    want = {x: top(x) for x in up}
    assert {x["node"]: x["component"] for x in connected_components(df, "a", "b").collect()} == want
    assert {x["node"]: x["component"] for x in neardup.joined(df.where("a <> b")).collect()} == want


# 6 secrets


def test_secret_base_spans():
    spans = lambda t: [(secrets.KINDS[k], t[b:e]) for b, k, e, _ in secrets.base_spans(t)]
    assert spans('API_KEY: "abc123xyz"') == [("assign", 'API_KEY: "abc123xyz')]
    assert spans("token: token: abcdefghi") == []  # the first match fails and is consumed
    assert spans("secret=abc12 secret=abc123") == [("assign", "secret=abc123")]
    assert spans("AKIA" + "A" * 15) == [] and spans("xAKIA" + "A1" * 8) == [("access", "AKIA" + "A1" * 8)]
    assert spans("g" + "0a" * 12) == [("hex", "0a" * 12)] and spans("0a" * 11) == []
    assert spans("ſecret=abc123") == []


def test_secret_scan_and_redaction(spark, docs, none):
    rows = [(i, prose(i, 30) + f" password={hashlib.md5(str(i).encode()).hexdigest()[:18]} " + prose(i + 1, 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = secrets.train(df)
    got = secrets.digests(df, field).collect()
    assert all(r["n_assign"] == 1 and r["spans"].startswith("assign:") for r in got)
    clean = secrets.redact(df.withColumn("spans", F.lit(1)), field)
    assert clean.columns == ["doc_id", "text", "spans"] and clean.where(F.col("text").contains("password=")).count() == 0
    assert secrets.digests(docs, field).where("n_assign + n_access + n_hex > 0").count() == 0
    assert secrets.redact(docs, field).where("text IS NULL").count() == 1
    assert secrets.digests(none, None).count() == 0 and secrets.train(docs) is None


def test_viterbi_skipping_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(50):
        e, moves = rng.normal(0, 2, (12, 3)), rng.normal(0, 0.5, (3, 3))
        f = secrets.Field()
        f.moves[:] = moves
        open_ = np.flatnonzero(e[:, 2] - e[:, :2].max(1) <= f.certain())
        tags = [2] * 12
        for piece in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(piece):
                for at, t in zip(piece, secrets.viterbi(e[piece], moves)):
                    tags[at] = t
        assert tags == secrets.viterbi(e, moves)


# 7 mixing


def test_mixing_reaches_targets(spark, docs, none):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 300 + [None] * 300)] + [(1, "w w w", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) == int(1.5 * total)
    by = defaultdict(lambda: [0, 0])
    for r in got:
        by[r["source_size"]] = [by[r["source_size"]][0] + r["taken"], r["target"]]
    assert all(abs(t - w) <= 2 * 13 for t, w in by.values())
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))
    edge = mixing.mix(docs).collect()
    assert len(edge) == len(EDGE) and {r["taken"] for r in edge if not r["size"]} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mix(docs.where("doc_id < 3")).count() == 2


# 8 quality


def test_quality_keeps_good_texts(spark, docs, none):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.8
        ws = prose(i, r.randint(40, 200)).split()
        rows.append((i, " ".join(ws) if good else " ".join(w.upper() + "!!" for w in ws) if i % 2 else " ".join([ws[0]] * len(ws)), "x"))
        labels.append((i, int(good)))
    df, lb = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    net, prior = quality.train(df, lb, F.col("doc_id") % 3 != 1)
    assert 0.5 < prior < 0.95
    got = {x["doc_id"]: x["score"] for x in quality.score(df, net).collect()}
    held = [(i, q) for i, q in labels if i % 3 == 1]
    assert sum((got[i] >= 0.5) == q for i, q in held) / len(held) > 0.95
    assert len(quality.score(docs, net).collect()) == len(EDGE) and quality.score(none, net).count() == 0
    assert quality.train(df, lb.where("quality = 0"), F.lit(True)) is None


# 9 top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(0, 0.2, (400, 40)), 2)
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(1000, None), (1050, [float("nan")] * 40), (1100, [None] + [0.1] * 39), (1150, [float("inf")] * 40), (1200, [0.1] * 3), (1201, [0.2] * 3), (17, [float(x) for x in v[17]]), (None, [0.1] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    w = np.floor(256 * v).astype(int)
    cand = [(i, w[i]) for i in range(400)] + [(17, w[17])]
    for q in range(0, 400, 50):
        assert got[q] == [(i, -s) for s, i in sorted((-int(w[q] @ x), i) for i, x in cand if i != q)[:5]]
    assert got[1200] == [(1201, 3 * 25 * 51)] and set(got) == {*range(0, 400, 50), 1200}
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# 10 near-duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().translate(neardup._LOWER).split()
        sets[i] = {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    if small:  # every way of large nodes, large families and large graphs
        monkeypatch.setattr(neardup, "NODE", 6)
        monkeypatch.setattr(neardup, "BLOCK", 12)
        monkeypatch.setattr(neardup, "ANCHORS", 2)
        monkeypatch.setattr(neardup, "TILE", 16)
    r = random.Random(10)
    rows = [(i, prose(i, r.randint(1, 80))) for i in range(80)]
    for g in range(3):
        base = prose(900 + g, 120).split()
        for _ in range(45):
            ws = list(base)
            for _ in range(r.randrange(6)):
                ws[r.randrange(len(ws))] = f"new{r.randrange(99)}"
            rows.append((len(rows), " ".join(ws)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "one two", rows[90][1], rows[90][1].upper()])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    want, sizes = brute_components(rows, 4, 80)
    got = neardup.components(df, shingle=4).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x["component_id"], x["n_shingles"], x["kept"]) == (want[x["doc_id"]], sizes[x["doc_id"]], want[x["doc_id"]] == x["doc_id"])


def test_near_duplicates_survive_the_deepest_extension():
    """Pairs at the threshold must share a path of length DEPTH in a tree, as if every node were extended, and pass CUT."""
    r = np.random.default_rng(3)
    one = r.integers(0, 1 << 32, (3000, neardup.HASHES), dtype=np.uint32)
    other = np.where(r.random(one.shape) < 0.8, one, r.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    lost = np.arange(len(one))
    for tree in range(getattr(neardup, "DEEP_TREES", neardup.TREES)):
        root = np.full(len(lost), neardup._blend(np.array([tree + 1], np.uint64))[0])
        (at, paths), (to, others) = (np.arange(len(lost)), root), (np.arange(len(lost)), root)
        for _ in range(neardup.DEPTH):
            rows, paths = neardup.extend(paths, one[lost[at]], 1.25)
            at = at[rows]
            rows, others = neardup.extend(others, other[lost[to]], 1.25)
            to = to[rows]
        both = {*zip(at.tolist(), paths.tolist())} & {*zip(to.tolist(), others.tolist())}
        lost = np.delete(lost, sorted({x for x, _ in both}))
    near = (one == other).mean(axis=1) >= neardup.CUT
    assert not len(lost) and near.all()


def test_near_duplicates_of_edge_rows(docs, none):
    got = neardup.components(docs).collect()
    assert len(got) == len(EDGE)
    assert {x["component_id"] for x in got if x["doc_id"] in (6, 7)} == {6} and {x["component_id"] for x in got if x["doc_id"] is None} == {None}
    assert neardup.components(none).count() == 0


# pipeline


def test_pipeline_on_edge_rows(spark, docs, none, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(6, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        out = start
        for k, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, out, str(tmp_path))
            if k < len(p.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{start is docs}-{k}")
            out = spark.read.parquet(f"{tmp_path}/{start is docs}-{k}")
        assert out.where("NOT round_trip").count() == 0


def test_pipeline_mix_keeps_rows_without_id(spark):
    import corpus_pipeline as p

    rows = [(None, "one two three", "en", "a", 13), (None, "four five", "de", "a", 9), (1, "six seven", "en", "a", 9)]
    out = p.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    # 7 words, a budget of 10: all rows once, and then what fits of the second copies
    assert {tuple(x) for x in out} == set(rows) and sum(len(x["text"].split()) for x in out) <= 10
