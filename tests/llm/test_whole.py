"""Operators against plain programs: every step written out, on rows that a cap, a prefix or a clash would lose."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, prose
from textspark.llm import bpe, fingerprints, licenses, mixing, neardup, quality, secrets, topk, toxicity, urls
from textspark.llm.common import cut, delete

INNER = "_id _y _t _l _trusted _score _copies _copy _w _row _key _x _c _n key rep node family block role part size turn finish range place ghost bucket next_text edited licenses spans score signature n_shingles statistics alias action a b u v m".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Documents, labels, pages and vectors with every inner name as a further column."""
    r = random.Random(1)
    rows = [(i, prose(i, r.randint(5, 60)) + (f" token={hashlib.md5(str(i).encode()).hexdigest()}" if i % 5 == 0 else ""), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(None, None, None, None, None), (40, rows[3][1], "en", "a", 1), (40, rows[3][1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"x{c}") for c in INNER})
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in INNER})
    return docs, labels


def test_no_inner_name_clashes(spark, odd):
    import corpus_pipeline as p

    docs, labels = odd
    n = docs.count()
    fold = F.lit(True)
    assert bpe.round_trip(docs).count() == n and bpe.digests(docs).count() == n
    assert licenses.scan(docs).count() == n
    assert toxicity.score(docs, toxicity.train(docs, labels, fold), out="score_2").count() == n
    assert fingerprints.neighbours(docs).count() == n
    field = secrets.train(docs)
    assert secrets.scan(docs, field).count() == n and secrets.redact(docs, field).columns == docs.columns
    assert mixing.mix(docs, keep=("lang",)).count() == n
    fitted = quality.train(docs, labels, fold)
    assert quality.score(docs, fitted[0]).count() == n
    assert neardup.components(docs).count() == n
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in INNER})
    assert topk.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 10
    pages = spark.createDataFrame([(1, "http://a.net/es/", None), (2, None, None)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in INNER})
    assert urls.judge(pages).count() == 2
    for stage in (p.drop_near_duplicates, p.redact_secrets, p.mix_sources):
        assert stage(spark, docs, "").columns == docs.columns


def test_cut_writes_tables_that_can_be_deleted(spark):
    df = cut(spark.range(5).withColumn("x", F.lit("a")))
    again = cut(df.where("id > 1"), df)
    assert again.count() == 3
    delete(again)
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        again.collect()


# licenses: every template against every place of the text


def plain_stretch(text, words):
    """Best local alignment without a band: (matched, begin, end)."""
    best, before = (0, 0, 0, 0), [(0, 0, 0)] * (len(text) + 1)
    for w in words:
        row = [(0, 0, 0)]
        for i, t in enumerate(text):
            score, matched, begin = before[i]
            cell = (score + 2, matched + 1, begin if score > 0 else i) if t == w else (score - 1, matched, begin)
            for s, m, b in (before[i + 1], row[-1]):
                if (s - 1, m, -b) > (cell[0], cell[1], -cell[2]):
                    cell = (s - 1, m, b)
            row.append(cell if cell[0] > 0 else (0, 0, i + 1))
            if row[-1][0] > best[0]:
                best = (*row[-1], i + 1)
        before = row
    return best[1:]


def plain_scan(text):
    words = licenses.WORD.findall(text.translate(licenses.LOWER))
    spans = [m.span() for m in licenses.WORD.finditer(text.translate(licenses.LOWER))]
    found = set()
    for t, (name, template) in enumerate(licenses.TEMPLATES.items()):
        own, todo = licenses.WORD.findall(template.translate(licenses.LOWER)), [(0, len(words))]
        while todo:
            low, high = todo.pop()
            matched, begin, end = plain_stretch(words[low:high], own)
            if licenses.enough(matched, len(own)):
                found.add((-matched, t, low + begin, low + end, name))
                todo += [(low, low + begin), (low + end, high)]
    kept = []
    for f in sorted(found):
        if not any(f[2] < g[3] and g[2] < f[3] for g in kept):
            kept.append(f)
    return sorted((spans[b][0], spans[e - 1][1], name, -m) for m, _, b, e, name in kept)


def test_licenses_equal_plain_alignment_of_all_templates():
    r = random.Random(6)
    index, names = licenses.Index(licenses.TEMPLATES), list(licenses.TEMPLATES)
    for k in range(14):
        parts = []
        for _ in range(2):
            ws = licenses.TEMPLATES[r.choice(names)].split()
            begin = r.randrange(max(1, len(ws) - 40))
            ws = ws[begin : begin + r.randint(5, 60)]
            for _ in range(r.randrange(3)):
                ws[r.randrange(len(ws))] = r.choice(["", "other", "İ two"])
            parts += [prose(k, 20), "İ" * k, " ".join(ws)]
        text = "\n".join(parts)
        assert sorted((m["begin"], m["end"], m["license"], m["matched_words"]) for m in index.scan(text)) == plain_scan(text)


def test_licenses_of_long_texts_and_copies_side_by_side(spark):
    text = prose(1, 20000) + "\nİİ Released under the MIT License." * 9 + prose(2, 20000)
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    got = licenses.matches(df).collect()
    assert len(got) == 18 and {text[m["begin"] : m["end"]] for m in got} == {"Released under the MIT License"}


# toxicity: a plain network


def plain_logit(net, words):
    p, h = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    xs = []
    for w in words:
        own, chars, _ = toxicity.hashed([w])
        xs.append(p["word"][own[0]].astype(float) + np.mean([p["char"][c].astype(float) for c in chars], axis=0))
    states = np.zeros((toxicity.WINDOW, 2 * h))
    rows = [np.concatenate([xs[k] @ p["w"][d] + p["b"][d][0] if k < len(xs) else np.zeros(3 * h) for d in (0, 1)]) for k in range(toxicity.WINDOW)]
    for d, order in ((0, range(toxicity.WINDOW)), (1, reversed(range(toxicity.WINDOW)))):
        s = np.zeros(h)
        for k in order:
            x, g = rows[k][d * 3 * h : (d + 1) * 3 * h], s @ p["u"][d]
            z, q = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
            c = np.tanh(x[2 * h :] + q * g[2 * h :])
            s = c + z * (s - c)
            states[k, d * h : (d + 1) * h] = s
    score = np.array([states[k] @ p["a"] if k < len(xs) else -30.0 for k in range(toxicity.WINDOW)])
    alpha = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    return float((alpha[:, None] * states).sum(0) @ p["o"] + p["c"][0])


def test_toxicity_scores_equal_a_plain_network():
    net = toxicity.Recurrent(3)
    texts = [prose(1, 24), prose(2, 7), prose(3, 100)]
    for text, top in zip(texts, toxicity.Scorer(net).logits(texts)[0]):
        ws = toxicity.words_of(text)
        assert top == pytest.approx(max(plain_logit(net, [ws[i] for i in row if i >= 0]) for row in toxicity.windows(len(ws))), abs=1e-4)


def test_toxicity_gradients_equal_differences():
    words = prose(4, 30).split()
    index = np.array([list(range(24)), [*range(24, 30), *[-1] * 18]])
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss(net):
        q = 1 / (1 + np.exp(-np.array([plain_logit(net, [words[i] for i in row if i >= 0]) for row in index])))
        return float((-(target * np.log(q) + (1 - target) * np.log(1 - q)) * weight).sum() / weight.sum())

    net, seen = toxicity.Recurrent(5), {}
    net.step = lambda grad, rate: seen.update(grad)
    net.learn(words, index, target, weight, 0.1)
    r = random.Random(2)
    for name, g in seen.items():
        for _ in range(4):
            if isinstance(g, tuple):
                row = int(r.choice(list(g[0])))
                at, want = (row, r.randrange(toxicity.WIDTH)), None
                want = g[1][np.asarray(g[0]) == row].sum(0)[at[1]]
            else:
                at = tuple(r.randrange(k) for k in np.shape(g))
                want = np.asarray(g)[at]
            p = net.p[name] = net.p[name].astype(np.float64)
            old, eps = p[at], 1e-3
            p[at] = old + eps
            up = loss(net)
            p[at] = old - eps
            down = loss(net)
            p[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(want, abs=3e-4)


def test_toxicity_learns_from_the_one_toxic_window_of_long_texts(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(260):
        ws = prose(3000 + i, 400).split()
        if i % 2:
            at = r.randrange(len(ws))
            ws[at:at] = ["grumfel", "grumfost", "grumfa"]
        rows.append((i, " ".join(ws)))
        labels.append((i, i % 2))
    df, lb = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(df, lb, F.col("doc_id") < 200)
    got = {x["doc_id"]: x["score"] >= 0.5 for x in toxicity.score(df, net).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(200, 260)) >= 54
    same = toxicity.score(spark.createDataFrame([(1, rows[1][1]), (2, rows[1][1])], "doc_id long, text string"), net).collect()
    assert same[0]["score"] == same[1]["score"]


# quality: a plain risk


def test_quality_gradients_equal_differences_of_the_risk():
    rng = np.random.default_rng(4)
    net = quality.Network(np.zeros(5), np.ones(5), hidden=3, seed=1)
    xp, xu, prior = rng.normal(0.5, 1, (20, 5)), rng.normal(0, 1, (30, 5)), 0.6
    s = lambda x: 1 / (1 + math.exp(-x))

    def score(x):
        hidden = [math.tanh(sum(x[i] * net.p[0][i, j] for i in range(5)) + net.p[1][j]) for j in range(3)]
        return sum(h * w for h, w in zip(hidden, net.p[2])) + net.p[3][0]

    def risk():
        negative = np.mean([s(score(x)) for x in xu]) - prior * np.mean([s(score(x)) for x in xp])
        return prior * np.mean([1 - s(score(x)) for x in xp]) + negative, negative

    (fp, hp), (fu, hu) = net.forward(xp), net.forward(xu)
    sp, su = quality.sigmoid(fp), quality.sigmoid(fu)
    grads = [a + b for a, b in zip(net.gradient(xp, hp, -2 * prior * sp * (1 - sp) / len(xp)), net.gradient(xu, hu, su * (1 - su) / len(xu)))]
    assert risk()[1] == pytest.approx(su.mean() - prior * sp.mean())
    for k, g in enumerate(grads):
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-5
            up = risk()[0]
            net.p[k][at] = old - 1e-5
            down = risk()[0]
            net.p[k][at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_quality_scores_equal_plain_statistics(spark):
    texts = ["", None, "one", prose(1, 300) + "\n" + prose(1, 300), "A1! b?\n" * 50, prose(2, 30000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    net = quality.Network(np.zeros(16), np.ones(16), seed=2)
    got = quality.score(df, net).collect()
    for r in got:
        assert r["score"] == pytest.approx(float(net.score(np.array([quality.statistics(r["text"] or "")]))[0]))
    raw = "Ab ab ab\n12 !!"
    known = dict(zip(quality.NAMES, quality.statistics(raw)))
    want = {"log_words": math.log1p(5), "distinct": 4 / 5, "top_word": 2 / 5, "repeats": 1 / 5, "digits": 2 / 14, "lines": 2 / 5, "distinct_lines": 1.0, "words_with_marks": 1 / 5}
    assert {k: known[k] for k in want} == pytest.approx(want)


# fingerprints: more word pairs than a packed counter holds


def test_fingerprints_of_a_text_of_more_than_a_million_words(spark):
    from tests.llm.test_operators import brute_fingerprint

    text = " ".join(f"{i % 977:x}" for i in range(1_200_000))
    df = spark.createDataFrame([(1, text), (2, "a b")], "k int, t string")
    got = {r["k"]: r["f"] for r in fingerprints.fingerprint(df, ["k"], "t").select("k", fingerprints.text_form(F.col("fingerprint")).alias("f")).collect()}
    assert got[1] == brute_fingerprint(text) and got[2] == brute_fingerprint("a b")


@pytest.mark.parametrize("n", [4_000_000, 6_000_000, 20_000_000])
def test_likeness_of_unrelated_very_long_texts_is_small(spark, n):
    rng = np.random.default_rng(n)
    lanes = [[int(x) for x in rng.binomial(n, 0.5, 63)] for _ in range(2)]
    row = spark.createDataFrame([(([1] * 8, lanes[0], n), ([2] * 8, lanes[1], n))], "a struct<exact:array<bigint>,lanes:array<bigint>,n:bigint>, b struct<exact:array<bigint>,lanes:array<bigint>,n:bigint>")
    near, same = row.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("a"))).first()
    assert near < 0.6 and same == 1.0


# urls: planted chains, cycles, hubs and relative links against plain reachability


def test_urls_equal_plain_reachability(spark):
    r = random.Random(12)
    hosts = ["a.net", "b.org", "c.com", "www.example.com", "shop.example.com", "d.io"]
    address = lambda i: f"http://{hosts[i % 6]}/{['en', 'es', 'fr', 'x'][i % 4]}/p{i}"
    pages, edges = [], defaultdict(set)

    def link(i, j):
        edges[i].add(j)
        edges[j].add(i)

    n = 1500
    html = [""] * n
    canonical = lambda h: f'<LINK rel="canonical" href="{h}">'
    refresh = lambda h: f"<meta http-equiv=refresh content='3; url={h}'>"
    for i in range(300, 330):  # a chain, half of it by links from the root
        html[i] += canonical(address(i + 1))
        link(i, i + 1)
    for i in range(400, 420):  # a cycle
        j = i + 1 if i < 419 else 400
        html[i] += refresh(address(j))
        link(i, j)
    for i in range(500, 900):  # a hub
        html[i] += canonical(address(499)) + canonical(address(i))
        link(i, 499)
    for i in range(900, 1200):  # same host and folder: relative forms
        j = i + 12 * r.randrange(1, 20)
        form = [f"/{address(j).split('/', 3)[3]}", f"p{j}", f"../{address(j).split('/')[3]}/p{j}", f"./p{j}", f"//{address(j).split('/', 2)[2]}"][i % 5]
        html[i] += "<link rel='canonical' href='mailto:x@y'>" + refresh(form)
        link(i, j)
    for i in range(n):
        pages.append((i, address(i), html[i] or None))
    pages += [(n, "http://q.io/a?x=1&y=2", ""), (n + 1, "http://q.io/b", canonical("/a?x=1&amp;y=2") + refresh("http://a.net/es/p1")), (n + 2, "http://q.io/b?z", canonical("?w")), (n + 3, "http://q.io/b?w", refresh(".")), (n + 4, "http://q.io/", refresh("http://a.net/es/x"))]
    rule = lambda i: next((a for a, h, p in sorted(urls.RULES, key=lambda x: -len(x[1] + x[2])) if (address(i).split("/")[2] == h or address(i).split("/")[2].endswith("." + h)) and ("/" + address(i).split("/", 3)[3]).startswith(p)), None)
    want = {}
    seen = set()
    top = n + 300
    for i in range(top):
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            for j in edges[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        bad = any(rule(j) == "block" for j in part)
        for j in part:
            want[j] = rule(j) or ("block" if bad and len(part) > 1 else "allow")
    got = {x["page_id"]: x["verdict"] for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(n)} == {i: want[i] for i in range(n)}
    assert [got[n + k] for k in range(5)] == ["block", "block", "block", "block", "block"]


# secrets


def test_secret_base_digests_equal_plain_patterns(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in secrets.digests(docs, None).join(docs, "doc_id").collect():
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r["text"] or "") if len(m.group(1)) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r["text"] or "") if len(m.group()) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", r["text"] or "") if len(m.group()) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{b}:{e}" for b, k, e in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == text
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, j, _ in found) for k in range(3)]


def test_the_field_adds_secrets_that_no_pattern_catches(spark):
    r = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    learn = [(i, f"{prose(i, 40)}\n{r.choice(['password', 'token', 'api_key'])}={word(r.randint(20, 32))}\n{prose(i + 1, 40)}") for i in range(300)] + [(1000 + i, prose(5000 + i, 60)) for i in range(200)]
    field = secrets.train(spark.createDataFrame(learn, "doc_id long, text string"))
    planted, texts = [], []
    for i in range(120):
        s = word(r.randint(22, 30))
        text = f"{prose(9000 + i, 30)}\nauth {s}\n{prose(9500 + i, 30)}"
        planted.append((text.index(s), text.index(s) + len(s)))
        texts.append((i, text))
    texts += [(500 + i, prose(20000 + i, 80)) for i in range(120)]
    got = {x["doc_id"]: [(s["begin"], s["end"]) for s in x["spans"] if s["kind"] == "crf"] for x in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"), field).collect()}
    hits = sum(planted[i] in got[i] for i in range(120))
    wrong = sum(len(v) for v in got.values()) - hits
    assert hits / 120 >= 0.8 and wrong / max(1, hits + wrong) <= 0.1


# mixing and top-k


def test_mixing_equals_sql_on_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else i // 2, prose(i, r.randint(0, 30)) if i % 17 else None, ["a", "b", "c", None][i % 4]) for i in range(400)] + [(7, "one two", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    plain = lambda rows: sorted(tuple("" if x is None else f"{float(x):.6f}" for x in r) for r in rows)
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert plain(map(tuple, got)) == plain(con.execute(mixing.SQL).fetchall())


def test_top_k_of_repeated_query_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [0.1, 0.1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    # the smallest vector stands for the id, and rows of the id itself are no candidates
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 2, 128 * 256), (2, 1, 64 * 256)]


# near-duplicates


def test_near_duplicates_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want, sizes = brute_components(rows, 4, 80)
    got = {x["doc_id"]: (x["component_id"], x["n_shingles"]) for x in neardup.components(docs, shingle=4).collect()}
    assert got == {i: (want[i], sizes[i]) for i in want}


def test_tiles_stay_small_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 20)
    n, k = 700, 600
    known = spark.range(n).select(F.col("id").alias("rep"), F.lit(1).alias("family"), F.col("id").alias("part"), F.lit(bytes(32)).alias("short"), F.lit(n).alias("n"), F.lit(k).alias("k"))
    tiles = neardup._tiles(known, known.where(F.col("rep") < k), "family")
    sizes = tiles.groupBy("own", "other", "role").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3 * 20
    # every open row meets every known one exactly once
    met = tiles.where("role = 1").select("own", "other", F.col("rep").alias("a")).join(tiles.where("role = 0").select("own", "other", F.col("rep").alias("b")), ["own", "other"])
    assert met.count() == n * k == met.distinct().count()


def test_near_duplicates_in_a_large_family_that_does_not_link(spark, monkeypatch):
    for name, value in (("NODE", 4), ("BLOCK", 8), ("ANCHORS", 2), ("TILE", 8), ("DEPTH", 3)):
        monkeypatch.setattr(neardup, name, value)
    base, rows = prose(70, 150).split(), []
    for i in range(40):  # alike, most of them below the threshold; some pairs above it
        ws = list(base)
        for j in range(8 if i % 2 else 2):
            ws[(i // 2 * 7 + j * 13) % len(ws)] = f"own{i // 2}x{j}"
        rows.append((i, " ".join(ws)))
    want, _ = brute_components(rows, 4, 80)
    got = {x["doc_id"]: x["component_id"] for x in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == want and len(set(want.values())) > 5


def test_texts_of_one_id_are_linked_and_long_texts_are_whole(spark):
    long = prose(1, 30000)
    rows = [(5, prose(2, 50)), (5, prose(3, 50)), (7, prose(3, 50)), (3, prose(2, 50)), (9, long + " end"), (8, long), (10, prose(4, 40)), (11, None)]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (9, 8, False), (10, 10, True), (11, 11, True)]


# pipeline, stage by stage


def test_pipeline_stages_equal_plain_programs(spark, tmp_path):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = {r["doc_id"]: r for r in docs.collect()}

    fitted = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    keep = {i for i, r in rows.items() if fitted[0].score(np.array([quality.statistics(r["text"] or "")]))[0] >= 0.5}
    first = cut(p.keep_quality(spark, docs, sf))
    assert {r["doc_id"] for r in first.collect()} == keep

    want, _ = brute_components([(i, rows[i]["text"]) for i in sorted(keep)], 5, 80)
    second = cut(p.drop_near_duplicates(spark, first, sf))
    assert sorted(r["doc_id"] for r in second.collect()) == sorted({*want.values()})

    scanner = secrets.Scanner(secrets.train(second))
    third = cut(p.redact_secrets(spark, second, sf))
    for r in third.collect():
        text = rows[r["doc_id"]]["text"]
        for s in reversed(scanner.spans([text])[0]):
            text = text[: s["begin"]] + "[SECRET]" + text[s["end"] :] if s["end"] <= len(text) else text
        assert r["n_chars"] == len(r["text"]) and (r["text"] == text or len(scanner.spans([rows[r["doc_id"]]["text"]])[0]) > 1)

    fourth = cut(p.mix_sources(spark, third, sf))
    third.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    copies = {i: t // s for i, s, _, _, t in con.execute(mixing.SQL).fetchall() if s and t // s}
    got = defaultdict(int)
    for r in fourth.collect():
        got[r["doc_id"]] += 1
    assert dict(got) == copies

    tok = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    for r in p.encode_tokens(spark, fourth, sf).dropDuplicates(["doc_id"]).collect():
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["round_trip"]



def test_pipeline_mixing_shuffles_no_text(spark):
    """With and without ids and sources: documents meet one row for each source, not one for each id."""
    import corpus_pipeline as p

    r = random.Random(12)
    rows = [(i if i % 9 else None, prose(i, r.randint(0, 30)) if i % 13 else None, "en", [None, "a", "b", "c"][i % 4], 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = p.mix_sources(spark, docs, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("doc_id" in x.split("Join", 1)[1] for x in plan.splitlines() if "Join" in x), plan
    got = [tuple(x) for x in found.collect()]
    con = duckdb.connect()
    docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}).pipe(lambda d: con.register("documents", d))
    want = defaultdict(int)
    for i, s, _, _, t in con.execute(mixing.SQL).fetchall():
        want[i] += t // s if s else 0
    count = defaultdict(int)
    for x in got:
        count[x[0]] += 1
    assert dict(count) == {i: n for i, n in want.items() if n}
