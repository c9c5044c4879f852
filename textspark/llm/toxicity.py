"""Toxicity: a bidirectional gated recurrent network over windows of words.

Input of a word is the sum of a hashed word embedding and the mean of hashed
character embeddings (trigrams of the marked word, and its beginnings of four and
five letters).  A gated recurrent network reads a window of ``WINDOW`` words both
ways, attention pools its states, and a linear layer gives the window's logit.
Windows overlap by half and cover the whole text; a text's logit is the largest of
its windows', corrected for the number of windows by a fitted line.  Everything is
numpy, trained here.

Training sees text labels only: it begins with some windows of each text under the
text's label and then goes on with the window of the largest logit (and, for clean
texts, the hardest ones), the usual way for labels of bags.  Then the tasks score all
windows of the whole sampled texts with the network as it is and send the ``KEPT``
highest ones of each text, which are learnt from as well, so the toxic passage of a long
text counts wherever it stands.

The network is fitted on the driver on a bounded sample of labelled texts: at most
``TOXIC`` and ``CLEAN`` texts, those with the smallest hash of their id, of which one in
``HELD`` only calibrates the line.  All documents are scored whole.  A word's input
products are computed once and kept in a bounded table of the task.

Defined results: null text counts as empty; a text without words is one empty
window and has a score like any other; repeated rows and ties have equal scores;
labels that are null are no labels, and a document labelled twice is toxic if one
label says so; without texts of both kinds every score is 0; other columns stay, but one
with the name of the new one is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm.common import map_batches

TOXIC, CLEAN, KEPT = 1250, 3000, 8
#: One text of so many of the sample only calibrates.
HELD = 8
WINDOW, STRIDE = 24, 12
HIDDEN, WIDTH, BUCKETS = 8, 12, 1 << 14
EPOCHS, AGAIN, BATCH = 8, 2, 384
#: Words whose input products a task keeps.
TABLE = 200_000
_STRIP = ".,;:!?\"'()[]{}*%&$#|<>-_"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; character buckets of all words one after the other, and where each word's begin."""
    bare = [w.strip(_STRIP) or w for w in words]
    own = np.array([xxhash.xxh32_intdigest(w) % BUCKETS for w in bare], np.int32)
    codes = np.frombuffer("".join([f"^{w}$" for w in bare]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in bare])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int32)  # noqa: E731  14 bits
    padded = np.concatenate([codes, np.zeros(4, np.uint64)])
    k = np.uint64(0x100000001B3)
    three = (padded[:-4] * k + padded[1:-3]) * k + padded[2:-2]
    # beginnings end with their word, so a word's buckets don't depend on the one after it
    four = three[starts] * k + np.where(sizes > 3, padded[starts + 3], np.uint64(0))
    five = four * k + np.where(sizes > 4, padded[starts + 4], np.uint64(0))
    # a word of n letters has n trigrams (n + 2 marked letters), and its beginnings stand in the last two places
    out = mix(three)
    last = starts + sizes - 1
    out[last - 1] = mix(four ^ np.uint64(4))
    out[last] = mix(five ^ np.uint64(5))
    return own, out, starts


class Recurrent:
    """Parameters, forward and backward pass, and Adam."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, 1, s).astype(np.float32)
        self.p = {
            "word": n(BUCKETS, WIDTH) * 0.03, "char": n(BUCKETS, WIDTH) * 0.1, "w": n(2, WIDTH, 3 * HIDDEN) / math.sqrt(WIDTH), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "u": n(2, HIDDEN, 3 * HIDDEN) / math.sqrt(HIDDEN), "a": n(2 * HIDDEN) * 0.3, "o": n(2 * HIDDEN) * 0.3, "c": np.full(1, -1.0, np.float32),
        }
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        self.line = (0.0, 0.0, 1.0)

    @classmethod
    def of(cls, p: dict, line: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> Recurrent:
        """A network that only reads."""
        net = cls.__new__(cls)
        net.p, net.line = p, line
        return net

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        own, chars, starts = hashed(words)
        counts = np.diff(np.append(starts, len(chars))).astype(np.float32)
        x = self.p["word"][own] + np.add.reduceat(self.p["char"][chars], starts, axis=0) / counts[:, None]
        return x, (own, chars, starts, counts)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Input products of each word for both directions: (words, 2 * 3 * HIDDEN)."""
        return np.concatenate([x @ self.p["w"][0] + self.p["b"][0], x @ self.p["w"][1] + self.p["b"][1]], axis=1)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; x: (WINDOW, B, 2 * 3 * HIDDEN), mask: (WINDOW, B)."""
        t, b, h3 = len(x), x.shape[1], 3 * HIDDEN
        h = np.zeros((2, b, HIDDEN), np.float32)
        states = np.empty((t, b, 2 * HIDDEN), np.float32)
        held = []
        u = self.p["u"]
        xs = np.empty((2, b, h3), np.float32)
        for k in range(t):
            xs[0], xs[1] = x[k, :, :h3], x[t - 1 - k, :, h3:]
            g = h @ u
            zr = 1 / (1 + np.exp(-(xs[:, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN])))
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            gn = g[:, :, 2 * HIDDEN :]
            c = np.tanh(xs[:, :, 2 * HIDDEN :] + r * gn)
            if keep:
                held.append((h, z, r, gn, c))
            h = c + z * (h - c)
            states[k, :, :HIDDEN], states[t - 1 - k, :, HIDDEN:] = h[0], h[1]
        score = states @ self.p["a"]
        score = np.where(mask, score, np.float32(-30))
        e = np.exp(score - score.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (states, alpha, pooled, held)) if keep else logit

    def learn(self, words: list[str], index: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step on windows ``index`` (B, WINDOW) into ``words``; -1 is no word."""
        flat, inverse = np.unique(index, return_inverse=True)
        inverse = inverse.reshape(index.shape)
        none = int(flat[0] == -1)
        known = [words[i] for i in flat[none:]]
        emb, (own, chars, starts, counts) = self.embed(known) if known else (np.zeros((0, WIDTH), np.float32), (None,) * 4)
        rows = self.inputs(emb)
        if none:
            rows = np.vstack([np.zeros((1, rows.shape[1]), np.float32), rows])
        x = rows[inverse.T]
        mask = index.T >= 0
        logit, (states, alpha, pooled, held) = self.run(x, mask, keep=True)
        y = 1 / (1 + np.exp(-logit))
        g = ((y - target) * weight / weight.sum()).astype(np.float32)
        grad = {"o": pooled.T @ g, "c": g.sum(keepdims=True)}
        dpooled = g[:, None] * self.p["o"]
        da = (states * dpooled).sum(2)
        ds = alpha * (da - (alpha * da).sum(0)) * mask
        dstates = alpha[:, :, None] * dpooled + ds[:, :, None] * self.p["a"]
        grad["a"] = (ds[:, :, None] * states).sum((0, 1))
        du = np.zeros_like(self.p["u"])
        dx = np.zeros_like(x)
        dh = np.zeros((2, x.shape[1], HIDDEN), np.float32)
        t, h3 = len(x), 3 * HIDDEN
        for k in range(t - 1, -1, -1):
            h, z, r, gn, c = held[k]
            dh = dh + np.stack([dstates[k, :, :HIDDEN], dstates[t - 1 - k, :, HIDDEN:]])
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=2)
            dxs = np.concatenate([dz, dr, dc], axis=2)
            du += h.transpose(0, 2, 1) @ dg
            dx[k, :, :h3] += dxs[0]
            dx[t - 1 - k, :, h3:] += dxs[1]
            dh = dh * z + dg @ self.p["u"].transpose(0, 2, 1)
        grad["u"] = du
        drows = np.zeros_like(rows)
        order = np.argsort(inverse.T.ravel(), kind="stable")
        cuts = np.searchsorted(inverse.T.ravel()[order], np.arange(len(rows)))
        drows = np.add.reduceat(dx.reshape(-1, dx.shape[2])[order], cuts, axis=0)[none:]
        both = (drows[:, :h3], drows[:, h3:])
        grad["w"] = np.stack([emb.T @ d for d in both])
        grad["b"] = np.stack([d.sum(0, keepdims=True) for d in both])
        if known:
            demb = both[0] @ self.p["w"][0].T + both[1] @ self.p["w"][1].T
            grad["word"], grad["char"] = (own, demb), (chars, np.repeat(demb / counts[:, None], np.diff(np.append(starts, len(chars))), axis=0))
        self.step(grad, rate)
        return float((-(target * np.log(y + 1e-9) + (1 - target) * np.log(1 - y + 1e-9)) * weight).sum() / weight.sum())

    def step(self, grad: dict, rate: float) -> None:
        self.t += 1
        for k, g in grad.items():
            p, m, v = self.p[k], self.m[k], self.v[k]
            if isinstance(g, tuple):  # rows that took part
                at, inverse = np.unique(g[0], return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                g = np.add.reduceat(g[1][order], np.searchsorted(inverse[order], np.arange(len(at))), axis=0)
            else:
                at = slice(None)
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            p[at] -= rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-7)


def windows(n: int) -> np.ndarray:
    """Positions of the words of all overlapping windows of n words; -1 beyond the end."""
    starts = np.arange(max(1, math.ceil((n - WINDOW) / STRIDE) + 1)) * STRIDE
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


class Scorer:
    """Scores whole texts; keeps the input products of words it has seen."""

    def __init__(self, net: Recurrent):
        self.net, self.ids = net, {}
        self.rows = np.zeros((1, 6 * HIDDEN), np.float32)

    def window_logits(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, logits of all windows one text after the other, and numbers of windows."""
        if len(self.ids) > TABLE:
            self.ids, self.rows = {}, self.rows[:1]
        docs = [words_of(t) for t in texts]
        fresh = list({w for d in docs for w in d if w not in self.ids})
        if fresh:
            self.ids |= {w: len(self.rows) + i for i, w in enumerate(fresh)}
            new = [self.net.inputs(self.net.embed(fresh[i : i + 50_000])[0]) for i in range(0, len(fresh), 50_000)]
            self.rows = np.concatenate([self.rows, *new])
        ids, index, counts, base = [], [], [], 0
        get = self.ids.__getitem__
        for d in docs:
            at = windows(len(d))
            index.append(np.where(at >= 0, at + base, -1))
            counts.append(len(at))
            ids.append(np.fromiter(map(get, d), np.int32, len(d)))
            base += len(d)
        flat = np.append(np.concatenate(ids), np.int32(0))  # the last one stands for no word
        at = flat[np.concatenate(index)]
        found = np.empty(len(at), np.float32)
        for k in range(0, len(at), 2048):
            part = at[k : k + 2048].T
            found[k : k + 2048] = self.net.run(self.rows[part], part > 0)
        return docs, found, np.array(counts)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Largest window logit of each text, and its number of windows."""
        _, found, counts = self.window_logits(texts)
        return np.maximum.reduceat(found, np.concatenate([[0], np.cumsum(counts)[:-1]])), counts

    def highest(self, texts: list[str], kept: int = KEPT) -> list[list[str]]:
        """The windows of the largest logits of each whole text (ties: the earlier one)."""
        docs, found, counts = self.window_logits(texts)
        out, at = [], 0
        for d, n in zip(docs, counts.tolist()):
            places = np.argsort(-found[at : at + n], kind="stable")[:kept]
            out.append([" ".join(d[i * STRIDE : i * STRIDE + WINDOW]) for i in places.tolist()])
            at += n
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for part in parts(texts):
            top, n = self.logits(part)
            a, b, c = self.net.line
            out.append(1 / (1 + np.exp(-np.clip(a + c * top - b * np.log(n), -30, 30).astype(float))))
        return np.concatenate(out) if out else np.zeros(0)


def parts(texts: list[str], most: int = 1_000_000):
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def sampled(text: str, kept: int = KEPT) -> list[str]:
    """Up to ``kept`` windows to begin with, those with the smallest hash."""
    ws = words_of(text)
    found = [" ".join(ws[i] for i in row if i >= 0) for row in windows(len(ws))]
    return sorted(found, key=xxhash.xxh64_intdigest)[:kept] if len(found) > kept else found


def fit(bags: list[tuple], seed: int = 11, net: Recurrent | None = None) -> Recurrent | None:
    """Fit on (windows, label, ...) of texts, or go on with ``net``; None unless both labels occur."""
    labels = np.array([b[1] for b in bags], dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    names: dict[str, int] = {}
    rows, owner = [], []
    for k, bag in enumerate(bags):
        for w in bag[0]:
            ids = [names.setdefault(x, len(names)) for x in w.split()[:WINDOW]]
            rows.append(ids + [-1] * (WINDOW - len(ids)))
            owner.append(k)
    index, owner, words = np.array(rows), np.array(owner), list(names)
    rng = np.random.default_rng(seed)
    y = labels[owner]
    few = np.minimum(1.0, len(y) / 20_000)
    epochs = range(EPOCHS + int(EPOCHS * 2 * (1 - few))) if net is None else range(EPOCHS, EPOCHS + AGAIN)
    net = net or Recurrent(seed)
    for epoch in epochs:
        if epoch < 2:
            use = rng.permutation(len(index))
            weight = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0).clip(0, 5)
        else:
            table = net.inputs(net.embed(words)[0])
            table = np.vstack([table, np.zeros((1, table.shape[1]), np.float32)])
            logit = np.concatenate([net.run(table[index[k : k + 2048].T], index[k : k + 2048].T >= 0) for k in range(0, len(index), 2048)])
            order = np.lexsort((-logit, owner))
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order)) - np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(bags)))[:-1]])[owner[order]]
            # a toxic text has at least one toxic window; all of a clean text's are clean
            use = rng.permutation(np.flatnonzero(np.where(y == 1, place == 0, place < 3)))
            weight = np.ones(len(y))
        rate = 0.02 if epoch < EPOCHS // 2 else 0.005
        for k in range(0, len(use), BATCH):
            part = use[k : k + BATCH]
            net.learn(words, index[part], y[part], weight[part], rate)
    return net


def line(top: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 0.003, steps: int = 25) -> tuple[float, float, float]:
    """Logistic line (offset, per log of windows, per logit), by Newton steps from (0, 0, 1)."""
    x = np.stack([np.ones(len(top)), np.log(n), np.clip(top, -12, 12)], 1)
    start = np.array([0.0, 0.0, 1.0])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).mean() + ridge / 2 * ((w - start) ** 2).sum())

    w = start.copy()
    for _ in range(steps):
        q = 0.5 * (1 + np.tanh(x @ w / 2))
        g = x.T @ (q - y) / len(y) + ridge * (w - start)
        h = (x * (q * (1 - q))[:, None]).T @ x / len(y) + ridge * np.eye(3)
        move, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-3 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
    return float(w[0]), float(-w[1]), float(w[2])


def train(documents: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Recurrent | None:
    """Fit on labelled documents for which ``learn`` (over the id) holds."""
    spark = documents.sparkSession
    by = F.xxhash64(F.col("_id").cast("string"))
    # two columns of each table under names of our own: no other column can clash
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_t"))
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    # a bounded number of ids reaches the driver
    picked = [[r["_id"] for r in known.where(F.col("_y") == y).orderBy(by, "_id").limit(n).collect()] for y, n in ((0, CLEAN), (1, TOXIC))]
    parts_of = {"fit": [(i, y) for y, ids in enumerate(picked) for i in ids[: len(ids) - len(ids) // HELD]], "line": [(i, y) for y, ids in enumerate(picked) for i in ids[len(ids) - len(ids) // HELD :]]}
    schema = T.StructType([T.StructField("_id", known.schema["_id"].dataType), T.StructField("_y", T.IntegerType())])
    chosen = {k: docs.join(F.broadcast(spark.createDataFrame([(i, int(y)) for i, y in rows], schema)), "_id") for k, rows in parts_of.items()}

    def bags(make) -> list[tuple[list[str], int, object]]:
        found = map_batches(chosen["fit"], make, [T.StructField("_w", T.ArrayType(T.StringType()))], keep=["_id", "_y"]).collect()
        return [(list(r["_w"]), r["_y"], r["_id"]) for r in sorted(found, key=lambda r: (r["_id"], r["_w"]))]

    def column(batch: pa.RecordBatch) -> list[str]:
        return [t or "" for t in batch.column(batch.schema.get_field_index("_t")).to_pylist()]

    first = bags(lambda: lambda batch: [pa.array([sampled(t) for t in column(batch)], pa.list_(pa.string()))])
    net = fit(first)
    if net is None:
        return None

    def hardest():
        scorer = Scorer(Recurrent.of(sent.value))
        return lambda batch: [pa.array([w for p in parts(column(batch)) for w in scorer.highest(p)], pa.list_(pa.string()))]

    def measure():
        scorer = Scorer(Recurrent.of(sent.value))

        def run(batch: pa.RecordBatch) -> list:
            found = [scorer.logits(p) for p in parts(column(batch))]
            return [pa.array(np.concatenate([f[0] for f in found]).astype(float)), pa.array(np.concatenate([f[1] for f in found]).astype(float))]

        return run

    sent = spark.sparkContext.broadcast(net.p)
    # texts of a repeated id share one bag of windows
    every: dict = {}
    for ws, y, k in [*first, *bags(hardest)]:
        every.setdefault(k, ([], y))[0].extend(ws)
    net = fit([(list(dict.fromkeys(ws)), y, k) for k, (ws, y) in every.items()], net=net)
    sent = spark.sparkContext.broadcast(net.p)
    rows = map_batches(chosen["line"], measure, [T.StructField("_top", T.DoubleType()), T.StructField("_n", T.DoubleType())], keep=["_id", "_y"]).collect()
    rows.sort()
    if len({r["_y"] for r in rows}) == 2:
        net.line = line(*(np.array([r[k] for r in rows], dtype=float) for k in ("_top", "_n", "_y")))
    return net


def score(documents: DataFrame, net: Recurrent | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: 0 to 1, higher for texts more likely toxic."""
    sent = documents.sparkSession.sparkContext.broadcast(net and {"p": net.p, "line": net.line})

    def make():
        if sent.value is None:
            return lambda batch: [[0.0] * batch.num_rows]
        scorer = Scorer(Recurrent.of(**sent.value))
        return lambda batch: [pa.array(scorer.scores([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]))]

    return map_batches(documents, make, [T.StructField(out, T.DoubleType())])
