"""Quality classifier by positive-unlabelled learning.

Only trusted good texts are labelled; everything else is unlabelled web text that
holds good and bad.  A small network on document statistics minimises the
non-negative unbiased risk

    pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])

with the sigmoid loss.  When the second part falls below zero the step follows
its opposite, so the network can't drive the unlabelled risk negative.  The class
prior ``pi`` is estimated: a first classifier of trusted against unlabelled texts
orders the texts, and the ratios of the unlabelled to the trusted share above a
threshold bound pi, closely where the region above holds no bad text.

The network is fitted on the driver on bounded samples (``POSITIVES`` trusted and
``UNLABELLED`` other texts, those with the smallest hash of their id, whole texts);
only statistics of these reach the driver.  All documents are scored.

Defined results: null text counts as empty; an empty text has statistics of zero
and a score like any other; repeated rows and ties have equal scores; labels that
are null are no labels, and a document labelled twice is trusted only if all its
labels are good; without any trusted text every score is 0.5; an empty table gives
an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm.common import map_batches

POSITIVES = 4000
UNLABELLED = 8000
HIDDEN = 16
EPOCHS = 60

_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_COMMON = b".,;:'\"-()?"
_MARKS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _COMMON)
NAMES = ("log_words", "distinct", "top_word", "repeats", "upper", "letters", "digits", "marks", "common", "spaces", "word_length", "lines", "distinct_lines", "words_with_marks", "log_line", "distinct_pairs")


def statistics(text: str) -> list[float]:
    """What the classifier sees of a whole text."""
    raw = text.encode()
    n = len(raw) or 1
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    words = raw.split()
    w = len(words) or 1
    counts = Counter(words)
    lines = raw.split(b"\n")
    letters = share(_LETTERS)
    marked = len(b" ".join(words).translate(None, bytes(b for b in range(256) if b not in _MARKS and b != 32)).split())
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else w
    return [
        math.log1p(len(words)), len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, share(_UPPER) / (letters or 1), letters, share(_DIGITS), share(_MARKS), share(_COMMON),
        share(_SPACE), sum(map(len, words)) / w, len(lines) / w, len(set(lines)) / len(lines), marked / w, math.log1p(n / len(lines)), pairs / max(1, len(words) - 1),
    ]


class Network:
    """One hidden layer of tanh units, in numpy."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / math.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def gradient(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = g[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ g, g.sum(keepdims=True)]

    def step(self, grads: list[np.ndarray], rate: float = 0.01, decay: float = 1e-4) -> None:
        self.t += 1
        for i, g in enumerate(grads):
            g = g + decay * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.scaled(x))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _batches(rng: np.random.Generator, p: int, u: int, size: int = 256):
    order_p, order_u = rng.permutation(p), rng.permutation(u)
    for k in range(0, u, size):
        yield order_p[np.arange(k, k + size) % p], order_u[k : k + size]


def estimate_prior(scores_p: np.ndarray, scores_u: np.ndarray, least: float = 0.5) -> float:
    """Lower quartile of the ratios of unlabelled to trusted shares above a threshold.

    Every such ratio bounds the prior from above, and is near it where few bad texts
    lie above the threshold; the least ratio of all would follow the noise instead.
    """
    if not len(scores_p) or not len(scores_u):
        return 0.5
    cuts = np.quantile(scores_p, np.linspace(0.05, 1 - least, 60))
    ratios = [(scores_u >= t).mean() / (scores_p >= t).mean() for t in cuts]
    return float(np.clip(np.quantile(ratios, 0.25), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> tuple[Network, float]:
    """The network and the estimated class prior."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    net = Network(mean, scale, seed=seed)
    p, u = net.scaled(positive), net.scaled(unlabelled)
    # each half is scored by a classifier of the other, which does not know its trusted texts
    half_p, half_u = (rng.permutation(len(x)) % 2 for x in (p, u))
    held_p, held_u = np.zeros(len(p)), np.zeros(len(u))
    for k in (0, 1):
        first = Network(mean, scale, seed=seed)
        p1, u1 = p[half_p != k], u[half_u != k]
        for _ in range(max(4, EPOCHS // 3) if len(p1) and len(u1) else 0):
            for i, j in _batches(rng, len(p1), len(u1)):
                grads = []
                for x, y in ((p1[i], 1.0), (u1[j], 0.0)):
                    f, h = first.forward(x)
                    grads.append(first.gradient(x, h, (sigmoid(f) - y) / len(x)))
                first.step([a + b for a, b in zip(*grads)])
        held_p[half_p == k], held_u[half_u == k] = first.forward(p[half_p == k])[0], first.forward(u[half_u == k])[0]
    prior = estimate_prior(held_p, held_u)
    net = Network(mean, scale, seed=seed + 1)
    for _ in range(EPOCHS):
        for i, j in _batches(rng, len(p), len(u)):
            xp, xu = p[i], u[j]
            (fp, hp), (fu, hu) = net.forward(xp), net.forward(xu)
            sp, su = sigmoid(fp), sigmoid(fu)  # loss of calling f negative; 1 - s of calling it positive
            negative = su.mean() - prior * sp.mean()
            dp, du = sp * (1 - sp), su * (1 - su)
            if negative >= 0:
                grad = [a + b for a, b in zip(net.gradient(xp, hp, -2 * prior * dp / len(xp)), net.gradient(xu, hu, du / len(xu)))]
            else:  # follow the opposite of the part that fell below zero
                grad = [a + b for a, b in zip(net.gradient(xp, hp, prior * dp / len(xp)), net.gradient(xu, hu, -du / len(xu)))]
            net.step(grad)
    return net, prior


def measured(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    def make():
        return lambda batch: [pa.array([statistics(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.list_(pa.float64()))]

    return map_batches(df, make, [T.StructField(out, T.ArrayType(T.DoubleType()))])


def train(documents: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Network, float] | None:
    """Fit on documents for which ``learn`` (over the id) holds; None without a trusted text."""
    by = F.xxhash64(F.col("_id").cast("string"))
    # only two columns of each table, under names of our own: no other column can clash
    docs = documents.where(F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_t"))
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).alias("_l"))
    trusted = known.groupBy("_id").agg(F.min("_l").alias("_l")).where("_l = 1")
    chosen = trusted.orderBy(by, "_id").limit(POSITIVES).select("_id", F.lit(1).alias("_trusted"))
    other = docs.select("_id").distinct().orderBy(by, "_id").limit(POSITIVES + UNLABELLED)
    other = other.join(chosen, "_id", "left_anti").orderBy(by, "_id").limit(UNLABELLED).withColumn("_trusted", F.lit(0))
    # at most POSITIVES + UNLABELLED rows, so the broadcast is bounded
    ids = F.broadcast(chosen.unionByName(other))
    sample = measured(docs.join(ids, "_id").select("_t", "_trusted"), "_t").drop("_t").collect()
    kept = {k: np.array(sorted(tuple(r["statistics"]) for r in sample if r["_trusted"] == k)).reshape(-1, len(NAMES)) for k in (0, 1)}
    if not len(kept[1]) or not len(kept[0]):
        return None
    return fit(kept[1], kept[0])


def score(documents: DataFrame, network: Network | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: 0 to 1, higher for better texts."""
    sent = documents.sparkSession.sparkContext.broadcast(network)

    def make():
        net = sent.value

        def run(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            if net is None:
                return [[0.5] * len(texts)]
            return [pa.array(net.score(np.array([statistics(t or "") for t in texts], dtype=float).reshape(-1, len(NAMES))))]

        return run

    return map_batches(documents, make, [T.StructField(out, T.DoubleType())])
