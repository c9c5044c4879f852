"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Three patterns give the base spans: assignments to a telling name, access key ids
and long hexadecimal runs.  The conditional random field tags tokens as begin,
inside or outside of a secret.  Its features are a token's shape, the words before
and after it, and features of the file; it is decoded by Viterbi.  It adds spans of
kind ``crf`` where no base span is.

The field is trained here, on what the base patterns mark in a bounded sample: of
``MARKED`` texts with a base span and ``OTHERS`` texts (those with the smallest hash of
their id) all windows of the whole texts are drawn from, and the ``AT_MARKS`` windows
around a mark and ``ELSEWHERE`` other windows with the smallest hash are learnt from,
however they are spread over the texts.  Neighbours are hidden or exchanged at random
while it learns, so that it also knows a secret by its own shape, and tagging is
cautious: a span's score must beat the score of the same tokens outside by ``CAUTION``.

Decoding is exact and skips most tokens: where "outside" leads by more than any two
transitions can change, the best path is outside whatever the neighbours are, so
the chain falls into short pieces between such tokens.

Defined results: null text counts as empty and has no spans; repeated rows are
scanned each for itself; an empty table gives an empty one; without any base span in
the sample nothing is added; other columns stay, but one with the name of the new one
is replaced.  Begin and end count code points, end is exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm.common import map_batches, small_batches

MARKED, OTHERS, AROUND = 800, 800, 10
AT_MARKS, ELSEWHERE = 2500, 4000
CAUTION = 4.0
STEPS = 50
TABLE = 300_000
KINDS = ("assign", "access", "hex", "crf")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]+")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(begin, kind, end, begin of the secret itself), in order."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


# --- features -----------------------------------------------------------------

SPACE = 1 << 13
WIDTH = 12


def _hashed(names: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(x) % (SPACE - 1) + 1 for x in names]


@lru_cache(maxsize=10_000)
def _plain(size: int, case: str, end: str) -> list[int]:
    """Features of a word of letters, all but the word itself."""
    names = [f"n{size}", f"c{case}", "t0", "e-", f"p{case}{end}", "hFalse", "d0", f"s{size}{case}", f"m{end}", f"x{end}", f"u{case}{size}"]
    return _hashed(names)


def shape(token: str) -> list[int]:
    """Hashed features of one token; 0 is none."""
    n = len(token)
    word, end = (token[:-1], ".") if token[-1] == "." else (token, "")
    if word.isalpha():
        case = "l" if word.islower() else "u" if word.isupper() else "t" if word[1:].islower() else "m"
        own = xxhash.xxh32_intdigest("w" + word.lower()) % (SPACE - 1) + 1 if n < 12 else 0
        return [own, *_plain(min(12, int(math.log2(n) * 2)), case, end)]
    upper, lower, digit = sum(c.isupper() for c in token), sum(c.islower() for c in token), sum(c.isdigit() for c in token)
    turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(token, token[1:]))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(token).values())
    pattern = re.sub(r"(.)\1+", r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token))
    size = min(12, int(math.log2(n) * 2))
    names = [
        f"w{token.lower()}" if n < 12 and digit == 0 else "w*", f"n{size}", f"c{upper > 0}{lower > 0}{digit > 0}{upper + lower + digit < n}", f"t{min(turns, 6)}", f"e{int(entropy * 2)}", f"p{pattern}" if len(pattern) < 13 else "p*",
        f"h{bool(digit) and set(token) <= set('0123456789abcdef')}{n > 15}", f"d{int(4 * digit / n)}{n > 7}", f"s{size}{min(turns, 6)}{lower > 0}{upper > 0}",
        f"m{token[:1] if not token[:1].isalnum() else ''}", f"x{'.' in token}{'-' in token}{'/' in token}", f"u{upper == n}{n > 11}",
    ]
    return _hashed(names)


def file_features(text: str, tokens: int) -> np.ndarray:
    """Features of a file, in a row."""
    n = len(text) or 1
    return np.array([1.0, min(1.0, 20 * text.count("=") / n), min(1.0, 40 * text.count("\n") / n), min(1.0, 20 * text.count('"') / n), min(1.0, math.log1p(tokens) / 10)])


class Field:
    """Weights: four roles of a token (its own, previous, the one before, next), file and transitions."""

    def __init__(self):
        self.roles = np.zeros((4, SPACE, 3))
        self.file = np.zeros((5, 3))
        self.moves = np.zeros((3, 3))
        self.file[0] = (-1.0, -1.0, 1.0)

    def emissions(self, table: np.ndarray) -> np.ndarray:
        """(4, tokens, 3) for a table of features (tokens, WIDTH)."""
        return self.roles[:, table].sum(2)

    def certain(self) -> float:
        """Lead of "outside" from which it is on every best path."""
        m, o = self.moves, 2
        return max(m[a, x] + m[x, b] - m[a, o] - m[o, b] for x in (0, 1) for a in range(3) for b in range(3))


def viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of one piece that has an outside token on either side."""
    best = e[0] + moves[2]
    back = []
    for row in e[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    tag = int((best + moves[:, 2]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


def fit(windows: list[tuple[list[str], list[int], np.ndarray]], steps: int = STEPS, seed: int = 3) -> Field | None:
    """Maximise the likelihood of tagged windows (tokens, tags, file features)."""
    if not any(min(tags) < 2 for _, tags, _ in windows):
        return None
    names: dict[str, int] = {}
    t = max(len(w) for w, _, _ in windows)
    ids = np.zeros((len(windows), t), int)
    gold = np.full((len(windows), t), 2)
    mask = np.zeros((len(windows), t), bool)
    for k, (w, tags, _) in enumerate(windows):
        ids[k, : len(w)] = [names.setdefault(x, len(names)) + 1 for x in w]
        gold[k, : len(w)], mask[k, : len(w)] = tags, True
    table = np.zeros((len(names) + 1, WIDTH), int)
    for x, i in names.items():
        table[i + 1] = shape(x)
    files = np.array([f for _, _, f in windows])
    flat = ids[mask]
    pad = np.zeros((len(windows), 2), int)
    wide = np.hstack([pad, ids, pad])
    roles = [wide[:, 2 : 2 + t], wide[:, 1 : 1 + t], wide[:, 0:t], wide[:, 3 : 3 + t]]
    field, rng = Field(), np.random.default_rng(seed)
    params = [field.roles, field.file, field.moves]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(3)[gold] * mask[:, :, None]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for step in range(1, steps + 1):
        # a neighbour is hidden, or another token stands in its place, so that it does not decide alone
        hide = [np.ones((len(windows), t, 1)), *((rng.random((len(windows), t, 1)) > 0.3).astype(float) for _ in range(3))]
        seen = [roles[0], *(np.where(rng.random(ids.shape) < 0.3, flat[rng.integers(0, len(flat), ids.shape)], at) for at in roles[1:])]
        tables = field.emissions(table)
        e = sum(tables[r][seen[r]] * hide[r] for r in range(4)) + (files @ field.file)[:, None, :]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, t):
            nxt = lse(alpha[:, k - 1, :, None] + field.moves, 1) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], nxt, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            prev = lse((beta[:, k + 1] + e[:, k + 1])[:, None, :] + field.moves, 2)
            beta[:, k] = np.where(mask[:, k + 1, None], prev, 0)
        z = lse(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = alpha[:, :-1, :, None] + field.moves + (beta[:, 1:] + e[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        rest = (post - one) / len(windows)
        grads = [np.zeros_like(field.roles), np.einsum("bf,btk->fk", files, rest), (expected - gold_moves) / len(windows)]
        for r in range(4):
            at, g = seen[r].ravel(), (rest * hide[r]).reshape(-1, 3)
            for k in range(3):
                by_token = np.bincount(at, weights=g[:, k], minlength=len(table))
                grads[0][r, :, k] = np.bincount(table.ravel(), weights=np.repeat(by_token, WIDTH), minlength=SPACE)
            grads[0][r, 0] = 0
        for i, (p, g) in enumerate(zip(params, grads)):
            g = g + 1e-4 * p
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p -= 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return field


def windows_of(text: str, marked: list[tuple[int, int, int, int]]) -> list[tuple[bool, int, list[str], list[int], list[float]]]:
    """All windows of a text: (around a mark or not, hash, tokens, tags, file features)."""
    found = list(TOKEN.finditer(text))
    tags = [2] * len(found)
    centres = []
    k = 0
    for begin, _, end, secret in marked:
        k = next((i for i in range(k, len(found)) if found[i].end() > secret), len(found))
        first = True
        i = k
        while i < len(found) and found[i].start() < end:
            tags[i] = 0 if first else 1
            if first:
                centres.append(i)
            first, i = False, i + 1
    file = file_features(text, len(found)).tolist()
    places = [*((True, i) for i in centres), *((False, i) for i in range(0, len(found), 2 * AROUND))]
    tokens = [m.group() for m in found]
    return [(at, xxhash.xxh3_64_intdigest(f"{i} {' '.join(tokens[max(0, i - AROUND) : i + AROUND])}") >> 1, tokens[max(0, i - AROUND) : i + AROUND], tags[max(0, i - AROUND) : i + AROUND], file) for at, i in places]


class Scanner:
    """Base and added spans of whole texts; keeps emissions of tokens it has seen."""

    def __init__(self, field: Field | None):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((4, 1, 3), np.float32)

    def added(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of the field in each text, in code points."""
        field = self.field
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if field is None:
            return out
        if len(self.ids) > TABLE:
            self.clear()
        docs = [TOKEN.findall(t) for t in texts]
        fresh = list({w for d in docs for w in d if w not in self.ids})
        if fresh:
            self.ids |= {w: self.rows.shape[1] + i for i, w in enumerate(fresh)}
            new = [field.emissions(np.array([shape(w) for w in fresh[i : i + 20_000]])) for i in range(0, len(fresh), 20_000)]
            self.rows = np.concatenate([self.rows, *(x.astype(np.float32) for x in new)], axis=1)
        get, certain = self.ids.__getitem__, field.certain()
        for k, (text, d) in enumerate(zip(texts, docs)):
            if not d:
                continue
            ids = np.zeros(len(d) + 3, np.int32)
            ids[2:-1] = np.fromiter(map(get, d), np.int32, len(d))
            e = self.rows[0][ids[2:-1]] + self.rows[1][ids[1:-2]] + self.rows[2][ids[:-3]] + self.rows[3][ids[3:]]
            e = e + (file_features(text, len(d)) @ field.file).astype(np.float32)
            open_ = np.flatnonzero(e[:, 2] - np.maximum(e[:, 0], e[:, 1]) <= certain)
            if not len(open_):
                continue
            places = None
            for piece in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                rows = e[piece].astype(np.float64)
                tags = viterbi(rows, field.moves)
                i = 0
                while i < len(tags):
                    if tags[i] == 2:
                        i += 1
                        continue
                    j = i + 1
                    while j < len(tags) and tags[j] == 1:
                        j += 1
                    lead = sum(rows[x][tags[x]] - rows[x][2] for x in range(i, j))
                    if lead > CAUTION and sum(len(d[piece[x]]) for x in range(i, j)) >= 6:
                        places = places or [m.span() for m in TOKEN.finditer(text)]
                        out[k].append((places[piece[i]][0], places[piece[j - 1]][1]))
                    i = j
        return out

    def spans(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for text, more in zip(texts, self.added(texts)):
            base = [(b, k, e) for b, k, e, _ in base_spans(text)]
            extra = [(b, 3, e) for b, e in more if not any(x < e and b < y for x, _, y in base)]
            out.append([{"kind": KINDS[k], "begin": b, "end": e} for b, k, e in sorted(base + extra)])
        return out


def train(documents: DataFrame, id: str = "doc_id", text: str = "text") -> Field | None:
    """Fit the field on what the base patterns mark in a bounded sample."""
    by = F.xxhash64(F.col("_id").cast("string"))
    # two columns under names of our own: no other column can clash
    rows = documents.where(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_t"))
    telling = F.col("_t").rlike(r"(?i)(passw|secret|token|api_?key)[^\n]{0,4}[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    # bounded numbers of ids, so the broadcast is bounded
    ids = rows.where(telling).select("_id").distinct().orderBy(by, "_id").limit(MARKED).unionByName(rows.select("_id").distinct().orderBy(by, "_id").limit(OTHERS)).distinct()
    chosen = rows.join(F.broadcast(ids), "_id").select("_t")
    limits = {True: AT_MARKS, False: ELSEWHERE}

    def run(batches):
        for batch in batches:
            found = [w for t in batch.column(0).to_pylist() for w in windows_of(t, base_spans(t)) if w[2]]
            # those of a batch that can be among the smallest of all
            found = [w for at, most in limits.items() for w in sorted((w for w in found if w[0] == at), key=lambda w: w[1])[:most]]
            yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in found], kind) for k, kind in enumerate(kinds)], names=["at", "hash", "w", "t", "f"])

    kinds = (pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()))
    small_batches(documents.sparkSession)
    windows = chosen.mapInArrow(run, "at boolean, hash bigint, w array<string>, t array<int>, f array<double>")
    windows = windows.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["at"]: r["count"] for r in windows.groupBy("at").count().collect()}
    found = []
    for at, most in limits.items():
        # hashes are spread evenly: below this bound lie a few more than are wanted, and only these are sent
        bound = int(2.0**63 * min(1.0, (most + 8 * math.sqrt(most) + 8) / max(1, counts.get(at, 0))))
        found += windows.where((F.col("at") == at) & (F.col("hash") < min(bound, (1 << 63) - 1))).orderBy("hash", "w").limit(most).collect()
    windows.unpersist()
    return fit([(list(r["w"]), list(r["t"]), np.array(r["f"])) for r in found]) if found else None


def scan(documents: DataFrame, field: Field | None, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: spans (kind, begin, end) by begin, then kind."""
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def make():
        scanner = Scanner(sent.value)

        def run(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return [pa.array([s for k in range(0, len(texts), 500) for s in scanner.spans(texts[k : k + 500])], ARROW_SPANS)]

        return run

    return map_batches(documents, make, [T.StructField(out, T.ArrayType(SPAN))])


def redact(documents: DataFrame, field: Field | None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span of ``text`` replaced by ``mark``; null stays null."""
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def make():
        scanner = Scanner(sent.value)

        def clean(t: str, spans: list[dict]) -> str:
            parts, at = [], 0
            for s in spans:
                if s["end"] > at:
                    parts += [t[at : max(at, s["begin"])], mark]
                    at = s["end"]
            return "".join([*parts, t[at:]])

        def run(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            done = []
            for k in range(0, len(texts), 500):
                part = [t or "" for t in texts[k : k + 500]]
                done += [None if o is None else clean(t, s) if s else t for o, t, s in zip(texts[k : k + 500], part, scanner.spans(part))]
            return [done]

        return run

    return map_batches(documents, make, [T.StructField(text, T.StringType())]).select(*documents.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digests(documents: DataFrame, field: Field | None) -> DataFrame:
    found = scan(documents.select("doc_id", "text"), field).drop("text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
