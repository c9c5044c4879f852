"""Byte-level BPE encoding and decoding with a prefix-sharing trie.

``encode`` gives the ids that the ``tokenizers`` library gives for the same
vocabulary file (``add_special_tokens=False``, without truncation and padding);
``decode`` reverses it (``skip_special_tokens=False``).

Method.  Texts are cut into words by the vocabulary's own pattern.  The distinct
words of a batch are walked as a trie: sorted order is the depth-first order of
the trie, and the state of a node is the *last token* of the encoding of the
prefix that the node stands for.  A node's last token is the longest vocabulary
entry ``t`` that ends there and is compatible with the last token ``s`` of the
prefix before it, which means that BPE would keep ``s`` and ``t`` apart.  The
encoding of any prefix is found by following last tokens backwards, so shared
prefixes are encoded once.

Nothing is shuffled; each task holds a bounded dictionary of words it has seen.

Defined results: a null text counts as empty; an empty text has no tokens; the
other columns of the input stay, and a column with the name of a new one is
replaced; repeated rows are encoded each for itself; an empty table gives an
empty table.  Texts are processed whole, at any length.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm.common import map_batches

#: Entries of each dictionary that a worker keeps; one is emptied when it is full.
CACHE = 400_000
#: Characters that are handled together.
SLICE = 4_000_000
#: Chunks not seen before that are learnt together; the text that brings more of them is still read to its end.
FRESH = 30_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Vocabulary:
    """Tokens, the merge that makes each of them, and the words seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        self.add_space = spec["pre_tokenizer"]["add_prefix_space"]
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.begins = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        # rank of the merge that makes a token; single bytes come before all merges
        self.rank = [-1] * len(self.tokens)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[raw[a]], self.ids[raw[b]]
            whole = self.ids[self.tokens[a] + self.tokens[b]]
            self.merged.setdefault((a, b), r)
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (a, b), r
        if any(len(t) > 1 and self.rank[i] < 0 for t, i in self.ids.items()):
            raise ValueError("every token must be a byte or made by a merge")
        self.states, self.suffix, self.ending, self.goto = {b"": 0}, [b""], [[]], {}
        self.apart: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.cut = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def keeps_apart(self, left: int, right: int) -> bool:
        """Whether BPE, run over both tokens' bytes, ends with just these two.

        The merges that made both tokens are undone from the latest to the
        earliest; a merge across the border would have come first if its rank is
        below that of the merge undone last on its side.
        """
        key = left * len(self.tokens) + right
        known = self.apart.get(key)
        if known is None:
            known, a, b, before = True, left, right, len(self.rank) + 1
            while True:
                across = self.merged.get((a, b))
                if across is not None and across < before:
                    known = False
                    break
                ra, rb = self.rank[a], self.rank[b]
                if ra < 0 and rb < 0:
                    break
                if ra > rb:  # a leftmost merge of the same rank comes first, so equal ranks undo the right one
                    before, a = ra, self.parts[a][1]
                else:
                    before, b = rb + 1, self.parts[b][0]
            self.apart[key] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest suffix that begins some token."""
        s = self.suffix[state] + bytes((byte,))
        while s not in self.begins:
            s = s[1:]
        to = self.states.get(s)
        if to is None:
            to = self.states[s] = len(self.suffix)
            self.suffix.append(s)
            # tokens that end here, longest first
            self.ending.append([(t, len(s) - k) for k in range(len(s)) if (t := self.ids.get(s[k:])) is not None])
        self.goto[state << 8 | byte] = to
        return to

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are new, by one depth-first walk of their trie."""
        goto, ending, tokens, apart, keeps, chunks, n = self.goto.get, self.ending, self.tokens, self.apart.get, self.keeps_apart, self.chunks, len(self.tokens)
        last: list[int] = []  # last token of the encoding of each prefix on the path
        at = [0]  # state of each prefix on the path, the empty one first
        before = b""
        for name in sorted(words):  # code points and their UTF-8 have the same order
            word = name.encode()
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], at[shared + 1 :]
            state = at[-1]
            for end in range(shared, len(word)):
                to = goto(state << 8 | word[end])
                state = self.step(state, word[end]) if to is None else to
                at.append(state)
                for token, length in ending[state]:
                    if length > end:  # the prefix is a token, which encodes to itself
                        break
                    left = last[end - length]
                    known = apart(left * n + token)
                    if known or known is None and keeps(left, token):
                        break
                last.append(token)
            found, end = [], len(word)
            while end:
                token = last[end - 1]
                found.append(token)
                end -= len(tokens[token])
            found.reverse()
            ids = array("I", found)
            if sys.byteorder != "little":
                ids.byteswap()
            chunks[name] = ids.tobytes()
            before = word

    @staticmethod
    def chunked(text: str) -> list[str]:
        """Pieces that start at each single space before a word.

        No word of the pattern crosses such a border, and what lies on one side
        has no influence on the other.
        """
        pieces = text.split(" ")
        out = [pieces[0]]
        for p in pieces[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out if out[0] else out[1:]

    def pretokens(self, chunk: str) -> list[str]:
        """The pattern's words of a chunk; letters alone, or before one ASCII mark, need no search."""
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1:]]
        return self.cut.findall(chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        # a document is a list of ids that are known, and of one string for each chunk that is not
        docs: list[list[str | bytes]] = []
        fresh: dict[str, str] = {}
        get, once = self.chunks.get, fresh.setdefault
        for text in texts:
            doc: list[str | bytes] = []
            parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
            for part in parts:
                if part in self.special:
                    doc.append(np.array(self.special[part], "<u4").tobytes())
                elif part:
                    doc.extend([get(c) or once(c, c) for c in self.chunked(" " + part if self.add_space and not part[0].isspace() else part)])
            docs.append(doc)
            if len(fresh) > FRESH:
                out += self.settle(docs, fresh)
                docs.clear()
                fresh.clear()
        return out + self.settle(docs, fresh)

    def settle(self, docs: list[list[str | bytes]], fresh: Iterable[str]) -> list[bytes]:
        """Ids of whole documents, once the chunks in ``fresh`` are learnt.

        One dictionary holds chunks and words: the pattern leaves each of its words whole, so
        a chunk that equals a word has the ids of that word.
        """
        chunks = self.chunks
        words, several = set(), {}
        for c in fresh:
            found = self.pretokens(c)
            if len(found) == 1:
                words.add(c)
            else:
                several[c] = found
                words.update([w for w in found if w not in chunks])
        self.learn(words)
        for c, found in several.items():
            chunks[c] = b"".join([chunks[w] for w in found])
        out = [b"".join([chunks[c] if c.__class__ is str else c for c in doc]) for doc in docs]
        for held in (chunks, self.apart):
            if len(held) > CACHE:
                held.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD; unknown ids are left out."""
        tokens, n = self.tokens, len(self.tokens)
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def shipped(df: DataFrame, path: str | None) -> Callable[[], Vocabulary]:
    """How a task finds the vocabulary: the public file where it runs, or a file of the user's that is sent along."""
    if path is None:
        return lambda: vocabulary(default_path())
    df.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: vocabulary(SparkFiles.get(name))


def slices(texts: list[str], most: int = SLICE) -> Iterable[list[str]]:
    """Consecutive texts of about ``most`` characters; a longer one is alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of ``text``, packed as little-endian 32-bit integers (see ``unpack``)."""
    find = shipped(df, path)

    def make():
        known = find()

        def run(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return [[x for part in slices(texts) for x in known.encode(part)]]

        return run

    return map_batches(df, make, [T.StructField(out, T.BinaryType())])


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the packed ids in ``ids``; null ids count as none."""
    find = shipped(df, path)

    def make():
        known = find()
        return lambda batch: [[known.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]]

    return map_batches(df, make, [T.StructField(out, T.StringType())])


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass, so a task needs one worker and one vocabulary."""
    find = shipped(df, path)

    def make():
        known = find()

        def run(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            packed = [x for part in slices(texts) for x in known.encode(part)]
            return [packed, [known.decode(x) for x in packed]]

        return run

    return map_batches(df, make, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())])


def verified(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "token_ids", out: str = "round_trip", keep: list[str] | None = None) -> DataFrame:
    """``encode``, and whether ``decode`` gives the text again; only this answer leaves the worker, not the decoded text."""
    find = shipped(df, path)

    def make():
        known = find()

        def run(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            packed = [x for part in slices(texts) for x in known.encode(part)]
            return [packed, [known.decode(x) == t for x, t in zip(packed, texts, strict=True)]]

        return run

    return map_batches(df, make, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.BooleanType())], keep)


def n_tokens(ids: str = "token_ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpack(ids: str = "token_ids") -> Column:
    """Packed ids as ``array<bigint>``."""
    at = lambda i: F.concat(*(F.substring(F.col(ids), i * 4 + k, 1) for k in (4, 3, 2, 1)))
    return F.when(n_tokens(ids) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (n_tokens(ids) - 1).cast("int")), lambda i: F.conv(F.hex(at(i)), 16, 10).cast("long")))


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of the ids and of the decoded text."""
    done = round_trip(df.select("doc_id", "text"), path=path)
    return done.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
