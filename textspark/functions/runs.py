"""Runs of code points by class, on whole Arrow arrays of texts.

Higher-order functions of Spark are interpreted for each character or token; classes of
characters are instead looked up for all texts of a batch at once, in linear time.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
PARTS = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("part", T.IntegerType()), *SPANS.elementType.fields]))
#: Bytes of texts that are worked on at once; one longer text is taken as a whole.
AT_ONCE = 2_000_000
_UNIT = r"(?:[^\\\[\]&^~|-]|[&~|](?![&~|])|\\[tnrf]|\\x[0-9A-Fa-f]{2}|\\x\{[0-9A-Fa-f]+\}|\\[^A-Za-z0-9])"


def members(body: str) -> tuple[tuple[int, int], ...] | None:
    """Ranges (first, last) of the body of a character class; None for one that isn't made of characters and ranges alone."""
    if not re.fullmatch(f"(?:{_UNIT}(?:-{_UNIT})?)+", body, re.S):
        return None
    same = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", body)
    return tuple((m.start(), m.end() - 1) for m in re.finditer(f"[{same}]+", "".join(map(chr, range(0x110000)))))


def disjoint(*classes: Iterable[tuple[int, int]]) -> bool:
    """Whether no two ranges share a code point."""
    ranges = sorted(r for c in classes for r in c)
    return all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def lookup(ranges: Iterable[tuple[int, int, int]], kind: type = np.uint8) -> Callable[[], np.ndarray]:
    """The bits of all ranges (first, last, bits) that hold a code point, by code point; the table is made where it is first used."""
    held: list[np.ndarray] = []

    def table() -> np.ndarray:
        if not held:
            held.append(np.zeros(0x110000, kind))
            for first, last, bits in ranges:
                held[0][first : last + 1] |= kind(bits)
        return held[0]

    return table


class Batch:
    """Texts as one array of code points: ``codes``, where each begins in ``data`` (``at``), and the places of the texts (``docs``)."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        self.data = data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        codes = lead.astype(np.int32)
        for first, last, bits, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xF7, 0x07, 3)):
            here = np.flatnonzero((lead >= first) & (lead <= last))
            value = codes[here] & bits
            for k in range(1, more + 1):
                value = (value << 6) | (data[np.minimum(at[here] + k, len(data) - 1)] & 0x3F)
            codes[here] = np.minimum(value, 0x10FFFF)
        self.codes, self.at = codes, np.append(at, len(data))
        self.docs = np.searchsorted(at, offsets - offsets[0])

    def firsts(self) -> np.ndarray:
        """Whether a code point is the first of its text."""
        out = np.zeros(len(self.codes) + 1, bool)
        out[self.docs[:-1]] = True
        return out[:-1]

    def cut(self, begins: np.ndarray, kept: np.ndarray, more: Callable[[np.ndarray], list[tuple[str, np.ndarray]]] | None = None) -> tuple[np.ndarray, pa.StructArray]:
        """Offsets for each text, and pieces from each of ``begins`` to the next without code points that are not ``kept``; no empty ones."""
        starts = np.flatnonzero(begins)
        sums = np.append(0, np.cumsum(kept))
        ends = np.append(starts[1:], len(self.codes))
        n = sums[ends] - sums[starts]
        bytes_kept = np.append(0, np.cumsum(np.where(kept, np.diff(self.at), 0)))
        size = bytes_kept[ends] - bytes_kept[starts]
        full = n > 0
        starts, n, size = starts[full], n[full], size[full]
        text = self.data[np.repeat(kept, np.diff(self.at))]
        values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(text))
        doc = np.searchsorted(self.docs, starts, "right") - 1
        begin = (starts - self.docs[doc]).astype(np.int32)
        fields = [*(more(starts) if more else []), ("begin", begin), ("end", begin + n.astype(np.int32)), ("text", values)]
        return np.searchsorted(starts, self.docs), pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for _, x in fields], names=[k for k, _ in fields])


def by_batch(text: Column, found: Callable[[Batch], tuple[np.ndarray, pa.StructArray]], kind: T.ArrayType) -> Column:
    """An array for each text (null for null) by a function of batches that gives offsets and values."""

    def run(texts: pa.Array) -> pa.Array:
        sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()))
        out, begin = [pa.array([], to_arrow_type(kind))], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + AT_ONCE, "right")) - 1)
            piece = texts.slice(begin, end - begin)
            offsets, values = found(Batch(piece))
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=piece.is_null()).cast(out[0].type))
            begin = end
        return pa.concat_arrays(out)

    small_batches()
    return F.arrow_udf(run, kind)(text)


def whole_groups(batches: Iterator[pa.RecordBatch], id: str) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows that come sorted by ``id`` as tables of whole groups, with the (begin, end) of each group; no group is parted."""
    held: list[pa.RecordBatch] = []
    last = held  # equals no key
    for batch in batches:
        keys = ["nan" if k != k else k for k in batch.column(batch.schema.get_field_index(id)).to_pylist()]
        begins = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
        if begins:
            before = sum(b.num_rows for b in held)
            edges = [0] * (before > 0) + [before + i for i in begins]
            if edges[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])]), list(zip(edges, edges[1:]))
            held = []
        if keys:
            held.append(batch.slice(begins[-1] if begins else 0))
            last = keys[-1]
    if held:
        table = pa.Table.from_batches(held)
        yield table, [(0, table.num_rows)]


def _grams(texts: pa.Array, owner: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(owner, n-gram, count) for the owners of the texts, from 0: n-grams of words ``^word$``, which ``apart`` parts; a shorter word is its own."""
    batch = Batch(texts)
    inside = apart[batch.codes] == 0
    first = inside & (batch.firsts() | changes(inside))
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, int), pa.array([], pa.string()), np.zeros(0, int)
    length = np.bincount(np.cumsum(first)[inside] - 1)
    # the words one after the other, each between its marks
    edges = np.append(0, np.cumsum(length + 2))
    marked, letter = np.zeros(edges[-1] + n, np.int64), np.zeros(edges[-1] + n, bool)
    letter[: edges[-1]] = True
    letter[edges[:-1]] = letter[edges[1:] - 1] = False
    marked[edges[:-1]], marked[edges[1:] - 1], marked[letter] = ord("^"), ord("$"), batch.codes[inside]
    each = np.maximum(1, length + 3 - n)
    word = np.repeat(np.arange(len(begins)), each)
    start = np.arange(len(word)) + np.repeat(edges[:-1] - (np.cumsum(each) - each), each)
    codes = lambda start, word, k: np.where(start + k < edges[word + 1], marked[start + k], 0)
    key = np.zeros(len(word), np.int64)
    for k in range(n):
        # 21 bits for each code point; what is beyond three of them is numbered anew
        key = (np.unique(key, return_inverse=True)[1] if k > 2 else key) << 21 | codes(start, word, k)
    known = pc.dictionary_encode(pa.array(key))
    at, size = known.indices.to_numpy(), len(known.dictionary)
    some = np.zeros(size, int)
    some[at] = np.arange(len(at))
    grams = np.stack([codes(start[some], word[some], k) for k in range(n)], 1).astype("<u4").view(f"<U{n}")[:, 0]
    found, counts = np.unique(owner[np.searchsorted(batch.docs, begins, "right") - 1][word] * size + at, return_counts=True)
    return found // size, pa.array(grams.tolist(), pa.string()).take(pa.array(found % size)), counts


def gram_counts(df: DataFrame, id: str, apart: tuple[tuple[int, int], ...], n: int) -> DataFrame:
    """(id, gram, n, weight) of rows (id, text): how often each n-gram occurs in the texts of an id, and its share of these."""
    held, (_, text) = lookup([(*r, 1) for r in apart]), df.columns
    names = [id, "gram", "n", "weight"]

    def rows(keys: pa.Array, whose: np.ndarray, grams: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        share = counts / np.bincount(whose, counts, len(keys))[whose]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(whose)), grams, pa.array(counts, pa.int64()), pa.array(share, pa.float64())], names=names)

    def summed(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        sums = pa.table({"g": pa.concat_arrays([g for g, _ in parts]), "n": np.concatenate([c for _, c in parts])}).group_by("g").aggregate([("n", "sum")]).combine_chunks()
        return sums.column("g").combine_chunks(), sums.column("n_sum").to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is known of the id of the last row: its texts may go on
        parts: list[tuple[pa.Array, np.ndarray]] = []
        key = last = None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()))
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + AT_ONCE, "right")) - 1)
                keys = batch.column(batch.schema.get_field_index(id)).slice(begin, end - begin)
                values = ["nan" if k != k else k for k in keys.to_pylist()]
                new = np.array([i > 0 and values[i] != values[i - 1] for i in range(len(values))])
                owner = np.cumsum(new)
                whose, grams, counts = _grams(texts.slice(begin, end - begin), owner, held(), n)
                firsts = keys.take(pa.array(np.append(0, np.flatnonzero(new))))
                if parts and values[0] != last:
                    if len(parts[0][0]):
                        yield rows(key, np.zeros(len(parts[0][0]), int), *parts[0])
                    parts = []
                # rows of the first id, of those that are complete, and of the last one
                one, rest = np.searchsorted(whose, [1, owner[-1]]) if owner[-1] else (0, 0)
                if owner[-1]:
                    parts.append((grams.slice(0, one), counts[:one]))
                    whole = summed(parts)
                    if len(whole[0]):
                        yield rows(firsts.slice(0, 1), np.zeros(len(whole[0]), int), *whole)
                    if rest > one:
                        yield rows(firsts, whose[one:rest], grams.slice(one, rest - one), counts[one:rest])
                    parts = []
                parts = [summed([*parts, (grams.slice(rest), counts[rest:])])]
                key, last, begin = firsts.slice(len(firsts) - 1), values[-1], end
        if parts and len(parts[0][0]):
            yield rows(key, np.zeros(len(parts[0][0]), int), *parts[0])

    small_batches()
    schema = T.StructType([df.schema[id], *(T.StructField(k, t) for k, t in zip(names[1:], (T.StringType(), T.LongType(), T.DoubleType())))])
    return df.repartition(id).sortWithinPartitions(id).mapInArrow(run, schema)


#: Rows and bytes of an Arrow batch; texts are wide, and a worker holds its batch and what it makes of it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "32m"}


def small_batches() -> None:
    """Bound Arrow batches by rows and bytes, where the user has not set these options."""
    spark = SparkSession.getActiveSession()
    known = spark._jsparkSession.sessionState().conf() if spark else None
    for name, value in BATCH.items() if spark else ():
        if not known.contains(name):
            spark.conf.set(name, value)


def _tokens_of(separators: tuple[tuple[int, int], ...]) -> Callable[[Batch], tuple[np.ndarray, pa.StructArray]]:
    apart = lookup([(*r, 1) for r in separators])

    def found(batch: Batch) -> tuple[np.ndarray, pa.StructArray]:
        inside = apart()[batch.codes] == 0
        return batch.cut(batch.firsts() | changes(inside), inside)

    return found


def tokens(text: Column, separators: tuple[tuple[int, int], ...]) -> Column:
    """Maximal runs of code points outside the ranges ``separators``."""
    return by_batch(text, _tokens_of(separators), SPANS)


def tokens_with(text: Column, separators: tuple[tuple[int, int], ...], wanted: tuple[tuple[int, int], ...]) -> Column:
    """Those of ``tokens`` that hold a code point of ``wanted``, with their number ``idx`` among all."""
    bits = lookup([(*r, 1) for r in separators] + [(*r, 2) for r in wanted])

    def found(batch: Batch) -> tuple[np.ndarray, pa.StructArray]:
        bit = bits()[batch.codes]
        inside = bit & 1 == 0
        begins = batch.firsts() | changes(inside)
        nth = np.append(0, np.cumsum(begins & inside))
        run = np.cumsum(begins) - 1
        holds = np.bincount(run, inside & (bit & 2 > 0), minlength=1) > 0

        def number(starts: np.ndarray) -> list[tuple[str, np.ndarray]]:
            return [("idx", nth[starts + 1] - nth[batch.docs[np.searchsorted(batch.docs, starts, "right") - 1]] - 1)]

        return batch.cut(begins, inside & holds[run], number)

    return by_batch(text, found, T.ArrayType(T.StructType([PARTS.elementType.fields[0], *SPANS.elementType.fields])))


def windows(text: Column, separators: tuple[tuple[int, int], ...], n: int, pad: str) -> Column:
    """For each token the array of n tokens before it, itself and n after it; ``pad`` where the text ends."""
    tokens_of = _tokens_of(separators)

    def found(batch: Batch) -> tuple[np.ndarray, pa.ListArray]:
        offsets, values = tokens_of(batch)
        count, width = len(values), 2 * n + 1
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.arange(count)[:, None] + np.arange(-n, n + 1)
        at = np.where((at >= offsets[doc][:, None]) & (at < offsets[doc + 1][:, None]), at, count)
        words = pa.concat_arrays([values.field("text"), pa.array([pad], pa.string())]).take(pa.array(at.ravel()))
        return offsets, pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * width, pa.int32()), words)

    return by_batch(text, found, T.ArrayType(T.ArrayType(T.StringType())))


def sequences(text: Column, separators: tuple[tuple[int, int], ...], lengths: tuple[int, ...]) -> Column:
    """Spans of any of so many tokens in a row, with the tokens joined by one space."""
    tokens_of = _tokens_of(separators)

    def found(batch: Batch) -> tuple[np.ndarray, pa.StructArray]:
        offsets, values = tokens_of(batch)
        begin, end, text = (values.field(f) for f in ("begin", "end", "text"))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        parts, docs = [], []
        for n in lengths:
            first = np.flatnonzero(np.arange(len(doc)) + n <= offsets[doc + 1])
            words = [text.take(pa.array(first + k)) for k in range(n)]
            joined = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
            parts.append(pa.StructArray.from_arrays([begin.take(pa.array(first)), end.take(pa.array(first + n - 1)), joined], names=["begin", "end", "text"]))
            docs.append(doc[first])
        docs = np.concatenate(docs)
        return np.searchsorted(docs, np.arange(len(offsets)), sorter=(order := np.argsort(docs, kind="stable"))), pa.concat_arrays(parts).take(pa.array(order))

    return by_batch(text, found, SPANS)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it."""
    out = np.zeros(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def class_tokens(text: Column, classes: tuple[tuple[tuple[int, int], ...], ...], separators: tuple[tuple[int, int], ...]) -> Column:
    """Runs of code points of one of the (disjoint) ``classes``, or of none, with the number ``idx`` of the run without separators and the ``part`` in it."""
    kinds = lookup([(*r, 1) for r in separators] + [(*r, k + 2) for k, rs in enumerate(classes) for r in rs])

    def found(batch: Batch) -> tuple[np.ndarray, pa.StructArray]:
        kind = kinds()[batch.codes]
        inside, first = kind != 1, batch.firsts()
        words, parts = inside & (first | changes(inside)), inside & (first | changes(kind))
        nth = np.append(0, np.cumsum(words))
        at_word = np.maximum.accumulate(np.where(words, np.arange(len(words)), 0)) if len(words) else np.zeros(0, int)
        part = np.append(0, np.cumsum(parts))

        def numbers(starts: np.ndarray) -> list[tuple[str, np.ndarray]]:
            doc = np.searchsorted(batch.docs, starts, "right") - 1
            return [("idx", nth[starts + 1] - nth[batch.docs[doc]] - 1), ("part", part[starts] - part[at_word[starts]])]

        return batch.cut(first | changes(kind), inside, numbers)

    return by_batch(text, found, PARTS)


def role_tokens(text: Column, roles: list[tuple[int, int, int]], scripts: list[list[tuple[int, int, int]]]) -> Column:
    """Pieces parted before code points with bit 1 of ``roles``, after those with bit 2 and where a script begins or ends, without those with bit 4.

    Each table in ``scripts`` has a bit for each of up to 60 scripts, and the highest bit for a code point of any.
    """
    role, tables = lookup(roles), [lookup(x, np.int64) for x in scripts]

    def found(batch: Batch) -> tuple[np.ndarray, pa.StructArray]:
        bits = role()[batch.codes]
        parted = batch.firsts() | (bits & 1 > 0)
        parted[1:] |= bits[:-1] & 2 > 0
        for table in tables:
            script = table()[batch.codes]
            parted[1:] |= (script[:-1] & ~script[1:] != 0) | ((script[:-1] >> 61 == 0) & (script[1:] >> 61 != 0))
        return batch.cut(parted, bits & 4 == 0)

    return by_batch(text, found, SPANS)


# workers needn't find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
