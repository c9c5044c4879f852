"""Token features and small tensor operations as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = "\x01"


def chargrams(word: Column, orders: tuple[int, ...], most: int = 20) -> Column:
    """Character n-grams of ``^word$``; order 1 has no marks, a word beyond ``most`` keeps its two ends; without orders the word itself."""
    if not orders:
        return F.array(word)
    half = most // 2
    short = F.when(F.length(word) > most, F.concat(F.substring(word, 1, half), F.lit(CUT), F.substring(word, -half, half))).otherwise(word)
    marked = F.concat(F.lit("^"), short, F.lit("$"))

    def of(n: int) -> Column:
        body = short if n == 1 else marked
        last = F.length(body) - (n - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(body, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, orders))


def byte_chargrams(word: Column, orders: tuple[int, ...], most: int = 20) -> Column:
    """``chargrams`` of the bytes of a word; a gram is a text with one character for each byte."""
    return chargrams(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), orders, most)


def remap_digits(word: Column, lower: bool = False, every: bool = False) -> Column:
    """Digits become 0 (with ``every`` those of all scripts), letters lower case where asked."""
    out = F.regexp_replace(word, r"\p{Nd}" if every else "[0-9]", "0")
    return F.lower(out) if lower else out


def dense(word: Column, inside: Column | None = None, patterns: tuple[str, ...] = (), case: bool = True) -> Column:
    """Dense features: case, whether the token lies in the selection (1 or -1), and one for each pattern that fits the whole word."""
    parts = [starts_upper(word)] if case else []
    parts += [sign(inside)] if inside is not None else []
    return F.array(*parts, *(sign(word.rlike(f"^(?:{p})$")) for p in patterns))


def token_features(tokens: DataFrame, orders: tuple[int, ...], buckets: int, patterns: tuple[str, ...] = (), word: str = "value", inside: str | None = None, every: bool = True) -> DataFrame:
    """Add ``sparse`` (bucket of each gram) and ``dense`` to tokens."""
    w = F.col(word)
    grams = chargrams(w, orders) if every else byte_chargrams(w, orders)
    return tokens.withColumns({"sparse": F.transform(grams, lambda g: bucket(g, buckets)), "dense": dense(w, None if inside is None else F.col(inside), patterns)})


def embedded(rows: DataFrame, matrix: DataFrame, id: tuple[str, ...], buckets: str = "buckets", bits: int = 8) -> DataFrame:
    """(id, embedding): mean of the dequantised rows of a matrix (bucket, values, scale) over the buckets of each row.

    A bucket that the matrix does not have is an error.  Sums are combined before they are
    shuffled; the matrix is joined on its buckets and sent along if it is small.
    """
    each = rows.select(*id, F.size(buckets).alias("_n"), F.explode(buckets).alias("bucket"))
    # a row of the matrix is dequantised once, not for each of its uses
    hits = each.join(matrix.select("bucket", dequantize(F.col("values"), F.col("scale"), bits).alias("_v")), "bucket", "left")
    checked = F.when(F.col("_v").isNull(), F.raise_error(F.concat(F.lit("no row for bucket "), F.col("bucket").cast("string")))).otherwise(F.col("_v"))
    parts = hits.select(*id, "_n", F.posexplode(checked).alias("place", "x"))
    sums = parts.groupBy(*id, "place").agg((F.sum("x") / F.max("_n")).alias("x"))
    return sums.groupBy(*id).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("embedding"))


def windows(vectors: Column, n: int, pad: Column) -> Column:
    """Features of each token of a text: the vectors of the n tokens before it, its own and n after it, one after the other, padded."""
    at = lambda i: F.when((i >= 0) & (i < F.size(vectors)), F.get(vectors, i)).otherwise(pad)
    return F.transform(F.sequence(F.lit(0), F.size(vectors) - 1), lambda i: F.flatten(F.transform(F.sequence(i - n, i + n), at)))


def mean_vector(vectors: Column, size: int) -> Column:
    """The mean of some vectors of ``size`` components; zeros for none."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(F.size(vectors) == 0, F.lit(0.0)).otherwise(F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, j).cast("double")) / F.size(vectors)))


def bounds_features(vectors: Column, first: Column, last: Column, before: int, inside: int, after: int, pad: Column, size: int, bag: bool = True, length: bool = True) -> Column:
    """Features of a token span [first, last): vectors around and inside both of its ends, the mean of all inside, and its length.

    ``before`` vectors end where the span begins, ``inside`` ones follow its begin and end at
    its end, ``after`` ones follow it; places outside the span (for the inner ones) or the
    text are padded.
    """
    n = F.size(vectors)
    get = lambda i, low, high: F.when((i >= low) & (i < high), F.get(vectors, i)).otherwise(pad)
    zero = F.lit(0)
    parts = [get(first - k, zero, n) for k in range(before, 0, -1)] + [get(first + k, first, last) for k in range(inside)]
    parts += [get(last - k, first, last) for k in range(inside, 0, -1)] + [get(last + k, zero, n) for k in range(after)]
    out = [F.flatten(F.array(*parts))]
    if bag:
        out.append(mean_vector(F.slice(vectors, first + 1, last - first), size))
    if length:
        out.append(F.array((last - first).cast("double")))
    return F.concat(*out)


def spans_across(tokens: Column, first: Column, last: Column, most: int) -> Column:
    """All token spans (first, last) of up to ``most`` tokens that share a token with [first, last)."""
    size = F.size(tokens)
    begins = F.sequence(F.greatest(F.lit(0), first - (most - 1)), F.greatest(F.lit(0), last - 1))
    spans = F.flatten(F.transform(begins, lambda b: F.transform(F.sequence(b + 1, b + most), lambda e: F.struct(b.alias("first"), e.alias("last")))))
    return F.filter(spans, lambda s: (s["last"] <= size) & (s["last"] > first) & (s["first"] < last))


def chunked(scored: Column) -> Column:
    """Of spans (first, last, score) those that a greedy choice by score keeps without sharing tokens, in their order; ties go to the earlier and shorter."""
    items = F.array_sort(F.transform(scored, lambda s: F.struct((-s["score"]).alias("o"), s["first"].alias("first"), s["last"].alias("last"))))
    step = lambda acc, x: F.when(F.exists(acc, lambda y: (y["first"] < x["last"]) & (x["first"] < y["last"])), acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(items, F.slice(items, 1, 0), step)
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), (-x["o"]).alias("score"))))


def best_of_clicks(clicks: DataFrame, id: tuple[str, ...]) -> DataFrame:
    """(id, first, last, score): the highest probability of each span over the clicks (click, logits array<struct<first,last,logit>>) inside it."""
    p = softmax(F.transform("logits", lambda x: x["logit"]))
    rows = clicks.select(*id, F.explode(F.arrays_zip(F.col("logits").alias("s"), p.alias("p"))).alias("_x"))
    return rows.groupBy(*id, F.col("_x.s.first").alias("first"), F.col("_x.s.last").alias("last")).agg(F.max("_x.p").alias("score"))


def network(a: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Layers of weights and bias; what a layer reads is cut at zero, but for the first."""
    for k, (weights, bias) in enumerate(layers):
        x = F.transform(a, lambda v: F.greatest(F.lit(0.0), v.cast("double"))) if k else a
        # arrays in variables of lambdas lose their type, so each row is written out
        a = F.array(*(dot(F.array(*map(F.lit, row)), x) + b for row, b in zip(weights, bias)))
    return a


def concatenated(features: DataFrame, matrix: DataFrame, spaces: dict[str, int], id: tuple[str, ...]) -> DataFrame:
    """(id, embedding): for each space the weighted sum of its rows, one after the other; zeros where a space has no feature.

    ``features``: (id, space, row, weight); ``matrix``: (space, row, values).
    """
    hits = features.join(matrix.select("space", "row", F.col("values").alias("_v")), ["space", "row"])
    parts = hits.select(*id, "space", "weight", F.posexplode("_v").alias("place", "x")).groupBy(*id, "space", "place").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    starts = {name: sum(list(spaces.values())[:k]) for k, name in enumerate(spaces)}
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("space"))
    by_place = parts.groupBy(*id).agg(F.map_from_entries(F.collect_list(F.struct((offset + F.col("place")).alias("k"), "x"))).alias("_m"))
    return by_place.select(*id, F.transform(F.sequence(F.lit(0), F.lit(sum(spaces.values()) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("embedding"))


# element by element, and the shapes of arrays


def elementwise(a: Column, b: Column, op: str) -> Column:
    """``add``, ``sub``, ``mul``, ``div``, ``maximum`` or ``minimum`` of two arrays."""
    by = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y, "maximum": F.greatest, "minimum": F.least}[op]
    return F.zip_with(a, b, lambda x, y: by(x.cast("double"), y.cast("double")))


def mapped(a: Column, op: str) -> Column:
    """``neg``, ``exp``, ``log`` or ``cast`` (to whole numbers) of each element."""
    by = {"neg": lambda x: -x, "exp": F.exp, "log": F.log, "cast": lambda x: x.cast("bigint")}[op]
    return F.transform(a, lambda x: by(x.cast("double")))


def strided(a: Column, begin: int, end: int, stride: int) -> Column:
    return F.filter(F.slice(a, begin + 1, end - begin), lambda x, i: i % stride == 0)


def pieces_of(a: Column, count: int) -> Column:
    """The array in ``count`` equal parts."""
    size = (F.size(a) / count).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(a, i * size + 1, size))


def convolved(rows: Column, kernel: list[list[float]], height: int, width: int) -> Column:
    """Valid two-dimensional convolution (no padding, stride 1) of an array of rows."""
    kh, kw = len(kernel), len(kernel[0])
    cell = lambda i, j: reduce(lambda s, t: s + t, (F.get(F.get(rows, i + a), j + b).cast("double") * kernel[a][b] for a in range(kh) for b in range(kw)))
    return F.transform(F.sequence(F.lit(0), F.lit(height - kh)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(width - kw)), lambda j: cell(i, j)))


def bucket(gram: Column, buckets: int) -> Column:
    """Place of a gram in a hashed table."""
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def bucket_listed(gram: Column, listed: Column, buckets: int) -> Column:
    """Like ``bucket`` with a list of known grams: 0 is unknown, 1 is padding."""
    return F.when(gram == "<PAD>", 1).when(listed, F.pmod(F.xxhash64(gram), F.lit(buckets - 2)).cast("int") + 2).otherwise(0)


def sign(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(-1.0))


def starts_upper(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return sign((F.upper(first) == first) & (F.lower(first) != first))


# --- quantised embeddings ---------------------------------------------------------


def dequantize(values: Column, scale: Column, bits: int, count: int = 1) -> Column:
    """(v - 2**(bits-1)) * scale / count of unsigned values."""
    return F.transform(values, lambda v: (v - (1 << bits - 1)) * scale / count)


def unpack_bits(packed: Column, bits: int, n: int) -> Column:
    """The first n values of ``bits`` bits each from an array of bytes, lowest bits first."""
    byte = lambda k: F.coalesce(F.get(packed, k), F.lit(0)).cast("int")

    def at(i: Column) -> Column:
        k = F.floor(i * bits / 8).cast("int")
        wide = byte(k) + byte(k + 1) * 256
        return F.floor(wide / F.pow(F.lit(2), F.pmod(i * bits, F.lit(8)))).cast("int").bitwiseAND(F.lit((1 << bits) - 1))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def pruned_rank(mask: DataFrame, bucket: str = "bucket", kept: str = "kept") -> DataFrame:
    """Add ``row``: kept buckets are numbered in order, all others share the row after the last.

    Counts of chunks of 65,536 buckets are summed up in one place, one row for a chunk.
    """
    chunks = mask.groupBy(F.floor(F.col(bucket) / 65_536).alias("_chunk")).agg(F.count_if(kept).alias("_n"))
    before = chunks.withColumn("_before", F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    inside = F.sum(F.col(kept).cast("int")).over(Window.partitionBy("_chunk").orderBy(bucket))
    rows = mask.withColumn("_chunk", F.floor(F.col(bucket) / 65_536)).withColumn("_inside", inside).join(before, "_chunk")
    return rows.select(bucket, kept, F.when(F.col(kept), F.col("_before") + F.col("_inside") - 1).otherwise(F.col("_all")).alias("row"))


# --- arrays as tensors ------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def l2_normalized(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / norm)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(F.greatest(F.lit(-16.0), x.cast("double") - F.array_max(a).cast("double"))))
    return F.transform(e, lambda x: x / total(e))


def top(a: Column, k: int) -> Column:
    """The k largest values with their places; ties go to the earlier place."""
    items = F.transform(a, lambda x, i: F.struct((-x).alias("o"), i.alias("place"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(x["value"].alias("value"), x["place"].alias("place")))


def gather(a: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(a, i))


def reshape(a: Column, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(a) / columns).cast("int") - 1), lambda i: F.slice(a, i * columns + 1, F.lit(columns)))


def transpose(rows: Column, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def fully_connected(a: Column, weights: list[list[float]], bias: list[float], relu: bool = False) -> Column:
    """One layer with fixed weights."""
    out = [reduce(lambda s, t: s + t, (F.get(a, F.lit(j)).cast("double") * w for j, w in enumerate(row))) + b for row, b in zip(weights, bias)]
    return F.array(*(F.greatest(F.lit(0.0), x) if relu else x for x in out))


def padded_tail(a: Column, n: int, pad: Column) -> Column:
    """The last n items; shorter arrays are filled up with ``pad``."""
    tail = F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), F.lit(n))
    return F.concat(tail, F.array_repeat(pad, F.greatest(F.lit(0), n - F.size(a))))


def token_positions(counts: Column, most: int) -> Column:
    """Positions 0..n+1 of each message's n tokens and two marks, the last ``most`` of them, padded with ``most``."""
    return padded_tail(F.flatten(F.transform(counts, lambda n: F.sequence(F.lit(0), n + 1))), most, F.lit(most))


def diversified(vectors: Column, least: float, most: int) -> Column:
    """Places of a greedy choice: the first vector, then each at ``least`` distance from all chosen; -1 fills up."""
    distance = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    items = F.transform(vectors, lambda v, i: F.struct(i.alias("i"), v.alias("v")))

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: distance(y["v"], x["v"]) < least)
        return F.when(near | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(x)))

    chosen = F.aggregate(items, F.slice(items, 1, 0), step)
    return padded_tail(F.transform(chosen, lambda x: x["i"]), most, F.lit(-1))
