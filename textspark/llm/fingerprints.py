"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A text is a multiset of paragraphs (pieces between line feeds).  A paragraph is
hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo a power of two.  So the order of paragraphs
does not matter, equal multisets have equal fingerprints, and a paragraph is
inserted or deleted by adding or subtracting its vector (``add``, ``subtract``).

A vector has two parts:

* ``exact``: eight 32-bit words of the paragraph's SHA-256, summed modulo 2**32.
  It decides equality.
* ``lanes``: 63 counters modulo 2**40.  Lane j counts the paragraph's adjacent word
  pairs whose hash has bit j set; ``n`` counts all pairs.  Twice a lane less n is a
  sum of random signs, so squared differences of lanes estimate how many pairs two
  documents do not share.  ``likeness`` uses that:
  2 <a, b> / (|a|**2 + |b|**2) over the signed lanes, cut to 0..1.

Counters are kept three to a 64-bit sum while up to 2**20 words are added up, so a word
costs 21 additions inside generated code; the sums of such chunks are then added modulo
2**40, which no text that fits a row can reach.

``with_next`` finds each document's successor by descending id without a global
sort: ids are dealt to buckets that follow each other, each bucket also gets the
first row of the next one, and a window inside the bucket does the rest.  A bucket
holds about ``BYTES`` of text, or less while there are few; so the table of first rows
that is broadcast has one row for ``BYTES`` of input, or ``BUCKETS`` rows at least.
Texts are shuffled once; all later steps keep that partitioning.

Defined results: null text counts as empty; an empty text is one empty paragraph;
null ids come last in descending order; rows with the same id follow each other
by text; a single row is its own successor; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 63
BITS = 21
PACKED = 21
MASK = (1 << 0) | (1 << 21) | (1 << 42)
LOW = (1 << BITS) - 1
WORDS = 8
#: Bytes of text in a bucket of ids; below so many buckets they are smaller, of at least so many rows on average.
BYTES = 128 << 20
BUCKETS = 20_000
ROWS = 250
#: Lanes of whole texts are kept modulo a power of two.
TOTAL = (1 << 40) - 1
POINTS = 64
#: Word pairs that are counted before lanes are reduced; below 2**21.
CHUNK = 20


def exact_words(paragraphs: Column) -> list[Column]:
    hashes = F.transform(paragraphs, lambda p: F.sha2(p, 256))

    def lane(i: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: F.pmod(a + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(1 << 32)))

    return [lane(i) for i in range(WORDS)]


def pair_hashes(paragraphs: Column) -> Column:
    """Hash of each word and the word before it in the same paragraph."""
    split = F.transform(paragraphs, lambda p: F.split(p, " "))
    return F.flatten(F.transform(split, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.coalesce(F.get(ws, i - 1), F.lit(""))))))


def fingerprint(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """One row for each row of ``df``: ``keys`` (which must tell rows apart) and ``fingerprint``.

    The grouping needs no shuffle where ``df`` is already partitioned by some of ``keys``.
    """
    paragraphs = F.split(F.coalesce(F.col(body), F.lit("")), "\n")
    rows = df.select(*keys, paragraphs.alias("_p")).select(*keys, *(e.alias(f"_e{i}") for i, e in enumerate(exact_words(F.col("_p")))), pair_hashes(F.col("_p")).alias("_h"))
    rows = rows.select(*keys, *(f"_e{i}" for i in range(WORDS)), F.posexplode("_h").alias("_at", "_w"))
    chunk = F.shiftright("_at", CHUNK)
    sums = [F.sum(F.shiftright("_w", i).bitwiseAND(F.lit(MASK))).alias(f"_s{i}") for i in range(PACKED)]
    chunks = rows.groupBy(*keys, chunk.alias("_c")).agg(F.count("*").alias("_n"), *sums, *(F.max(f"_e{i}").alias(f"_e{i}") for i in range(WORDS)))
    packed = F.array(*(F.col(f"_s{i}") for i in range(PACKED)))
    shifted = lambda k: F.transform(packed, lambda x: F.shiftright(x, k * BITS).bitwiseAND(F.lit(LOW)))
    lanes = F.flatten(F.array(*map(shifted, range(3))))
    parts = chunks.select(*keys, F.struct(F.array(*(F.col(f"_e{i}") for i in range(WORDS))).alias("exact"), lanes.alias("lanes"), F.col("_n").alias("n")).alias("_f"))
    parts = parts.groupBy(*keys).agg(F.collect_list("_f").alias("_f"))  # one part for a million words
    first = F.get("_f", F.lit(0))
    total = F.aggregate(F.col("_f"), F.transform(first["lanes"], lambda x: F.lit(0).cast("long")), lambda a, f: F.zip_with(a, f["lanes"], lambda x, y: (x + y).bitwiseAND(F.lit(TOTAL))))
    n = F.aggregate(F.col("_f"), F.lit(0).cast("long"), lambda a, f: a + f["n"])
    return parts.select(*keys, F.struct(first["exact"].alias("exact"), total.alias("lanes"), n.alias("n")).alias("fingerprint"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    mod = lambda bits: lambda x, y: F.pmod(x + sign * y, F.lit(1 << bits))
    return F.struct(F.zip_with(a["exact"], b["exact"], mod(32)).alias("exact"), F.zip_with(a["lanes"], b["lanes"], mod(40)).alias("lanes"), (a["n"] + sign * b["n"]).alias("n"))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combined(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of a's paragraphs without b's."""
    return _combined(a, b, -1)


def text_form(f: Column) -> Column:
    """The fingerprint as a string: exact words, then count and lanes, in hexadecimal."""
    words = F.array_join(F.transform(f["exact"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(words, F.lit(":"), F.lower(F.hex(f["n"])), F.lit(":"), F.array_join(F.transform(f["lanes"], lambda x: F.lower(F.hex(x))), "."))


def _signed(f: Column) -> Column:
    return F.transform(f["lanes"], lambda x: (2 * x - f["n"]).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of word pairs that two fingerprints have in common, 0 to 1; equal ones give 1."""
    dot = F.aggregate(F.zip_with(_signed(a), _signed(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda f: F.aggregate(_signed(f), F.lit(0.0), lambda s, x: s + x * x)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot / F.nullif(norm(a) + norm(b), F.lit(0.0))))
    return F.when((a["exact"] == b["exact"]) & (a["n"] == b["n"]), F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


def with_next(documents: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, text, next_text, and (bucket, place, ghost); rows are partitioned by bucket.

    Rows with ``ghost`` set repeat the first row of the following bucket.
    """
    key = F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))
    rows = documents.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("key"))
    n, size, low, high, points = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.min("key"), F.max("key"), F.percentile_approx("key", [i / POINTS for i in range(1, POINTS)], 10_000)).first()
    bounds = sorted({low, *(points or [])}) if n else [0]
    fine = max(1, max(min(BUCKETS, n // ROWS), (size or 0) // BYTES) // len(bounds))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("key") >= b))
    lows = F.element_at(F.array(*(F.lit(float(b)) for b in bounds)), F.col("_j"))
    highs = F.element_at(F.array(*(F.lit(float(b)) for b in [*bounds[1:], (high or 0) + 1])), F.col("_j"))
    within = (F.col("key").cast("double") - lows) / F.greatest(F.lit(1.0), highs - lows)
    dealt = rows.withColumn("_j", F.greatest(at, F.lit(1))).withColumn("bucket", (F.col("_j") - 1) * fine + F.greatest(F.lit(0), F.least(F.floor(within * fine).cast("int"), F.lit(fine - 1)))).drop("_j")
    # one row for each bucket: the largest id of each bucket, and the bucket that it follows
    heads = dealt.groupBy("bucket").agg(F.max("key").alias("key"))
    above = F.lead("bucket").over(Window.orderBy("bucket"))
    heads = heads.select("key", F.coalesce(above, F.min("bucket").over(Window.partitionBy())).alias("to"))
    ghosts = dealt.join(F.broadcast(heads), "key").select("doc_id", "text", "key", F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    both = dealt.select("doc_id", "text", "key", "bucket", F.lit(0).alias("ghost")).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), F.desc("text"))
    return both.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)}).drop("key")


def neighbours(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's."""
    rows = with_next(documents, id, text)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumns({"n_chars": size.cast("long"), "edited": F.when(F.col("ghost") == 0, edited)})
    bodies = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"))), lambda x: x["body"].isNotNull())
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    sides = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.explode(bodies).alias("_b")).select(*keys, "_b.side", "_b.body")
    found = fingerprint(sides, [*keys, "side"], "body")
    docs = found.groupBy(*keys).agg(F.collect_list(F.struct("side", "fingerprint")).alias("_f"))
    of = lambda side: F.get(F.filter("_f", lambda x: x["side"] == side), F.lit(0))["fingerprint"]
    docs = docs.select(*keys, of(0).alias("own"), of(1).alias("changed"))
    order = Window.partitionBy("bucket").orderBy("place")
    docs = docs.withColumn("following", F.lead("own").over(order)).where("ghost = 0")
    return docs.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"), text_form(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
