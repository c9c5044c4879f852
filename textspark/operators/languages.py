"""Language identification: words, trigrams, scripts, scores, softmax, thresholds.

The weights are learned from labelled texts (multinomial naive Bayes over trigrams inside
words); they are a table (gram, lang, weight) and scoring is a join and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import runs as R
from textspark.functions import text as X

#: One-byte characters that are no letters part words; others never do.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
APART_RANGES = ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SCRIPTS = {"latin": r"[A-Za-zÀ-ɏ]", "greek": r"[Ͱ-Ͽ]", "cyrillic": r"[Ѐ-ӿ]", "hebrew": r"[֐-׿]", "arabic": r"[؀-ۿ]", "kana": r"[぀-ヿ]", "cjk": r"[一-鿿]", "hangul": r"[가-힯]"}
THRESHOLD = 0.5
UNKNOWN = "und"


def words(text: Column) -> Column:
    """Marked words ``^word$``."""
    return F.transform(F.filter(F.split(text, APART), lambda w: w != ""), lambda w: F.concat(F.lit("^"), w, F.lit("$")))


def ngrams(word: Column, n: int = 3) -> Column:
    """All n-grams of a marked word, repeated ones too."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - (n - 1))), lambda i: F.substring(word, i, F.lit(n)))


def ngram_counts(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(id, gram, n, weight): how often each n-gram occurs, and its share of the text's n-grams.

    Texts are dealt by id once and sorted, so that texts that share an id are neighbours;
    n-grams are counted for batches of them.  What a task holds is a batch and the n-grams of
    one id, never those of all its texts.
    """
    return R.gram_counts(df.select(id, F.lower(text).alias("_t")), id, APART_RANGES, n)


def script_shares(text: Column) -> Column:
    """Share of each script among the characters that belong to one, as a map.

    Scripts share no character.  Latin letters are counted in the whole text, the others in
    what is left of it without the characters up to the last Latin one; every count is made once.
    """
    (_, latin), *others = SCRIPTS.items()
    left = F.regexp_replace(text, "[\\x00-ɏ]+", "")
    without = lambda t, p: F.length(t) - F.length(F.regexp_replace(t, p + "+", ""))
    counts = X.let(left, lambda t: F.array(without(text, latin), *(F.when(F.length(t) > 0, without(t, p)).otherwise(F.length(t)) for _, p in others)))

    def shares(ns: Column) -> Column:
        total = F.aggregate(ns, F.lit(0), lambda a, n: a + n)
        return X.let(total, lambda n: F.map_from_arrays(F.array(*map(F.lit, SCRIPTS)), F.array(*(F.when(n > 0, F.get(ns, F.lit(i)) / n).otherwise(F.lit(0.0)) for i in range(len(SCRIPTS))))))

    return X.let(counts, shares)


def _by_gram(df: DataFrame, lang: str, id: str, text: str) -> tuple[DataFrame, list[str]]:
    """(gram, w): an array of weights for each gram, one for each of the languages that are returned, in order.

    Only the names of the languages reach the driver, read from their column alone.
    """
    known = df.where(F.col(lang).isNotNull())
    names = sorted(r[0] for r in known.select(lang).distinct().collect())
    # words of a language are counted before their n-grams are formed: a word costs one row for each language
    by_word = known.select(F.col(lang).alias("_l"), F.explode(words(F.lower(text))).alias("_w")).groupBy("_l", "_w").agg(F.count("*").alias("_c"))
    rows = by_word.select("_l", "_c", F.explode(ngrams(F.col("_w"))).alias("gram"))
    by_gram = rows.groupBy("gram").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("_l") == name, F.col("_c"))), F.lit(0)) for name in names)).alias("ns"))
    # one row: the sum for each language, and the number of grams
    sums = by_gram.agg(F.array(*(F.sum(F.get("ns", F.lit(i))) for i in range(len(names)))).alias("totals"), F.count("*").alias("grams"))
    weights = F.zip_with("ns", "totals", lambda n, total: F.round(F.log((n + 1) / (total + F.col("grams"))), 4))
    return by_gram.crossJoin(F.broadcast(sums)).select("gram", weights.alias("w")), names


def train(df: DataFrame, lang: str = "lang", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, lang, weight): smoothed log shares, rounded so that the order of sums doesn't show."""
    weights, names = _by_gram(df, lang, id, text)
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).cast("array<string>").alias("n"), F.col("w").alias("w"))
    return weights.select("gram", F.explode(pairs).alias("x")).select("gram", F.col("x.n").alias(lang), F.col("x.w").alias("weight"))


#: Bytes of an n-gram's row of weights besides those of the weights, and of all weights that are sent to every task.
ROW, SENT = 64, 128 * 2**20


def _scored(counts: DataFrame, by_gram: DataFrame, names: list, id: str, lang: str) -> DataFrame:
    """Scores by (gram, ws, cs): for each language the sum of a gram's weights in ten-thousandths, and their number.

    The table of weights is made once and counted.  A usual one is sent along; only one that
    is too large for that is joined by a shuffle of all n-grams.
    """
    by_gram = by_gram.persist()
    small = by_gram.count() * (ROW + 24 * len(names)) <= SENT
    hits = counts.select(id, "gram", "n").join(F.broadcast(by_gram) if small else by_gram, "gram")
    at = range(len(names))
    sums = [x for i in at for x in (F.sum(F.col("n") * F.get("ws", F.lit(i))).alias(f"_w{i}"), F.sum(F.col("n") * F.get("cs", F.lit(i))).alias(f"_c{i}"))]
    per_text = hits.groupBy(id).agg(*sums) if names else hits.select(id).limit(0)
    found = F.array(*(F.when(F.col(f"_c{i}") > 0, F.struct(F.lit(name).alias(lang), F.round(F.col(f"_w{i}") / 10_000 / F.col(f"_c{i}"), 4).alias("score"))) for i, name in enumerate(names)))
    none = F.array().cast(f"array<struct<`{lang}`:string,score:double>>")
    return per_text.select(id, F.explode(F.filter(found, lambda x: x.isNotNull()) if names else none).alias("_x")).select(id, f"_x.{lang}", "_x.score")


def _units(weight: Column) -> Column:
    """A weight, rounded to four places, in ten-thousandths: whole numbers, whose sums don't depend on their order."""
    return (weight.cast("decimal(12,4)") * 10_000).cast("bigint")


def scores(counts: DataFrame, weights: DataFrame, id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, lang, score): mean weight of a text's n-grams, rounded to 4 places.

    Only the names of the languages reach the driver; a gram's weights are one row.
    """
    names = sorted((r[0] for r in weights.select(lang).distinct().collect()), key=lambda x: (x is not None, x))
    one = lambda name, value: F.coalesce(F.sum(F.when(F.col(lang).eqNullSafe(F.lit(name)), value)), F.lit(0))
    units = _units(F.col("weight"))
    by_gram = weights.groupBy("gram").agg(F.array(*(one(x, units) for x in names)).alias("ws"), F.array(*(one(x, F.lit(1)) for x in names)).alias("cs"))
    return _scored(counts, by_gram, names, id, lang)


def self_scores(df: DataFrame, lang: str = "lang", id: str = "doc_id", text: str = "text") -> DataFrame:
    """``scores`` of the texts that the weights are learned from: their table is taken as it is made, one row for each gram."""
    weights, names = _by_gram(df, lang, id, text)
    by_gram = weights.select("gram", F.transform("w", _units).alias("ws"), F.array_repeat(F.lit(1).cast("bigint"), len(names)).alias("cs"))
    return _scored(ngram_counts(df, id, text), by_gram, names, id, lang)


def softmax(scored: DataFrame, id: str = "doc_id", scale: float = 1.0) -> DataFrame:
    """Add ``probability`` within each id; differences beyond 16 count as 16."""
    w = Window.partitionBy(id)
    shifted = F.greatest(F.lit(-16.0), (F.col("score") - F.max("score").over(w)) * scale)
    rows = scored.withColumn("_e", F.exp(shifted))
    return rows.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def ranked(probable: DataFrame, id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Add ``place``: probability from high to low, then language."""
    return probable.withColumn("place", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("probability"), lang)))


def best(probable: DataFrame, thresholds: dict[str, float] | None = None, id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, lang, probability): the most probable language, or ``und`` below its threshold."""
    top = ranked(probable, id, lang).where("place = 1")
    least = F.lit(THRESHOLD)
    for name, value in (thresholds or {}).items():
        least = F.when(F.col(lang) == name, F.lit(value)).otherwise(least)
    return top.select(id, F.when(F.col("probability") >= least, F.col(lang)).otherwise(UNKNOWN).alias("lang"), "probability")
