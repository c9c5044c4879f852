"""Token features and tensor operations on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import features as A
from textspark.sources import read_table

WEIGHTS, BIAS = [[(j % 9 - 4) / 4 for j in range(64)], [(j % 5 - 2) / 2 for j in range(64)]], [0.1, -0.2]


def _words(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(F.explode(F.split("text", r"[ \n]")).alias("word")).where("word <> ''").distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "embedding")


def chargrams(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("word", F.array_join(A.chargrams(F.col("word"), (1, 2, 3)), " ").alias("grams"))


def digit_remap(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("word", A.remap_digits(F.col("word")).alias("remapped"))


def case_regex_features(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    return _words(spark, d).select("word", A.starts_upper(w).alias("upper"), A.sign(w.rlike("^[a-z]+$")).alias("letters"), A.sign(w.rlike("^[0-9]+$")).alias("digits"))


def hashed_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Hashes have no counterpart in SQL; tests hold them against the library of the hash."""
    grams = _words(spark, d).select(F.explode(A.chargrams(F.col("word"), (3,))).alias("gram")).distinct()
    return grams.select("gram", A.bucket(F.col("gram"), 1000).alias("bucket"), A.bucket_listed(F.col("gram"), F.col("gram").rlike("^[a-z]+$"), 1000).alias("listed"))


def dequantize_8bit(spark: SparkSession, d: str) -> DataFrame:
    bytes_ = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 1000), F.lit(256)))
    return _vectors(spark, d).select("vec_id", F.posexplode(A.dequantize(bytes_, F.lit(0.1), 8, 7)).alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("value"))


def dequantize_nbit(spark: SparkSession, d: str) -> DataFrame:
    packed = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(F.col("vec_id") * 37 + i * 11, F.lit(256)).cast("int"))
    values = A.unpack_bits(packed, 3, 10)
    return _vectors(spark, d).select("vec_id", F.posexplode(A.dequantize(values, F.lit(9.0), 3, 7)).alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("value"))


def prune_bucket_rank(spark: SparkSession, d: str) -> DataFrame:
    return A.pruned_rank(_vectors(spark, d).select(F.col("vec_id").alias("bucket"), (F.col("vec_id") % 3 == 0).alias("kept")))


def bag_mean(spark: SparkSession, d: str) -> DataFrame:
    groups = _vectors(spark, d).select(F.floor(F.col("vec_id") / 10).alias("bag"), F.posexplode("embedding").alias("place", "x"))
    return groups.groupBy("bag", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def tensor_ops(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("e", F.col("embedding"))
    r = lambda c: F.round(c, 5)
    return rows.select(
        "vec_id", r(A.total(F.col("e"))).alias("total"), r(A.mean(F.col("e"))).alias("mean"), r(A.dot(F.col("e"), F.reverse("e"))).alias("dot"), r(F.get(A.l2_normalized(F.col("e")), F.lit(2))).alias("unit"),
        r(F.get(A.softmax(F.col("e")), F.lit(3))).alias("soft"), F.get(A.top(F.col("e"), 2), F.lit(1))["place"].alias("second"), r(F.get(F.get(A.transpose(A.reshape(F.col("e"), 4), 4), F.lit(3)), F.lit(1)).cast("double")).alias("turned"),
        r(F.get(A.fully_connected(F.col("e"), WEIGHTS, BIAS, relu=True), F.lit(0))).alias("layer"), r(F.get(A.gather(F.col("e"), F.array(F.lit(5), F.lit(0))), F.lit(0)).cast("double")).alias("gathered"),
    )


def token_encoder(spark: SparkSession, d: str) -> DataFrame:
    counts = F.array((F.col("vec_id") % 3 + 1).cast("int"), (F.col("vec_id") % 4 + 1).cast("int"))
    return _vectors(spark, d).select("vec_id", F.array_join(A.token_positions(counts, 9), " ").alias("positions"))


def distance_diversify(spark: SparkSession, d: str) -> DataFrame:
    """In groups of 10 vectors, up to 4 that lie apart."""
    groups = _vectors(spark, d).groupBy(F.floor(F.col("vec_id") / 10).alias("bag")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vs"))
    return groups.select("bag", F.array_join(A.diversified(F.col("vs"), 1.4, 4), " ").alias("chosen"))


_WORDS = "w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) WHERE word <> '')"
_GRAM = lambda body, n: f"list_transform(range(1, length({body}) - {n} + 2), lambda i: substr({body}, CAST(i AS INTEGER), {n}))"

QUERIES = {q.__name__: q for q in (chargrams, digit_remap, case_regex_features, hashed_buckets, dequantize_8bit, dequantize_nbit, prune_bucket_rank, bag_mean, tensor_ops, token_encoder, distance_diversify)}
SQL = {
    "chargrams": f"WITH {_WORDS}, s AS (SELECT word, CASE WHEN length(word) > 20 THEN left(word, 10) || chr(1) || right(word, 10) ELSE word END AS s FROM w), m AS (SELECT word, s, '^' || s || '$' AS m FROM s) SELECT word, array_to_string({_GRAM('s', 1)} || {_GRAM('m', 2)} || {_GRAM('m', 3)}, ' ') AS grams FROM m",
    "digit_remap": f"WITH {_WORDS} SELECT word, regexp_replace(word, '[0-9]', '0', 'g') AS remapped FROM w",
    "case_regex_features": f"WITH {_WORDS} SELECT word, CASE WHEN upper(word[1]) = word[1] AND lower(word[1]) <> word[1] THEN 1.0 ELSE -1.0 END AS upper, CASE WHEN regexp_matches(word, '^[a-z]+$') THEN 1.0 ELSE -1.0 END AS letters, CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 1.0 ELSE -1.0 END AS digits FROM w",
    "dequantize_8bit": """WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS place, embedding FROM embeddings), b AS (SELECT vec_id, place, CAST(floor(CAST(embedding[place + 1] AS DOUBLE) * 1000) AS BIGINT) AS x FROM v)
SELECT vec_id, CAST(place AS INTEGER) AS place, round((((x % 256) + 256) % 256 - 128) * 0.1 / 7, 6) AS value FROM b""",
    "dequantize_nbit": """WITH v AS (SELECT vec_id, unnest(range(0, 10)) AS place FROM embeddings), b AS (SELECT vec_id, place, CAST(floor(place * 3 / 8) AS BIGINT) AS k FROM v),
w AS (SELECT vec_id, place, CASE WHEN k <= 5 THEN (vec_id * 37 + k * 11) % 256 ELSE 0 END + CASE WHEN k + 1 <= 5 THEN (vec_id * 37 + (k + 1) * 11) % 256 ELSE 0 END * 256 AS wide FROM b)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(((CAST(wide AS BIGINT) >> ((place * 3) % 8)) % 8 - 4) * 9.0 / 7, 6) AS value FROM w""",
    "prune_bucket_rank": "SELECT vec_id AS bucket, vec_id % 3 = 0 AS kept, CASE WHEN vec_id % 3 = 0 THEN row_number() OVER (PARTITION BY vec_id % 3 = 0 ORDER BY vec_id) - 1 ELSE (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0) END AS row FROM embeddings",
    "bag_mean": "WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS place, embedding FROM embeddings) SELECT CAST(floor(vec_id / 10) AS BIGINT) AS bag, CAST(place AS INTEGER) AS place, round(avg(CAST(embedding[place + 1] AS DOUBLE)), 6) AS mean FROM v GROUP BY ALL",
    "tensor_ops": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, embedding AS f FROM embeddings), m AS (SELECT *, list_max(e) AS top FROM v)
SELECT vec_id, round(list_sum(e), 5) AS total, round(list_sum(e) / 64, 5) AS mean, round(list_dot_product(e, list_reverse(e)), 5) AS dot, round(e[3] / sqrt(list_dot_product(e, e)), 5) AS unit,
round(exp(e[4] - top) / list_sum(list_transform(e, lambda x: exp(x - top))), 5) AS soft, CAST(list_position(f, list_sort(f, 'DESC')[2]) - 1 AS INTEGER) AS second, round(e[8], 5) AS turned,
round(greatest(0.0, list_dot_product(e, list_transform(range(0, 64), lambda j: CAST((j % 9 - 4) / 4 AS DOUBLE))) + 0.1), 5) AS layer, round(e[6], 5) AS gathered FROM m""",
    "token_encoder": """WITH p AS (SELECT vec_id, range(0, vec_id % 3 + 3) || range(0, vec_id % 4 + 3) AS p FROM embeddings) SELECT vec_id, array_to_string(p[greatest(1, len(p) - 8):] || list_transform(range(0, greatest(0, 9 - len(p))), lambda i: 9), ' ') AS positions FROM p""",
    "distance_diversify": """WITH RECURSIVE v AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS bag, row_number() OVER (PARTITION BY floor(vec_id / 10) ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT bag, i, [{'i': i, 'v': v}] AS kept FROM v WHERE i = 0 UNION ALL
SELECT g.bag, v.i, CASE WHEN len(g.kept) >= 4 OR len(list_filter(g.kept, lambda y: list_distance(y.v, v.v) < 1.4)) > 0 THEN g.kept ELSE list_append(g.kept, {'i': v.i, 'v': v.v}) END FROM g JOIN v ON v.bag = g.bag AND v.i = g.i + 1)
SELECT bag, array_to_string(list_transform(k, lambda y: y.i) || list_transform(range(0, 4 - len(k)), lambda i: -1), ' ') AS chosen FROM (SELECT bag, arg_max(kept, i) AS k FROM g GROUP BY bag)""",
}
