"""Token features, embeddings, span scores and small networks on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import features as A
from textspark.operators import tokens as T
from textspark.queries.features import _vectors, _words
from textspark.sources import read_table, rule_table

PATTERNS = ("[a-z]+", "[0-9]+")
LAYERS = [([[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(64)] for i in range(4)], [0.1, -0.2, 0.3, 0.0]), ([[1.0, -0.5, 0.25, 2.0], [0.5, 0.5, -1.0, 0.0]], [0.05, -0.05])]


def byte_chargrams(spark: SparkSession, d: str) -> DataFrame:
    grams = F.transform(A.byte_chargrams(F.col("word"), (2,)), lambda g: F.hex(F.encode(g, "ISO-8859-1")))
    return _words(spark, d).select("word", F.array_join(grams, " ").alias("grams"))


def token_features(spark: SparkSession, d: str) -> DataFrame:
    """Words in lower case with zeros for digits, and their dense features; a word lies in the selection if it holds an a."""
    w = F.col("word")
    dense = A.dense(w, w.contains("a"), PATTERNS)
    return _words(spark, d).select("word", A.remap_digits(w, lower=True, every=True).alias("remapped"), F.array_join(F.transform(dense, lambda x: x.cast("int").cast("string")), ",").alias("dense"))


def hashed_features(spark: SparkSession, d: str) -> DataFrame:
    """How many buckets the grams of a word fall into: as many as it has grams, all below the number of buckets."""
    found = A.token_features(_words(spark, d), (3,), 1000, PATTERNS, word="word")
    return found.select("word", F.size("sparse").alias("n"), F.forall("sparse", lambda b: (b >= 0) & (b < 1000)).alias("inside"), F.element_at("dense", 2).alias("letters"))


def embedding_sum(spark: SparkSession, d: str) -> DataFrame:
    """Means of rows of a matrix of bytes, for buckets made from the letters of words."""
    matrix = spark.range(40).select(F.col("id").cast("int").alias("bucket"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.pmod(F.col("id") * 31 + j * 17, F.lit(256)).cast("int")).alias("values"), F.lit(0.5).alias("scale"))
    codes = F.transform(X.characters(F.col("word")), lambda c: F.pmod(F.ascii(c), F.lit(40)))
    found = A.embedded(_words(spark, d).select("word", codes.alias("buckets")), matrix, ("word",))
    return found.select("word", *(F.round(F.get("embedding", F.lit(j)), 6).alias(f"x{j}") for j in range(4)))


def _bags(spark: SparkSession, d: str) -> DataFrame:
    """Ten vectors as the tokens of a text."""
    vs = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    return _vectors(spark, d).groupBy(F.floor(F.col("vec_id") / 10).alias("bag")).agg(vs.alias("vs"))


def context_features(spark: SparkSession, d: str) -> DataFrame:
    pad = F.array_repeat(F.lit(0.0).cast("float"), 64)
    rows = _bags(spark, d).select("bag", F.posexplode(A.windows(F.col("vs"), 1, pad)).alias("place", "f"))
    return rows.select("bag", "place", F.size("f").alias("n"), *(F.round(F.get("f", F.lit(j)).cast("double"), 6).alias(f"x{j}") for j in (0, 64, 128)), F.round(A.total(F.col("f")), 4).alias("total"))


def bounds_features(spark: SparkSession, d: str) -> DataFrame:
    """Spans [2, 5) of each bag: two vectors before and one after, one inside each end, the mean of all inside, the length."""
    pad = F.array_repeat(F.lit(0.0).cast("float"), 64)
    rows = _bags(spark, d).where(F.size("vs") >= 6).select("bag", A.bounds_features(F.col("vs"), F.lit(2), F.lit(5), 2, 1, 1, pad, 64).alias("f"))
    return rows.select("bag", F.size("f").alias("n"), *(F.round(F.get("f", F.lit(j)).cast("double"), 6).alias(f"x{j}") for j in (0, 64, 128, 192, 256, 320, 384)))


def span_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Of all spans of up to 3 words around a word, those that a greedy choice by score keeps."""
    words = F.transform(X.tokens(F.col("text"), T.SPACE), lambda m: m["text"])
    rows = read_table(spark, d, "documents").select("doc_id", words.alias("ws")).where(F.size("ws") > 0).withColumn("c", (F.col("doc_id") % F.size("ws")).cast("int"))
    spans = A.spans_across(F.col("ws"), F.col("c"), F.col("c") + 2, 3)
    scored = F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), (F.pmod(s["first"] * 7 + s["last"] * 13, F.lit(10)) / 10).alias("score")))
    return rows.select("doc_id", F.explode(A.chunked(scored)).alias("s")).select("doc_id", "s.first", "s.last", "s.score")


def click_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best probability of each span over the clicks (vectors) of a bag that may choose it."""
    logits = F.array(*(F.struct((F.col("vec_id") % 10 - F.lit(k)).alias("first"), (F.col("vec_id") % 10 + 1).alias("last"), F.get("embedding", F.lit(k)).cast("double").alias("logit")) for k in range(3)))
    found = A.best_of_clicks(_vectors(spark, d).select(F.floor(F.col("vec_id") / 10).alias("bag"), logits.alias("logits")), ("bag",))
    return found.select("bag", "first", "last", F.round("score", 6).alias("score"))


def network_scores(spark: SparkSession, d: str) -> DataFrame:
    out = A.network(F.col("embedding"), LAYERS)
    return _vectors(spark, d).select("vec_id", out.alias("y")).select("vec_id", F.round(F.get("y", F.lit(0)), 5).alias("y0"), F.round(F.get("y", F.lit(1)), 5).alias("y1"))


def embedding_concat(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two spaces for each customer's orders, weighted and one after the other."""
    matrix = rule_table(spark, [("a", i, [i * 0.5, -1.0 * i]) for i in range(7)] + [("b", i, [1.0 + i, 0.25 * i, 2.0]) for i in range(5)], "space string, row int, values array<double>")
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey")
    one = o.select("o_custkey", F.lit("a").alias("space"), (F.col("o_orderkey") % 7).cast("int").alias("row"), F.lit(0.5).alias("weight"))
    two = o.where("o_orderkey % 3 = 0").select("o_custkey", F.lit("b"), (F.col("o_orderkey") % 5).cast("int"), F.lit(2.0))
    found = A.concatenated(one.union(two), matrix, {"a": 2, "b": 3}, ("o_custkey",))
    return found.select("o_custkey", *(F.round(F.get("embedding", F.lit(j)), 6).alias(f"x{j}") for j in range(5)))


def tensor_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The remaining array operations, on whole vectors."""
    e, r = F.col("embedding"), F.reverse("embedding")
    ops = {op: F.round(A.total(A.elementwise(e, r, op)), 4) for op in ("add", "sub", "mul", "maximum", "minimum")}
    rows = A.reshape(e, 8)
    conv = A.convolved(rows, [[0.5, -1.0], [0.25, 2.0]], 8, 8)
    return _vectors(spark, d).select(
        "vec_id", *(c.alias(k) for k, c in ops.items()), F.round(F.get(A.elementwise(F.transform(e, lambda x: x + 2), F.transform(r, lambda x: x * x + 1), "div"), F.lit(5)), 4).alias("quotient"), F.round(A.total(A.mapped(e, "neg")), 4).alias("neg"), F.round(A.total(A.mapped(e, "exp")), 4).alias("exp"),
        F.round(F.get(A.mapped(F.transform(e, lambda x: x * x + 1), "log"), F.lit(3)), 5).alias("log"), F.get(A.mapped(F.transform(e, lambda x: x * 100), "cast"), F.lit(1)).alias("whole"), F.round(A.total(A.strided(e, 4, 60, 5)), 4).alias("strided"),
        (F.round(A.total(F.get(A.pieces_of(e, 4), F.lit(2))), 4) + 0.0).alias("piece"), F.round(F.get(F.get(conv, F.lit(3)), F.lit(4)), 4).alias("conv"),
    )


_WORDS = "w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) WHERE word <> '')"
_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS r FROM embeddings)"
_ZIP = lambda op: f"round(list_sum(list_transform(range(1, 65), lambda i: {op})), 4)"
_BAG = "b AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS bag, list(embedding ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1)"
_SUM1 = lambda v: f"coalesce(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE))), 0.0)"
_DOT = lambda w, b, x: f"list_dot_product([{', '.join(f'CAST({v} AS DOUBLE)' for v in w)}], {x}) + {b}"

QUERIES = {q.__name__: q for q in (byte_chargrams, token_features, hashed_features, embedding_sum, context_features, bounds_features, span_chunks, click_scores, network_scores, embedding_concat, tensor_shapes)}
SQL = {
    "byte_chargrams": f"""WITH {_WORDS}, h AS (SELECT word, hex(encode(word)) AS x FROM w), m AS (SELECT word, '5E' || CASE WHEN length(x) > 40 THEN left(x, 20) || '01' || right(x, 20) ELSE x END || '24' AS x FROM h)
SELECT word, array_to_string(list_transform(range(0, length(x) // 2 - 1), lambda i: substr(x, CAST(2 * i + 1 AS INTEGER), 4)), ' ') AS grams FROM m""",
    "token_features": f"""WITH {_WORDS} SELECT word, lower(regexp_replace(word, '\\p{{Nd}}', '0', 'g')) AS remapped, concat_ws(',', CASE WHEN upper(word[1]) = word[1] AND lower(word[1]) <> word[1] THEN '1' ELSE '-1' END, CASE WHEN contains(word, 'a') THEN '1' ELSE '-1' END, CASE WHEN regexp_full_match(word, '[a-z]+') THEN '1' ELSE '-1' END, CASE WHEN regexp_full_match(word, '[0-9]+') THEN '1' ELSE '-1' END) AS dense FROM w""",
    "hashed_features": f"WITH {_WORDS} SELECT word, CAST(CASE WHEN length(word) > 20 THEN 21 ELSE length(word) END AS INTEGER) AS n, TRUE AS inside, CASE WHEN regexp_full_match(word, '[a-z]+') THEN 1.0 ELSE -1.0 END AS letters FROM w",
    "embedding_sum": f"""WITH {_WORDS}, c AS (SELECT word, length(word) AS n, unnest(list_transform(string_split(word, ''), lambda ch: unicode(ch) % 40)) AS b FROM w)
SELECT word, {", ".join(f"round(CAST(sum(((b * 31 + {j} * 17) % 256 - 128) * CAST(0.5 AS DOUBLE)) AS DOUBLE) / max(n), 6) AS x{j}" for j in range(4))} FROM c GROUP BY word""",
    "context_features": f"""WITH {_BAG}, p AS (SELECT bag, vs, unnest(range(0, len(vs))) AS i FROM b), z AS (SELECT bag, i, CASE WHEN i > 0 THEN vs[i] ELSE list_transform(range(0, 64), lambda k: CAST(0 AS FLOAT)) END AS a, vs[i + 1] AS c, CASE WHEN i + 1 < len(vs) THEN vs[i + 2] ELSE list_transform(range(0, 64), lambda k: CAST(0 AS FLOAT)) END AS d FROM p)
SELECT bag, CAST(i AS INTEGER) AS place, 192 AS n, round(CAST(a[1] AS DOUBLE), 6) AS x0, round(CAST(c[1] AS DOUBLE), 6) AS x64, round(CAST(d[1] AS DOUBLE), 6) AS x128, round({_SUM1('a')} + {_SUM1('c')} + {_SUM1('d')}, 4) AS total FROM z""",
    "bounds_features": f"""WITH {_BAG}, p AS (SELECT bag, vs, list_transform(vs, lambda v: CAST(v[1] AS DOUBLE)) AS f FROM b WHERE len(vs) >= 6)
SELECT bag, {6 * 64 + 1} AS n, round(f[1], 6) AS x0, round(f[2], 6) AS x64, round(f[3], 6) AS x128, round(f[5], 6) AS x192, round(f[6], 6) AS x256, round((f[3] + f[4] + f[5]) / 3, 6) AS x320, 3.0 AS x384 FROM p""",
    "span_chunks": r"""WITH RECURSIVE w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM documents), c AS (SELECT doc_id, n, doc_id % n AS c FROM w WHERE n > 0),
s AS (SELECT doc_id, a.f AS f, a.f + b.k AS l, ((a.f * 7 + (a.f + b.k) * 13) % 10) / 10 AS score FROM c, LATERAL (SELECT unnest(range(greatest(0, c - 2), c + 2)) AS f) a, (VALUES (1), (2), (3)) b(k) WHERE a.f + b.k <= n AND a.f + b.k > c AND a.f < c + 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f, l) AS rn FROM s),
g AS (SELECT doc_id, rn, [{'f': f, 'l': l, 's': score}] AS kept FROM o WHERE rn = 1 UNION ALL SELECT g.doc_id, o.rn, CASE WHEN len(list_filter(g.kept, lambda y: y.f < o.l AND o.f < y.l)) > 0 THEN g.kept ELSE list_append(g.kept, {'f': o.f, 'l': o.l, 's': o.score}) END FROM g JOIN o ON o.doc_id = g.doc_id AND o.rn = g.rn + 1)
SELECT doc_id, CAST(x.f AS INTEGER) AS first, CAST(x.l AS INTEGER) AS last, x.s AS score FROM (SELECT doc_id, unnest(arg_max(kept, rn)) AS x FROM g GROUP BY doc_id)""",
    "click_scores": """WITH v AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS bag, vec_id % 10 AS t, list_transform(embedding[1:3], lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding[1:3]) AS DOUBLE))) AS x FROM embeddings), s AS (SELECT bag, t - k AS first, t + 1 AS last, x[k + 1] / list_sum(x) AS p FROM v, (VALUES (0), (1), (2)) z(k))
SELECT bag, first, last, round(max(p), 6) AS score FROM s GROUP BY ALL""",
    "network_scores": f"""WITH {_E}, l AS (SELECT vec_id, [{", ".join(_DOT(w, b, "e") for w, b in zip(*LAYERS[0]))}] AS y FROM e), q AS (SELECT vec_id, list_transform(y, lambda v: greatest(0.0, v)) AS y FROM l)
SELECT vec_id, round({_DOT(LAYERS[1][0][0], LAYERS[1][1][0], "y")}, 5) AS y0, round({_DOT(LAYERS[1][0][1], LAYERS[1][1][1], "y")}, 5) AS y1 FROM q""",
    "embedding_concat": """SELECT o_custkey, round(CAST(sum(0.5 * (o_orderkey % 7) * 0.5) AS DOUBLE), 6) AS x0, round(CAST(sum(-0.5 * (o_orderkey % 7)) AS DOUBLE), 6) AS x1, round(CAST(coalesce(sum(2.0 * (1 + o_orderkey % 5)) FILTER (o_orderkey % 3 = 0), 0) AS DOUBLE), 6) AS x2,
round(CAST(coalesce(sum(2.0 * 0.25 * (o_orderkey % 5)) FILTER (o_orderkey % 3 = 0), 0) AS DOUBLE), 6) AS x3, round(CAST(coalesce(sum(4.0) FILTER (o_orderkey % 3 = 0), 0) AS DOUBLE), 6) AS x4 FROM orders GROUP BY o_custkey""",
    "tensor_shapes": f"""WITH {_E} SELECT vec_id, {_ZIP("e[i] + r[i]")} AS add, {_ZIP("e[i] - r[i]")} AS sub, {_ZIP("e[i] * r[i]")} AS mul, {_ZIP("greatest(e[i], r[i])")} AS maximum, {_ZIP("least(e[i], r[i])")} AS minimum,
round((e[6] + 2) / (r[6] * r[6] + 1), 4) AS quotient, {_ZIP("-e[i]")} AS neg, {_ZIP("exp(e[i])")} AS exp, round(ln(e[4] * e[4] + 1), 5) AS log, CAST(trunc(e[2] * 100) AS BIGINT) AS whole, round(list_sum(list_transform(range(5, 61, 5), lambda i: e[i])), 4) AS strided,
round(list_sum(e[33:48]), 4) + 0.0 AS piece, round(e[29] * 0.5 - e[30] + e[37] * 0.25 + e[38] * 2.0, 4) AS conv FROM e""",
}
