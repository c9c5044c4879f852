"""Tokenisers and token ranges on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import tokens as T
from textspark.queries.spans import find, tokens_sql
from textspark.sources import read_table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text")


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    """A click on the first number of each text."""
    first = X.find_nth(F.col("text"), "[0-9]+", F.lit(0))
    return _docs(spark, d).select("doc_id", first.alias("m")).where("m IS NOT NULL").select("doc_id", F.col("m.begin").alias("span_begin"), F.col("m.end").alias("span_end"))


def tokenize_space(spark: SparkSession, d: str) -> DataFrame:
    return T.tokenize(_docs(spark, d))


def tokenize_script_change(spark: SparkSession, d: str) -> DataFrame:
    return T.tokenize_scripts(_docs(spark, d))


def split_on_selection(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.tokenize(_docs(spark, d)).join(_clicks(spark, d), "doc_id")
    return T.split_on_selection(tokens, F.col("span_begin") + 1, F.col("span_end")).select("doc_id", "idx", "part", "value", "begin", "end")


def span_to_tokens(spark: SparkSession, d: str) -> DataFrame:
    clicks = _clicks(spark, d)
    wide = clicks.select("doc_id", F.greatest(F.lit(0), F.col("span_begin") - 20).alias("span_begin"), (F.col("span_end") + 20).alias("span_end"))
    return T.span_to_tokens(T.tokenize(_docs(spark, d)), wide)


def span_to_tokens_snap(spark: SparkSession, d: str) -> DataFrame:
    return T.span_to_tokens(T.tokenize(_docs(spark, d)), _clicks(spark, d), snap=True)


def token_to_span(spark: SparkSession, d: str) -> DataFrame:
    ranges = read_table(spark, d, "documents").select("doc_id", F.lit(2).alias("first"), F.lit(6).alias("last"))
    return T.token_span_to_text(T.tokenize(_docs(spark, d)), ranges)


def context_window(spark: SparkSession, d: str) -> DataFrame:
    found = T.context_window(_docs(spark, d), 2)
    return found.select("doc_id", "idx", F.array_join("window", " ").alias("context"))


def keep_clicked_line(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.explode(X.tokens(F.col("text"), r"\n|")).alias("m")).select("doc_id", "m.begin", "m.end")
    tokens = T.tokenize(_docs(spark, d)).join(_clicks(spark, d), "doc_id", "left_semi")
    return T.keep_line(tokens, lines, _clicks(spark, d)).select("doc_id", "idx", "value", "begin", "end")


def center_token(spark: SparkSession, d: str) -> DataFrame:
    return T.center_token(T.tokenize(_docs(spark, d)), _clicks(spark, d))


def label_span_map(spark: SparkSession, d: str) -> DataFrame:
    return T.label_spans(spark, 12)


_T = f"t AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, text AS value, begin, CAST(begin + length(text) AS INTEGER) AS \"end\" FROM ({tokens_sql(' ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r')}))"
_C = f"""c AS (SELECT doc_id, arg_min(begin, begin) AS span_begin, arg_min("end", begin) AS span_end FROM ({find("[0-9]+")}) GROUP BY doc_id)"""
_BODIES = [b.replace(r"À-ɏ", "À-ɏ").replace(r"가-힯", "가-힯").replace(r"一-鿿", "一-鿿").replace(r"぀-ヿ", "぀-ヿ") for _, b in T.SCRIPTS]
_SCRIPT = "|".join([*(f"[{b}]+" for b in _BODIES), "[^" + "".join(_BODIES) + r"\x20\t\n\r]+"])

QUERIES = {q.__name__: q for q in (tokenize_space, tokenize_script_change, split_on_selection, span_to_tokens, span_to_tokens_snap, token_to_span, context_window, keep_clicked_line, center_token, label_span_map)}
SQL = {
    "tokenize_space": f"WITH {_T} SELECT * FROM t",
    "tokenize_script_change": f"""WITH {_T}, p AS (SELECT doc_id, idx, begin AS tb, regexp_extract_all(value, '{_SCRIPT}') AS m FROM t), u AS (SELECT doc_id, idx, tb, m, unnest(range(1, len(m) + 1)) AS i FROM p)
SELECT doc_id, idx, CAST(i - 1 AS INTEGER) AS part, m[i] AS value, CAST(tb + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS begin, CAST(tb + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS "end" FROM u""",
    "split_on_selection": f"""WITH {_T}, {_C}, j AS (SELECT t.*, list_sort(list_distinct(list_filter([begin, CASE WHEN span_begin + 1 > begin AND span_begin + 1 < "end" THEN span_begin + 1 END, CASE WHEN span_end > begin AND span_end < "end" THEN span_end END, "end"], lambda x: x IS NOT NULL))) AS cuts FROM t JOIN c USING (doc_id)),
u AS (SELECT *, unnest(range(1, len(cuts))) AS i FROM j)
SELECT doc_id, idx, CAST(i - 1 AS INTEGER) AS part, substr(value, cuts[i] - begin + 1, cuts[i+1] - cuts[i]) AS value, CAST(cuts[i] AS INTEGER) AS begin, CAST(cuts[i+1] AS INTEGER) AS "end" FROM u""",
    "span_to_tokens": f"""WITH {_T}, {_C}, s AS (SELECT doc_id, greatest(0, span_begin - 20) AS span_begin, span_end + 20 AS span_end FROM c)
SELECT s.doc_id, span_begin, span_end, min(idx) AS first, max(idx) + 1 AS last FROM s JOIN t ON t.doc_id = s.doc_id AND begin >= span_begin AND "end" <= span_end GROUP BY ALL""",
    "span_to_tokens_snap": f"""WITH {_T}, {_C} SELECT c.doc_id, span_begin, span_end, min(idx) AS first, max(idx) + 1 AS last FROM c JOIN t ON t.doc_id = c.doc_id AND begin < span_end AND "end" > span_begin GROUP BY ALL""",
    "token_to_span": f"""WITH {_T} SELECT doc_id, 2 AS first, 6 AS last, min(begin) AS begin, max("end") AS "end" FROM t WHERE idx >= 2 AND idx < 6 GROUP BY doc_id""",
    "context_window": f"""WITH {_T} SELECT doc_id, idx, concat_ws(' ', coalesce(lag(value, 2) OVER w, '<PAD>'), coalesce(lag(value, 1) OVER w, '<PAD>'), value, coalesce(lead(value, 1) OVER w, '<PAD>'), coalesce(lead(value, 2) OVER w, '<PAD>')) AS context FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""",
    "keep_clicked_line": f"""WITH {_T}, {_C}, l AS (SELECT doc_id, begin AS lb, begin + length(text) AS le FROM ({tokens_sql(chr(92) + 'n|')})), o AS (SELECT c.doc_id, min(lb) AS lb, max(le) AS le FROM c JOIN l ON l.doc_id = c.doc_id AND lb <= span_begin AND le >= span_end GROUP BY c.doc_id)
SELECT t.doc_id, idx, value, begin, "end" FROM t JOIN c USING (doc_id) LEFT JOIN o USING (doc_id) WHERE lb IS NULL OR (begin >= lb AND "end" <= le)""",
    "center_token": f"""WITH {_T}, {_C}, a AS (SELECT doc_id, span_begin, span_end, count(*) FILTER (begin >= span_begin AND "end" <= span_end) AS n, min(idx) FILTER (begin >= span_begin AND "end" <= span_end) AS one, min(idx) FILTER (begin <= span_begin AND "end" >= span_end) AS outer_ FROM c JOIN t USING (doc_id) GROUP BY ALL)
SELECT doc_id, span_begin, span_end, CASE WHEN n = 1 THEN one ELSE outer_ END AS center FROM a""",
    "label_span_map": """SELECT CAST(row_number() OVER (ORDER BY l, r) - 1 AS INTEGER) AS label, CAST(l AS INTEGER) AS "left", CAST(r AS INTEGER) AS "right" FROM range(13) a(l), range(13) b(r) WHERE l + r <= 12""",
}
