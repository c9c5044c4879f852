"""Whole-text annotation, classification of selections, growth of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import annotate as A
from textspark.operators import spans as S
from textspark.queries.spans import GREEDY, ISLANDS, LUHN, find, greedy_sql, tokens_sql
from textspark.queries.times import _DUE, _due
from textspark.queries.tokens import _C, _clicks, _docs
from textspark.queries.values import _EV, _IG, _NUM, _events
from textspark.sources import read_table


def classify_text(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("word")).where(F.col("word").rlike("[0-9@]")).distinct()
    return words.select("doc_id", "word", A.classify(F.col("word")).alias("c")).select("doc_id", "word", F.col("c.collection").alias("collection"), F.col("c.score").alias("score"))


def suggest_selection(spark: SparkSession, d: str) -> DataFrame:
    return A.select(_docs(spark, d), _clicks(spark, d))


def annotate_times(spark: SparkSession, d: str) -> DataFrame:
    """All generators on the sentences made from orders."""
    return A.annotate(_due(spark, d), types=("date", "datetime")).select("doc_id", "begin", "end", "collection", "text")


SAID = " from 2024-03-05 for 2 hours ok"


def annotate_all(spark: SparkSession, d: str) -> DataFrame:
    """All generators on documents; a date and a duration, which they lack, are put behind each."""
    return A.annotate(_docs(spark, d).withColumn("text", F.concat("text", F.lit(SAID))))


def duration_classify(spark: SparkSession, d: str) -> DataFrame:
    """The sentences made from events, without their first three words."""
    cut = _events(spark, d).select("doc_id", F.regexp_replace("text", "^wake me in ", "").alias("text"))
    return A.classify_durations(cut)


_SEP = " " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r"
_ALL = (
    f"e AS (SELECT doc_id, text || '{SAID}' AS text, length(text) AS n FROM documents), t AS ({tokens_sql(_SEP, 'e')}), u AS (SELECT doc_id, begin, text AS value, regexp_replace(regexp_replace(text, '^{_IG}+', ''), '{_IG}+$', '') AS core FROM t), "
    + f"v AS (SELECT doc_id, begin + length(value) - length(regexp_replace(value, '^{_IG}+', '')) + length(core) - length(regexp_replace(core, '^[$]+', '')) AS b, regexp_extract(core, '{_NUM}', 1) AS d FROM u WHERE regexp_matches(core, '{_NUM}')), c AS ("
    + " UNION ALL ".join(find(r.pattern, r.id, f", '{r.collection}' AS collection, CAST({r.priority} AS DOUBLE) AS priority", f" WHERE {LUHN}" if r.luhn else "", table="e") for r in S.PII_RULES)
    + """ UNION ALL SELECT doc_id, CAST(b AS INTEGER), CAST(b + length(d) AS INTEGER), d, 1000, 'number', CAST(0.1 AS DOUBLE) FROM v WHERE TRY_CAST(d AS BIGINT) IS NOT NULL
UNION ALL SELECT doc_id, CAST(n + 6 AS INTEGER), CAST(n + 16 AS INTEGER), '2024-03-05', 1002, 'date', CAST(0.65 AS DOUBLE) FROM e UNION ALL SELECT doc_id, CAST(n + 21 AS INTEGER), CAST(n + 28 AS INTEGER), '2 hours', 1001, 'duration', CAST(0.6 AS DOUBLE) FROM e)"""
)
_RULES = " UNION ALL ".join(
    [f"SELECT doc_id, word, '{r.collection}' AS collection, CAST({r.priority} AS DOUBLE) AS p FROM (SELECT *, word AS t FROM w WHERE regexp_full_match(word, '{r.pattern}'))" + (f" WHERE {LUHN}" if r.luhn else "") for r in S.PII_RULES]
    + ["SELECT doc_id, word, 'number', 0.1 FROM w WHERE regexp_full_match(word, '[$]*[+-]?[0-9]+[%]*') AND TRY_CAST(regexp_extract(word, '[+-]?[0-9]+') AS BIGINT) IS NOT NULL"]
    + [f"SELECT doc_id, word, '{'datetime' if 'hour' in g else 'date'}', 0.65 FROM w WHERE regexp_full_match(word, '{p}')" for p, g in A.D.PATTERNS]
)

QUERIES = {q.__name__: q for q in (classify_text, suggest_selection, annotate_times, annotate_all, duration_classify)}
SQL = {
    "classify_text": f"""WITH w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) WHERE regexp_matches(word, '[0-9@]')), h AS ({_RULES}),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY p DESC, collection) = 1)
SELECT w.doc_id, w.word, coalesce(collection, 'other') AS collection, 1.0 AS score FROM w LEFT JOIN b USING (doc_id, word)""",
    "suggest_selection": GREEDY
    + f""", {_C.replace("c AS", "clicks AS", 1)}, h AS (SELECT c.doc_id, span_begin, span_end, x.b AS b, x.e AS e, x.t AS t FROM clicks c JOIN k ON k.doc_id = c.doc_id AND x.b < span_end AND span_begin < x.e QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY x.p DESC, x.b, x.e) = 1)
SELECT c.doc_id, c.span_begin, c.span_end, coalesce(CASE WHEN t[1] = '(' AND strpos(t, ')') = 0 THEN b + 1 ELSE b END, c.span_begin) AS begin, coalesce(CASE WHEN t[-1] = ')' AND strpos(t, '(') = 0 THEN e - 1 ELSE e END, c.span_end) AS "end" FROM clicks c LEFT JOIN h ON h.doc_id = c.doc_id""",
    "annotate_times": f"""WITH {_DUE} SELECT doc_id, begin, "end", CASE WHEN pattern = 0 THEN 'datetime' ELSE 'date' END AS collection, text FROM l""",
    "annotate_all": f'WITH RECURSIVE {_ALL}, {ISLANDS}, {greedy_sql()} SELECT doc_id, x.b AS begin, x.e AS "end", x.c AS collection, x.p AS priority, x.t AS text FROM k',
    "duration_classify": f"""WITH {_EV} SELECT doc_id, CAST(CASE k WHEN 0 THEN n * 3600000 + 1800000 WHEN 1 THEN NULL WHEN 2 THEN n * 86400000 + 1800000 ELSE NULL END AS BIGINT) AS duration_ms FROM e""",
}
