"""Numbers, durations and dictionary phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import tokens as T
from textspark.operators import values as V
from textspark.queries.tokens import _T, _docs
from textspark.sources import read_table


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with durations, made from events."""
    e = read_table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id"))
    n, k = F.col("doc_id") % 90 + 1, F.col("user_id") % 4
    units = F.element_at(F.array(*map(F.lit, ("hours", "minutes", "days", "weeks"))), (k + 1).cast("int"))
    text = F.concat(F.lit("wake me in "), n.cast("string"), F.lit(" "), units, F.when(k == 0, F.lit(" and a half")).when(k == 1, F.lit(" and 5 seconds, ok")).when(k == 2, F.lit(", half an hour")).otherwise(F.lit(" please")))
    return e.select("doc_id", text.alias("text"))


def number_find_all(spark: SparkSession, d: str) -> DataFrame:
    return V.find_numbers(_docs(spark, d)).drop("text")


def number_classify(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("word")).where(F.col("word").rlike("[0-9]")).distinct()
    return words.select("doc_id", "word", V.classify_number(F.col("word")).alias("number"))


def duration_find_all(spark: SparkSession, d: str) -> DataFrame:
    return V.find_durations(_events(spark, d)).drop("text")


def duration_kinds(spark: SparkSession, d: str) -> DataFrame:
    return V.duration_tokens(T.tokenize(_events(spark, d))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amounts"))


def dictionary_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Every three words of each benchmark item that follow each other, searched in all documents."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "")
    threes = F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.array_join(F.slice("ws", i, F.lit(3)), " "))
    phrases = read_table(spark, d, "benchmark").select(words.alias("ws")).where(F.size("ws") >= 3).select(F.explode(threes).alias("phrase")).distinct()
    return V.dictionary_phrases(_docs(spark, d), phrases, (3,))


_IG = r"[.,\[\]()!?]"
_NUM = r"^[\$]*([+-]?[0-9]+)[%]*$"
_EV = """e AS (SELECT event_id AS doc_id, 'wake me in ' || CAST(event_id % 90 + 1 AS VARCHAR) || ' ' || (['hours', 'minutes', 'days', 'weeks'])[user_id % 4 + 1] ||
  CASE user_id % 4 WHEN 0 THEN ' and a half' WHEN 1 THEN ' and 5 seconds, ok' WHEN 2 THEN ', half an hour' ELSE ' please' END AS text, user_id % 4 AS k, event_id % 90 + 1 AS n FROM events)"""

QUERIES = {q.__name__: q for q in (number_find_all, number_classify, duration_find_all, duration_kinds, dictionary_phrases)}
SQL = {
    "number_find_all": f"""WITH {_T}, n AS (SELECT doc_id, idx, begin, value, regexp_replace(regexp_replace(value, '^{_IG}+', ''), '{_IG}+$', '') AS core, length(value) - length(regexp_replace(value, '^{_IG}+', '')) AS front FROM t),
m AS (SELECT *, regexp_extract(core, '{_NUM}', 1) AS digits, length(core) - length(regexp_replace(core, '^[\\$]+', '')) AS skip FROM n WHERE regexp_matches(core, '{_NUM}'))
SELECT doc_id, idx, CAST(begin + front + skip AS INTEGER) AS begin, CAST(begin + front + skip + length(digits) AS INTEGER) AS "end", TRY_CAST(digits AS BIGINT) AS number FROM m WHERE TRY_CAST(digits AS BIGINT) IS NOT NULL""",
    "number_classify": f"""WITH w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) WHERE regexp_matches(word, '[0-9]'))
SELECT doc_id, word, CASE WHEN regexp_matches(word, '{_NUM}') THEN TRY_CAST(regexp_extract(word, '{_NUM}', 1) AS BIGINT) END AS number FROM w""",
    "duration_find_all": f"""WITH {_EV}, p AS (SELECT *, length(CAST(n AS VARCHAR)) AS l FROM e)
SELECT doc_id, 11 AS begin, CAST(11 + l + 1 + CASE k WHEN 0 THEN 5 + 11 WHEN 1 THEN 7 + 14 WHEN 2 THEN 4 + 14 ELSE 5 END AS INTEGER) AS "end",
CAST(CASE k WHEN 0 THEN n * 3600000 + 1800000 WHEN 1 THEN n * 60000 + 5000 WHEN 2 THEN n * 86400000 + 1800000 ELSE n * 604800000 END AS BIGINT) AS duration_ms FROM p""",
    "duration_kinds": f"""WITH {_EV}, w AS (SELECT rtrim(ltrim(unnest(string_split(text, ' ')), ','), ',') AS w FROM e), c AS (SELECT CASE WHEN regexp_full_match(w, '(week|day|hour|minute|second)s?') THEN 'U' WHEN regexp_full_match(w, '[0-9]+') THEN 'Q' WHEN w = 'half' THEN 'H' WHEN w IN ('and', 'a', 'an', 'one') THEN 'F' END AS kind, TRY_CAST(w AS BIGINT) AS amount FROM w)
SELECT kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amounts FROM c GROUP BY kind""",
    "dictionary_phrases": f"""WITH {_T}, q AS (SELECT list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM benchmark), h AS (SELECT DISTINCT array_to_string(ws[i:i + 2], ' ') AS phrase FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM q WHERE len(ws) >= 3)),
v AS (SELECT doc_id, begin, lower(value) || ' ' || lower(lead(value, 1) OVER w) || ' ' || lower(lead(value, 2) OVER w) AS phrase, lead("end", 2) OVER w AS e FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, begin, e AS "end", phrase FROM v JOIN h USING (phrase) WHERE e IS NOT NULL""",
}
