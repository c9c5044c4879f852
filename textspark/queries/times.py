"""Dates and times made from orders, and their interpretation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import times as D
from textspark.sources import read_table


def _due(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a date, made from orders."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", (F.col("o_orderkey") % 3).alias("k"))
    iso, dots = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd.MM.yyyy")
    stamp = F.concat(iso, F.lit(" "), F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit(":07"))
    return o.select("doc_id", F.concat(F.lit("due "), F.when(F.col("k") == 0, iso).when(F.col("k") == 1, dots).otherwise(stamp), F.lit(" ok")).alias("text"))


def datetime_extract(spark: SparkSession, d: str) -> DataFrame:
    return D.extract(_due(spark, d)).select("doc_id", "begin", "end", "pattern", "text", *(F.col(f"data.{f}").alias(f) for f in D.FIELDS[:6]))


def datetime_longest_first(spark: SparkSession, d: str) -> DataFrame:
    return D.longest_first(D.extract(_due(spark, d))).select("doc_id", "begin", "end", "pattern", "text")


def datetime_interpret(spark: SparkSession, d: str) -> DataFrame:
    found = D.longest_first(D.extract(_due(spark, d)))
    return found.select("doc_id", "begin", D.interpret(F.col("data"), F.lit(0).cast("bigint"), F.lit("Europe/Zurich")).alias("time_ms"))


def datetime_granularity(spark: SparkSession, d: str) -> DataFrame:
    size = D.granularity(F.col("data"))
    return D.longest_first(D.extract(_due(spark, d))).select("doc_id", "begin", size.alias("granularity"), D.collection(size).alias("collection"))


def datetime_relation(spark: SparkSession, d: str) -> DataFrame:
    """Each event: next weekday, last month, in n hours, tomorrow, seen from the event."""
    e = read_table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now"))
    k, n = F.col("event_id") % 4, (F.col("event_id") % 50 + 1).cast("int")
    relation = F.when(k == 0, D.NEXT).when(k == 1, D.LAST).when(k == 2, D.FUTURE).otherwise(D.TOMORROW)
    kind = F.when(k == 0, (F.col("event_id") % 7 + 1).cast("int")).when(k == 1, D.R_MONTH).when(k == 2, D.R_HOUR)
    data = D.parse_data(relation=relation, relation_type=kind, distance=F.when(k == 2, n))
    return e.select("event_id", D.interpret(data, F.col("now"), F.lit("UTC")).alias("time_ms"))


def datetime_alternatives(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", (F.col("event_id") % 24).cast("int").alias("h"))
    rows = e.select("event_id", F.explode(D.interpretations(D.parse_data(hour=F.col("h"), minute=F.lit(30)))).alias("x"))
    return rows.select("event_id", F.col("x.ampm").alias("ampm"), D.interpret(F.col("x"), F.lit(0).cast("bigint"), F.lit("UTC")).alias("time_ms"))


def written_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id")
    word = lambda ws, m: F.element_at(F.array(*map(F.lit, ws)), (F.col("event_id") % m + 1).cast("int"))
    text = F.concat_ws(" ", word(("twenty", "fifty", "ninety"), 3), word(("one", "two", "seven", "nine"), 4), F.lit("thousand"), word(("three", "eight"), 2), F.lit("hundred and"), word(("five", "eleven", "forty"), 3))
    return e.select("event_id", D.written_number(text).alias("number"))


def datetime_locale_expand(spark: SparkSession, d: str) -> DataFrame:
    tags = F.element_at(F.array(*map(F.lit, ("en-US", "zh-Hant-TW,en-US", "de-CH", "fr,de-CH", "zh-SG"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return D.expand_locales(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), tags.alias("tags")), ("en-US", "default"))


_DUE = """due AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate,
  'due ' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':07' END || ' ok' AS text FROM orders),
p(pattern, p) AS (VALUES """ + ", ".join(f"({i}, '{p}')" for i, (p, _) in enumerate(D.PATTERNS)) + """),
m AS (SELECT doc_id, pattern, CASE WHEN pattern = 3 THEN 15 ELSE 4 END AS begin, CASE pattern WHEN 0 THEN substr(text, 5, 19) WHEN 3 THEN substr(text, 16, 5) ELSE substr(text, 5, 10) END AS t, o_orderdate FROM due, p
  WHERE (pattern = 0 AND k = 2) OR (pattern = 1 AND k <> 1) OR (pattern = 2 AND k = 1) OR (pattern = 3 AND k = 2)),
x AS (SELECT doc_id, CAST(begin AS INTEGER) AS begin, CAST(begin + length(t) AS INTEGER) AS "end", CAST(pattern AS INTEGER) AS pattern, t AS text, o_orderdate FROM m WHERE regexp_full_match(t, (SELECT p.p FROM p WHERE p.pattern = m.pattern))),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "end" - begin DESC, pattern) = 1)"""
_ZURICH = "CAST(epoch_ms(timezone('Europe/Zurich', o_orderdate + CASE WHEN pattern = 0 THEN to_hours(doc_id % 24) + to_minutes(doc_id % 60) + to_seconds(7) ELSE to_hours(0) END)) AS BIGINT)"

QUERIES = {q.__name__: q for q in (datetime_extract, datetime_longest_first, datetime_interpret, datetime_granularity, datetime_relation, datetime_alternatives, written_numbers, datetime_locale_expand)}
SQL = {
    "datetime_extract": f"""WITH {_DUE} SELECT doc_id, begin, "end", pattern, text, CASE WHEN pattern <> 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN pattern <> 3 THEN CAST(month(o_orderdate) AS INTEGER) END AS month, CASE WHEN pattern <> 3 THEN CAST(day(o_orderdate) AS INTEGER) END AS day,
CASE WHEN pattern IN (0, 3) THEN CAST(doc_id % 24 AS INTEGER) END AS hour, CASE WHEN pattern IN (0, 3) THEN CAST(doc_id % 60 AS INTEGER) END AS minute, CASE WHEN pattern = 0 THEN 7 END AS second FROM x""",
    "datetime_longest_first": f'WITH {_DUE} SELECT doc_id, begin, "end", pattern, text FROM l',
    "datetime_interpret": f"WITH {_DUE} SELECT doc_id, begin, {_ZURICH} AS time_ms FROM l",
    "datetime_granularity": f"WITH {_DUE} SELECT doc_id, begin, CASE WHEN pattern = 0 THEN 6 ELSE 3 END AS granularity, CASE WHEN pattern = 0 THEN 'datetime' ELSE 'date' END AS collection FROM l",
    "datetime_relation": """WITH e AS (SELECT event_id, ts, event_id % 4 AS k, event_id % 50 + 1 AS n, (event_id % 7 + 1) - (dayofweek(ts) + 1) AS ahead FROM events)
SELECT event_id, CAST(epoch_ms(CASE k WHEN 0 THEN date_trunc('day', ts) + to_days(CAST(CASE WHEN ahead <= 0 THEN ahead + 7 ELSE ahead END AS INTEGER)) WHEN 1 THEN date_trunc('month', ts) - INTERVAL 1 MONTH
WHEN 2 THEN date_trunc('milliseconds', ts) + to_hours(n) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END) AS BIGINT) AS time_ms FROM e""",
    "datetime_alternatives": """WITH e AS (SELECT event_id, event_id % 24 AS h FROM events), a AS (SELECT event_id, h, 0 AS ampm FROM e WHERE h <= 12 UNION ALL SELECT event_id, h, 1 FROM e WHERE h <= 12 UNION ALL SELECT event_id, h, NULL FROM e WHERE h > 12)
SELECT event_id, ampm, CAST(((h + CASE WHEN ampm = 1 AND h < 12 THEN 12 ELSE 0 END) * 60 + 30) * 60000 AS BIGINT) AS time_ms FROM a""",
    "written_numbers": "SELECT event_id, CAST(((CASE event_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 50 ELSE 90 END) + (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 7 ELSE 9 END)) * 1000 + (CASE event_id % 2 WHEN 0 THEN 3 ELSE 8 END) * 100 + (CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 11 ELSE 40 END) AS INTEGER) AS number FROM events",
    "datetime_locale_expand": """WITH l(k, ord, locale) AS (VALUES (0, 0, 'en-US'), (0, 1, '*-US'), (0, 2, 'en-*'), (0, 3, 'default'), (1, 0, 'zh-Hant-TW'), (1, 1, '*-TW'), (1, 2, 'zh-Hant-*'), (1, 3, 'zh-*'), (1, 4, 'en-US'), (1, 5, '*-US'), (1, 6, 'en-*'), (1, 7, 'default'),
(2, 0, 'de-CH'), (2, 1, '*-CH'), (2, 2, 'de-*'), (2, 3, 'en-US'), (2, 4, 'default'), (3, 0, 'fr'), (3, 1, 'fr-*'), (3, 2, 'de-CH'), (3, 3, '*-CH'), (3, 4, 'de-*'), (3, 5, 'en-US'), (3, 6, 'default'), (4, 0, 'zh-SG'), (4, 1, '*-SG'), (4, 2, 'zh-*'), (4, 3, 'en-US'), (4, 4, 'default'))
SELECT n_nationkey AS id, ord, locale FROM nation JOIN l ON n_nationkey % 5 = k""",
}
