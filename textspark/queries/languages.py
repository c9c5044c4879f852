"""Language identification on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import languages as L
from textspark.sources import read_table

SCALE = 20.0


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text", "lang")


def _probable(spark: SparkSession, d: str) -> DataFrame:
    return L.softmax(L.self_scores(_docs(spark, d)), scale=SCALE)


def langid_trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.ngram_counts(_docs(spark, d)).select("doc_id", "gram", "n", F.round("weight", 6).alias("weight"))


def langid_script_share(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("text", F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit(" Ελλάδα мир")).otherwise("")))
    return docs.select("doc_id", F.explode(L.script_shares(F.col("text"))).alias("script", "share")).select("doc_id", "script", F.round("share", 6).alias("share"))


def langid_weights(spark: SparkSession, d: str) -> DataFrame:
    return L.train(_docs(spark, d))


def langid_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.self_scores(_docs(spark, d))


def langid_top1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return L.best(_probable(spark, d), {"en": 0.6, "fr": 0.4}).select("doc_id", "lang", F.round("probability", 6).alias("probability"))


def langid_ranked(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked(_probable(spark, d)).select("doc_id", "place", "lang", F.round("probability", 6).alias("probability"))


_G = r"""w AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY ALL),
g AS (SELECT doc_id, substr('^' || w || '$', CAST(i AS INTEGER), 3) AS gram, CAST(sum(c) AS BIGINT) AS n FROM (SELECT doc_id, w, c, unnest(range(1, length(w) + 1)) AS i FROM w) GROUP BY ALL)"""
_W = f"""{_G}, c AS (SELECT gram, lang, CAST(sum(n) AS BIGINT) AS n FROM g JOIN documents USING (doc_id) GROUP BY ALL), tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang), gr AS (SELECT DISTINCT gram FROM c),
wt AS (SELECT gr.gram, tot.lang, round(ln((coalesce(c.n, 0) + 1) / (total + (SELECT count(*) FROM gr))), 4) AS weight FROM gr CROSS JOIN tot LEFT JOIN c ON c.gram = gr.gram AND c.lang = tot.lang)"""
_S = f"{_W}, s AS (SELECT doc_id, lang, round(CAST(sum(n * CAST(weight AS DECIMAL(12,4))) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 4) AS score FROM g JOIN wt USING (gram) GROUP BY doc_id, lang)"
_P = f"{_S}, e AS (SELECT doc_id, lang, exp(greatest(-16.0, (score - max(score) OVER (PARTITION BY doc_id)) * {SCALE})) AS e FROM s), p AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS pr FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pr DESC, lang) AS place FROM p)"
_RX = {k: v.replace("'", "''") for k, v in L.SCRIPTS.items()}
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS {k}" for k, p in _RX.items())

QUERIES = {q.__name__: q for q in (langid_trigram_counts, langid_script_share, langid_weights, langid_scores, langid_top1_threshold, langid_ranked)}
SQL = {
    "langid_trigram_counts": f"WITH {_G} SELECT doc_id, gram, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS weight FROM g",
    "langid_script_share": f"WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Ελλάδα мир' ELSE '' END AS t FROM documents), c AS (SELECT doc_id, {_COUNTS} FROM d), a AS (SELECT *, {' + '.join(_RX)} AS total FROM c) "
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS script, CASE WHEN total > 0 THEN round({k} / total, 6) ELSE 0.0 END AS share FROM a" for k in _RX),
    "langid_weights": f"WITH {_W} SELECT gram, lang, weight FROM wt",
    "langid_scores": f"WITH {_S} SELECT doc_id, lang, score FROM s",
    "langid_top1_threshold": f"WITH {_P} SELECT doc_id, CASE WHEN pr >= CASE lang WHEN 'en' THEN 0.6 WHEN 'fr' THEN 0.4 ELSE 0.5 END THEN lang ELSE 'und' END AS lang, round(pr, 6) AS probability FROM r WHERE place = 1",
    "langid_ranked": f"WITH {_P} SELECT doc_id, CAST(place AS INTEGER) AS place, lang, round(pr, 6) AS probability FROM r",
}
