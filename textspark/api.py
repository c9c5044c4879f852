"""The five questions that the library answers, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.operators import annotate as _annotate
from textspark.operators import conversations as _conversations
from textspark.operators import gates as _gates
from textspark.operators import languages as _languages
from textspark.operators.gates import Limits
from textspark.sources import rule_table


def annotate(df: DataFrame, **options) -> DataFrame:
    """All spans of each text that do not conflict: see ``operators.annotate.annotate``."""
    return _annotate.annotate(df, **options)


def classify(df: DataFrame, begin: str = "begin", end: str = "end", text: str = "text", limits: Limits = Limits(), tags: str | None = None) -> DataFrame:
    """Add ``collection`` and ``score`` of the selection [begin, end) of each row; a selection that is none is ``other``.

    An empty selection has neither.  ``limits`` are the gates of ``operators.gates``; ``tags``
    names a column with an array of languages, for dictionary words.
    """
    piece = F.coalesce(F.substring(F.col(text), F.col(begin) + 1, F.greatest(F.lit(0), F.col(end) - F.col(begin))), F.lit(""))
    found = F.when(_gates.valid_span(F.coalesce(F.col(text), F.lit("")), F.col(begin), F.col(end), inside=False), _annotate.classify(piece))
    languages = F.array().cast("array<string>") if tags is None else F.col(tags)
    rows = df.withColumn("_c", found)
    return rows.withColumns({"collection": _gates.classified(F.col("_c.collection"), piece, languages, limits), "score": F.col("_c.score")}).drop("_c")


def select(df: DataFrame, clicks: DataFrame, **options) -> DataFrame:
    """Each click grown to the span that it belongs to: see ``operators.annotate.select``."""
    return _annotate.select(df, clicks, **options)


def detect_language(df: DataFrame, weights: DataFrame, thresholds: dict[str, float] | None = None, id: str = "doc_id", text: str = "text", scale: float = 20.0) -> DataFrame:
    """(id, lang, probability) by weights from ``operators.languages.train``."""
    counts = _languages.ngram_counts(df.select(id, text), id, text)
    return _languages.best(_languages.softmax(_languages.scores(counts, weights, id), id, scale=scale), thresholds, id)


def suggest_actions(messages: DataFrame, patterns: list, mapping: list, rules: list, outputs: DataFrame | None = None, action_types: list = (), most_any: int = 2, most_last: int = 3, **limits) -> DataFrame:
    """Ranked actions (conv_id, place, type, response, turn, begin, end, score): from annotations of the usable history, from what a model says, and from rules on the last message.

    ``outputs`` are a model's (see ``operators.conversations.actions_of_model``), none by
    default; ``action_types`` are (name, enabled, least, type).  ``limits`` go to
    ``operators.conversations.gathered``, which runs all gates and the ranking.
    """
    spark = messages.sparkSession
    table = rule_table(spark, mapping, "collection string, type string, least double, use_score boolean, fixed_score double")
    types = rule_table(spark, action_types, "name string, enabled boolean, least double, type string")
    usable = _conversations.usable_history(messages, most_any, most_last)
    annotations = _conversations.annotate_messages(usable, patterns)
    if outputs is None:
        no_replies, no_scores = F.array().cast("array<struct<text:string,score:double>>"), F.create_map().cast("map<string,double>")
        outputs = messages.select("conv_id").distinct().select("conv_id", F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("trigger"), no_replies.alias("replies"), no_scores.alias("scores"))
    return _conversations.gathered(messages, annotations, table, rules, outputs, types, **limits)
