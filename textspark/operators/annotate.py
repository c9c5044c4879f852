"""The whole-text operators: annotate, classify a selection, grow a click to a selection.

All generators give the same rows (id, begin, end, rule, collection, priority, source, text);
they are narrow but for numbers and durations, which need tokens in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import spans as S
from textspark.operators import times as D
from textspark.operators import tokens as T
from textspark.operators import values as V

#: Rule numbers of the generators that are no patterns, and their priorities.
NUMBER, DURATION, DATETIME = 1000, 1001, 1002
PRIORITY = {NUMBER: 0.1, DURATION: 0.6, DATETIME: 0.65}
KINDS = ("number", "duration", "datetime")


def _found(df: DataFrame, id: str, rule: int, collection: Column, source: str, text: Column) -> DataFrame:
    return df.select(id, "begin", "end", F.lit(rule).alias("rule"), collection.alias("collection"), F.lit(PRIORITY[rule]).alias("priority"), F.lit(source).alias("source"), text.alias("text"))


def candidates(df: DataFrame, rules: tuple[S.Rule, ...] = S.PII_RULES, kinds: tuple[str, ...] = KINDS, id: str = "doc_id", text: str = "text", mode: int = S.ANNOTATION) -> DataFrame:
    """Candidates of all rules and generators; dates and durations that are not asked for are not made."""
    out = S.candidates(df, rules, id, text, mode)
    if "datetime" in kinds:
        times = D.longest_first(D.extract(df, id, text), id)
        out = out.unionByName(_found(times, id, DATETIME, D.collection(D.granularity(F.col("data"))), S.DATETIME, F.col("text")))
    if "number" in kinds:
        out = out.unionByName(_found(V.find_numbers(df, id, text), id, NUMBER, F.lit("number"), S.OTHER, F.col("text")))
    if "duration" in kinds:
        out = out.unionByName(_found(V.find_durations(df, id, text), id, DURATION, F.lit("duration"), S.DURATION, F.col("text")))
    return out


def annotate(
    df: DataFrame, rules: tuple[S.Rule, ...] = S.PII_RULES, kinds: tuple[str, ...] = KINDS, types: tuple[str, ...] = (), raw: bool = False, id: str = "doc_id", text: str = "text",
    modes: int = S.ANNOTATION, characters: str = "", least_supported: float = 0.0, filtered: tuple[str, ...] = (), least_priority: float | None = None,
) -> DataFrame:
    """(id, begin, end, collection, priority, text): spans without conflicts; ``types`` filters after the resolution.

    Without the bit of annotation in ``modes`` there are none; texts with too few supported
    ``characters`` (a class body) have none; collections in ``filtered`` and spans below
    ``least_priority`` are not reported.
    """
    rows = df if modes & S.ANNOTATION else df.limit(0)
    rows = rows.where(X.passes_ratio(F.col(text), characters, least_supported)) if characters else rows
    kept = S.greedy(S.islands(candidates(rows, rules, kinds, id, text), id), id, raw)
    kept = kept.where(F.col("collection").isin(*types)) if types else kept
    kept = kept.where(~F.col("collection").isin(*filtered)) if filtered else kept
    kept = kept.where(F.col("priority") >= least_priority) if least_priority is not None else kept
    return kept.select(id, "begin", "end", "collection", "priority", "text")


def classify(selection: Column, rules: tuple[S.Rule, ...] = S.PII_RULES) -> Column:
    """(collection, score, priority) of a selected text: the best rule, number or date that it is as a whole, else ``other``."""
    entry = lambda name, score, priority: F.struct(F.lit(-priority).alias("o"), F.lit(name).alias("collection"), F.lit(score).alias("score"), F.lit(priority).alias("priority"))
    hits = []
    for r in S.enabled(rules, S.CLASSIFICATION):
        fits = selection.rlike(f"^(?:{r.pattern})$") & (X.luhn(selection) if r.luhn else F.lit(True))
        hits.append(F.when(fits, entry(r.collection, r.score, r.priority)))
    hits.append(F.when(V.classify_number(selection).isNotNull(), entry("number", 1.0, PRIORITY[NUMBER])))
    for pattern, groups in D.PATTERNS:
        hits.append(F.when(selection.rlike(f"^(?:{pattern})$"), entry("datetime" if "hour" in groups else "date", 1.0, PRIORITY[DATETIME])))
    found = F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return F.coalesce(F.get(found, F.lit(0)), entry("other", 1.0, -1.0))


def select(df: DataFrame, clicks: DataFrame, rules: tuple[S.Rule, ...] = S.PII_RULES, kinds: tuple[str, ...] = (), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, span_begin, span_end, begin, end): the best span that overlaps a click, without unpaired brackets; else the click."""
    kept = S.greedy(S.islands(candidates(df, rules, kinds, id, text, S.SELECTION), id), id).drop("text")
    c = clicks.select(id, "span_begin", "span_end")
    hits = c.join(kept, id).where((F.col("begin") < F.col("span_end")) & (F.col("span_begin") < F.col("end")))
    order = Window.partitionBy(id, "span_begin", "span_end").orderBy(F.desc("priority"), "begin", "end")
    best = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(id, "span_begin", "span_end", "begin", "end")
    rows = c.join(best, [id, "span_begin", "span_end"], "left").join(df.select(id, F.col(text).alias("_t")), id)
    grown = X.strip_brackets(F.col("_t"), F.coalesce("begin", "span_begin"), F.coalesce("end", "span_end"))
    return rows.select(id, "span_begin", "span_end", grown.alias("_s")).select(id, "span_begin", "span_end", "_s.begin", "_s.end")


def classify_durations(selections: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, duration_ms): selections of which every token belongs to one duration; others are null."""
    whole = f"^[{T.SPACE}]*(?:{V.duration_runs()})[{T.SPACE}]*$"
    found = V.find_durations(selections.where(F.col(text).rlike(whole)), id, text).groupBy(id).agg(F.min("duration_ms").alias("duration_ms"))
    return selections.select(id).join(found, id, "left")
