"""Annotation of streams of texts.

Conflicts are resolved inside the row of a text, so the stream needs no state and no
watermark: all candidates of a row form one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import spans as S


def annotate_stream(texts: DataFrame, rules: tuple[S.Rule, ...] = S.PII_RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, begin, end, collection, priority, text) for a streaming or a batch DataFrame; rows with null text have no spans."""
    found = []
    for r in S.enabled(rules, S.ANNOTATION):
        hits = X.find_all(F.col(text), r.pattern)
        hits = F.filter(hits, lambda m: X.luhn(m["text"])) if r.luhn else hits
        found.append(F.transform(hits, _ordered(r)))
    everything = F.array_sort(F.concat(*found))
    step = lambda acc, x: F.when(F.exists(acc, lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x)))
    rows = texts.select(id, everything.alias("xs")).select(id, F.explode(F.aggregate("xs", F.slice("xs", 1, 0), step)).alias("k"))
    return rows.select(id, "k.begin", "k.end", "k.collection", "k.priority", "k.text")


def _ordered(r: S.Rule):
    return lambda m: F.struct(F.lit(-r.priority).alias("o"), m["begin"].alias("begin"), m["end"].alias("end"), F.lit(r.id).alias("rule"), F.lit(r.collection).alias("collection"), F.lit(r.priority).alias("priority"), m["text"].alias("text"))
