"""Candidate spans from rules, and the resolution of their conflicts.

A candidate is a row (id, begin, end, rule, collection, priority, source, text).
Everything up to the conflicts is narrow; the conflicts need one shuffle by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import text as X

ANNOTATION, CLASSIFICATION, SELECTION = 1, 2, 4
OTHER, KNOWLEDGE, DURATION, DATETIME = "OTHER", "KNOWLEDGE", "DURATION", "DATETIME"


@dataclass(frozen=True)
class Rule:
    """A pattern that makes candidates.

    With ``prefix`` or ``suffix`` these are matched around ``pattern`` but are no part of the
    span; ``fields`` names groups of ``pattern`` (which then has one group for each) whose
    texts become entity data, beside the fixed ``data``.
    """

    id: int
    collection: str
    pattern: str
    priority: float
    modes: int = ANNOTATION | CLASSIFICATION | SELECTION
    luhn: bool = False
    score: float = 1.0
    source: str = OTHER
    prefix: str = ""
    suffix: str = ""
    fields: tuple[str, ...] = ()
    data: tuple[tuple[str, str], ...] = ()

    @property
    def whole(self) -> str:
        return f"({self.prefix})({self.pattern})({self.suffix})" if self.prefix or self.suffix else self.pattern


PII_RULES = (
    Rule(0, "email", "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.]*[A-Za-z0-9]", 0.9),
    Rule(1, "payment_card", "[0-9]{13,19}", 0.8, luhn=True),
    Rule(2, "ip", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0.7),
    Rule(3, "number", "[0-9]+", 0.1),
    Rule(4, "phone", "[+]?[0-9][0-9() -]{6,}[0-9]", 0.5),
)


def enabled(rules: tuple[Rule, ...], mode: int) -> tuple[Rule, ...]:
    return tuple(r for r in rules if r.modes & mode)


def candidates(df: DataFrame, rules: tuple[Rule, ...] = PII_RULES, id: str = "doc_id", text: str = "text", mode: int = ANNOTATION) -> DataFrame:
    """All matches of all rules that are enabled for ``mode``; one pass over the texts."""
    found = []
    for r in enabled(rules, mode):
        hits = X.find_all(F.col(text), r.whole)
        if r.prefix or r.suffix:
            hits = F.transform(hits, _core(r))
        if r.luhn:
            hits = F.filter(hits, lambda m: X.luhn(m["text"]))
        found.append(F.transform(hits, _labelled(r)))
    rows = df.select(F.col(id), F.explode(F.concat(*found)).alias("_c"))
    return rows.select(id, "_c.*")


def _core(r: Rule):
    """The part of a match between prefix and suffix."""

    def cut(m: Column) -> Column:
        begin = m["begin"] + F.length(F.regexp_extract(m["text"], r.whole, 1))
        inner = F.regexp_extract(m["text"], r.whole, 2)
        return F.struct(begin.alias("begin"), (begin + F.length(inner)).alias("end"), inner.alias("text"))

    return cut


def entity_data(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", rule: str = "rule", out: str = "data") -> DataFrame:
    """Add ``out``: the map of fixed data and of the groups of each span's rule; groups that matched nothing are left out."""
    found = None
    for r in rules:
        if not (r.fields or r.data):
            continue
        groups = [F.struct(F.lit(name).alias("key"), F.regexp_extract(text, f"^(?:{r.pattern})$", i + 1).alias("value")) for i, name in enumerate(r.fields)]
        fixed = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in r.data if k not in r.fields]
        entries = F.map_from_entries(F.filter(F.array(*fixed, *groups), lambda e: e["value"] != ""))
        found = F.when(F.col(rule) == r.id, entries) if found is None else found.when(F.col(rule) == r.id, entries)
    return df.withColumn(out, F.lit(None).cast("map<string,string>") if found is None else found)


def _labelled(r: Rule):
    return lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.lit(r.id).alias("rule"), F.lit(r.collection).alias("collection"), F.lit(r.priority).alias("priority"), F.lit(r.source).alias("source"), m["text"].alias("text"))


def islands(df: DataFrame, id: str = "doc_id") -> DataFrame:
    """Add ``component``: candidates of an id that overlap, directly or through others, share it."""
    order = Window.partitionBy(id).orderBy("begin", "end", "rule")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("begin") >= reach).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("component", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def conflicts(a: Column, b: Column, raw: bool) -> Column:
    """Whether overlapping candidates exclude each other; in raw use some kinds live side by side."""
    if not raw:
        return F.lit(True)
    pair = lambda x, y: (a["source"] == x) & (b["source"] == y)
    return ~(pair(DURATION, DATETIME) | pair(DATETIME, DURATION) | (a["source"] == KNOWLEDGE) | (b["source"] == KNOWLEDGE))


def greedy(df: DataFrame, id: str = "doc_id", raw: bool = False) -> DataFrame:
    """Keep candidates by priority unless one that is kept overlaps and conflicts.

    Works on components, which are short lists; order: priority, begin, end, rule.
    """
    fields = ["begin", "end", "rule", "collection", "priority", "source", "text"]
    item = F.struct((-F.col("priority")).alias("_order"), *fields)
    if "component" not in df.columns:
        df = islands(df, id)
    grouped = df.groupBy(id, "component").agg(F.sort_array(F.collect_list(item)).alias("_xs"))

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"]) & conflicts(x, y, raw))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.when(F.size("_xs") == 1, F.col("_xs")).otherwise(F.aggregate("_xs", F.slice("_xs", 1, 0), step))
    return grouped.select(id, "component", F.explode(kept).alias("_k")).select(id, "component", *(f"_k.{f}" for f in fields))


def merged(df: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row for each span: its collections, best priority first."""
    item = F.struct((-F.col("priority")).alias("o"), "collection")
    return df.groupBy(id, "begin", "end").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["collection"]).alias("collections"), F.max("priority").alias("priority"))


def without_collections(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """Left anti join with a table of collections that are not reported."""
    return df.join(dropped, "collection", "left_anti")


def classify_full(df: DataFrame, rules: tuple[Rule, ...], id: str, text: str = "text") -> DataFrame:
    """Every rule that matches a whole text."""
    hits = [F.when(F.col(text).rlike(f"^(?:{r.pattern})$") & (X.luhn(F.col(text)) if r.luhn else F.lit(True)), F.struct(F.lit(r.id).alias("rule"), F.lit(r.collection).alias("collection"), F.lit(r.priority).alias("priority"))) for r in enabled(rules, CLASSIFICATION)]
    return df.select(id, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_c")).select(id, "_c.*")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
