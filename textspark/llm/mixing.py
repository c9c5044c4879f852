"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in shuffled order (md5 of its id and text).
A copy of a document finishes at the virtual time *words of the source up to and
including it / target of the source*; the second copy of a source's documents
queues up behind the first.  The mix takes copies in the order of finish times,
over all sources, until the budget is spent; the copy that crosses the budget is
taken in part, so the budget is met to the word.

Targets: sources in code point order (null last) get the weights in turn; a
target stops at ``most`` times the size of its source and what is above is
shared anew by weight, until no target is above (water filling).

The order of the mix is a global sort: copies are dealt to ranges of finish time
(``repartitionByRange``), the words of each range are added up, and the range in which
the budget ends is searched for the copy at which it ends.  What comes before that copy
is taken, the rest is cut off.

Scale: a source may hold any share of the rows.  Running sums inside a source are taken
per (source, leading digits of the shuffle key), with so many digits that about ``ROWS``
rows share them, and joined with the sums of the digits before, so no task sees a whole
source.  Ranges grow in number with the rows.  Only a table with one row per source is
sorted in one place; two scalars, the last copy, and one row for each range reach the
driver.

Defined results: a null or empty text has size 0 and is never taken; a null source
is a source of its own; documents are shuffled by the md5 of id and text, where null
counts as empty, so rows without an id are spread as well; repeated rows queue up each
for itself (their copies are told apart by position); an empty table, or one without
words, gives no words; columns in ``keep`` stay, others do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.llm.common import cut, delete

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows that share the hexadecimal digits of the shuffle key which deal a source's rows to tasks; rows of a range.
ROWS = 250_000
DIGITS = 3
RANGE = 500_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(id: str = "doc_id", text: str = "text") -> Column:
    """What documents of a source are ordered by before all else."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(part(id), F.lit(" "), part(text)).cast("binary"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``turn`` (place of the source) and ``target`` to rows (source, source_size)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = sources.withColumn("turn", F.row_number().over(by_name))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    rows = turn.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("level", "turn").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "turn").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("weights", F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("left") > F.col("level") * F.col("weights"))
    rows = rows.withColumn("free_left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)).withColumn("free_weights", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    return rows.select("source", "source_size", "turn", F.when(F.col("full"), F.col("cap")).otherwise(F.col("free_left") * F.col("weight") / F.col("free_weights")).alias("target"))


def mix(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the columns in ``keep``."""
    shuffled = shuffle_key(id, text)
    narrow = cut(documents.select(F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), shuffled.alias("key"), *keep))
    rows = narrow.count()
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = cut(targets(sizes, weights, share, most))
    budget = int(float(shares.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share)
    digits = F.substring("key", 1, max(DIGITS, math.ceil(math.log(max(1, rows / ROWS), 16))))
    # one row for each source and digits
    by = narrow.groupBy("source", digits.alias("digits")).agg(F.sum("size").alias("words"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by.select(F.col("source").alias("s"), F.col("digits").alias("d"), start.alias("start"))
    named = shares.select(F.col("source").alias("n"), "source_size", "turn", "target")
    starts = starts.join(named, F.col("s").eqNullSafe(F.col("n"))).drop("n")
    inside = F.sum("size").over(Window.partitionBy("source", "digits").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = narrow.withColumn("digits", digits).withColumn("inside", inside)
    queued = queued.join(starts, queued["source"].eqNullSafe(starts["s"]) & (queued["digits"] == starts["d"])).drop("s", "d", "digits")
    queued = cut(queued.withColumn("upto", F.col("start") + F.col("inside")).drop("start", "inside"), narrow, shares)
    finish = lambda copy: F.when(F.col("target") > 0, (F.lit(copy) * F.col("source_size") + F.col("upto")) / F.col("target"))
    copies = queued.where("size > 0 AND target > 0").select("turn", "key", "upto", "size", F.explode(F.array(*(F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(most)))).alias("c")).select("c.finish", "turn", "key", "upto", "c.copy", "size")
    order = ("finish", "turn", "key", "upto", "copy")
    ranges = max(1, math.ceil(most * rows / RANGE), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(copies.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    # one row for each range
    sums = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.sum("size")).collect())
    upto, crossing = 0, None
    for n, size in sums:
        if upto + size > budget:
            crossing = n
            break
        upto += size
    if crossing is not None:
        inner = dealt.where(F.col("range") == crossing).withColumn("total", F.lit(upto) + F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        last = inner.where(F.col("total") > budget).orderBy(*order).limit(1).collect()[0]
        mark = F.struct(*(F.lit(last[c]).cast(t) for c, t in zip(order, ("double", "int", "string", "long", "int"))))
        place = lambda copy: F.struct(finish(copy).alias("finish"), F.col("turn").cast("int").alias("turn"), F.col("key"), F.col("upto").cast("long").alias("upto"), F.lit(copy).alias("copy"))
        part_taken = last["size"] - (last["total"] - budget)
        take = lambda copy: F.when(F.col("size") == 0, 0).when(finish(copy).isNull(), 0).when(place(copy) < mark, F.col("size")).when(place(copy) == mark, part_taken).otherwise(0)
    else:
        take = lambda copy: F.when(finish(copy).isNull(), 0).otherwise(F.col("size"))
    delete(dealt)
    taken = sum((take(c) for c in range(1, most)), take(0))
    return queued.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE turn % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         CAST(source_size * 2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM s
), l AS (
  SELECT *, cap / weight AS level FROM w
), f AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY level, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            > level * sum(weight) OVER (ORDER BY level, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
  FROM l
), t AS (
  SELECT source, source_size, turn, budget,
         CASE WHEN filled THEN cap
              ELSE (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () END AS target
  FROM f
), q AS (
  SELECT doc_id, size, key, source_size, turn, target, budget,
         CAST(sum(size) OVER (PARTITION BY turn ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         row_number() OVER (ORDER BY turn, key, doc_id NULLS FIRST, size) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, e.epoch, CAST(e.epoch * source_size + upto AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) e(epoch) WHERE target > 0 AND size > 0
), r AS (
  SELECT place, greatest(0, least(size, CAST(floor(budget) AS BIGINT) - (sum(size) OVER (ORDER BY finish, turn, key, upto, epoch ROWS UNBOUNDED PRECEDING) - size))) AS part FROM c
), p AS (
  SELECT place, CAST(sum(part) AS BIGINT) AS taken FROM r GROUP BY place
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN p USING (place)
"""
