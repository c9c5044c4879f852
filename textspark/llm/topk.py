"""Exact top-k search by columnar branch and bound.

``top_k`` returns, for each query vector, the ``k`` rows with the highest inner
product of integer vectors.  Candidates stay where they are read.  Each task
lays its batch out by dimension, adds the inner product up block by block of
dimensions, and after each block drops the candidates that cannot reach the
query's threshold even if the remaining dimensions point the same way
(partial sum + norm of the query's rest * norm of the candidate's rest,
Cauchy-Schwarz).  The survivors are compacted.  A threshold starts from a small
sample of candidates (a true lower bound, so it costs no result) and rises as
better rows are found.

Queries go to the tasks in blocks of at most about ``block`` rows.  A block is one pass
over the candidates; its result is written to the shared folder and its broadcast is
destroyed before the next block is read, so the driver and the tasks hold one block
however many queries there are.  A task returns at most ``k`` rows for a query, and one
ranking by query joins those.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; vectors of different length are never compared; rows
that carry the query's own id are not its candidates; ties go to the smaller id;
repeated candidate rows are ranked each for itself; a repeated query id is
answered once, for its smallest vector; queries with fewer than ``k`` candidates return all of them, and
without candidates nothing.  Ids must be integers, rows with a null id take no part;
other columns do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.llm.common import cut, delete

QUERY_BLOCK = 4096
SAMPLE = 2048
DIMENSIONS = 16
ROWS = 8192


def quantised(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: str = "embedding") -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def _arrays(batch: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids, and components with one row for each dimension."""
    ids = batch.column("id").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("id").to_numpy()
    vectors = batch.column("v")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = vectors.offsets.to_numpy()
    values, lengths = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    return {int(d): (ids[rows := np.flatnonzero(lengths == d)], np.ascontiguousarray(values[offsets[rows][:, None] + np.arange(d)].T)) for d in np.unique(lengths)}


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norm of the dimensions after each block, one row for each block."""
    squares = columns.astype(np.float64) ** 2
    return np.sqrt(np.array([squares[b:].sum(axis=0) for b in range(DIMENSIONS, len(columns) + DIMENSIONS, DIMENSIONS)]))


def search(ids: np.ndarray, columns: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> None:
    """Raise ``best`` (for each query at most k pairs (-score, id), sorted) by the given candidates.

    A query's list may begin with a bound (-score, None) in place of rows.
    """
    order = np.argsort(-np.var(columns.astype(np.float64), axis=1), kind="stable")  # wide dimensions first
    columns, queries = columns[order], queries[order]
    largest = float(np.abs(columns).max(initial=0)) * float(np.abs(queries).max(initial=0)) * len(columns)
    exact = np.float64 if largest < 2.0**52 else np.int64
    c, q = columns.astype(exact), queries.astype(exact)
    rest, query_rest = _rest(columns), _rest(queries)
    for j, own in enumerate(query_ids):
        held = best[j]
        least = -held[-1][0] if len(held) == k else None
        alive = np.flatnonzero(ids != own)
        partial = np.zeros(len(alive), exact)
        for b in range(len(rest)):
            part = slice(b * DIMENSIONS, (b + 1) * DIMENSIONS)
            partial += q[part, j] @ (c[part] if len(alive) == c.shape[1] else c[part][:, alive])
            if least is not None:
                reach = partial + rest[b][alive] * query_rest[b, j] * (1 + 1e-9) + 1e-6
                keep = reach >= least
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        if len(alive):
            if len(alive) > 4 * k:
                least = np.partition(partial, len(partial) - k)[len(partial) - k]
                keep = partial >= least
                alive, partial = alive[keep], partial[keep]
            found = [x for x in held if x[1] is not None]
            if len(found) < len(held):  # rows must still reach the bound, but take its place
                found += [(-int(s), int(i)) for s, i in zip(partial, ids[alive])]
                found.sort()
                bound = [x for x in held if x[1] is None]
                best[j] = (found + bound)[:k] if len(found) < k else found[:k]
            else:
                best[j] = sorted(found + [(-int(s), int(i)) for s, i in zip(partial, ids[alive])])[:k]


def top_k(vectors: DataFrame, query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row where ``query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), quantised(vector, scale).alias("v"), query.alias("is_query"))
    queries = cut(rows.where("is_query").groupBy("id").agg(F.min("v").alias("v")))
    candidates = rows.select("id", "v")
    blocks = max(1, -(-queries.count() // block))
    seeds = _arrays(candidates.limit(SAMPLE).toArrow())
    parts = []
    for n in range(blocks):
        asked = _arrays(queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).select("id", "v").toArrow())
        bounds = {}
        for d, (query_ids, q) in asked.items():
            lists: list[list[tuple[int, int]]] = [[] for _ in query_ids]
            if d in seeds:
                search(*seeds[d], query_ids, q, lists, k)
            # the k-th best of the sample bounds the k-th best of all rows from below
            bounds[d] = [x[-1][0] if len(x) == k else None for x in lists]
        sent = spark.sparkContext.broadcast((asked, bounds))

        def run(batches, sent=sent):
            asked, bounds = sent.value
            best = {d: [[(b, None)] * k if b is not None else [] for b in bounds[d]] for d in asked}
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    for d, (ids, columns) in _arrays(batch.slice(start, ROWS)).items():
                        if d in asked:
                            search(ids, columns, *asked[d], best[d], k)
            found = [(int(i), v, -s) for d in asked for i, x in zip(asked[d][0], best[d]) for s, v in x if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        found = candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        parts.append(cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
        sent.destroy()
    delete(queries)
    return reduce(DataFrame.unionByName, parts)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM u q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
