"""The training-data pipeline: ordered stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's ``docs``.  All but the last return the columns of
documents; columns that ``documents`` has beyond those of the contract are kept, whatever
their names.

Defined results.  Null texts count as empty everywhere: such a document has a quality
score like any other, takes no part in near-duplicates and stays, has no secrets, has no
words and so is never mixed in.  Documents without an id stay in the first three stages
and are mixed like others.  Rows that share an id are one document for near-duplicates:
the first by its columns stays.  Ties of scores, hashes and finish times are broken by
value, so reruns agree.  Very long texts are handled whole.  Empty tables, of documents
or labels, give empty results; without labels every document has score 0.5 and stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm import bpe, mixing, neardup, quality, secrets
from textspark.llm.common import cut, ensure_checkpoint_dir, fold, fresh, remove, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the others go."""
    fitted = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    score = fresh(docs, "_score")
    return quality.score(docs, fitted and fitted[0], out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; rows without an id stay."""
    kept = cut(neardup.components(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    row = fresh(docs, "_row")
    order = F.xxhash64(*(f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)))
    unique = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return unique.select(f"{row}.*").unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes in full, at most two.

    Of the document at which the budget ends only a part would be taken, so that copy goes.
    Inside a source the mix takes documents in the order of their shuffle key, so for each
    source and number of copies the last one taken tells which are: rows with an id, of
    which the stage before keeps one for each, are compared with it where they are, and no
    text is shuffled.  Rows without an id carry their columns through the mix.
    """
    row, key, copies, copy, group, ends = (fresh(docs, n) for n in ("_row", "_key", "_copies", "_copy", "_group", "_ends"))
    placed = docs.withColumn(key, F.struct(mixing.shuffle_key("doc_id", "text").alias("key"), F.col("doc_id").alias("id")))
    mixed = mixing.mix(placed.withColumn(row, F.when(F.col("doc_id").isNull(), F.struct(*docs.columns))).withColumn(group, F.col("source")), keep=(row, key, group)).where("taken > 0")
    mixed = mixed.select("doc_id", row, key, group, F.floor(F.col("taken") / F.col("size")).cast("int").alias(copies)).where(F.col(copies) > 0)
    last = [F.max(F.when(F.col(copies) >= c, F.col(key))).alias(f"c{c}") for c in range(1, mixing.MOST + 1)]
    taken = cut(mixed.where("doc_id IS NOT NULL").groupBy(group).agg(F.struct(*last).alias(ends)))
    named = placed.where("doc_id IS NOT NULL").join(taken, F.col("source").eqNullSafe(F.col(group)))
    counts = sum((F.when(F.col(key) <= F.col(ends)[f"c{c}"], 1).otherwise(0) for c in range(1, mixing.MOST + 1)), F.lit(0))
    named = named.where(mixing.words() > 0).select(*docs.columns, counts.alias(copies)).where(F.col(copies) > 0)
    unnamed = mixed.where("doc_id IS NULL").select(f"{row}.*", copies)
    return named.unionByName(unnamed).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids (packed), round_trip: whether decoding gives the text again."""
    done = bpe.verified(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"])
    return done.select("doc_id", "source", bpe.n_tokens().alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: Trained models and hashing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage before wrote is needed no more
            remove(spark, f"{folder}/{k - 1}")
    return docs
