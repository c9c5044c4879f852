"""Reading tables and rule tables, and writing results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Tasks for each core that a small table is dealt to.
TASKS = 3


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores are dealt to a few tasks for each core; others stay where they are read.

    Text expressions cost far more than moving a table that is so small, and the longest task is short.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(TASKS * cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder in any store that Spark reads."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of rules from literals; it is a local relation that joins broadcast."""
    return spark.createDataFrame(list(rows), schema)


def read_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of rules from JSON lines."""
    return spark.read.schema(schema).json(path)


def parse_rules(text: str) -> list[dict]:
    """Rules from a JSON array."""
    return json.loads(text)


def write_result(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Write a result as Parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
