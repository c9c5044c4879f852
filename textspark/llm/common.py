"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textspark.sources import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the path may be in any store that Spark reads.  One with fewer splits than cores is dealt to all cores."""
    return read_table(spark, sf_dir, name)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again, which cuts its lineage.

    A written table outlives its executors, tells the planner its size and is dealt anew
    where a join needs it, so that adaptive execution can split its hot keys.  Tables in
    ``done`` that an earlier cut wrote are deleted: the caller needs them no more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    delete(*done)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in any store that Spark writes to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables."""
    for t in tables:
        if getattr(t, "_folder", None):
            remove(t.sparkSession, t._folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` wrote in this application; results that were not written yet are lost."""
    if spark.sparkContext.getCheckpointDir() is not None:
        remove(spark, spark.sparkContext.getCheckpointDir())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of an Arrow batch; texts are wide, and a worker holds a few copies of its batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "32m"}


def release() -> None:
    """Give memory that is free again back to the system; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, where the user has not set these options.

    Spark reads them when it makes a plan, which is after this call, so they are set for
    the session.
    """
    known = spark._jsparkSession.sessionState().conf()
    for name, value in BATCH.items():
        if not known.contains(name):
            spark.conf.set(name, value)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Append columns computed from Arrow batches.

    ``make`` runs once per task and returns a function from a batch to one
    array (or list) per field of ``fields``.  Columns named in ``keep`` stay
    (all by default); a column that clashes with a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]
    small_batches(df.sparkSession)
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            if not batch.num_rows:
                continue
            function = function or make()
            columns = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(function(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *columns], names=[*names, *(f.name for f in fields)])
        function = batch = columns = None
        release()

    return df.mapInArrow(run, schema)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``: the fold of a row."""
    return F.crc32(F.col(key).cast("string")) % folds
