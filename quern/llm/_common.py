"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in most contracts: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return root or held.get()
    root = root or tempfile.mkdtemp(prefix="quern-checkpoint-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, in the shared folder."""
    return f"{shared_root(spark)}/quern-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage is cut, no executor holds the only copy."""
    path = shared_path(df.sparkSession, label)
    with few_rows(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows while a plan runs in this block; the session's own size holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.getAll.get(key)
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no plan holds any longer removed: Spark does so when the driver's garbage is collected, which few tasks may not bring about."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables in the shared folder that go when what they were made for is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, label))
        with few_rows(self.spark):
            df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for p in self.paths:
            remove(self.spark, p)
        self.paths = []


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def give_back() -> None:
    """Return memory that this process has freed to the machine: a worker lives through many tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches, rows: int = 1000, size: int = 16 << 20):
    """The batches in slices of at most so many rows, and of about so many bytes of text where one row doesn't have more.

    What Python makes of a batch is bounded by this alone; the session's own batch size, which later queries see, stays as it is.
    """
    give_back()  # what an earlier task of this worker left
    for b in batches:
        held = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(held), 0
        while at < b.num_rows:
            most = (ends[at - 1] if at else 0) + size
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, most, side="right"))))
            yield b.slice(at, to - at)
            at = to
        give_back()


def fresh(label: str) -> str:
    """A column name that no table has, for a column that stands beside the caller's own."""
    return f"_{label}_{uuid.uuid4().hex}"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast df only when its counted rows are within the limit; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
