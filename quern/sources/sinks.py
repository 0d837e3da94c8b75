"""Sinks: shards, manifests, checksums, versions and logs, on whatever file system the session writes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT_BYTES = 50_000_000


def write_shards(df: DataFrame, path: str, key: str, shards: int, per_file: int = 1_000_000) -> None:
    """df in ranges of the key, each file written once."""
    df.repartitionByRange(shards, key).write.option("maxRecordsPerFile", per_file).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows) of the Parquet files under path; only footers and one column's nulls are read."""
    files = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_size")
    return files.groupBy(F.col("file_name").alias("file")).agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def artifact_size(spark: SparkSession, path: str, limit: int = LIMIT_BYTES) -> DataFrame:
    """Bytes of all files under path, in MB and in MiB, against the limit in bytes."""
    total = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length").alias("bytes"))
    return total.select("bytes", F.round(F.col("bytes") / 1e6, 6).alias("mb"), F.round(F.col("bytes") / 1048576, 6).alias("mib"), (F.col("bytes") < limit).alias("within"))


def commit_version(df: DataFrame, root: str, version: str) -> None:
    """A new version beside the others; the pointer moves only after its data is complete."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    set_version(df.sparkSession, root, version)


def set_version(spark: SparkSession, root: str, version: str) -> None:
    """Move the pointer, forwards or back; moves are kept as a log whose last row counts."""
    moves = read_pointer(spark, root)
    spark.createDataFrame([(moves + 1, version)], "move long, version string").coalesce(1).write.mode("append").json(f"{root}_pointer")


def read_pointer(spark: SparkSession, root: str) -> int:
    try:
        return spark.read.schema("move long, version string").json(f"{root}_pointer").agg(F.max("move")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The data of the version that the pointer names; other versions' folders aren't read."""
    log = spark.read.schema("move long, version string").json(f"{root}_pointer")
    version = log.agg(F.max_by("version", "move")).first()[0]
    return spark.read.parquet(root).where(F.col("version") == version)


def append_log(spark: SparkSession, path: str, row: dict) -> None:
    """One more row of an append-only log; an experiment id that is there already is refused."""
    df = spark.createDataFrame([tuple(row.values())], list(row))
    df.coalesce(1).write.mode("errorifexists").json(f"{path}/experiment={row['experiment']}")
