"""Continual ingest: a file stream whose batches pass the gates before they are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, incoming: str, store: str, checkpoint: str, schema, permitted: list[str], tolerance: float = 0.0) -> DataFrame:
    """All files under incoming, in batches of one: license, filter, dedup against the store, quality gate, add.

    A batch is added under its number, so a batch that is run again after a
    failure replaces itself.  A batch whose mean length falls below the store's
    by more than the tolerance's share is refused.  Returns the store.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col("license").isin(*permitted) & (F.length("text") > 0)).withColumn("h", F.sha2("text", 256))
        fresh = fresh.dropDuplicates(["h"])
        known = _stored(batch.sparkSession, store, number)
        if known is not None:
            fresh = fresh.join(known.select("h"), "h", "left_anti")
            now, before = fresh.agg(F.avg(F.length("text"))).first()[0], known.agg(F.avg(F.length("text"))).first()[0]
            if now is not None and before is not None and now < before * (1 - tolerance):
                return
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(store)


def _stored(spark: SparkSession, store: str, before: int) -> DataFrame | None:
    """The batches added before this one; None if there are none."""
    try:
        return spark.read.parquet(store).where(F.col("batch") < before)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts by tumbling window and key; for streams with a watermark, later rows are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
