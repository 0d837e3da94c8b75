"""Splits, contamination, pairs, mixing and orders; all of them deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as X


def bucket(key: Column, n: int = 100) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def assign(key: Column, cuts: tuple[int, int, int] = (80, 90, 95)) -> Column:
    """train, validation, test or challenge, by the hash of a row's or a group's key."""
    b = bucket(key)
    return F.when(b < cuts[0], "train").when(b < cuts[1], "validation").when(b < cuts[2], "test").otherwise("challenge")


def _grams(df: DataFrame, row_id: str, n: int) -> DataFrame:
    w = df.select(row_id, F.explode(F.array(F.split(X.norm_key(F.col("text")), " "))).alias("w"))
    return w.select(row_id, F.explode(F.array_distinct(X.shingles(F.col("w"), n))).alias("g"))


def ngram_overlap(docs: DataFrame, bench: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, item_id, share): which share of an item's n-grams a document has, where it has any."""
    items = _grams(bench, "item_id", n)
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n"))
    met = _grams(docs, "doc_id", n).join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("o"))
    return met.join(sizes, "item_id").select("doc_id", "item_id", F.round(F.col("o") / F.col("n"), 9).alias("share"))


def verdict(splitted: DataFrame) -> DataFrame:
    """(chk, n, verdict): texts that the training split shares with the others, exactly and normalised."""

    def shared(name: str, key: Column) -> DataFrame:
        d = splitted.select(key.alias("k"), "split")
        both = d.groupBy("k").agg(F.bool_or(F.col("split") == "train").alias("a"), F.bool_or(F.col("split") != "train").alias("b"))
        return both.agg(F.lit(name).alias("chk"), F.count_if(F.col("a") & F.col("b")).alias("n"))

    checks = shared("exact", F.md5("text")).unionByName(shared("normalized", F.md5(X.norm_key(F.col("text")))))
    return checks.withColumn("verdict", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


def pair(items: DataFrame, first: str, second: str) -> DataFrame:
    of = lambda kind, name: items.where(F.col("kind") == kind).select("task", F.col("body").alias(name))
    return of(first, "first").join(of(second, "second"), "task")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its 1-based place in a total order: range-sorted partitions, their sizes added up, places within.

    The range partitions are stored first, so that both passes see the same ones.
    """
    from quern.operators.dedup import _checkpoint_dir

    _checkpoint_dir(df)
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    part = part.withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)).checkpoint()
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_off"))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_in") + 1).drop("_part", "_in", "_off")


def epoch_order(df: DataFrame, seed: int, epoch: int, row_id: str = "doc_id") -> DataFrame:
    """df with pos, its 0-based place in the epoch's order; every row has one, the tail included."""
    keyed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(row_id).cast("string"))))
    return global_rank(keyed, ["_h", row_id], "pos").withColumn("pos", F.col("pos") - 1).drop("_h")


def mix(df: DataFrame, by: str, weights: dict[str, float], row_id: str = "doc_id") -> DataFrame:
    """The share of each category that its weight names, by hash order; 1 for categories without weight.

    A row's place in its category is its place in the total order less that of
    the category's first row, so no category is one task's.
    """
    share = F.lit(1.0)
    for k, w in weights.items():
        share = F.when(F.col(by) == k, w).otherwise(share)
    placed = global_rank(df.withColumn("_h", F.md5(F.col(row_id).cast("string"))), [by, "_h", row_id], "_at")
    of = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    joined = placed.join(of, F.col(by).eqNullSafe(F.col("_by")))
    p = F.when(F.col("_n") > 1, (F.col("_at") - F.col("_first")) / (F.col("_n") - 1)).otherwise(0.0)
    return joined.where(p <= share).select(*df.columns)


def tiles(df: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """df with the number of its tile, of n tiles of equal sizes in a total order, the first ones larger by one if need be."""
    total = df.count()
    size, rest = divmod(total, n)
    at = F.col("_at") - 1
    tile = F.when(at < rest * (size + 1), F.floor(at / (size + 1))).otherwise(F.floor((at - rest * (size + 1)) / max(1, size)) + rest) + 1
    return global_rank(df, order, "_at").withColumn(name, tile.cast("int")).drop("_at")
