"""Mixing sources to target weights by hash order and distributed prefix sums.

Rows get a hash-random key.  Within a source they are ordered by key, in ranges
of the key that hold about as many rows each, whatever the source's size; token
counts are summed per range, the ranges' offsets come from those sums, and a
running sum inside each range finds the row at which the source's budget ends.
Only ids, sizes and keys are shuffled.  What a mix needs afterwards is one row
per source - whole epochs and the key of the cut - so applying it to the texts
is a filter, not a join on ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import broadcast_if, fresh, load, materialise, words_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 10_000
BROADCAST_SOURCES = 10_000


def key_of(row_id: Column) -> Column:
    return F.md5(F.coalesce(row_id.cast("string"), F.lit("")))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, key): size is the number of words ``[^\\x20\\x09-\\x0D]+``."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("size"),
        key_of(F.col(id_col).cast("long")).alias("key"),
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) per source.

    All sizes are shared by weight; a source stops at max_epochs times its size
    and the excess is shared by weight among the others.  With the sources in
    the order in which their caps bind, a source is capped exactly if the share
    left by those before it exceeds its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)) + 1)
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("capped", left / rest > F.col("cap") / F.col("weight"))
    free = F.sum(F.col("source_size").cast("double")).over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free / open_weight)
    return per.select("source", "source_size", target.alias("target"))


def cuts(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(source, source_size, target, epochs, cut): every row of the source is taken epochs times, and once more if (key, id) <= cut.

    A row belongs to the part epoch if at least half of it lies before the
    source's exact budget, so a source misses its target by half a row at most.
    """
    aims = targets(sized, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = materialise(aims.withColumn("epochs", F.least(whole, F.lit(max_epochs)).cast("int")), "aims")
    n_ranges = max(1, -(-sized.count() // range_rows))
    ranged = sized.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_ranges, 32))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offset = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    sums = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), offset.alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("within", F.sum("size").over(inside))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).select(
        F.col("source").alias("_s"), "key", "id", "size", (F.col("offset") + F.col("within") - F.col("size")).alias("before")
    )
    small = broadcast_if(aims, aims.count(), BROADCAST_SOURCES)
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    taken = rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).where((budget > 0) & (2 * F.col("before") + F.col("size") <= 2 * budget))
    last = taken.groupBy("_s").agg(F.max(F.struct("key", F.coalesce("id", F.lit(-(1 << 63))).alias("id"))).alias("cut"))
    return materialise(aims.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "cuts")


def copies(key: Column, row_id: Column) -> Column:
    """How often the mix takes a row, given its source's epochs and cut."""
    at = F.struct(key.alias("key"), F.coalesce(row_id, F.lit(-(1 << 63))).alias("id"))
    return F.col("epochs") + F.when(F.col("cut").isNotNull() & (at <= F.col("cut")), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it (0 to max_epochs times).

    Null sources are one source; null and blank texts have size 0; rows that
    repeat an id share its place in the order; an empty table gives no rows.
    """
    plan = cuts(materialise(sizes(docs, id_col, text_col, source_col), "sizes"), weights, max_epochs)
    of, held, copy = fresh("source"), fresh("plan"), fresh("copy")
    plan = broadcast_if(plan, plan.count(), BROADCAST_SOURCES).select(F.col("source").alias(of), F.struct("epochs", "cut").alias(held))
    row_id = F.col(id_col).cast("long")
    n = docs.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(of)))
    at = F.struct(key_of(row_id).alias("key"), F.coalesce(row_id, F.lit(-(1 << 63))).alias("id"))
    times = F.col(held)["epochs"] + F.when(F.col(held)["cut"].isNotNull() & (at <= F.col(held)["cut"]), 1).otherwise(0)
    return n.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(sizes(load(spark, sf_dir, "documents")), "sizes")
    plan = cuts(sized).withColumnRenamed("source", "_s")
    plan = broadcast_if(plan, plan.count(), BROADCAST_SOURCES)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    taken = F.col("size") * copies(F.col("key"), F.col("id"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


#: The same with one window over each source; shares are found by handing the excess on, round by round.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
share AS (
  SELECT 0 AS round, source, source_size, w, w * (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w,
         CASE WHEN target >= 3 * source_size THEN 3.0 * source_size
              ELSE target + w * excess / open_w END
  FROM (SELECT *, sum(greatest(target - 3 * source_size, 0)) OVER () AS excess,
               sum(CASE WHEN target < 3 * source_size THEN w ELSE 0 END) OVER () AS open_w FROM share)
  WHERE excess > 1e-6 AND round < 60),
t AS (SELECT source, source_size, target, floor(target / nullif(source_size, 0))::BIGINT AS epochs FROM share WHERE round = (SELECT max(round) FROM share)),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.epochs, 0) AS epochs, t.target - coalesce(t.epochs, 0) * t.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN budget > 0 AND 2 * before + size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
