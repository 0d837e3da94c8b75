"""Tokens, packed sequences, masks and generated samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as X
from quern.operators import splits


def with_words(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and w, the words of the normalised text, computed once."""
    return df.select(*keep, F.explode(F.array(F.split(X.norm_key(F.col("text")), " "))).alias("w"))


def token_rows(df: DataFrame, row_id: str = "doc_id") -> DataFrame:
    made = with_words(df, row_id, splits.assign(F.col(row_id).cast("string")).alias("split"))
    return made.select(row_id, "split", F.explode("w").alias("tok"))


def vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """(tok, n, id): the most frequent tokens, ties by token; a top-k, so one small window numbers them."""
    top = tokens.groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(size)
    return top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "tok")) - 1)


def encode(df: DataFrame, vocab: DataFrame, unknown: int, row_id: str = "doc_id") -> DataFrame:
    """(id, ids): each text's token ids in order; tokens without id are unknown. vocab has as many rows as it was made with."""
    rows = with_words(df, row_id).select(row_id, F.posexplode("w").alias("pos", "tok"))
    coded = rows.join(F.broadcast(vocab.select("tok", "id")), "tok", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return coded.groupBy(row_id).agg(in_order.alias("ids"))


def packed_shape(df: DataFrame, length: int, row_id: str = "doc_id") -> DataFrame:
    """(seq, n_tokens, n_docs) of the texts' words laid end to end in id order and cut every length words."""
    sized = df.select(row_id, F.size(F.split("text", " ")).cast("long").alias("n"))
    placed = running_total(sized, "n", row_id)
    cut = placed.select("at", "n", F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}"))).alias("seq"))
    inside = F.least(F.col("at") + F.col("n"), (F.col("seq") + 1) * length) - F.greatest("at", F.col("seq") * length)
    return cut.groupBy("seq").agg(F.sum(inside).alias("n_tokens"), F.count("*").alias("n_docs"))


def running_total(df: DataFrame, n: str, order: str) -> DataFrame:
    """df with at, the sum of n over all rows before in the order: sums within range partitions, then their offsets."""
    from quern.operators.dedup import _checkpoint_dir

    _checkpoint_dir(df)
    part = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = part.groupBy("_part").agg(F.sum(n).alias("_n"))
    offsets = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_off"))
    within = F.sum(n).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    return part.withColumn("_in", within).join(F.broadcast(offsets), "_part").withColumn("at", F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")


def last_of(items: Column, n: Column) -> Column:
    """The last n elements, or all of them."""
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), n)


def sliding(df: DataFrame, length: int, stride: int, row_id: str = "doc_id") -> DataFrame:
    w = df.select(row_id, F.explode(F.array(F.split("text", " "))).alias("w"))
    starts = w.select(row_id, "w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(stride))).alias("at"))
    return starts.select(row_id, "at", F.slice("w", F.col("at"), F.lit(length)).alias("piece"))


def loss_mask(conv: DataFrame, targets: list[str]) -> DataFrame:
    """(conv_id, mask): 1 for each word of a target role, in order."""
    return segment_mask(conv.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("kind"), F.size(F.split("text", " ")).alias("n")), targets, "conv_id")


def segment_mask(segments: DataFrame, targets: list[str], row_id: str = "record_id") -> DataFrame:
    s = segments.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("kind").isin(*targets).cast("int").alias("on"), "n"))).alias("s"))
    return s.select(row_id, F.flatten(F.transform("s", lambda x: F.array_repeat(x["on"], x["n"]))).alias("mask"))


def pad(masks: DataFrame, length: int) -> DataFrame:
    """masks with padded: zeros up to length."""
    return masks.withColumn("padded", F.concat("mask", F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size("mask"), F.lit(0)))))


def masked_mean(values: Column, mask: Column) -> Column:
    """The mean over unmasked places; null if there are none. Masked places count neither above nor below."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.aggregate(mask, F.lit(0), lambda a, x: a + x))


def operand(name: str) -> Column:
    """A number from 0 to 99 for each id and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("s:"), F.col("id").cast("string"), F.lit(f":{name}"))), 1, 4), 16, 10).cast("long") % 100


def arithmetic(spark: SparkSession, n: int) -> DataFrame:
    a, b, c = (operand(x) for x in "abc")
    return spark.range(n).select("id", F.concat(a, F.lit(" + "), b, F.lit(" * "), c, F.lit(" =")).alias("prompt"), (a + b * c).alias("answer"))


def verify_arithmetic(samples: DataFrame) -> DataFrame:
    """samples with accepted: the answer is what the prompt's own numbers give, added up term by term."""
    n = F.transform(F.regexp_extract_all("prompt", F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))
    solved = samples.select("*", n.alias("_n"))
    total = F.aggregate(F.array_repeat(F.col("_n")[2], F.col("_n")[1].cast("int")), F.col("_n")[0], lambda a, x: a + x)
    return solved.withColumn("accepted", total.eqNullSafe(F.col("answer"))).drop("_n")
