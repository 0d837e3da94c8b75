"""Tool calls: parsing, validation, routing, computing and control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def parse_calls(df: DataFrame) -> DataFrame:
    """df with parsed, name and arguments of the JSON in call; text that is no JSON parses to nulls."""
    ok = F.try_parse_json("call").isNotNull()
    call = F.from_json(F.when(ok, F.col("call")), "name string, arguments map<string,string>")
    return df.withColumns({"parsed": ok, "name": call["name"], "arguments": call["arguments"]})


def validate(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """parsed with implementation and valid: the tool is known and its required argument is there."""
    r = F.broadcast(registry.select(F.col("name").alias("_tool"), "required", "implementation"))
    joined = parsed.join(r, F.col("name") == F.col("_tool"), "left")
    return joined.withColumn("valid", F.coalesce(F.col("_tool").isNotNull() & F.map_contains_key("arguments", F.col("required")), F.lit(False)))


def calculator(a: Column, op: Column, b: Column) -> Column:
    """The result as double; null for division by zero and unknown operators."""
    return F.when(op == "+", (a + b).cast("double")).when(op == "-", (a - b).cast("double")).when(op == "*", (a * b).cast("double")).when(op == "/", F.try_divide(a, b))


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("step", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
