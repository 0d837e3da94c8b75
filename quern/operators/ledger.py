"""Experiment ledgers: comparing, gating, detecting and keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _steps() -> W:
    return W.partitionBy("experiment").orderBy("step")


def compare(ledger: DataFrame, a: str, b: str) -> DataFrame:
    """(step, gain): the first experiment's validation value less the second's, where both have the step."""
    of = lambda e, n: ledger.where(F.col("experiment") == e).select("step", F.col("validation").alias(n))
    return of(a, "x").join(of(b, "y"), "step").select("step", F.round(F.col("x") - F.col("y"), 9).alias("gain"))


def regression_gate(ledger: DataFrame, tolerance: float) -> DataFrame:
    """ledger with accepted: no worse than the best step before by more than the tolerance."""
    best = F.min("validation").over(_steps().rowsBetween(W.unboundedPreceding, -1))
    return ledger.withColumn("accepted", F.coalesce(F.col("validation") <= best + tolerance, F.lit(True)))


def overfit(ledger: DataFrame) -> DataFrame:
    """The steps at which training improved while validation got worse."""
    d = lambda c: F.col(c) - F.lag(c).over(_steps())
    return ledger.withColumns({"dt": d("train"), "dv": d("validation")}).where("dt < 0 AND dv > 0")


def retain(ledger: DataFrame) -> DataFrame:
    """The best and the latest step of each experiment."""
    by = W.partitionBy("experiment")
    best, last = F.row_number().over(by.orderBy("validation", "step")), F.row_number().over(by.orderBy(F.desc("step")))
    return ledger.withColumns({"_best": best, "_last": last}).where("_best = 1 OR _last = 1").drop("_best", "_last")


def fingerprint(hashes: DataFrame, column: str = "h") -> DataFrame:
    """One order-free fingerprint of any number of row hashes: their number and the sums of their four quarters."""
    quarter = lambda i: F.sum(F.conv(F.substring(column, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return hashes.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[quarter(i).cast("string") for i in range(4)]), 256).alias("fingerprint"))
