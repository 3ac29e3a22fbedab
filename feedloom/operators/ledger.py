"""Sums, percentiles and windows over the ledger of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(ledger: DataFrame) -> DataFrame:
    """model, caller (null where not grouped by), calls, cost, unknown, errors: overall, by model and by caller in one pass."""
    ledger.createOrReplaceTempView("_feedloom_ledger")
    return ledger.sparkSession.sql(
        "SELECT model, caller, count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 6) AS cost, count_if(cost_usd IS NULL) AS unknown, count_if(NOT success) AS errors "
        "FROM _feedloom_ledger GROUP BY GROUPING SETS ((), (model), (caller))"
    )


def nearest_rank(values: str, p: float) -> Column:
    """Of a sorted array: the element at the half-even rounding of p x (n - 1)."""
    return F.element_at(values, (F.rint(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def latencies(ledger: DataFrame, key: str = "model") -> DataFrame:
    """key, p50, p95, p99, max over successes. Counts by value first, so that no array is longer than there are values."""
    ok = ledger.where("success").groupBy(key, "latency_ms").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("latency_ms"))
    all_ = F.sum("n").over(Window.partitionBy(key))
    held = ok.withColumn("upto", upto).withColumn("all", all_)
    at = lambda p: F.min(F.when(F.col("upto") >= F.rint(F.lit(p) * (F.col("all") - 1)) + 1, F.col("latency_ms")))
    return held.groupBy(key).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("latency_ms").alias("max"))


def ring(ledger: DataFrame, n: int) -> DataFrame:
    """The last n entries."""
    return ledger.orderBy(F.desc("seq")).limit(n)


def rolling(ledger: DataFrame, since: Column) -> DataFrame:
    return ledger.where(F.col("ts") >= since)


def latency_ms(start: Column, end: Column, seconds: bool = False) -> Column:
    """Milliseconds between two times, or between two numbers of seconds; 0 where one is missing."""
    between = (end - start) * 1000.0 if seconds else (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000
    return F.coalesce(between, F.lit(0.0))
