"""Windows in time, orders, caps and other filters over items."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import hours_before


def cutoff(at: Column, hours: int, max_days: int = 7) -> Column:
    """The later of `hours` ago and the cap."""
    return hours_before(at, min(hours, max_days * 24))


def recent(items: DataFrame, at: Column, hours: int, topic: str | None = None, source: str | None = None, duplicates: bool = False, languages: list[str] | None = None, dismissed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    out = items.where(F.col("published_at") >= cutoff(at, hours))
    if topic is not None:
        out = out.where(F.col("topic").ilike(topic))
    if source is not None:
        out = out.where(F.col("source") == source)
    if languages:
        out = out.where(F.col("language").isin(languages))
    if not duplicates:
        out = out.where(~F.col("is_duplicate"))
    if dismissed is not None:
        out = out.join(dismissed, "id", "left_anti")
    return out if limit is None else out.orderBy(*recent_order()).limit(limit)


def recent_order() -> list[Column]:
    return [F.desc("fetched_at"), F.desc_nulls_last("relevance"), F.desc("raw_score"), F.desc("published_at"), F.asc("id")]


def unanalysed(items: DataFrame, limit: int | None = None) -> DataFrame:
    out = items.where(F.col("summary").isNull() & ~F.col("is_duplicate"))
    return out if limit is None else out.orderBy(F.desc("fetched_at"), F.desc("published_at"), "id").limit(limit)


def with_totals(rows: DataFrame, *keys: str, **totals: Column) -> DataFrame:
    """rows with aggregates of the rows that have the same keys (null is a key). Sums are made before the shuffle and joined
    back, so that a key with most rows has no task of its own."""
    sums = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(*(v.alias(name) for name, v in totals.items()))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(sums, on).drop(*(f"_of_{k}" for k in keys))


def widen(items: DataFrame, at: Column, hours: int, key: str, least: int = 5) -> DataFrame:
    """By key: the rows inside the window if there are `least`, else all, with the flag widened."""
    inside = F.col("published_at") >= hours_before(at, hours)
    counted = with_totals(items.withColumn("_in", inside), key, _n=F.count_if("_in"))
    return counted.where(F.col("_in") | (F.col("_n") < least)).withColumn("widened", F.col("_n") < least).drop("_in", "_n")


def cap_per(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_seen(rows: DataFrame, key: Column | str, *order: str) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(*order))).where("_n = 1").drop("_n")


def batches(rows: DataFrame, key: str, size: int, *order: str) -> DataFrame:
    """rows with batch, numbered within key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def cooldown(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """requests (keyword, seq, ts, force) with admitted: not within `seconds` of the keyword's request before it."""
    before = F.lag("ts").over(Window.partitionBy(F.lower("keyword")).orderBy("ts", "seq"))
    return requests.withColumn("admitted", F.col("force") | before.isNull() | (F.timestamp_diff("SECOND", before, F.col("ts")) >= seconds))


def latest_digest(digests: DataFrame, date: str, topic: str, exact: bool = False) -> DataFrame:
    """The digest of the day if there is one, else the topic's latest."""
    held = digests.where(F.col("topic") == F.lower(F.lit(topic)))
    if exact:
        held = held.where(F.col("date") == date)
    return held.orderBy(F.when(F.col("date") == date, 0).otherwise(1), F.desc("generated_at"), "id").limit(1)


def stale(cached: Column, current: Column) -> Column:
    return (current > 2 * cached) & (current - cached > 20)


def round_robin(models: DataFrame) -> DataFrame:
    """slot, model from models (ord, model, rpm): each as often as its rate over the least, at least once."""
    least = F.min("rpm").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    many = F.greatest(F.lit(1), F.rint(F.col("rpm") / least).cast("int"))
    spread = models.withColumn("_many", many).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_many"))))
    return spread.select((F.row_number().over(Window.orderBy("ord", "copy")) - 1).alias("slot"), "model")  # a few models


def deal(rows: DataFrame, pool: DataFrame, batch: str = "batch") -> DataFrame:
    """rows with the model of their batch: slot `batch` modulo the pool's size."""
    sized = pool.select(F.col("slot").alias("_slot"), "model").withColumn("_of", F.count("*").over(Window.partitionBy()))  # a few slots
    n = sized.agg(F.max("_of").alias("_n"))
    held = rows.join(F.broadcast(n)).withColumn("_slot", F.pmod(F.col(batch), F.col("_n")))
    return held.join(F.broadcast(sized.select("_slot", "model")), "_slot").drop("_slot", "_n")


def diagnostics(items: DataFrame, digests: DataFrame, last: int = 5) -> DataFrame:
    """topic, total, duplicates, analysed, digests (the last ones, latest first: date, item_count, preview) of each topic of the items."""
    counts = items.groupBy(F.lower("topic").alias("topic")).agg(F.count("*").alias("total"), F.count_if("is_duplicate").alias("duplicates"), F.count("summary").alias("analysed"))
    # ranked before the shuffle too, so that a topic with most digests sends `last` rows a task
    order = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc_nulls_last("generated_at"), "id"))
    row = F.struct("_n", "date", "item_count", F.substring("content", 1, 80).alias("preview"))
    kept = digests.withColumn("_n", order).where(F.col("_n") <= last).groupBy("topic").agg(F.array_sort(F.collect_list(row)).alias("digests"))
    return counts.join(kept, "topic", "left").withColumn("digests", F.transform("digests", lambda x: x.dropFields("_n")))
