"""What readers like, from what they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import interaction_weight, sigmoid_boost

#: Scale of each dimension's boost.
SCALES = {"source": 0.3, "tag": 0.5, "entity": 0.4}


def dimensions(items: DataFrame) -> DataFrame:
    """id, dimension, value (lower case, 128 characters)."""
    both = F.concat(
        F.array(F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("dimension"), t.alias("value"))),
        F.transform("entities", lambda e: F.struct(F.lit("entity").alias("dimension"), e.alias("value"))),
    )
    return items.select("id", F.explode(both).alias("x")).select("id", "x.dimension", F.substring(F.lower("x.value"), 1, 128).alias("value"))


def weighted(interactions: DataFrame) -> DataFrame:
    return interactions.withColumn("weight", interaction_weight("action", "read_seconds"))


def scores(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """dimension, value, score. Weights are summed by item before items are looked up."""
    by_item = weighted(interactions).groupBy(F.col("item_id").alias("id")).agg(F.sum("weight").alias("weight"))
    found = by_item.where("weight <> 0").join(dimensions(items), "id")
    return found.groupBy("dimension", "value").agg(F.round(F.sum("weight"), 6).alias("score"))


def replayed(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """The scores after a recomputation that adds all history again at each interaction: each weight counts once for every
    interaction from its own on."""
    n = interactions.agg(F.count("*").alias("n"))
    # interactions are numbered inside seconds, seconds inside days (86,400 at most): no task orders a whole day's rows
    rows = weighted(interactions).withColumn("_second", F.date_trunc("second", "created_at"))
    seconds = rows.groupBy("_second").agg(F.count("*").alias("m")).withColumn("_day", F.to_date("_second"))
    days = seconds.groupBy("_day").agg(F.sum("m").alias("m")).select("_day", (F.sum("m").over(Window.orderBy("_day")) - F.col("m")).alias("_days"))  # a row a day
    inside = F.sum("m").over(Window.partitionBy("_day").orderBy("_second")) - F.col("m")
    before = seconds.withColumn("_inside", inside).join(days, "_day").select("_second", (F.col("_days") + F.col("_inside")).alias("base"))
    ordered = rows.withColumn("_j", F.row_number().over(Window.partitionBy("_second").orderBy("created_at", "seq"))).join(before, "_second")
    times = ordered.join(F.broadcast(n)).select(F.col("item_id").alias("id"), (F.col("weight") * (F.col("n") - F.col("base") - F.col("_j") + 1)).alias("weight"))
    found = times.groupBy("id").agg(F.sum("weight").alias("weight")).join(dimensions(items), "id")
    return found.groupBy("dimension", "value").agg(F.round(F.sum("weight"), 6).alias("score"))


def compounded(interactions: DataFrame, items: DataFrame, cycle: Column, last: int) -> DataFrame:
    """The scores at the end of cycle `last`, where each cycle adds all history so far: a weight counts once for every cycle
    from its own on. What preference_changes keeps up incrementally."""
    times = weighted(interactions).select(F.col("item_id").alias("id"), (F.col("weight") * (F.lit(last) - cycle.cast("long") + 1)).alias("weight"), F.col("weight").alias("own"))
    by_item = times.where("own <> 0").groupBy("id").agg(F.sum("weight").alias("weight"))
    return by_item.join(dimensions(items), "id").groupBy("dimension", "value").agg(F.round(F.sum("weight"), 6).alias("score"))


def boosted(items: DataFrame, prefs: DataFrame) -> DataFrame:
    """items with boost (clamped to 3 either way) and boosted (0 to 10; null where relevance is)."""
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    part = F.round(F.lit(2.0) / (1.0 + F.exp(-scale[F.col("dimension")] * F.col("score"))) - 1.0, 9)
    sums = dimensions(items).join(prefs, ["dimension", "value"]).groupBy("id").agg(F.sum(part).alias("boost"))
    boost = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), F.coalesce("boost", F.lit(0.0))))
    held = items.join(sums, "id", "left").withColumn("boost", F.round(boost, 6))
    return held.withColumn("boosted", F.when(F.col("relevance").isNotNull(), F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("relevance") + F.col("boost"))), 6)))


def active_votes(interactions: DataFrame) -> DataFrame:
    """item_id, vote: the last of up and down votes that no cancel followed."""
    last = interactions.where(F.col("action").isin("upvote", "unupvote", "downvote", "undownvote")).groupBy("item_id").agg(F.max_by("action", F.struct("created_at", "seq")).alias("vote"))
    return last.where(F.col("vote").isin("upvote", "downvote"))


def cancel_for(vote: Column, new: Column) -> Column:
    """The cancel that a new vote needs first, if the opposite one is active."""
    return F.when((new == "upvote") & (vote == "downvote"), "undownvote").when((new == "downvote") & (vote == "upvote"), "unupvote")


__all__ = ["active_votes", "boosted", "cancel_for", "dimensions", "replayed", "scores", "sigmoid_boost", "weighted"]
