"""Spam predicates on short posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .text import cashtags, col

#: Phrases that settle the matter, and hints that count; SURVEY P1 and P3.
PHRASES = (
    "guaranteed profit", "guaranteed return", "guaranteed income", "dm me for signals", "dm for signals", "dm me for profit", "100% win rate", "never lose", "copy my trades", "mirror my trades",
    "copyable strat", "copyable trade", "go follow @", "stock market guru", "trading guru", "market guru", "investing guru", "start earning", "boost your income", "live trades",
)
HINTS = (
    "his picks", "her picks", "their picks", "his calls", "her calls", "their calls", "his trades", "her trades", "their trades", "his strategies", "her strategies", "their strategies",
    "his stock picks", "her stock picks", "always go up", "never go down", "always goes up", "never goes down", "always surge", "always surges", "making a fortune", "making money every day",
    "incredible", "impressive gains", "crushing it", "trade alerts", "trading signals", "quietly following", "been following", "follow @", "thanks to @", "stock picks", "worth following",
    "recommending this", "profiting me", "steady gains", "consistent gains", "seeing gains", "earn over", "earning over",
)

#: Phrases of video titles and descriptions, and sequences of four tickers and more.
VIDEO_PHRASES = (
    "deleted in 24 hours", "will be deleted", "remove this video", "this video will be removed", "dm me", "dm for", "message me for", "guaranteed profit", "guaranteed return",
    "100% win", "never lose", "get rich", "financial freedom in", "copy my trades", "live trading", "live crypto", "live gold", "live forex", "urgent:", "🔴 urgent", "🚨 urgent",
    "must watch", "watch before", "prediction!", "friday prediction", "monday prediction",
)
TICKERS = r"[A-Z]{1,5}(\s*[/|,]\s*[A-Z]{1,5}){3,}"


def any_phrase(text: Column | str, phrases: tuple[str, ...] = PHRASES) -> Column:
    low = F.lower(col(text))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases))


def many_cashtags(text: Column | str, least: int = 3) -> Column:
    return F.size(cashtags(text)) >= least


def hint_count(text: Column | str, hints: tuple[str, ...] = HINTS) -> Column:
    low = F.lower(col(text))
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(h)).cast("int") for h in hints))


def shill(text: Column | str) -> Column:
    t = col(text)
    return t.rlike(r"@\w+") & (F.size(cashtags(t)) > 0) & (hint_count(t) >= 2)


def is_spam(text: Column | str) -> Column:
    return any_phrase(text) | many_cashtags(text) | shill(text)


def video_spam(title: Column | str, description: Column | str | None = None) -> Column:
    t = col(title)
    marks = F.length(t) - F.length(F.replace(F.replace(t, F.lit("#"), F.lit("")), F.lit("$"), F.lit("")))
    whole = t if description is None else F.concat(t, F.lit(" "), F.coalesce(col(description), F.lit("")))
    return any_phrase(whole, VIDEO_PHRASES) | (marks >= 4) | t.rlike(TICKERS)


STEPS = ("seen", "engagement", "age", "spam", "model", "none")


def funnel(posts: DataFrame, at: Column, floor: int = 3, days: int = 7, seen: DataFrame | None = None, flag: Column | None = None) -> DataFrame:
    """posts (id, ord, text, likes, reposts, published_at) with the step that drops each: seen, engagement, age, spam, model or none.

    An id is seen if it is among those `seen` before (id), or once a row of it was kept. `flag` is a model's verdict; it is
    asked about the posts that no other step drops."""
    engagement = F.col("likes") + 2 * F.col("reposts")
    old = F.timestamp_diff("SECOND", F.col("published_at"), at) > days * 86400
    step = F.when(engagement < floor, "engagement").when(old, "age").when(is_spam("text"), "spam").otherwise("none")
    told = posts.withColumn("engagement", engagement)
    if seen is not None:
        known = seen.select(F.col("id").alias("_id"), F.lit(True).alias("_seen")).distinct()
        told = told.join(known, F.col("id") == F.col("_id"), "left").withColumn("dropped", F.when(F.col("_seen"), "seen").otherwise(step)).drop("_id", "_seen")
    else:
        told = told.withColumn("dropped", step)
    if flag is not None:
        # rows that the cheap steps drop never reach the model
        asked = told.where("dropped = 'none'").withColumn("_flag", flag).withColumn("dropped", F.when(F.col("_flag"), "model").otherwise("none")).drop("_flag")
        told = asked.unionByName(told.where("dropped <> 'none'"))
    again = told.where("dropped = 'none'").groupBy("id").agg(F.min("ord").alias("_kept"))
    # later rows of a kept id are seen, whatever step would drop them; counted up before rows meet, so copies are no hot key
    return told.join(again.select(F.col("id").alias("_id"), "_kept"), F.col("id") == F.col("_id"), "left").withColumn("dropped", F.when(F.col("ord") > F.col("_kept"), "seen").otherwise(F.col("dropped"))).drop("_id", "_kept")


def counted(told: DataFrame, name: str = "funnel") -> tuple[DataFrame, Observation]:
    """told, and an observation of how many posts each step drops, complete once an action has read told."""
    seen = Observation(name)
    return told.observe(seen, *(F.count_if(F.col("dropped") == s).alias(s) for s in STEPS)), seen
