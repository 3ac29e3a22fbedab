"""Analysis of items by a language model in batches, and the backfill of those without one.

A round takes the newest `size` items that lack a summary, deals those of each topic out in batches, each batch to a slot of
a weighted pool of models by its number, and joins the answers to the items by position. A rate-limited model passes its
batch on to the next slot; what cannot be parsed leaves its items as they were. Since an item is tried once a backfill, the
rounds are known beforehand: items are numbered once, and one, two, four, up to MOST rounds run as one job, whose analyses are
a segment of a versioned table. A backfill that is cut off goes on after the last segment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from . import versions

BATCH, ROUND = 15, 200
#: Rounds that are one job, and lost if it is cut off.
MOST = 512
_ANSWER = "summary string, relevance double, key_entities array<string>, sentiment string, tags array<string>"


class RateLimited(Exception):
    """A model has no quota left; the next one is asked."""


def parsed(text: str) -> list[dict] | None:
    """The JSON array of an answer, fenced or not; None if it is none."""
    raw = text.strip()
    if "```" in raw:
        raw = raw.split("```")[1].removeprefix("json")
    try:
        found = json.loads(raw)
    except ValueError:
        return None
    return found if isinstance(found, list) and all(isinstance(x, dict) for x in found) else None


def _number(x: object) -> float:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 5.0


def _unanalysed(items: DataFrame) -> DataFrame:
    return items.where(F.col("summary").isNull() & ~F.coalesce("is_duplicate", F.lit(False)))


def newest_unanalysed(items: DataFrame, size: int = ROUND) -> DataFrame:
    return _unanalysed(items).orderBy(F.desc("fetched_at"), "id").limit(size)


def _asked(items: DataFrame, *more: str) -> DataFrame:
    """What a prompt needs of items."""
    return items.select("id", "topic", "fetched_at", "title", F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("content"), "source", *more)


def numbered(items: DataFrame, size: int, path: str) -> DataFrame:
    """Write what prompts need of items under path, with round (from 0, newest first), by one sort in ranges whose rows are counted."""
    spark, order = items.sparkSession, (F.desc("fetched_at"), F.col("id"))
    _asked(items).repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = F.broadcast(dealt.groupBy("part").count().select("part", before.alias("before")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    dealt.join(starts, "part").withColumn("round", F.floor(place / size).cast("int")).drop("part", "before").write.parquet(f"{path}/numbered")
    return spark.read.parquet(f"{path}/numbered")


def analyse(items: DataFrame, pool: list[str], ask: Callable[[str, str], str], batch: int = BATCH) -> DataFrame:
    """round (0 where items have none), id, topic, batch, model and the answer's columns of items that have one."""
    if "round" not in items.columns:
        items = items.withColumn("round", F.lit(0))
    order = Window.partitionBy("round", "topic").orderBy(F.desc("fetched_at"), "id")  # of one round's rows
    dealt = _asked(items, "round").withColumn("n", F.row_number().over(order) - 1)
    dealt = dealt.withColumn("batch", F.floor(F.col("n") / batch).cast("int"))
    id_type = dealt.schema["id"].dataType.simpleString()
    columns = ["round", "id", "topic", "batch", "model", "summary", "relevance", "key_entities", "sentiment", "tags"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, number, turn_of = rows.sort_values("n"), int(rows["batch"].iloc[0]), int(rows["round"].iloc[0])
        listed = [{"index": i, "title": t, "content": c, "source": s} for i, (t, c, s) in enumerate(zip(rows["title"], rows["content"], rows["source"], strict=True))]
        prompt = json.dumps({"topic": rows["topic"].iloc[0], "items": listed}, ensure_ascii=False)
        for turn in range(len(pool)):
            model = pool[(number + turn) % len(pool)]
            try:
                found = parsed(ask(model, prompt)) or []
            except RateLimited:
                continue
            except Exception:  # a failed call leaves its batch unanalysed
                found = []
            out = [
                (turn_of, i, rows["topic"].iloc[0], number, model, a.get("summary"), _number(a.get("relevance_score", 5.0)), a.get("key_entities") or [], a.get("sentiment") or "neutral", a.get("tags") or [])
                for i, a in zip(rows["id"], found, strict=False)
            ]
            return pd.DataFrame(out, columns=columns)
        return pd.DataFrame([], columns=columns)

    return dealt.groupBy("round", "topic", "batch").applyInPandas(run, f"round int, id {id_type}, topic string, batch int, model string, {_ANSWER}")


def segments(spark: SparkSession, path: str) -> DataFrame | None:
    """The analyses of all rounds so far, with round."""
    now = versions.latest(spark, path)
    if now is None or not now.segments:
        return None
    return spark.read.parquet(*(f"{path}/rounds/segment={s}" for s in now.segments))


def rounds(spark: SparkSession, items: DataFrame, path: str, pool: list[str], ask: Callable[[str, str], str], size: int = ROUND, batch: int = BATCH) -> Iterator[int]:
    """Analyse what lacks a summary, `size` items a round; yields how many items each round tried."""
    now = versions.latest(spark, path)
    number, done, first = (now.version + 1, list(now.segments), now.rounds) if now else (0, [], 0)
    left = _unanalysed(items)
    if done:
        left = left.join(spark.read.parquet(*(f"{path}/tried/segment={s}" for s in done)), "id", "left_anti")
    held = numbered(left, size, new_folder(spark))
    n, at, many = held.count(), 0, 1
    while at * size < n:
        upto = min(at + many, -(-n // size))
        taken = held.where((F.col("round") >= at) & (F.col("round") < upto)).withColumn("round", F.col("round") + first)
        analyse(taken, pool, ask, batch).write.mode("overwrite").parquet(f"{path}/rounds/segment={number}")
        taken.select("id").write.mode("overwrite").parquet(f"{path}/tried/segment={number}")
        done = [*done, number]
        versions.commit(spark, path, number, {"segments": done, "rounds": first + upto}, "segments array<int>, rounds int")
        yield from (min(size, n - k * size) for k in range(at, upto))
        at, number, many = upto, number + 1, min(2 * many, MOST)


def backfill(spark: SparkSession, items: DataFrame, path: str, pool: list[str], ask: Callable[[str, str], str], size: int = ROUND, batch: int = BATCH) -> int:
    """Run rounds until none is left; how many there were."""
    return sum(1 for _ in rounds(spark, items, path, pool, ask, size, batch))


def with_analyses(items: DataFrame, found: DataFrame) -> DataFrame:
    """items with the summaries, relevances and tags found for them."""
    new = found.where(F.col("summary").isNotNull()).select("id", F.col("summary").alias("_s"), F.col("relevance").alias("_r"), F.col("tags").alias("_t"))
    return items.join(new, "id", "left").select(*(F.coalesce(new, c).alias(c) if (new := {"summary": "_s", "relevance": "_r", "tags": "_t"}.get(c)) else F.col(c) for c in items.columns))
