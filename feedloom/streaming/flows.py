"""The library's flows as Structured Streaming queries; each gives what its batch twin gives once all input is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import interaction_weight
from ..operators.preference import dimensions
from ..operators.store import last_of, merge


def watch(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).options(**{"maxFilesPerTrigger": 10, **options}).parquet(path)


def arrivals(items: DataFrame, key: str = "id", event: str = "published_at", late: str = "7 days") -> DataFrame:
    """Each key once while its watermark lasts; later copies go."""
    return items.withWatermark(event, late).dropDuplicatesWithinWatermark([key])


def drop_late(items: DataFrame, at: Column, days: int = 7) -> DataFrame:
    return items.where(F.timestamp_diff("SECOND", F.col("published_at"), at) <= days * 86400)


def upserts(path: str, key: str, update: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the next version of a table. A batch that runs again writes
    its own version again, from the version before it; versions before that one are removed."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_of(batch, key, order)
        old = version_before(spark, path, number)
        out = new if old is None else merge(spark.read.parquet(old), new, key, update)
        out.write.mode("overwrite").parquet(f"{path}/version={number}")
        if old is not None:
            for v in _versions(spark, path):
                if v < int(old.rpartition("=")[2]):
                    _delete(spark, f"{path}/version={v}")

    return run


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return []
    done = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def version_before(spark: SparkSession, path: str, number: int) -> str | None:
    found = [v for v in _versions(spark, path) if v < number]
    return f"{path}/version={found[-1]}" if found else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def fetch_round(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> list[tuple[int, int]]:
    """One run of an interval job: read what came since the last run, store the keys not stored yet, and return (batch, rows
    stored) of each batch. How much a batch reads is the source's limit; a batch that runs again replaces its own part."""
    spark, counts = stream.sparkSession, []
    schema = stream.schema.add("batch", "long")

    def store(batch: DataFrame, number: int) -> None:
        seen = Observation()
        new = batch.dropDuplicates([key])
        if number:
            held = spark.read.schema(schema).parquet(path).where(F.col("batch") < number)
            new = new.join(held.select(key), key, "left_anti").select(*batch.columns)
        new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        counts.append((number, seen.get["n"]))

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


def running_scores(interactions: DataFrame) -> DataFrame:
    """item_id, score so far; update mode."""
    return interactions.groupBy("item_id").agg(F.sum(interaction_weight("action", "read_seconds")).alias("score"))


def tumbling(interactions: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """An addition: counts by window of event time."""
    return interactions.withWatermark("created_at", late).groupBy(F.window("created_at", width), "action").agg(F.count("*").alias("n"))


def sessions(interactions: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """An addition: sessions by reader."""
    return interactions.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), "user_id").agg(F.count("*").alias("n"))


def matched(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "2 days") -> DataFrame:
    """Rows of left (key, seq, created_at) with the rows of right that follow them on the same key `within` an interval: both
    sides forget what their watermark and the interval rule out."""
    a = left.select(F.col(key).alias("a_key"), F.col("seq").alias("a_seq"), F.col("created_at").alias("a_at")).withWatermark("a_at", late)
    b = right.select(F.col(key).alias("b_key"), F.col("seq").alias("b_seq"), F.col("created_at").alias("b_at")).withWatermark("b_at", late)
    soon = F.expr(f"b_at >= a_at AND b_at <= a_at + INTERVAL {within}")
    return a.join(b, (F.col("a_key") == F.col("b_key")) & soon).select(F.col("a_key").alias(key), "a_seq", "b_seq")


_PREFERENCE = "dimension string, value string, total double, score double, cycle long"


def preference_changes(interactions: DataFrame, items: DataFrame, cycle: Column) -> DataFrame:
    """dimension, value, total, score, cycle: the state of each preference that new interactions change.

    Preferences compound: at the end of every cycle the weights of all history are added to the scores again. A key's state
    is the total of its weights and its score at the end of its last cycle, so cycles without an interaction cost nothing and
    late ones count from their own cycle on. The items are a table; keys without an interaction have no state."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Compounding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("preference", "total double, score double, cycle long")

        def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
            total, score, last = self.state.get() if self.state.exists() else (0.0, 0.0, None)
            for part in rows:
                newest = int(part["cycle"].max())
                if last is None:
                    last = newest
                elif newest > last:
                    score, last = score + total * (newest - last), newest
                score += float((part["weight"] * (last - part["cycle"] + 1)).sum())
                total += float(part["weight"].sum())
            self.state.update((total, score, last))
            yield pd.DataFrame([(*key, total, score, last)], columns=["dimension", "value", "total", "score", "cycle"])

        def close(self) -> None:
            pass

    weights = interactions.select(F.col("item_id").alias("id"), interaction_weight("action", "read_seconds").alias("weight"), cycle.cast("long").alias("cycle"))
    found = weights.where("weight <> 0").join(dimensions(items), "id").select("dimension", "value", "weight", "cycle")
    return found.groupBy("dimension", "value").transformWithStateInPandas(Compounding(), _PREFERENCE, "Update", "None")


def changes_to(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch's changes as a part of its own; a batch that runs again replaces its part."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def preferences_at(spark: SparkSession, path: str, cycle: int) -> DataFrame:
    """dimension, value, score at the end of a cycle, from the last change of each."""
    held = spark.read.schema(f"{_PREFERENCE}, batch long").parquet(path)
    last = held.groupBy("dimension", "value").agg(F.max_by(F.struct("total", "score", "cycle"), "batch").alias("s"))
    return last.select("dimension", "value", F.round(F.col("s.score") + F.col("s.total") * (F.lit(cycle) - F.col("s.cycle")), 6).alias("score"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keep state in RocksDB, as stateful processors need, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def votes(interactions: DataFrame) -> DataFrame:
    """item_id, seq, action, cancel: each vote with the cancel that it needs first; the state of an item is its active vote."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, action in zip(rows["seq"], rows["action"], strict=True):
            cancel = None
            if action in ("upvote", "downvote"):
                if active and active != action:
                    cancel = f"un{active}"
                active = action
            elif action == f"un{active}":
                active = ""
            out.append((key[0], seq, action, cancel))
        state.update((active,))
        yield pd.DataFrame(out, columns=["item_id", "seq", "action", "cancel"])

    held = interactions.where(F.col("action").isin("upvote", "unupvote", "downvote", "undownvote")).select("item_id", "seq", "action")
    return held.groupBy("item_id").applyInPandasWithState(run, "item_id long, seq long, action string, cancel string", "active string", "append", GroupStateTimeout.NoTimeout)


def drain(query: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run until all present input is read."""
    query.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def drain_batches(query: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    query.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
