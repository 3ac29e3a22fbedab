"""Keyed merges and the tables' upkeep, as functions from old and new rows to the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Rows of both by key: new rows are inserted whole; of known ones only the columns in `update` change."""
    o, n = old.alias("o"), new.alias("n")
    known, fresh = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(mine, theirs).alias(c)
        return (F.when(fresh, theirs).otherwise(mine) if c in update else F.when(known, mine).otherwise(theirs)).alias(c)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*(pick(c) for c in old.columns))


def set_where(old: DataFrame, new: DataFrame, key: str, columns: list[str], gate: str) -> DataFrame:
    """old with `columns` from new where new's `gate` is not null."""
    n = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    ok = F.col(f"_{gate}").isNotNull()
    return old.join(n, key, "left").select(*(F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def accumulate_state(old: DataFrame, runs: DataFrame) -> DataFrame:
    """source, items_fetched (summed), last_error and last_run (the last that is not null), by source."""
    rows = old.select("source", F.lit(-1).cast("long").alias("seq"), "items_fetched", "last_error", "last_run").unionByName(runs.select("source", F.col("seq").cast("long").alias("seq"), "items_fetched", "last_error", "last_run"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("source").agg(F.sum("items_fetched").alias("items_fetched"), last("last_error"), last("last_run"))


def prune(items: DataFrame, cutoff: Column) -> DataFrame:
    return items.where(F.col("fetched_at") >= cutoff)


def clear(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """relation, cleared: how many rows each table held before it was emptied; its columns stay."""
    counts = []
    for name, path in paths.items():
        held = spark.read.parquet(path)
        counts.append((name, held.count()))
        spark.createDataFrame([], held.schema).write.mode("overwrite").parquet(path)
    return spark.createDataFrame(counts, "relation string, cleared long")


def digest_rows(rows: DataFrame) -> DataFrame:
    """id, date, topic (in lower case), content, item_count, generated_at of digests as they are written."""
    topic = F.lower("topic")
    return rows.select(F.concat_ws("_", "date", topic).alias("id"), "date", topic.alias("topic"), "content", "item_count", "generated_at")


def put_digests(old: DataFrame, new: DataFrame) -> DataFrame:
    """The digests after new ones (one a date and topic): those of a known date and topic are replaced."""
    return merge(old, digest_rows(new), "id", ["content", "item_count", "generated_at"])


def latest_digests(held: DataFrame, date: str) -> DataFrame:
    """One digest of each topic: that of the date, else the latest. An aggregate, so a topic's digests are reduced where they are."""
    best = F.max_by(F.struct(*held.columns), F.struct((F.col("date") == date).alias("_exact"), F.col("generated_at").isNotNull().alias("_dated"), F.col("generated_at").alias("_at")))
    return held.groupBy(F.col("topic").alias("_topic")).agg(best.alias("_best")).select("_best.*")


def get_digest(held: DataFrame, date: str, topic: str) -> DataFrame:
    """The digest of a date and topic, else the topic's latest: one row or none."""
    return latest_digests(held.where(F.col("topic") == topic.lower()), date)


def delete_digest(held: DataFrame, date: str, topic: str) -> DataFrame:
    return held.where(F.col("id") != f"{date}_{topic.lower()}")


def put_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, value, updated_at after new settings, one a key."""
    return merge(old, new, "key", ["value", "updated_at"])


def get_setting(held: DataFrame, key: str, default: str = "") -> DataFrame:
    """value: one row, the default where the key is unknown."""
    return held.where(F.col("key") == key).agg(F.coalesce(F.first("value"), F.lit(default)).alias("value"))


def add_tombstones(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tombstones (id, ...) with new ones; one that is there stays as it is."""
    return old.unionByName(new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(*old.columns))


def drop_tombstones(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone.select("id"), "id", "left_anti")


def publish(df: DataFrame, path: str, version: int) -> str:
    """Write a version beside the others, never over one that is read."""
    to = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(to)
    return to


def export_json(items: DataFrame) -> DataFrame:
    """id, json: an object for each item, to be written as lines."""
    return items.select("id", F.to_json(F.struct("id", "title", "source", "relevance")).alias("json"))


def write_json(items: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition."""
    export_json(items).select("json").write.text(path)


def export_markdown(items: DataFrame, topics: list[str], limit: int = 20) -> DataFrame:
    """topic, markdown: its items that are no duplicates, best first."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "id")
    top = items.where(F.col("topic").isin(*topics) & ~F.col("is_duplicate")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    line = F.format_string("- [%s](%s)", "title", "url")
    return top.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("markdown"))
