"""The library's relations bound to the driver's tables, with the clock as an argument.

Each relation has a twin in SQL (`SQL`), from which the oracles are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def as_of(at: str = AS_OF) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def hours_before(at: Column, hours: Column | int) -> Column:
    return F.timestamp_add("HOUR", -(hours if isinstance(hours, Column) else F.lit(hours)).cast("int"), at)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str, at: str = AS_OF) -> DataFrame:
    """Articles from documents and labels."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    quality = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(quality, "doc_id", "left").select(
        i.alias("id"), "source", F.concat(F.lit("t"), i % 5).alias("topic"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), i).alias("url"), F.col("lang").alias("language"),
        hours_before(as_of(at), i % 240).alias("published_at"), hours_before(as_of(at), i % 48).alias("fetched_at"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("raw_score"),
        F.when(F.col("quality") == 1, 8.0).when(F.col("quality") == 0, 3.0).alias("relevance"),
        (i % 13 == 0).alias("is_duplicate"), F.when(i % 3 != 0, F.substring("text", 1, 120)).alias("summary"),
        F.array(F.col("lang"), F.concat(F.lit("q"), i % 7)).alias("tags"), F.array(F.concat(F.lit("e"), i % 23)).alias("entities"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader actions from events; items are numbered by event_id modulo the number of documents."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    kind = F.col("event_type")
    action = F.when(kind == "view", "read").when(kind == "click", "click").when(kind == "purchase", "upvote").when(kind == "error", "downvote").otherwise("undownvote")
    e = read(spark, sf_dir, "events").join(F.broadcast(n))
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") % F.col("n")).alias("item_id"), action.alias("action"), F.when(kind == "view", F.col("value")).alias("read_seconds"), F.col("ts").alias("created_at"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls from events."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.alias("seq"), "ts", F.col("event_type").alias("model"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("caller"), F.floor("value").cast("long").alias("total_tokens"),
        F.when(i % 17 != 0, F.col("value") / 1000).alias("cost_usd"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank evaluation rows: query (100 documents each), bucket, label, score without ties inside a query."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return d.select(F.floor(F.col("doc_id") / 100).alias("query"), F.element_at(F.array(*map(F.lit, ("nl", "entity", "ticker", "time"))), (F.floor(F.col("doc_id") / 100) % 4 + 1).cast("int")).alias("bucket"), F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("n_chars") * 1000 + F.col("doc_id") % 1000).alias("score"))


SQL = {
    "items": """items AS (SELECT d.doc_id AS id, source, 't' || (d.doc_id % 5) AS topic, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content,
 'https://' || source || '.example.com/a/' || d.doc_id AS url, lang AS language, TIMESTAMP '2024-01-31 00:00:00' - to_hours(d.doc_id % 240) AS published_at,
 TIMESTAMP '2024-01-31 00:00:00' - to_hours(d.doc_id % 48) AS fetched_at, (n_chars % 1000)::DOUBLE / 1000 AS raw_score,
 (CASE quality WHEN 1 THEN 8.0 WHEN 0 THEN 3.0 END)::DOUBLE AS relevance, d.doc_id % 13 = 0 AS is_duplicate, CASE WHEN d.doc_id % 3 <> 0 THEN substr(text, 1, 120) END AS summary,
 [lang, 'q' || (d.doc_id % 7)] AS tags, ['e' || (d.doc_id % 23)] AS entities FROM documents d LEFT JOIN labels USING (doc_id))""",
    "interactions": """interactions AS (SELECT event_id AS seq, event_id % (SELECT count(*) FROM documents) AS item_id,
 CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' ELSE 'undownvote' END AS action,
 CASE WHEN event_type = 'view' THEN value END AS read_seconds, ts AS created_at FROM events)""",
    "ledger": """ledger AS (SELECT event_id AS seq, ts, event_type AS model, 'c' || (user_id % 4) AS caller, floor(value)::BIGINT AS total_tokens,
 CASE WHEN event_id % 17 <> 0 THEN value / 1000 END AS cost_usd, value AS latency_ms, event_type <> 'error' AS success FROM events)""",
    "candidates": """candidates AS (SELECT doc_id // 100 AS query, ['nl', 'entity', 'ticker', 'time'][(doc_id // 100 % 4 + 1)::INT] AS bucket, doc_id AS id, quality AS label,
 n_chars * 1000 + doc_id % 1000 AS score FROM documents JOIN labels USING (doc_id))""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
