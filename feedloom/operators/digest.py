"""Choosing and laying out evidence for digests, answers and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bold, escaped, parse_digest, strip_html


def strength(relevance: str = "relevance", raw: str = "raw_score") -> Column:
    """Relevance, or raw score where that is null or zero, or 0."""
    zero = F.lit(0.0)
    return F.coalesce(F.nullif(F.col(relevance), zero), F.nullif(F.col(raw), zero), zero)


def select_items(items: DataFrame, n: int = 20, floor: float = 5.0) -> DataFrame:
    """topic, n, id, ...: of each topic's non-duplicates the relevant ones if there are any, else all; the n strongest."""
    held = items.where(~F.col("is_duplicate")).withColumn("_ok", F.coalesce(F.col("relevance") >= floor, F.lit(False)))
    # relevant ones rank first, so the n first tell whether there are any; a task sends n rows a topic
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("_ok"), F.desc(strength()), "id"))
    first = held.withColumn("n", rank).where(F.col("n") <= n)
    return first.withColumn("_any", F.max("_ok").over(Window.partitionBy("topic"))).where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def evidence(chosen: DataFrame) -> DataFrame:
    """topic, block: numbered titles, sources and texts."""
    text = F.substring(F.coalesce("summary", "content"), 1, 300)
    line = F.format_string("[%d] %s\nSource: %s\n%s", "n", "title", "source", text)
    lines = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return chosen.groupBy("topic").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("block"))


def prompt_rows(items: DataFrame, size: int = 15) -> DataFrame:
    """batch, payload: JSON arrays of index, title, content (500 characters) and source for a language model."""
    # batches are numbered inside hash buckets, so no task numbers all rows
    bucket = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("int") % 64
    held = items.withColumn("bucket", bucket).withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1)
    held = held.withColumn("batch", F.floor(F.col("_n") / size)).withColumn("index", F.col("_n") % size)
    row = F.struct("index", "title", F.substring("content", 1, 500).alias("content"), "source")
    return held.groupBy("bucket", "batch").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload"), F.count("*").alias("n"))


def answers(payload: Column) -> Column:
    """A language model's JSON array as structs; null if it is none."""
    return F.from_json(payload, "array<struct<summary string, relevance_score double, key_entities array<string>, sentiment string, tags array<string>>>")


def card(items: DataFrame) -> DataFrame:
    """id, text, cut (whether it was), tags (5), day: what a letter shows."""
    text = F.coalesce("summary", F.substring("content", 1, 300))
    cut = F.col("summary").isNull() & (F.length("content") > 300)
    return items.select("id", text.alias("text"), cut.alias("cut"), F.array_join(F.slice("tags", 1, 5), ",").alias("tags"), F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def sections(chosen: DataFrame, digests: DataFrame) -> DataFrame:
    """topic, items, html, text: a letter's part for each topic of the chosen items (n, sentiment, ...) or digests (topic, content).

    Texts are escaped in HTML; what **stars** enclose is bold there and bare in the plain part. At most a day's choice a topic."""
    source = strip_html(F.coalesce(F.nullif("summary", F.lit("")), F.substring("content", 1, 300)))
    cut = (F.coalesce("summary", F.lit("")) == "") & (F.length("content") > 300)
    mood = F.when(F.coalesce("sentiment", F.lit("")) != "", F.concat(F.lit(" <i>"), escaped("sentiment"), F.lit("</i>"))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("<p>"), F.array_join(F.transform(F.slice("tags", 1, 5), lambda t: F.concat(F.lit("<b>"), escaped(t), F.lit("</b>"))), " "), F.lit("</p>"))).otherwise("")
    when = F.coalesce(F.date_format("published_at", "MMM dd, HH:mm 'UTC'"), F.lit(""))
    html = F.concat(
        F.lit("<article><p>"), escaped("source"), mood, F.lit(" "), when, F.lit('</p><h3><a href="'), escaped("url"), F.lit('">'), escaped("title"), F.lit("</a></h3><p>"),
        escaped(source), F.when(cut, "…").otherwise(""), F.lit("</p>"), F.coalesce(tags, F.lit("")), F.lit("</article>"),
    )
    line = F.concat(F.lit("- ["), "source", F.lit("] "), "title", F.lit("\n  "), "url", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("\n  "), F.substring(strip_html("summary"), 1, 240))).otherwise(""))
    listed = chosen.select(F.lower("topic").alias("topic"), F.struct("n", "id", html.alias("html"), line.alias("line")).alias("i")).groupBy("topic").agg(F.array_sort(F.collect_list("i")).alias("all"))
    told = digests.select(F.lower("topic").alias("topic"), parse_digest("content").alias("d"))
    both = listed.join(told, "topic", "full_outer").withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))
    points = F.transform("d.bullets", lambda b: F.concat(F.lit("<li>"), bold(b), F.lit("</li>")))
    head = F.when(F.col("d").isNull(), "<p>No summary available for this period yet.</p>").otherwise(F.concat(F.lit("<p>"), F.coalesce(bold("d.headline"), F.lit("")), F.lit("</p>"), F.when(F.size("d.bullets") > 0, F.concat(F.lit("<ul>"), F.array_join(points, ""), F.lit("</ul>"))).otherwise("")))
    n = F.size("all")
    body = F.when(n == 0, "<p>No recent items.</p>").otherwise(F.array_join(F.transform("all", lambda x: x["html"]), "\n"))
    rich = F.concat(F.lit("<section><h2>"), escaped(F.initcap("topic")), F.lit(" &middot; "), n.cast("string"), F.lit(" items</h2>\n"), head, F.lit("\n"), body, F.lit("\n</section>"))
    bare = F.transform("d.bullets", lambda b: F.concat(F.lit("  • "), F.regexp_replace(b, r"\*\*(.+?)\*\*", "$1")))
    top = F.when(F.col("d").isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.coalesce("d.headline", F.lit(""))), bare))
    lines = F.concat(F.array(F.concat(F.lit("## "), F.upper("topic"), F.lit(" ("), n.cast("string"), F.lit(" items)"))), top, F.transform("all", lambda x: F.concat(F.lit("\n"), x["line"])))
    return both.select("topic", n.alias("items"), rich.alias("html"), F.array_join(lines, "\n").alias("text"))


def letter(parts: DataFrame, date: str) -> DataFrame:
    """html, text: one row, the sections (topic, html, text) in order of topic. As many as a reader has topics."""
    all_ = parts.agg(F.array_sort(F.collect_list(F.struct("topic", "html", "text"))).alias("s"))
    rich = F.concat(F.lit(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>News Digest</title></head><body><h1>News Digest</h1><p>{date}</p>\n'), F.array_join(F.transform("s", lambda x: x["html"]), "\n"), F.lit("\n</body></html>\n"))
    bare = F.concat(F.lit(f"News Digest — {date}\n{'=' * 60}\n\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n"), F.lit("\n"))
    return all_.select(rich.alias("html"), bare.alias("text"))
