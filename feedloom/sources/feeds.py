"""Sources: feeds, pages and JSON payloads that lie in files, as typed rows. Fetching them is the caller's."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import instant, minmax, news_target, strip_html

ITEM = "source string, topic string, title string, url string, content string, published_at timestamp_ntz, raw_score double"


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """feed, xml from XML files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("feed"), F.decode("content", "UTF-8").alias("xml"))


def entries(feeds: DataFrame, at: Column, first: int = 15, days: int = 7, raw_score: float = 0.4) -> DataFrame:
    """feed, pos, title, url, content, published_at, raw_score: of each feed (feed, xml) the first entries with title and link, none too old."""
    xml = F.regexp_replace("xml", r"<(/?)(?:[A-Za-z]+:)([A-Za-z]+)", "<$1$2")
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0))
    tag = lambda *names: F.coalesce(*(F.nullif(strip_html(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{n}(?: [^>]*)?>(.*?)</{n}>", 1), r"<!\[CDATA\[|\]\]>", "")), F.lit("")) for n in names))
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1), F.lit("")))
    stamp = tag("pubDate", "published", "updated")
    bare = F.regexp_replace(F.regexp_replace(stamp, r"^[A-Za-z]{3},\s*", ""), "(GMT|UTC|UT|Z)$", "+0000")
    when = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(stamp)).cast("timestamp_ntz")
    rows = feeds.select("feed", F.posexplode(F.slice(parts, 1, first)).alias("pos", "e"))
    rows = rows.select("feed", "pos", tag("title").alias("title"), link.alias("url"), F.substring(F.coalesce(tag("description", "summary", "content"), F.lit("")), 1, 2000).alias("content"), F.coalesce(when, at).alias("published_at"), F.lit(raw_score).alias("raw_score"))
    return rows.where(F.col("title").isNotNull() & F.col("url").isNotNull() & (F.timestamp_diff("SECOND", F.col("published_at"), at) <= days * 86400))


def search_address(template: str, keyword: Column | str) -> Column:
    """A search feed's address: the template with {keyword} as a form field."""
    before, after = template.split("{keyword}")
    return F.concat(F.lit(before), F.url_encode(keyword if isinstance(keyword, Column) else F.col(keyword)), F.lit(after))


def search_entries(found: DataFrame, at: Column, first: int = 20) -> DataFrame:
    """source, pos, title, url, content, published_at, raw_score of a search's feeds (source, xml): links of a news search are
    replaced by the addresses in them, an empty text by the title."""
    held = entries(found.withColumnRenamed("source", "feed"), at, first, raw_score=0.5).withColumnRenamed("feed", "source")
    return held.withColumn("url", news_target("url")).withColumn("content", F.coalesce(F.nullif("content", F.lit("")), F.col("title")))


def trending(pages: DataFrame, first: int = 25, most: float = 50_000.0) -> DataFrame:
    """page, pos, title, url, content, raw_score: the repositories of trending pages (page, html), without those that name no owner.

    Descriptions and star counts may be missing; a count that is no number is none."""
    rows = F.regexp_extract_all("html", F.lit(r'(?s)<article[^>]*class="[^"]*Box-row[^"]*".*?</article>'), F.lit(0))
    held = pages.select("page", F.posexplode(F.slice(rows, 1, first)).alias("pos", "a"))
    path = F.regexp_replace(F.regexp_extract("a", r'(?s)<h2[^>]*>.*?<a[^>]*href="([^"]*)"', 1), "^/+", "")
    about = strip_html(F.regexp_extract("a", r"(?s)<p[^>]*>(.*?)</p>", 1))
    stars = F.replace(strip_html(F.regexp_extract("a", r'(?s)<a[^>]*href="[^"]*/stargazers"[^>]*>(.*?)</a>', 1)), F.lit(","), F.lit("")).try_cast("long")
    found = held.select("page", "pos", path.alias("title"), about.alias("about"), F.coalesce(stars, F.lit(0)).alias("stars")).where(F.contains("title", F.lit("/")))
    content = F.coalesce(F.nullif("about", F.lit("")), F.concat(F.lit("Trending GitHub repository: "), "title"))
    return found.select("page", "pos", "title", F.concat(F.lit("https://github.com/"), "title").alias("url"), content.alias("content"), minmax(F.col("stars").cast("double"), F.lit(0.0), F.lit(most)).alias("raw_score"))


def scrape(pages: DataFrame, prefix: str, first: int = 5) -> DataFrame:
    """page_id, pos, href: the first distinct links of a page (page_id, html) under a path prefix, in order."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(rf'href="({prefix}[^"#?]*)"'), F.lit(1)))
    return pages.select("page_id", F.posexplode(F.slice(links, 1, first)).alias("pos", "href"))


def fetch(registry: DataFrame, found: DataFrame, sites: DataFrame, scraped: DataFrame, topics: tuple[str, ...] = (), most: int = 8) -> DataFrame:
    """feed, topic, pos, title, url: of the registry's feeds (feed, topic) that serve one of the topics, or of all, the first `most`
    entries found (feed, pos, title, url), so that no busy feed crowds out others; then all that was scraped from sites (feed, topic)."""
    from ..operators.recency import cap_per

    serves = F.col("topic").isin(*topics) if topics else F.lit(True)
    columns = ("feed", "topic", "pos", "title", "url")
    capped = cap_per(found.join(registry.where(serves), "feed"), "feed", most, F.col("pos"))
    return capped.select(*columns).unionByName(scraped.join(sites.where(serves), "feed").select(*columns))


def video_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, video_id: the distinct videos that a page (page_id, html) links to, in order."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r"youtube\.com/watch\?v=([A-Za-z0-9_-]{11})"), F.lit(1)))
    return pages.select("page_id", F.posexplode(found).alias("pos", "video_id"))


def talks(links: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, title, url, content, author, raw_score of linked videos (page_id, pos, video_id) whose title is known (video_id, title, author)."""
    held = links.join(known.withColumn("title", F.trim("title")).where("title <> ''"), "video_id")
    content = F.concat("title", F.lit(" — "), F.coalesce("author", F.lit("")))
    return held.select("page_id", "title", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"), content.alias("content"), "author", F.lit(0.75).alias("raw_score"))


def uploads(channels: DataFrame, videos: DataFrame, topics: DataFrame, at: Column, each: int = 5) -> DataFrame:
    """channel, ord, pos, topic, title, url, content, published_at, raw_score of the first `each` of a channel's videos
    (channel, pos, video_id, title, description, published), without those that have no id; channels (ord, channel) count once.
    Topics (channel, topic) that are not given are `youtube`; a date that cannot be read is `at`."""
    from ..operators.recency import cap_per, first_seen

    held = first_seen(channels, "channel", "ord").join(topics, "channel", "left").select("channel", "ord", F.coalesce("topic", F.lit("youtube")).alias("topic"))
    latest = cap_per(videos.join(held, "channel"), "channel", each, F.col("pos")).where("video_id IS NOT NULL")
    content = F.coalesce(F.nullif(F.substring("description", 1, 1000), F.lit("")), F.col("title"))
    return latest.select("channel", "ord", "pos", "topic", "title", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"), content.alias("content"), instant("published", at).alias("published_at"), F.lit(0.5).alias("raw_score"))


def page_item(pages: DataFrame, most: int = 3000) -> DataFrame:
    """page_id, title (h1, else title, else the path), month (of `Month YYYY`), body."""
    of = lambda t: F.nullif(strip_html(F.regexp_extract("html", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit(""))
    body = strip_html(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "))
    names = "January|February|March|April|May|June|July|August|September|October|November|December"
    month = F.regexp_extract(body, rf"\b((?:{names}) \d{{4}})\b", 1)
    return pages.select("page_id", F.coalesce(of("h1"), of("title"), F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)).alias("title"), F.try_to_timestamp(F.concat(F.lit("1 "), month), F.lit("d MMMM yyyy")).cast("date").alias("month"), F.substring(body, 1, most).alias("body"))


def reddit(posts: DataFrame, limit: int = 50, subreddits: int = 1) -> DataFrame:
    """posts (subreddit, id, title, selftext, is_self, score): no empty self posts, score over the subreddit's best, a cap for each."""
    from pyspark.sql import Window

    own = Window.partitionBy("subreddit")
    cap = max(10, limit // max(1, subreddits))
    held = posts.withColumn("_n", F.row_number().over(own.orderBy("ord"))).where(F.col("_n") <= cap).withColumn("_max", F.max("score").over(own))
    held = held.where(~(F.col("is_self") & (F.coalesce("selftext", F.lit("")) == "")))
    content = F.coalesce(F.nullif(F.substring("selftext", 1, 2000), F.lit("")), F.col("title"))
    return held.select("subreddit", "id", "title", content.alias("content"), minmax(F.col("score").cast("double"), F.lit(0.0), F.col("_max").cast("double")).alias("raw_score"))


def engagement(posts: DataFrame, floor: int) -> DataFrame:
    """posts (likes, reposts) over the floor, scored between the batch's bounds taken before the floor."""
    value = F.col("likes") + 2 * F.col("reposts")
    high = posts.agg(F.max(value).alias("high"))
    held = posts.withColumn("engagement", value).join(F.broadcast(high))  # one row
    return held.where(F.col("engagement") >= floor).withColumn("raw_score", minmax("engagement", F.lit(0.0), F.col("high"), 0.5)).drop("high")


def videos(found: DataFrame, statistics: DataFrame) -> DataFrame:
    """found (id, ord, title, language) once each, with statistics (id, views, likes), without spam and dead ones, English only,
    scored by the views of the most watched of all found."""
    from ..functions.spam import video_spam
    from ..operators.recency import first_seen

    held = first_seen(found, "id", "ord").join(statistics, "id", "left").fillna(0, ["views", "likes"])
    high = held.agg(F.when(F.max("views") > 0, F.max("views")).otherwise(1).alias("high"))
    held = held.where(~((F.col("likes") == 0) & (F.col("views") < 500)) & (F.col("language") == "en") & ~video_spam("title"))
    score = F.least(F.lit(1.0), (F.col("views") * 0.001 + F.col("likes")) / (F.col("high") * 0.001 + 1))
    return held.join(F.broadcast(high)).withColumn("raw_score", F.round(score, 6)).drop("high")


def releases(rows: DataFrame) -> DataFrame:
    """rows (repo, ord, tag, draft, prerelease): each repository's first of its three latest that is neither."""
    from ..operators.recency import cap_per, first_seen

    return first_seen(cap_per(rows, "repo", 3, F.col("ord")).where(~F.col("draft") & ~F.col("prerelease")), "repo", "ord")


def stars(rows: DataFrame, over: float, limit: int | None = None) -> DataFrame:
    held = rows.withColumn("raw_score", F.least(F.lit(1.0), F.col("stars") / over))
    return held if limit is None else held.orderBy(F.desc("stars"), "repo").limit(limit)


def collect(parts: list[DataFrame]) -> DataFrame:
    """All sources' rows; order is the reader's."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def gather(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], path: str, tag: Callable[[Column], Column], workers: int = 8) -> tuple[DataFrame, dict[str, str]]:
    """All sources' rows, with the language of title and 200 characters of content and the newest first, and what went wrong by source.

    Each source is read and stored under `path` on its own, several at a time; one that fails leaves nothing there and does
    not hold up the others."""

    def store(name: str) -> tuple[str, str | None]:
        try:
            sources[name]().write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as e:  # whatever a source runs into is its own
            return name, f"{type(e).__name__}: {e}"[:300]
        return name, None

    with ThreadPoolExecutor(workers) as pool:
        said = dict(pool.map(store, sources))
    good = [spark.read.parquet(f"{path}/{name}") for name, wrong in said.items() if wrong is None]
    if not good:
        raise ValueError(f"no source could be read: {said}")
    text = F.concat("title", F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, 200))
    return collect(good).withColumn("language", tag(text)).orderBy(F.desc("published_at")), {k: v for k, v in said.items() if v}


def enabled(registry: DataFrame, state: DataFrame) -> DataFrame:
    """Sources of the registry (source, configured) whose state (source, is_enabled) does not switch them off."""
    off = state.where(~F.col("is_enabled")).select("source")
    return registry.where("configured").join(off, "source", "left_anti")


def collector_state(raw: DataFrame) -> DataFrame:
    """source and the checked fields of state, a JSON object; an unreadable one gives nulls."""
    s = F.from_json("state", "last_id string, fetched long, cursor string", {"mode": "PERMISSIVE"})
    return raw.select("source", s.alias("s")).select("source", "s.last_id", "s.fetched", "s.cursor")
