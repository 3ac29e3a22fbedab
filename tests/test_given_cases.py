"""Fixed cases with known answers for functions whose queries run over given tables."""

import base64

import pytest
from pyspark.sql import functions as F

from feedloom.functions import spam as S
from feedloom.functions import text as T
from feedloom.operators import digest, recency, store
from feedloom.providers import language
from feedloom.session import new_folder
from feedloom.sources import feeds
from feedloom.streaming import flows

AT = "2024-01-31"


def at():
    return F.lit(AT).cast("timestamp_ntz")


def mapped(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f("x").alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_questions(spark):
    yes = ["whatsapp", "willow tree", "market news?", "the quick brown fox jumps over dogs", "might rates fall", "shall we buy", "do it", "who won", "Is  it", "why"]
    no = ["rust", "open source models", "has gold peaked", "whose turn", "island life", "cannot say", "dome"]
    assert mapped(spark, T.is_question, yes + no) == [True] * len(yes) + [False] * len(no)
    assert mapped(spark, T.wants_expansion, ["rust", "open source models", "why"]) == [False, True, True]


def test_video_titles(spark):
    titles = ["#a #b #c $d", "BUY AAPL, MSFT, TSLA, NVDA now", "calm title #one", "SPY / QQQ / NVDA / TSLA", "AAPL, MSFT and a calm day", "How to get RICH"]
    assert mapped(spark, S.video_spam, titles) == [True, True, False, True, False, True]


def test_shown_addresses(spark):
    urls = ["https://t.co/abc", "https://www.netflix.com/x", None, "https://x.com/i/1"]
    assert mapped(spark, lambda c: T.shown_url(c, F.lit("own")), urls) == ["own", "https://www.netflix.com/x", "own", "own"]


def test_news_targets(spark):
    inner = base64.urlsafe_b64encode(b"\x08\x13\x22\x19https://example.com/story\x00\x01").decode().rstrip("=")
    urls = [f"https://news.google.com/rss/articles/{inner}?oc=5", "https://news.google.com/x", "https://a.example/articles/aGk"]
    assert mapped(spark, T.news_target, urls) == ["https://example.com/story", *urls[1:]]


def test_texts(spark):
    assert mapped(spark, T.bold, ["**a & b** <i>"]) == ["<strong>a &amp; b</strong> &lt;i&gt;"]
    assert mapped(spark, T.fenced_json, ['```json\n[{"summary":"s"}]\n```', "[1]", "sorry"]) == ['[{"summary":"s"}]', "[1]", None]
    assert mapped(spark, T.csv_list, [" AI, Rust,ai,,rust", "all", ""]) == [["AI", "Rust"], [], []]
    [long] = mapped(spark, T.parse_digest, ["head" + "|||point" * 1500])
    assert long.headline == "head" and len(long.bullets) == 1500
    assert mapped(spark, T.parse_digest, ["", " \n ", None]) == [None] * 3
    assert [tuple(x) for x in mapped(spark, T.parse_digest, ["one", " **a**\r\n\n - b ", " h ||| ||| - b "])] == [("one", []), ("**a**", ["- b"]), (" h ", [" - b "])]


RSS = """<rss><channel><item><title>One &amp; only</title><link>https://a.example/1</link><description><![CDATA[<p>Body <b>one</b></p>]]></description><pubDate>Tue, 30 Jan 2024 10:00:00 +0000</pubDate></item>
<item><title>Old</title><link>https://a.example/2</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>No link</title></item><item><title>Bare</title><link>https://a.example/3</link></item></channel></rss>"""


def test_feeds(spark):
    held = spark.createDataFrame([("f", RSS)], "feed string, xml string")
    assert [(r.title, r.url, r.content) for r in feeds.entries(held, at()).orderBy("pos").collect()] == [("One & only", "https://a.example/1", "Body one"), ("Bare", "https://a.example/3", "")]
    found = feeds.search_entries(held.withColumnRenamed("feed", "source"), at()).orderBy("pos").collect()
    assert [(r.content, r.raw_score) for r in found] == [("Body one", 0.5), ("Bare", 0.5)]
    assert mapped(spark, lambda c: feeds.search_address("https://n.example/s?q={keyword}&x=1", F.col(c)), ["a b&c"]) == ["https://n.example/s?q=a+b%26c&x=1"]


def test_trending_pages(spark):
    row = '<article class="Box-row x"><h2 class="h"><a data-a="1" href="/{0}">\n <span>o</span> n</a></h2>{1}<a href="/{0}/stargazers">{2}</a></article>'
    page = "".join(row.format(*x) for x in [("o/n", "<p>Some\n text</p>", "<svg/> 12,500"), ("alone", "", "5"), ("p/q", "", "k")]) + '<article class="other"><h2><a href="/x/y">z</a></h2></article>'
    found = feeds.trending(spark.createDataFrame([("t", page), ("u", "no rows"), ("v", None)], "page string, html string")).orderBy("pos").collect()
    assert [(r.title, r.url, r.content, r.raw_score) for r in found] == [("o/n", "https://github.com/o/n", "Some text", 0.25), ("p/q", "https://github.com/p/q", "Trending GitHub repository: p/q", 0.0)]


def test_posts_and_videos(spark):
    rows = [("p", 1, 0, "t", " ", True, 5), ("p", 2, 1, "t", "body", True, 10), ("p", 3, 2, "t", "", True, 7), ("p", 5, 3, "t", None, True, 7), ("q", 4, 0, "t", None, False, 3)]
    held = spark.createDataFrame(rows, "subreddit string, id long, ord int, title string, selftext string, is_self boolean, score long")
    assert sorted((r.id, r.raw_score) for r in feeds.reddit(held).collect()) == [(1, 0.5), (2, 1.0), (4, 1.0)]
    found = spark.createDataFrame([("a", 0, "x", "en"), ("a", 1, "x", "en"), ("b", 2, "y", "en"), ("c", 3, "z", "en"), ("d", 4, "w", "de"), ("e", 5, "URGENT: sell", "en")], "id string, ord int, title string, language string")
    stats = spark.createDataFrame([("a", 1000, 10), ("c", 600, 0), ("d", 2000, 9), ("e", 900, 9)], "id string, views long, likes long")
    assert sorted((r.id, r.raw_score) for r in feeds.videos(found, stats).collect()) == [("a", 1.0), ("c", 0.2)]


def test_sources(spark):
    rows = spark.createDataFrame([("r", 0, "v3", True, False), ("r", 1, "v2", False, False), ("r", 2, "v1", False, False), ("s", 0, "w", False, True)], "repo string, ord int, tag string, draft boolean, prerelease boolean")
    assert [(r.repo, r.tag) for r in feeds.releases(rows).collect()] == [("r", "v2")]
    registry = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("e", False)], "source string, configured boolean")
    assert sorted(r.source for r in feeds.enabled(registry, spark.createDataFrame([("a", True), ("b", False)], "source string, is_enabled boolean")).collect()) == ["a", "c"]
    raw = spark.createDataFrame([("a", '{"last_id":"x","fetched":3}'), ("b", "broken")], "source string, state string")
    assert sorted((r.source, r.last_id, r.fetched) for r in feeds.collector_state(raw).collect()) == [("a", "x", 3), ("b", None, None)]
    pool = recency.round_robin(spark.createDataFrame([(0, "a", 10), (1, "b", 25), (2, "c", 35)], "ord int, model string, rpm int"))
    assert [r.model for r in pool.orderBy("slot").collect()] == ["a", "b", "b", "c", "c", "c", "c"]


def test_funnel_steps(spark):
    posts = [
        (1, "Join my Telegram for tips", 50), (2, "$AAPL $MSFT $TSLA up", 50), (3, "$AAPL and $AAPL again", 50), (4, "@you $DOGE to the moon, buy now", 50), (5, "@you $DOGE steady", 50),
        (6, "plain words", 1), (5, "@you $DOGE steady", 50), (7, "plain words two", 3), (8, "Copy my trades today", 50), (9, "@you $DOGE his picks keep crushing it", 50), (8, "calm now", 50), (8, "calm again", 50),
    ]
    held = spark.createDataFrame([(i, n, t, k, 0) for n, (i, t, k) in enumerate(posts)], "id long, ord long, text string, likes long, reposts long").withColumn("published_at", at())
    found = [r.dropped for r in S.funnel(held, at()).orderBy("ord").collect()]
    assert found == ["none", "spam", "none", "none", "none", "engagement", "seen", "none", "spam", "spam", "none", "seen"]


def test_digests_of_topics(spark):
    rows = [("2024-01-01", "A", "old", 1, 1), ("2024-01-02", "a", "new", 2, 5), ("2024-01-03", "a", "undated", 3, None), ("2024-01-01", "b", "only", 4, None)]
    held = store.digest_rows(spark.createDataFrame(rows, "date string, topic string, content string, item_count int, generated_at int"))
    pick = lambda date: sorted((r.topic, r.content) for r in store.latest_digests(held, date).collect())
    assert pick("2024-01-01") == [("a", "old"), ("b", "only")] and pick("x") == [("a", "new"), ("b", "only")]
    items = spark.createDataFrame([("A", False, None), ("a", True, "s"), ("c", False, "s")], "topic string, is_duplicate boolean, summary string")
    found = {r.topic: r for r in recency.diagnostics(items, held, 2).collect()}
    assert (found["a"].total, found["a"].duplicates, found["a"].analysed) == (2, 1, 1) and [d.preview for d in found["a"].digests] == ["new", "old"] and found["c"].digests is None


@pytest.mark.parametrize("summary,content,shown", [(None, "c" * 301, "c" * 300 + "…"), ("", "<b>x</b> & y", "x &amp; y"), ("short", "c" * 400, "short")])
def test_letters(spark, summary, content, shown):
    rows = [("ai", 1, 7, "s<1>", "T & t", "https://e.example/?a=1&b='2'", summary, content, None, ["x"] * 7, "2024-01-30 09:05:00")]
    chosen = spark.createDataFrame(rows, "topic string, n int, id long, source string, title string, url string, summary string, content string, sentiment string, tags array<string>, at string").withColumn("published_at", F.col("at").cast("timestamp_ntz"))
    told = spark.createDataFrame([("AI", "**Big** news|||one **x**|||two"), ("none", "h")], "topic string, content string")
    found = {r.topic: r for r in digest.sections(chosen, told).collect()}
    html = found["ai"].html
    assert f"<p>{shown}</p>" in html and "s&lt;1&gt; Jan 30, 09:05 UTC" in html and 'href="https://e.example/?a=1&amp;b=&#x27;2&#x27;"' in html and html.count("<b>x</b>") == 5
    assert "<strong>Big</strong> news" in html and "<li>one <strong>x</strong></li><li>two</li>" in html and "Ai &middot; 1 items" in html
    assert "  • one x\n  • two\n" in found["ai"].text and "No recent items" in found["none"].html and "## NONE (0 items)\nh" == found["none"].text
    [letter] = digest.letter(digest.sections(chosen, told.limit(0)), AT).collect()
    assert "No summary available" in letter.html and letter.text.startswith(f"News Digest — {AT}")


def test_interval_fetch_reads_new_files_only(spark):
    top = new_folder(spark)
    add = lambda rows: spark.createDataFrame(rows, "id long, x string").coalesce(1).write.mode("append").parquet(f"{top}/in")
    run = lambda: flows.fetch_round(flows.watch(spark, f"{top}/in", "id long, x string", maxFilesPerTrigger=1), f"{top}/out", f"{top}/checkpoint")
    add([(1, "a"), (1, "a"), (2, "b")])
    assert run() == [(0, 2)] and run() == []
    add([(2, "again"), (3, "c")])
    add([(3, "c"), (4, "d")])
    assert sorted(k for _, k in run()) == [1, 1] and run() == []
    assert sorted(r.id for r in spark.read.parquet(f"{top}/out").collect()) == [1, 2, 3, 4]


def test_gather_isolates_failures(spark, tmp_path):
    """A source that cannot be planned and one that breaks while it is read leave nothing; the rest comes newest first."""
    rows = spark.createDataFrame([(1, "The house and the garden", "it is what they have", 5), (2, "Das Haus und der Garten", "es ist nicht weit", 7)], "id long, title string, content string, day int")
    held = rows.withColumn("published_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day"))).drop("day")
    sources = {
        "first": lambda: held.where("id = 1"), "second": lambda: held.where("id = 2"), "gone": lambda: spark.read.parquet(f"{tmp_path}/nowhere"),
        "broken": lambda: held.withColumn("id", F.when(F.col("id") > 1, F.raise_error(F.lit("unreadable")).cast("long")).otherwise(F.col("id"))),
    }
    got, wrong = feeds.gather(spark, sources, f"file://{tmp_path}/parts", language)
    assert [(r["id"], r["language"]) for r in got.collect()] == [(2, "de"), (1, "en")] and set(wrong) == {"gone", "broken"}
    with pytest.raises(ValueError):
        feeds.gather(spark, {"gone": sources["gone"]}, f"file://{tmp_path}/none", language)


def test_fetch_caps_feeds_not_sites(spark):
    registry = spark.createDataFrame([("a", "x"), ("b", "y")], "feed string, topic string")
    found = spark.createDataFrame([(f, k, f"{f}{k}", f"u{f}{k}") for f in "abc" for k in range(12)], "feed string, pos int, title string, url string")
    sites = spark.createDataFrame([("s", "x"), ("t", "y")], "feed string, topic string")
    scraped = spark.createDataFrame([(f, k, f"{f}{k}", f"u{f}{k}") for f in "st" for k in range(10)], "feed string, pos int, title string, url string")
    count = lambda *topics: {r["feed"]: r["count"] for r in feeds.fetch(registry, found, sites, scraped, topics).groupBy("feed").count().collect()}
    assert count() == {"a": 8, "b": 8, "s": 10, "t": 10} and count("x") == {"a": 8, "s": 10} and count("z") == {}


def test_upserts_keep_what_a_batch_needs_again(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    put, frame = flows.upserts(path, "id", ["v"], "seq"), lambda *rows: spark.createDataFrame(rows, "id long, v string, seq long")
    for number in range(12):
        put(frame((number % 3, f"v{number}", number), (99, "first", number)), number)
    put(frame((2, "v11", 11), (99, "first", 11)), 11)
    assert flows._versions(spark, path) == [10, 11]
    assert {r["id"]: r["v"] for r in flows.current(spark, path).collect()} == {0: "v9", 1: "v10", 2: "v11", 99: "first"}
