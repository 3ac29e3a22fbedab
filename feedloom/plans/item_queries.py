"""Filters, joins, aggregates, orders and text functions over the item relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import as_of, hours_before, interactions, items, ledger, read, with_
from ..functions import text as T
from ..operators import digest, preference, recency, store
from ..operators import ledger as costs
from ..session import new_folder
from .registry import query

AT = "TIMESTAMP '2024-01-31 00:00:00'"
I, A, L = with_("items"), with_("items", "interactions"), with_("ledger")
DIMS = """dims AS (SELECT id, 'source' AS dimension, lower(source)[1:128] AS value FROM items UNION ALL SELECT id, 'tag', lower(t)[1:128] FROM (SELECT id, unnest(tags) AS t FROM items)
 UNION ALL SELECT id, 'entity', lower(e)[1:128] FROM (SELECT id, unnest(entities) AS e FROM items)),
w AS (SELECT *, CASE action WHEN 'upvote' THEN 5 WHEN 'unupvote' THEN -5 WHEN 'downvote' THEN -8 WHEN 'undownvote' THEN 8 WHEN 'click' THEN 1.5
 WHEN 'read' THEN CASE WHEN read_seconds >= 180 THEN 3 WHEN read_seconds >= 60 THEN 1.5 WHEN read_seconds >= 15 THEN 0.5 ELSE 0 END ELSE 0 END::DOUBLE AS weight FROM interactions)"""
PREFS = "prefs AS (SELECT dimension, value, round(sum(weight), 6) AS score FROM (SELECT item_id AS id, sum(weight) AS weight FROM w GROUP BY 1 HAVING sum(weight) <> 0) x JOIN dims USING (id) GROUP BY 1, 2)"


def dismissed(spark, d):
    return read(spark, d, "documents").where("doc_id % 17 = 0").select(F.col("doc_id").alias("id"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query(I + f"SELECT id, topic, language FROM items WHERE published_at >= {AT} - INTERVAL 72 HOUR AND topic ILIKE 'T1' AND NOT is_duplicate AND language IN ('en', 'fr')")
def f1_recent(spark, d):
    return recency.recent(items(spark, d), as_of(), 72, topic="T1", languages=["en", "fr"]).select("id", "topic", "language")


@query(I + "SELECT id, topic FROM items WHERE topic ILIKE 't_'")
def f2_topic_ilike(spark, d):
    return items(spark, d).where(F.col("topic").ilike("t_")).select("id", "topic")


@query(I + "SELECT id FROM items WHERE source = 'src3' AND language IN ('de', 'en') AND NOT is_duplicate")
def f3_equality_and_list(spark, d):
    return items(spark, d).where((F.col("source") == "src3") & F.col("language").isin("de", "en") & ~F.col("is_duplicate")).select("id")


@query(I + "SELECT id, relevance FROM items WHERE relevance IS NULL OR relevance >= 4.0")
def f4_relevance_gate(spark, d):
    return items(spark, d).where(F.col("relevance").isNull() | (F.col("relevance") >= 4.0)).select("id", "relevance")


@query(I + "SELECT id FROM items WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)")
def f5_not_dismissed(spark, d):
    return items(spark, d).join(dismissed(spark, d), "id", "left_anti").select("id")


@query(I + "SELECT id FROM items WHERE summary IS NULL AND NOT is_duplicate")
def f6_unanalysed(spark, d):
    return recency.unanalysed(items(spark, d)).select("id")


@query(I + "SELECT id, title, source FROM items WHERE id = 42")
def f7_point_lookup(spark, d):
    return items(spark, d).where("id = 42").select("id", "title", "source").limit(1)


@query(I + f"SELECT id, topic, n < 5 AS widened FROM (SELECT *, published_at >= {AT} - INTERVAL 2 HOUR AS inside, count(*) FILTER (published_at >= {AT} - INTERVAL 2 HOUR) OVER (PARTITION BY topic, source) AS n FROM items) WHERE inside OR n < 5")
def f8_widened_window(spark, d):
    held = items(spark, d).withColumn("k", F.concat_ws("|", "topic", "source"))
    return recency.widen(held, as_of(), 2, "k").select("id", "topic", "widened")


@query("SELECT item_id, greatest(CASE WHEN regexp_matches(lower(trim(text)), '^(what|why|how|will|would|could|should|do |does|did|is |are |can |which|who |when|where|might|shall)') OR len(regexp_extract_all(text, '\\S+')) >= 7 THEN 168 ELSE 72 END, 72) AS hours FROM benchmark")
def f9_question_window(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.greatest(F.when(T.is_question("text"), 168).otherwise(72), F.lit(72)).alias("hours"))


@query(I + "SELECT topic, bool_or(source <> topic) AS is_digest_topic FROM items GROUP BY topic")
def f10_digest_topic(spark, d):
    return items(spark, d).groupBy("topic").agg(F.bool_or(F.col("source") != F.col("topic")).alias("is_digest_topic"))


@query(I + "SELECT topic FROM items EXCEPT SELECT source FROM items")
def f11_u3_topics_except_sources(spark, d):
    held = items(spark, d)
    return held.select("topic").subtract(held.select(F.col("source").alias("topic")))


@query("SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')[1] AS first, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM conversations")
def f12_csv_parse(spark, d):
    parts = F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, d, "conversations").select("conv_id", "turn", F.get(parts, F.lit(0)).alias("first"), F.size(parts).cast("long").alias("n"))


@query(I + "SELECT id, length(content) > length(title) + 60 AND NOT starts_with(lower(content), 'http') AND lower(content)[1:80] <> lower(title)[1:80] AS show FROM items")
def f13_show_content(spark, d):
    return items(spark, d).select("id", T.show_content("title", "content").alias("show"))


@query(I + f"SELECT id, NULL::VARCHAR AS summary, NULL::DOUBLE AS relevance FROM items WHERE id NOT IN (SELECT id FROM items WHERE fetched_at < {AT} - INTERVAL 24 HOUR)")
def f15_f16_new_rows_cleared(spark, d):
    stored = items(spark, d).where(F.col("fetched_at") < hours_before(as_of(), 24)).select("id")
    new = items(spark, d).join(stored, "id", "left_anti")
    return new.select("id", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("double").alias("relevance"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query(A + "SELECT a.item_id, i.source, count(*) AS n FROM interactions a JOIN items i ON i.id = a.item_id GROUP BY 1, 2")
def j6_interactions_with_items(spark, d):
    by = interactions(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return by.join(items(spark, d).select("id", "source"), F.col("id") == F.col("item_id")).select("item_id", "source", "n")


@query(I + "SELECT id, coalesce(CASE lower(source) WHEN 'src1' THEN 0.9 WHEN 'src2' THEN 0.7 WHEN 'src3' THEN 0.2 END, 0.55)::DOUBLE AS authority FROM items")
def j8_authority(spark, d):
    weights = spark.createDataFrame([("SRC1", 0.9), ("src2", 0.7), ("Src3", 0.2)], "source string, weight double")
    held = items(spark, d).select("id", "source")
    return held.join(F.broadcast(weights.select(F.lower("source").alias("s"), "weight")), F.lower("source") == F.col("s"), "left").select("id", F.coalesce("weight", F.lit(0.55)).alias("authority"))


@query(I + "SELECT id FROM items WHERE EXISTS (SELECT 1 FROM benchmark WHERE item_id = id)")
def j2_semi(spark, d):
    return items(spark, d).join(read(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi").select("id")


@query("SELECT conv_id, turn, (turn % 3)::BIGINT AS pos, CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS result FROM conversations")
def j11_zip_results(spark, d):
    results = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, result string")
    return read(spark, d, "conversations").withColumn("pos", F.col("turn") % 3).join(F.broadcast(results), "pos", "left").select("conv_id", "turn", "pos", "result")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(I + "SELECT topic, count(*) AS n FROM items WHERE topic <> '' GROUP BY topic UNION ALL SELECT '(all)', count(*) FROM items")
def a1_counts(spark, d):
    held = items(spark, d)
    return held.where("topic <> ''").groupBy("topic").agg(F.count("*").alias("n")).unionByName(held.agg(F.lit("(all)").alias("topic"), F.count("*").alias("n")))


@query(I + f""", g AS (SELECT topic, strftime({AT}, '%Y-%m-%d') AS date, 'text ' || topic || ' ' || day AS content, n AS item_count, day AS generated_at FROM (SELECT topic, date_trunc('day', published_at) AS day, count(*) AS n FROM items GROUP BY 1, 2)),
l AS (SELECT topic, string_agg(strftime(generated_at, '%Y-%m-%d') || ' ' || item_count, ', ' ORDER BY generated_at DESC) AS digests FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY generated_at DESC) AS k FROM g) WHERE k <= 5 GROUP BY 1)
SELECT topic, total, duplicates, analysed, digests FROM (SELECT topic, count(*) AS total, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (summary IS NOT NULL) AS analysed FROM items GROUP BY topic) JOIN l USING (topic)""")
def a2_topic_diagnostics(spark, d):
    """Counts and the last five digests of each topic; a digest a day."""
    held = items(spark, d)
    days = held.groupBy("topic", F.date_trunc("day", "published_at").alias("generated_at")).agg(F.count("*").alias("item_count"))
    digests = days.select("topic", F.date_format("generated_at", "yyyy-MM-dd").alias("date"), F.concat_ws(" ", F.lit("text"), "topic").alias("content"), "item_count", "generated_at")
    found = recency.diagnostics(held, store.digest_rows(digests))
    line = F.transform("digests", lambda x: F.concat_ws(" ", x["date"], x["item_count"].cast("string")))
    return found.select("topic", "total", "duplicates", "analysed", F.array_join(line, ", ").alias("digests"))


@query(I + "SELECT source, count(*) AS n FROM items WHERE NOT is_duplicate GROUP BY source")
def a3_per_source(spark, d):
    return items(spark, d).where("NOT is_duplicate").groupBy("source").agg(F.count("*").alias("n"))


@query(I + "SELECT DISTINCT topic FROM items")
def a4_topics(spark, d):
    return items(spark, d).select("topic").distinct()


@query(A + ", " + DIMS + ", " + PREFS + " SELECT * FROM prefs")
def a5_preference_scores(spark, d):
    return preference.scores(interactions(spark, d), items(spark, d))


@query(A + ", " + DIMS + """, j AS (SELECT item_id AS id, weight * ((SELECT count(*) FROM w) - row_number() OVER (ORDER BY created_at, seq) + 1) AS weight FROM w)
SELECT dimension, value, round(sum(weight), 6) AS score FROM (SELECT id, sum(weight) AS weight FROM j GROUP BY 1) x JOIN dims USING (id) GROUP BY 1, 2""")
def a6_preference_replay(spark, d):
    return preference.replayed(interactions(spark, d), items(spark, d))


@query(L + "SELECT model, caller, count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 6) AS cost, count(*) FILTER (cost_usd IS NULL) AS unknown, count(*) FILTER (NOT success) AS errors FROM ledger GROUP BY GROUPING SETS ((), (model), (caller))")
def a7_ledger_summary(spark, d):
    return costs.summary(ledger(spark, d))


@query(L + "SELECT model, l[round_even(0.5::DOUBLE * (len(l) - 1), 0)::INT + 1] AS p50, l[round_even(0.95::DOUBLE * (len(l) - 1), 0)::INT + 1] AS p95, l[round_even(0.99::DOUBLE * (len(l) - 1), 0)::INT + 1] AS p99, l[len(l)] AS max FROM (SELECT model, list(latency_ms ORDER BY latency_ms) AS l FROM ledger WHERE success GROUP BY model)")
def a8_nearest_rank(spark, d):
    return costs.latencies(ledger(spark, d))


@query(L + "SELECT model, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(median(latency_ms), 6) AS p50, round(avg(latency_ms), 6) AS mean FROM ledger GROUP BY model")
def a9_a10_linear_percentile(spark, d):
    return ledger(spark, d).groupBy("model").agg(F.round(F.percentile("latency_ms", 0.95), 6).alias("p95"), F.round(F.median("latency_ms"), 6).alias("p50"), F.round(F.avg("latency_ms"), 6).alias("mean"))


@query(I + "SELECT id, round(raw_score / max(raw_score) OVER (PARTITION BY source), 6) AS share FROM items")
def a11_share_of_best(spark, d):
    held = recency.with_totals(items(spark, d).select("id", "source", "raw_score"), "source", best=F.max("raw_score"))
    return held.select("id", F.round(F.col("raw_score") / F.col("best"), 6).alias("share"))


@query("SELECT bucket, status, n FROM (SELECT lang AS bucket, CASE max(CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 1 ELSE 0 END) WHEN 3 THEN 'partial' WHEN 2 THEN 'fallback' WHEN 1 THEN 'not_needed' ELSE 'measured' END AS status, count(*) AS n FROM documents GROUP BY lang)")
def a13_t33_status_precedence(spark, d):
    code = F.when(F.col("source") == "src0", 3).when(F.col("source") == "src1", 2).when(F.col("source") == "src2", 1).otherwise(0)
    by = read(spark, d, "documents").groupBy(F.col("lang").alias("bucket")).agg(F.max(code).alias("c"), F.count("*").alias("n"))
    return by.select("bucket", F.when(F.col("c") == 3, "partial").when(F.col("c") == 2, "fallback").when(F.col("c") == 1, "not_needed").otherwise("measured").alias("status"), "n")


@query(I + f"SELECT count(*) AS fetched, count(DISTINCT source) AS sources, date_diff('hour', min(fetched_at), max(fetched_at)) AS hours, count(*) FILTER (NOT is_duplicate) AS uniques FROM items")
def a15_a16_fetch_summary(spark, d):
    return items(spark, d).agg(F.count("*").alias("fetched"), F.count_distinct("source").alias("sources"), F.timestamp_diff("HOUR", F.min("fetched_at"), F.max("fetched_at")).alias("hours"), F.count_if(~F.col("is_duplicate")).alias("uniques"))


@query(I + ", t AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', title, content)), '[\\p{L}\\p{N}]+')) AS term FROM items) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY term")
def a17_corpus_terms(spark, d):
    from ..operators.retrieval import postings

    return postings(items(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# --- text ------------------------------------------------------------------------------------------------------------


@query(I + "SELECT id, sha256(source || ':' || url)[1:16] AS item_id FROM items")
def t1_item_id(spark, d):
    return items(spark, d).select("id", T.item_id("source", "url").alias("item_id"))


_TRACK = "', '".join(T.TRACKING)
_PAIRS = f"list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '^[^?]*\\?(.*)$', 1), '&'), lambda p: instr(p, '=') > 0 AND NOT ends_with(p, '=') AND lower(split_part(p, '=', 1)) NOT IN ('{_TRACK}'))"


@query(f"WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '#.*$', ''), '^([^?]*)', 1) AS stem, array_to_string({_PAIRS}, '&') AS rest FROM pages) SELECT page_id, lower(regexp_replace(CASE WHEN rest = '' THEN stem ELSE stem || '?' || rest END, '/+$', '')) AS url FROM p")
def t2_normalize_url(spark, d):
    return read(spark, d, "pages").select("page_id", T.normalize_url("url").alias("url"))


@query(I + "SELECT id, regexp_replace(lower(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '\\s+-\\s+[\\p{L}\\p{N}_][^-]{0,40}$', '')), '[^a-z0-9]', '', 'g')[1:80] AS key FROM items")
def t3_title_key(spark, d):
    return items(spark, d).select("id", T.title_key("title").alias("key"))


@query(I + "SELECT id, round(length(content) * 0.001::DOUBLE + CASE WHEN coalesce(summary, '') <> '' THEN 2 ELSE 0 END + raw_score * 0.5::DOUBLE, 6) AS detail FROM items")
def t4_detail_score(spark, d):
    return items(spark, d).select("id", F.round(T.detail_score("content", "summary", "raw_score"), 6).alias("detail"))


_HTML = "replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({_HTML}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def t5_strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_html("html").alias("body"))


@query("SELECT item_id, CASE WHEN len(w) = 0 THEN '\"\"' ELSE array_to_string(list_transform(w, lambda x: '\"' || x || '\"'), ' ') END AS escaped FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM benchmark)")
def t8_fts_escape(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.fts_escape("text").alias("escaped"))


_Q = "(ends_with(trim(text), '?') OR regexp_matches(lower(trim(text)), '^(what|why|how|will|would|could|should|do |does|did|is |are |can |which|who |when|where|might|shall)') OR len(regexp_extract_all(trim(text), '\\S+')) >= 7)"
_ASKED = "(SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\\S+')[1:turn * 2 + 1], ' ') || CASE WHEN conv_id % 3 = 0 THEN '?' ELSE '' END AS text FROM conversations)"


@query(f"SELECT conv_id, turn, {_Q} AS question, {_Q} OR len(regexp_extract_all(text, '\\S+')) >= 3 AS expand FROM {_ASKED}")
def t9_t10_question(spark, d):
    """First words of turns, with a question mark on some."""
    few = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, (F.col("turn") * 2 + 1).cast("int")), " ")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat(few, F.when(F.col("conv_id") % 3 == 0, "?").otherwise("")).alias("text"))
    return rows.select("conv_id", "turn", T.is_question("text").alias("question"), T.wants_expansion("text").alias("expand"))


@query(I + "SELECT id, round(CASE WHEN hi <= lo THEN 0.5 ELSE least(1.0, greatest(0.0, (raw_score - lo) / (hi - lo))) END, 6)::DOUBLE AS n FROM (SELECT id, raw_score, min(raw_score) OVER (PARTITION BY source, topic) AS lo, max(raw_score) OVER (PARTITION BY source, topic) AS hi FROM items)")
def t11_minmax(spark, d):
    held = recency.with_totals(items(spark, d).select("id", "source", "topic", "raw_score"), "source", "topic", lo=F.min("raw_score"), hi=F.max("raw_score"))
    return held.select("id", F.round(T.minmax("raw_score", F.col("lo"), F.col("hi"), 0.5), 6).alias("n"))


@query(I + f"SELECT id, round(exp(-greatest(0, date_diff('second', published_at, {AT}) / 3600.0::DOUBLE) / 48), 6) AS freshness FROM items")
def t12_freshness(spark, d):
    return items(spark, d).select("id", F.round(T.freshness("published_at", as_of()), 6).alias("freshness"))


@query(L + "SELECT seq, round(2 / (1 + exp(-0.3::DOUBLE * (latency_ms / 10 - 5))) - 1, 6) AS boost FROM ledger")
def t13_sigmoid(spark, d):
    return ledger(spark, d).select("seq", F.round(T.sigmoid_boost(F.col("latency_ms") / 10 - 5, 0.3), 6).alias("boost"))


@query(A + ", " + DIMS + " SELECT seq, weight FROM w")
def t14_interaction_weight(spark, d):
    return preference.weighted(interactions(spark, d)).select("seq", "weight")


def digest_sql(column: str) -> str:
    """A digest's parts in SQL: the headline first."""
    ws = "'^\\s+|\\s+$', '', 'g'"
    return f"CASE WHEN contains({column}, '|||') THEN string_split({column}, '|||')[1:1] || list_filter(string_split({column}, '|||')[2:], lambda p: regexp_replace(p, {ws}) <> '') ELSE list_filter(list_transform(string_split({column}, chr(10)), lambda p: regexp_replace(p, {ws})), lambda p: p <> '') END"


@query(I + f""", c AS (SELECT id, CASE WHEN id % 3 = 0 THEN replace(content, ' ', '|||') WHEN id % 3 = 1 THEN replace(content, ' ', ' ' || chr(10)) ELSE content END AS content FROM items), p AS (SELECT id, {digest_sql("content")} AS parts FROM c)
SELECT id, parts[1] AS headline, CASE WHEN len(parts) > 0 THEN len(parts) - 1 END AS bullets, CASE WHEN len(parts) > 0 THEN coalesce(array_to_string(parts[2:], chr(10)), '') END AS body FROM p""")
def t16_digest_parse(spark, d):
    """Contents as they are, with their blanks as separators, and as lines."""
    kind, blank = F.col("id") % 3, F.lit(" ")
    text = F.when(kind == 0, F.replace("content", blank, F.lit("|||"))).when(kind == 1, F.replace("content", blank, F.lit(" \n"))).otherwise(F.col("content"))
    held = items(spark, d).withColumn("x", T.parse_digest(text))
    x = F.col("x")
    return held.select("id", x["headline"].alias("headline"), F.when(x.isNotNull(), F.size(x["bullets"])).cast("long").alias("bullets"), F.array_join(x["bullets"], "\n").alias("body"))


@query(I + r"""SELECT id, regexp_replace(replace(replace(replace(replace(replace('**' || title || '** <i> & ' || source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g') AS html FROM items""")
def t17_bold(spark, d):
    return items(spark, d).select("id", T.bold(F.concat(F.lit("**"), "title", F.lit("** <i> & "), "source")).alias("html"))


@query("SELECT DISTINCT p_name AS topic, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def t18_slug(spark, d):
    return read(spark, d, "part").select(F.col("p_name").alias("topic"), T.slug("p_name").alias("slug")).distinct()


@query(I + "SELECT id, title || ' ' || content[1:200] AS t FROM items")
def t19_embed_text(spark, d):
    return items(spark, d).select("id", T.embed_text("title", "content").alias("t"))


@query(I + """SELECT id, CASE id % 3 WHEN 2 THEN NULL ELSE '[{"summary":' || id || '}]' END AS body FROM items""")
def t21_fenced_json(spark, d):
    """Answers in a code fence, bare, or in words."""
    body, kind = F.concat(F.lit('[{"summary":'), "id", F.lit("}]")), F.col("id") % 3
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, body).otherwise(F.concat(F.lit("sorry "), "id"))
    return items(spark, d).select("id", T.fenced_json(text).alias("body"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def t22_json_object(spark, d):
    body = T.json_object(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    return read(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").cast("long").alias("k"))


@query("SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'https://example.com/articles/' || page_id ELSE url END AS target FROM pages")
def t6_news_target(spark, d):
    """Links that hold an address between other bytes, bare links, and other hosts' articles."""
    packed = F.translate(F.base64(F.concat(F.unhex(F.lit("081322")), F.char(F.least(F.lit(127), F.length("url"))).cast("binary"), F.col("url").cast("binary"), F.unhex(F.lit("0001")))), "+/=\r\n", "-_")
    kind = F.col("page_id") % 3
    link = F.when(kind == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), packed, F.lit("?oc=5"))).when(kind == 1, F.col("url")).otherwise(F.concat(F.lit("https://example.com/articles/"), "page_id"))
    return read(spark, d, "pages").select("page_id", T.news_target(link).alias("target"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value)::BIGINT END AS prompt_tokens, 0::BIGINT AS completion_tokens, CASE WHEN event_type = 'error' THEN 0 ELSE coalesce(user_id, 0) END::BIGINT AS total_tokens FROM events")
def t26_usage_default(spark, d):
    usage = F.struct(F.floor("value").alias("prompt_tokens"), F.col("event_type").alias("completion_tokens"), F.col("user_id").alias("total_tokens"))
    held = read(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.to_json(F.struct(usage.alias("usage")))).alias("response"))
    return held.select("event_id", *T.usage("response"))


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')[1:12]) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+')[1:12], 1) AS n FROM documents),
f AS (SELECT doc_id, arg_min(w, n) AS w, min(n) AS n FROM p GROUP BY doc_id, lower(w)), g AS (SELECT doc_id, string_agg(w, ',' ORDER BY n) AS topics FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(topics, '') END AS topics FROM documents LEFT JOIN g USING (doc_id)""")
def t27_csv_distinct(spark, d):
    """First words of texts as a setting, with empty parts; `All` on some."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 12)
    text = F.when(F.col("doc_id") % 10 == 0, " All ").otherwise(F.concat(F.lit(" , "), F.array_join(words, " , "), F.lit(",,")))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.csv_list(text), ",").alias("topics"))


@query(I + "SELECT id, trim(lower(title))[1:80] AS key FROM items")
def t28_search_title_key(spark, d):
    return items(spark, d).select("id", T.search_title_key("title").alias("key"))


@query(I + f"SELECT id, coalesce(summary, content[1:300]) AS text, summary IS NULL AND length(content) > 300 AS cut, array_to_string(tags[1:5], ',') AS tags, strftime(published_at, '%Y-%m-%d') AS day FROM items")
def t31_card(spark, d):
    return digest.card(items(spark, d))


@query(L + "SELECT seq, CASE WHEN seq % 11 = 0 THEN 0 ELSE floor(latency_ms) END::DOUBLE AS ms, CASE WHEN seq % 13 = 0 THEN 0 ELSE round((seq / 8.0::DOUBLE + floor(latency_ms) / 1024 - seq / 8.0::DOUBLE) * 1000, 6) END::DOUBLE AS of_seconds FROM ledger")
def t25_latency(spark, d):
    """Between two times, and between two numbers of seconds; ends are missing now and then."""
    end = F.timestamp_add("MILLISECOND", F.floor("latency_ms").cast("int"), F.col("ts"))
    start, after = F.col("seq") / 8.0, F.col("seq") / 8.0 + F.floor("latency_ms") / 1024
    times = costs.latency_ms(F.col("ts"), F.when(F.col("seq") % 11 != 0, end))
    return ledger(spark, d).select("seq", times.alias("ms"), F.round(costs.latency_ms(start, F.when(F.col("seq") % 13 != 0, after), seconds=True), 6).alias("of_seconds"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP), TIMESTAMP '2024-01-31 00:00:00')::VARCHAR AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def t23_parse_or_now(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    at = T.instant(text, as_of())
    return read(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- orders, caps, sets ------------------------------------------------------------------------------------------------


@query(I + "SELECT id, n FROM (SELECT id, row_number() OVER (ORDER BY fetched_at DESC, relevance DESC NULLS LAST, raw_score DESC, published_at DESC, id) AS n FROM items WHERE published_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR AND NOT is_duplicate) WHERE n <= 50")
def o1_recent_order(spark, d):
    top = recency.recent(items(spark, d), as_of(), 168, limit=50)
    return top.select("id", F.row_number().over(Window.orderBy(*recency.recent_order())).cast("long").alias("n"))


@query(I + "SELECT id FROM items WHERE summary IS NULL AND NOT is_duplicate ORDER BY fetched_at DESC, published_at DESC, id LIMIT 30")
def o2_unanalysed_order(spark, d):
    return recency.unanalysed(items(spark, d), 30).select("id")


@query(I + "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) AS n FROM items) WHERE n <= 8")
def o4_s4_cap_per_source(spark, d):
    return recency.cap_per(items(spark, d), "source", 8, F.desc("published_at"), F.asc("id")).select("id", "source")


@query(I + "SELECT id, topic, ((row_number() OVER (PARTITION BY topic ORDER BY id) - 1) // 15)::INT AS batch FROM items")
def o5_o6_batches(spark, d):
    return recency.batches(items(spark, d), "topic", 15, "id").select("id", "topic", "batch")


@query("SELECT n_name AS topic, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey DESC) AS n FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE n = 1")
def o7_exact_else_latest(spark, d):
    """Customers as digests of their nations, their segments as dates."""
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    held = rows.select(F.col("n_name").alias("topic"), F.col("c_mktsegment").alias("date"), F.struct("c_acctbal", "c_custkey").alias("generated_at"), F.col("c_custkey").alias("id"))
    return store.latest_digests(held, "BUILDING").select("topic", "id")


@query(I + "SELECT topic, n > 2 * k AND n - k > 20 AS stale FROM (SELECT topic, count(*) AS n, count(*) FILTER (id % 3 = 0) AS k FROM items GROUP BY topic)")
def o8_stale(spark, d):
    by = items(spark, d).groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 3 == 0).alias("k"))
    return by.select("topic", recency.stale(F.col("k"), F.col("n")).alias("stale"))


@query(A + "SELECT item_id, vote FROM (SELECT item_id, arg_max(action, (created_at, seq)) AS vote FROM interactions WHERE action IN ('upvote', 'unupvote', 'downvote', 'undownvote') GROUP BY 1) WHERE vote IN ('upvote', 'downvote')")
def o9_active_votes(spark, d):
    return preference.active_votes(interactions(spark, d))


@query("SELECT (row_number() OVER (ORDER BY ord, copy) - 1)::INT AS slot, model FROM (SELECT n_nationkey AS ord, n_name AS model, unnest(range(1, greatest(1, round_even((n_regionkey * 15 + 10) / 10.0, 0)::INT) + 1)) AS copy FROM nation)")
def o10_round_robin(spark, d):
    models = read(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("model"), (F.col("n_regionkey") * 15 + 10).alias("rpm"))
    return recency.round_robin(models)


@query(I + """, p AS (SELECT row_number() OVER (ORDER BY ord, copy) - 1 AS slot, model, count(*) OVER () AS n FROM (SELECT n_nationkey AS ord, n_name AS model, unnest(range(1, greatest(1, round_even((n_regionkey * 15 + 10) / 10.0, 0)::INT) + 1)) AS copy FROM nation)),
b AS (SELECT id, topic, ((row_number() OVER (PARTITION BY topic ORDER BY id) - 1) // 15)::INT AS batch FROM items) SELECT id, topic, batch, model FROM b JOIN p ON batch % n = slot""")
def o10_batches_to_models(spark, d):
    return recency.deal(recency.batches(items(spark, d), "topic", 15, "id"), o10_round_robin(spark, d)).select("id", "topic", "batch", "model")


@query(L + "SELECT seq, model FROM ledger ORDER BY seq DESC LIMIT 100")
def o11_ring(spark, d):
    return costs.ring(ledger(spark, d), 100).select("seq", "model")


@query(L + f"SELECT caller, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM ledger WHERE ts >= {AT} - INTERVAL 72 HOUR GROUP BY caller")
def o12_rolling(spark, d):
    return costs.rolling(ledger(spark, d), hours_before(as_of(), 72)).groupBy("caller").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query(I + "SELECT id, 'a' AS part FROM items WHERE id % 2 = 0 UNION ALL SELECT id, 'b' FROM items WHERE id % 3 = 0")
def u1_union_all(spark, d):
    held = items(spark, d)
    return held.where("id % 2 = 0").select("id", F.lit("a").alias("part")).unionByName(held.where("id % 3 = 0").select("id", F.lit("b").alias("part")))


@query(I + "SELECT source, min(id) AS first FROM items GROUP BY source")
def u2_first_seen(spark, d):
    return recency.first_seen(items(spark, d), "source", "id").select("source", F.col("id").alias("first"))


@query("SELECT count(*) FILTER (x AND y) AS both, count(*) AS either FROM (SELECT doc_id % 2 = 0 AS x, doc_id % 3 = 0 AS y FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)")
def u4_intersect_union(spark, d):
    held = read(spark, d, "documents").select("doc_id")
    a, b = held.where("doc_id % 2 = 0"), held.where("doc_id % 3 = 0")
    return a.intersect(b).agg(F.count("*").alias("both")).join(a.union(b).distinct().agg(F.count("*").alias("either")))


# --- digests, sinks --------------------------------------------------------------------------------------------------


_SEL = """, s AS (SELECT *, coalesce(nullif(relevance, 0), nullif(raw_score, 0), 0) AS strength, coalesce(relevance >= 5, false) AS ok FROM items WHERE NOT is_duplicate),
t AS (SELECT *, bool_or(ok) OVER (PARTITION BY topic) AS anyok FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY strength DESC, id) AS n FROM t WHERE ok OR NOT anyok)"""


@query(I + _SEL + " SELECT topic, n, id FROM n WHERE n <= 20")
def r20_r21_digest_selection(spark, d):
    return digest.select_items(items(spark, d)).select("topic", "n", "id")


@query(I + _SEL + " SELECT topic, string_agg('[' || n || '] ' || title || chr(10) || 'Source: ' || source || chr(10) || coalesce(summary, content)[1:300], chr(10) || chr(10) ORDER BY n) AS block FROM n WHERE n <= 20 GROUP BY topic")
def t20_evidence(spark, d):
    return digest.evidence(digest.select_items(items(spark, d)))


_PROMPT = """json_object('index', index, 'title', title, 'content', content[1:500], 'source', source)::VARCHAR"""


@query(I + f""", b AS (SELECT *, ('0x' || md5(id::VARCHAR)[1:4])::INT % 64 AS bucket FROM items), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) - 1 AS n FROM b),
p AS (SELECT *, n // 15 AS batch, n % 15 AS index FROM n) SELECT bucket, batch, '[' || string_agg({_PROMPT}, ',' ORDER BY index) || ']' AS payload, count(*) AS n FROM p GROUP BY bucket, batch""")
def t30_prompt_rows(spark, d):
    return digest.prompt_rows(items(spark, d))


_OLD = ", o AS (SELECT id, title, source, topic, raw_score FROM items WHERE id % 3 <> 0), n AS (SELECT id, '!' || title AS title, source || '!' AS source, topic, raw_score + 1 AS raw_score FROM items WHERE id % 2 = 0)"


@query(I + _OLD + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.source ELSE o.source END AS source, CASE WHEN o.id IS NOT NULL THEN o.topic ELSE n.topic END AS topic, CASE WHEN n.id IS NOT NULL THEN n.raw_score ELSE o.raw_score END AS raw_score FROM o FULL JOIN n ON o.id = n.id")
def k1_upsert(spark, d):
    held = items(spark, d).select("id", "title", "source", "topic", "raw_score")
    new = held.where("id % 2 = 0").select("id", F.concat(F.lit("!"), "title").alias("title"), F.concat("source", F.lit("!")).alias("source"), "topic", (F.col("raw_score") + 1).alias("raw_score"))
    return store.merge(held.where("id % 3 <> 0"), new, "id", ["source", "raw_score"])


@query(I + "SELECT id, CASE WHEN id % 2 = 0 AND title <> '' AND id % 4 = 0 THEN title ELSE summary END AS summary, CASE WHEN id % 4 = 0 THEN 7.5 ELSE relevance END::DOUBLE AS relevance FROM items")
def k3_analysis_update(spark, d):
    held = items(spark, d).select("id", "summary", "relevance")
    new = items(spark, d).where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("title")).alias("summary"), F.lit(7.5).alias("relevance"))
    return store.set_where(held, new, "id", ["summary", "relevance"], "summary")


@query(I + "SELECT id, CASE WHEN id % 5 = 0 THEN url || '?fixed' ELSE url END AS url, is_duplicate OR id % 5 = 0 AS is_duplicate FROM items")
def k4_patch(spark, d):
    held = items(spark, d).select("id", "url", "is_duplicate")
    new = held.where("id % 5 = 0").select("id", F.concat("url", F.lit("?fixed")).alias("url"), F.lit(True).alias("is_duplicate"))
    return store.set_where(held, new, "id", ["url", "is_duplicate"], "url")


@query(I + f"SELECT id FROM items WHERE fetched_at >= {AT} - INTERVAL 24 HOUR")
def k5_prune(spark, d):
    return store.prune(items(spark, d), hours_before(as_of(), 24)).select("id")


@query(I + "SELECT 'items' AS relation, count(*) AS cleared, 0::BIGINT AS left_over FROM items UNION ALL SELECT 'digests', count(DISTINCT topic), 0 FROM items")
def k6_clear(spark, d):
    at, held = new_folder(spark), items(spark, d)
    paths = {"items": f"{at}/items", "digests": f"{at}/digests"}
    held.write.parquet(paths["items"])
    held.groupBy("topic").agg(F.count("*").alias("item_count")).write.parquet(paths["digests"])
    cleared = store.clear(spark, paths)
    left = [spark.read.parquet(p).agg(F.lit(name).alias("relation"), F.count("*").alias("left_over")) for name, p in paths.items()]
    return cleared.join(left[0].unionByName(left[1]), "relation")


_DIGESTS = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, lower(o_orderpriority) AS topic, count(*) AS item_count FROM orders WHERE o_orderstatus {} 'F' GROUP BY 1, 2"


@query(f"SELECT date || '_' || topic AS id, date, topic, CASE WHEN n.date IS NULL THEN 'old' ELSE 'new' END AS content, coalesce(n.item_count, o.item_count) AS item_count FROM ({_DIGESTS.format('=')}) o FULL JOIN ({_DIGESTS.format('<>')}) n USING (date, topic)")
def k7_digest_upsert(spark, d):
    orders = read(spark, d, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    rows = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("topic"), "done").agg(F.count("*").alias("item_count"), F.max("o_orderdate").alias("generated_at"))
    old, new = (rows.where(F.col("done") == x).select("date", "topic", F.lit(c).alias("content"), "item_count", "generated_at") for x, c in ((True, "old"), (False, "new")))
    held = store.put_digests(store.digest_rows(old), new)
    return held.select("id", "date", "topic", "content", "item_count")


@query("SELECT 'k' || coalesce(s_suppkey, c_custkey) AS key, coalesce(c_name, s_name) AS value FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def k8_settings(spark, d):
    at = as_of()
    old = read(spark, d, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("key"), F.col("s_name").alias("value"), at.alias("updated_at"))
    new = read(spark, d, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("key"), F.col("c_name").alias("value"), at.alias("updated_at"))
    return store.put_settings(old, new).select("key", "value")


@query("SELECT source, (10 * (doc0 + 0) + n)::BIGINT AS items_fetched, last_error FROM (SELECT source, 1 AS doc0, sum(doc_id % 3) AS n, arg_max(CASE WHEN doc_id % 4 = 0 THEN 'e' || doc_id END, CASE WHEN doc_id % 4 = 0 THEN doc_id END) AS last_error FROM documents GROUP BY source)")
def k9_collector_state(spark, d):
    docs = read(spark, d, "documents")
    old = docs.select("source").distinct().select("source", F.lit(10).cast("long").alias("items_fetched"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp_ntz").alias("last_run"))
    runs = docs.select("source", F.col("doc_id").alias("seq"), (F.col("doc_id") % 3).alias("items_fetched"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("e"), "doc_id")).alias("last_error"), F.lit(None).cast("timestamp_ntz").alias("last_run"))
    return store.accumulate_state(old, runs).select("source", "items_fetched", "last_error")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'old' ELSE 'new' END AS source FROM documents WHERE (doc_id % 17 = 0 OR doc_id % 34 = 1) AND doc_id % 3 <> 0")
def k10_tombstones(spark, d):
    """Some are there already and stay as they are; every third is taken back."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    new = docs.where("id % 34 IN (0, 1)").withColumn("source", F.lit("new"))
    held = store.add_tombstones(dismissed(spark, d).withColumn("source", F.lit("old")), new.union(new))
    return store.drop_tombstones(held, docs.where("id % 3 = 0"))


@query(I + "SELECT topic, string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY n) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY coalesce(relevance, 0) DESC, id) AS n FROM items WHERE topic IN ('t1', 't2') AND NOT is_duplicate) WHERE n <= 20 GROUP BY topic")
def k12_markdown(spark, d):
    return store.export_markdown(items(spark, d), ["t1", "t2"])


@query(I + "SELECT id, '{\"id\":' || id || ',\"title\":' || to_json(title) || ',\"source\":' || to_json(source) || CASE WHEN relevance IS NULL THEN '' ELSE ',\"relevance\":' || relevance END || '}' AS json FROM items")
def k11_json(spark, d):
    at = f"{new_folder(spark)}/json"
    store.write_json(items(spark, d), at)
    line = F.col("value")
    return spark.read.text(at).select(F.get_json_object(line, "$.id").cast("long").alias("id"), line.alias("json"))


@query("SELECT o_custkey % 10 AS keyword, o_orderkey AS seq, coalesce(date_diff('second', lag(o_orderdate) OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate, o_orderkey), o_orderdate) >= 300, true) AS admitted FROM orders")
def s14_cooldown(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 10).cast("string").alias("keyword"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.lit(False).alias("force"))
    return recency.cooldown(rows).select(F.col("keyword").cast("long").alias("keyword"), "seq", "admitted")
