"""Indexes that grow, models behind providers, and flows with state."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import AS_OF, as_of, hours_before, interactions, items, read, with_
from ..functions import spam as S
from ..operators import analysis, digest, preference, research
from ..operators import retrieval as R
from ..operators.keyword_index import KeywordIndex
from ..operators.vector_index import VectorIndex
from ..providers import Providers, overlap_score, spam_flag
from ..session import new_folder
from .indexes import bm25_sql, indexed
from .item_queries import _SEL, DIMS, digest_sql
from .registry import query
from .search_queries import _AUTH, _flow, authority

I = with_("items")
AT = "TIMESTAMP '2024-01-31 00:00:00'"
NOW = datetime.fromisoformat(AS_OF)

# --- the keyword index ---------------------------------------------------------------------------------------------------

_LIVE = I.replace("items AS (", "every AS (", 1) + ", items AS (SELECT * FROM every WHERE NOT is_duplicate)"
_SEARCHES = {"all words": "this from", "phrase": "of_the", "inflected": "things thing", "none": "thewordthatnotextholds", "empty": "?"}


@query(_LIVE + ", " + ", ".join(bm25_sql(q, 40, f"x{i}") for i, q in enumerate(_SEARCHES.values()) if q != "?") + " " + " UNION ALL ".join(f"SELECT '{n}' AS query, id, score, rank FROM x{i}" for i, (n, q) in enumerate(_SEARCHES.items()) if q != "?"))
def r1_k2_j5_growing_index(spark, d):
    """The index after a first build, late arrivals, items changed and changed back, removals and compaction; words and phrases."""
    held = items(spark, d)
    index = KeywordIndex(spark, new_folder(spark), buckets=32, spread=2)
    index.build(held.where(F.col("published_at") < hours_before(as_of(), 120)))
    index.append(held)
    index.upsert(held.where("topic = 't2'").withColumn("content", F.lit("this is from another text of the index")))
    index.delete(held.where("is_duplicate").select("id"))
    index.upsert(held.where("topic = 't2' AND NOT is_duplicate"))
    index.compact()
    return index.search_many(_SEARCHES, 40)


_QUESTIONS = {"long": "this from that with are which", "short": "this from", "none": "?"}


def _research_sql(mode: research.Mode, limit: int = 200) -> str:
    """The loop unrolled: a question, its first three words, its last three; what is found earlier comes first."""
    parts, out = [], []
    for name, text in _QUESTIONS.items():
        turns = [text, *research.first_and_last_words(text, [text]).queries]
        turns = list(dict.fromkeys(turns))[: 1 + mode.branches] if text != "?" else []
        for n, q in enumerate(turns):
            tag = f"{name}{n}"
            parts.append(bm25_sql(q, 1 << 40, tag))
            out.append(f"SELECT '{name}' AS question, id, {n} AS n, row_number() OVER (ORDER BY {tag}.exact, published_at DESC, id) AS place FROM {tag} JOIN items USING (id) WHERE published_at >= {AT} - INTERVAL {limit} HOUR AND NOT is_duplicate")
    found = " UNION ALL ".join(out)
    return f"""{I}, {", ".join(parts)}, f AS (SELECT question, id, min((n, place)) AS p FROM ({found}) WHERE place <= {mode.per_query} GROUP BY 1, 2),
g AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY p) - 1 AS rank FROM f) SELECT question, id, rank FROM g WHERE rank < {mode.final}"""


@query(_research_sql(research.MODES["balanced"]))
def r14_balanced_loop(spark, d):
    return research.research(indexed(spark, d), items(spark, d), _QUESTIONS, hours_before(as_of(), 200), "balanced")


@query(_research_sql(research.MODES["deep"]))
def r14_deep_loop(spark, d):
    return research.research(indexed(spark, d), items(spark, d), _QUESTIONS, hours_before(as_of(), 200), "deep")


@query("""WITH e AS (SELECT conv_id AS question, role AS name, count(*) AS items, count(DISTINCT turn) AS queries FROM conversations GROUP BY 1, 2),
s AS (SELECT *, least(5, greatest(1, 1 + least(3, items // 4) + least(1, greatest(0, queries - 1))))::INT AS score FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, items DESC, name DESC) AS n FROM s),
w AS (SELECT question, CASE WHEN max(score) FILTER (n = 1) = max(score) FILTER (n = 2) AND max(items) FILTER (n = 1) = max(items) FILTER (n = 2) THEN 'tie' ELSE max(name) FILTER (n = 1) END AS winner FROM r GROUP BY 1)
SELECT question, name, score, winner FROM s JOIN w USING (question)""")
def r16_a13_judge_winner(spark, d):
    by = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("question"), F.col("role").alias("name")).agg(F.count("*").alias("items"), F.count_distinct("turn").alias("queries"))
    return research.judged(by, ["user", "assistant", "system"])


# --- the vector index ----------------------------------------------------------------------------------------------------

#: Hours after the first look, and how many new items may be appended.
_LOOKS, _MOST = (0.0, 0.1, 1.0, 1.05, 24.0), 50


def _looks_sql() -> str:
    at = [f"({AT} - INTERVAL 24 HOUR + INTERVAL {round(h * 60)} MINUTE)" for h in _LOOKS]
    out = [f"i0 AS MATERIALIZED (SELECT id FROM items WHERE NOT is_duplicate AND published_at BETWEEN {at[0]} - INTERVAL 7 DAY AND {at[0]})", "s0 AS (SELECT 'rebuilt' AS state)"]
    checked = 0.0
    for i in range(1, len(_LOOKS)):
        if (_LOOKS[i] - checked) * 3600 < 600:
            out += [f"i{i} AS (FROM i{i - 1})", f"s{i} AS (SELECT 'fresh' AS state)"]
            continue
        checked = _LOOKS[i]
        out += [
            f"w{i} AS (SELECT id FROM items WHERE NOT is_duplicate AND published_at BETWEEN {at[i]} - INTERVAL 7 DAY AND {at[i]})", f"n{i} AS MATERIALIZED (SELECT id FROM w{i} WHERE id NOT IN (FROM i{i - 1}))",
            f"s{i} AS (SELECT CASE WHEN count(*) = 0 THEN 'unchanged' WHEN count(*) <= {_MOST} THEN 'appended' ELSE 'rebuilt' END AS state FROM n{i})",
            f"i{i} AS MATERIALIZED (SELECT id FROM i{i - 1} WHERE (SELECT state FROM s{i}) <> 'rebuilt' UNION SELECT id FROM w{i} WHERE (SELECT state FROM s{i}) = 'rebuilt' OR id IN (FROM n{i}))",
        ]
    looks = " UNION ALL ".join(f"SELECT {i} AS look, (SELECT state FROM s{i}) AS state, count(*) AS items, sum(id)::BIGINT AS ids FROM i{i}" for i in range(len(_LOOKS)))
    return f"{I}, {', '.join(out)} {looks}"


@query(_looks_sql())
def r12_w4_k14_j4_index_states(spark, d):
    """What the vector index does and holds at looks over a day of arrivals."""
    held = items(spark, d)
    index = VectorIndex(spark, new_folder(spark), most=_MOST)
    looks = []
    for i, hours in enumerate(_LOOKS):
        at = NOW - timedelta(hours=24) + timedelta(minutes=round(hours * 60))
        state = index.ensure_fresh(held.where(F.col("published_at") <= F.lit(at).cast("timestamp_ntz")), at)
        looks.append((i, state, index.manifest().segments))
    out = None
    for i, state, parts in looks:
        ids = spark.read.parquet(*(f"{index.path}/vectors/segment={s}" for s in parts)).agg(F.count("*").alias("items"), F.sum("id").alias("ids"))
        one = ids.select(F.lit(i).alias("look"), F.lit(state).alias("state"), "items", "ids")
        out = one if out is None else out.unionByName(one)
    return out


# --- models behind providers ---------------------------------------------------------------------------------------------


def vowels(texts: list[str]) -> np.ndarray:
    """Unit vectors of how often a, e, i, o and u stand in a text: an embedding that SQL can follow."""
    found = np.array([[t.lower().count(v) for v in "aeiou"] for t in texts], np.float64).reshape(len(texts), 5)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norm == 0, 1, norm)


_ASKED = {"t0": "the of this thing", "t1": "und der die mit", "t2": "this from that", "t3": "la de les que", "t4": "el los una por"}


def _counts(column: str) -> str:
    return "[" + ", ".join(f"(length(lower({column})) - length(replace(lower({column}), '{v}', '')))::DOUBLE" for v in "aeiou") + "]"


_RANKED = f"""{I}, q AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{x}')" for t, x in _ASKED.items())}) v(topic, query)),
c AS (SELECT query, i.*, title || ' ' || substr(coalesce(summary, content), 1, 300) AS t, title || ' ' || substr(coalesce(summary, content), 1, 200) AS u FROM items i JOIN q USING (topic)),
v AS (SELECT *, {_counts('t')} AS a, {_counts('query')} AS b FROM c), m AS (SELECT *, CASE WHEN list_dot_product(a, a) = 0 THEN 0 ELSE list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)) END AS semantic FROM v),
s AS (SELECT *, round(0.35::DOUBLE * semantic + 0.25::DOUBLE * coalesce(relevance / 10, 0.5::DOUBLE) + 0.2::DOUBLE * {_AUTH} + 0.1::DOUBLE * exp(-greatest(0, date_diff('second', published_at, {AT}) / 3600.0::DOUBLE) / 48) + 0.1::DOUBLE * raw_score, 6) AS blended FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY blended DESC, id) - 1 AS place FROM s QUALIFY place < 60),
x AS (SELECT *, len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(regexp_extract_all(lower(u), '[^\\s]+')))) AS hits FROM r)
SELECT query, id, blended, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN place < 20 THEN 0 ELSE 1 END, CASE WHEN place < 20 THEN -hits ELSE 0 END, place) - 1 AS rank FROM x"""


def _candidates(spark, d):
    asked = F.broadcast(spark.createDataFrame(list(_ASKED.items()), "topic string, query string"))  # five queries
    return items(spark, d).join(asked, "topic").withColumn("ord", F.col("id"))


@query(_RANKED)
def r8_x1_x2_rank_by_query(spark, d):
    found = R.rank_by_query(_candidates(spark, d), authority(spark), as_of(), Providers(embed=vowels, cross=overlap_score))
    return found.select("query", "id", "blended", "rank")


@query(I + ", h AS (SELECT id, topic, row_number() OVER (PARTITION BY topic ORDER BY raw_score DESC, id) - 1 AS rank, length(content) AS ce FROM items) SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN rank < 20 THEN 0 ELSE 1 END, CASE WHEN rank < 20 THEN -ce END, rank) - 1 AS place FROM h")
def r8_r9_rerank_head(spark, d):
    held = items(spark, d).select("topic", "id", "raw_score", F.length("content").alias("score"))  # the texts stay where they are
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("raw_score"), "id")) - 1)
    return R.rerank(held, F.col("score"), "topic").select("topic", "id", "place")


@query(f"{I}, q AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {chr(39)}{x}{chr(39)})' for t, x in _ASKED.items())}) v(topic, query)) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) - 1 AS rank FROM items JOIN q USING (topic) QUALIFY rank < 60")
def r9_no_model_order(spark, d):
    return R.rank_by_query(_candidates(spark, d), authority(spark), as_of(), Providers(embed=None)).select("query", "id", "rank")


def pauses() -> Callable[[list[str]], list[float]]:
    """Loads a stand-in for a spam classifier: twenty times the share of commas among the characters."""
    return lambda texts: [min(1.0, 20.0 * t.count(",") / max(1, len(t))) for t in texts]


def _posts(spark, d):
    c = read(spark, d, "conversations")
    return c.select(
        F.md5(F.substring("text", 1, 40)).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text", (F.length("text") % 9).cast("int").alias("likes"), F.lit(0).alias("reposts"),
        hours_before(as_of(), F.col("conv_id") % 200).alias("published_at"),
    ).where(F.col("role") != "system"), c.where("role = 'system'").select(F.md5(F.substring("text", 1, 40)).alias("id"))


def _funnel(spark, d):
    posts, seen = _posts(spark, d)
    return S.funnel(posts, as_of(), seen=seen, flag=spam_flag("text", pauses, 0.4))


def _holds(words: tuple[str, ...], by: str) -> str:
    return by.join("contains(low, '{}')::INT".format(w.replace("'", "''")) for w in words)


_FUNNEL = f"""WITH p AS (SELECT md5(substr(text, 1, 40)) AS id, conv_id * 1000 + turn AS ord, text, lower(text) AS low, length(text) % 9 AS likes, {AT} - to_hours(conv_id % 200) AS published_at, len(list_distinct(regexp_extract_all(upper(text), '\\$[A-Z]{{1,5}}\\b'))) AS tags
FROM conversations WHERE role <> 'system'), k AS (SELECT DISTINCT md5(substr(text, 1, 40)) AS id FROM conversations WHERE role = 'system'),
s AS (SELECT *, CASE WHEN id IN (FROM k) THEN 'seen' WHEN likes < 3 THEN 'engagement' WHEN published_at < {AT} - INTERVAL 168 HOUR THEN 'age'
 WHEN ({_holds(S.PHRASES, " + ")}) > 0 OR tags >= 3 OR (regexp_matches(text, '@[A-Za-z0-9_]+') AND tags > 0 AND ({_holds(S.HINTS, " + ")}) >= 2) THEN 'spam'
 WHEN least(1.0::DOUBLE, 20.0::DOUBLE * (length(text[1:512]) - length(replace(text[1:512], ',', ''))) / greatest(1, length(text[1:512]))) >= 0.4 THEN 'model' ELSE 'none' END AS step FROM p),
f AS (SELECT id, ord, CASE WHEN ord > min(ord) FILTER (step = 'none') OVER (PARTITION BY id) THEN 'seen' ELSE step END AS dropped FROM s)"""


@query(_FUNNEL + " SELECT id, ord, dropped FROM f")
def p4_p5_x3_funnel(spark, d):
    return _funnel(spark, d).select("id", "ord", "dropped")


@query(_FUNNEL + f" SELECT x.step, count(f.dropped) AS n FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in S.STEPS)}) x(step) LEFT JOIN f ON f.dropped = x.step GROUP BY 1")
def p4_funnel_counters(spark, d):
    """What an observation counted while the kept posts were written."""
    told, seen = S.counted(_funnel(spark, d))
    told.where("dropped = 'none'").select("id", "ord").write.parquet(f"{new_folder(spark)}/kept")
    return spark.createDataFrame(list(seen.get.items()), "step string, n long")


def short_titles(model: str, prompt: str) -> str:
    """Stands for a language model: numbered titles as summaries; `busy` has no quota, `poor` answers no JSON for topic t3."""
    asked = json.loads(prompt)
    if model == "busy":
        raise analysis.RateLimited
    if model == "poor" and asked["topic"] == "t3":
        return "no answer"
    found = json.dumps([{"summary": f"{i['index']}:{i['title'][:20]}", "relevance_score": len(i["content"]) % 10, "tags": [i["source"]]} for i in asked["items"]])
    return f"```json\n{found}\n```" if model == "poor" else found


_POOL = ["good", "busy", "poor"]


@query(I + f""", u AS (SELECT *, row_number() OVER (ORDER BY fetched_at DESC, id) - 1 AS k FROM items WHERE summary IS NULL AND NOT is_duplicate), r AS (SELECT *, k // {analysis.ROUND} AS round, row_number() OVER (PARTITION BY k // {analysis.ROUND}, topic ORDER BY fetched_at DESC, id) - 1 AS n FROM u),
b AS (SELECT *, (n // 15)::INT AS batch, CASE WHEN n // 15 % 3 = 0 THEN 'good' ELSE 'poor' END AS model FROM r)
SELECT round::INT AS round, id, topic, batch, model, (n % 15) || ':' || title[1:20] AS summary, (length(content[1:500]) % 10)::DOUBLE AS relevance, source AS tag FROM b WHERE NOT (model = 'poor' AND topic = 't3')""")
def x5_w5_backfill(spark, d):
    """Rounds of 200 until no item lacks a summary."""
    at = new_folder(spark)
    analysis.backfill(spark, items(spark, d), at, _POOL, short_titles)
    found = analysis.segments(spark, at)
    return found.select(F.col("round").cast("int").alias("round"), "id", "topic", "batch", "model", "summary", "relevance", F.get("tags", F.lit(0)).alias("tag"))


# --- flows with state ----------------------------------------------------------------------------------------------------

_ACTION = "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' ELSE 'undownvote' END"
_LAST = 19_800  # the day (since 1970) at whose end preferences are read, after all events


def _actions(spark, d, events):
    n = read(spark, d, "documents").agg(F.count("*").alias("n"))  # one row
    kind = F.col("event_type")
    action = F.when(kind == "view", "read").when(kind == "click", "click").when(kind == "purchase", "upvote").when(kind == "error", "downvote").otherwise("undownvote")
    return events.join(F.broadcast(n)).select(F.col("event_id").alias("seq"), (F.col("event_id") % F.col("n")).alias("item_id"), action.alias("action"), F.when(kind == "view", F.col("value")).alias("read_seconds"), F.col("ts").alias("created_at"), "user_id")


def _day(c: str = "created_at"):
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


_COMPOUND = with_("items", "interactions") + ", " + DIMS + f""" SELECT dimension, value, round(sum(weight * ({_LAST} - date_diff('day', DATE '1970-01-01', created_at::DATE) + 1)), 6) AS score
FROM w JOIN dims ON dims.id = w.item_id WHERE weight <> 0 GROUP BY 1, 2"""


@query(_COMPOUND)
def a6_compounded_by_day(spark, d):
    return preference.compounded(interactions(spark, d), items(spark, d), _day(), _LAST)


@query(_COMPOUND)
def w8_stream_preferences(spark, d):
    """The same, kept up by a stream with state."""
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    with flows.keyed_state(spark):
        changes = flows.preference_changes(_actions(spark, d, events), items(spark, d), _day())
        flows.drain_batches(changes, flows.changes_to(f"{at}/changes"), f"{at}/checkpoint")
    return flows.preferences_at(spark, f"{at}/changes", _LAST)


@query("SELECT a.user_id, a.event_id AS a_seq, b.event_id AS b_seq FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def w10_stream_click_to_vote(spark, d):
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    acts = events.select("user_id", F.col("event_id").alias("seq"), "event_type", F.col("ts").cast("timestamp").alias("created_at"))
    pairs = flows.matched(acts.where("event_type = 'click'"), acts.where("event_type = 'purchase'"), "user_id", "6 HOURS", "40 days")
    flows.drain(pairs, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(pairs.schema).parquet(f"{at}/out")


@query("SELECT event_type AS action, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def w10_stream_tumbling(spark, d):
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    acts = events.select(F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("created_at"))
    days = flows.tumbling(acts, "1 day", "40 days").select("action", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
    flows.drain_batches(days, flows.changes_to(f"{at}/out"), f"{at}/checkpoint")
    held = spark.read.schema("action string, day string, n long, batch long").parquet(f"{at}/out")
    return held.groupBy("action", "day").agg(F.max_by("n", "batch").alias("n"))


@query("""WITH t AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 3 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM t) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, s""")
def w10_stream_sessions(spark, d):
    """What a reader did with less than three hours between; events come in any order within the watermark."""
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    acts = events.select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    found = flows.sessions(acts, "3 hours", "40 days").select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")
    flows.drain_batches(found, flows.changes_to(f"{at}/out"), f"{at}/checkpoint", "complete")
    held = spark.read.schema("user_id long, began string, n long, batch long").parquet(f"{at}/out")
    last = held.agg(F.max("batch").alias("batch"))  # one row; each batch gives all sessions so far
    return held.join(F.broadcast(last), "batch").select("user_id", "began", "n")


@query("SELECT 1 AS round, count(DISTINCT event_id) AS stored FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 2, count(DISTINCT event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def w1_w9_fetch_rounds(spark, d):
    """Two runs of the interval job: the second finds later events and a repetition of the first ones, and stores the new ones only."""
    at, events = new_folder(spark), read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("published_at"))
    early, late = events.where("published_at < TIMESTAMP '2024-01-10'"), events.where("published_at >= TIMESTAMP '2024-01-10'")
    flows, _ = _flow(spark, d)
    stored = []
    for n, part in enumerate((early, late.unionByName(early)), 1):
        part.write.mode("append").parquet(f"{at}/in")
        found = flows.fetch_round(flows.watch(spark, f"{at}/in", events.schema, maxFilesPerTrigger=2), f"{at}/out", f"{at}/checkpoint")
        stored.append((n, sum(k for _, k in found)))
    return spark.createDataFrame(stored, "round int, stored long")


# --- letters -------------------------------------------------------------------------------------------------------------

_TOLD = {"t0": "Two **points** & more|||first <one>|||second", "t1": "Only a headline", "t9": "* No items\n* bullet **x**"}


def _html(x: str) -> str:
    for char, name in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&quot;"), ("chr(39)", "&#x27;")):
        x = f"replace({x}, {char}, '{name}')"
    return x


def _stripped(x: str) -> str:
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {char})"
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _bolded(x: str) -> str:
    return f"regexp_replace({_html(x)}, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')"


_BARE = "regexp_replace(b, '\\*\\*(.+?)\\*\\*', '\\1', 'g')"
_LETTER = I + _SEL + f""", g AS (SELECT topic, {digest_sql('content')} AS parts
 FROM (VALUES {", ".join(f"('{t}', '{c}')" for t, c in _TOLD.items())}) v(topic, content)),
i AS (SELECT topic, n, '<article><p>' || {_html('source')} || ' <i>' || {_html('language')} || '</i> ' || strftime(published_at, '%b %d, %H:%M') || ' UTC</p><h3><a href="' || {_html('url')} || '">' || {_html('title')} || '</a></h3><p>' || {_html(_stripped("coalesce(nullif(summary, ''), content[1:300])"))}
 || CASE WHEN coalesce(summary, '') = '' AND length(content) > 300 THEN '…' ELSE '' END || '</p><p>' || array_to_string(list_transform(tags, lambda t: '<b>' || {_html('t')} || '</b>'), ' ') || '</p></article>' AS html,
 '- [' || source || '] ' || title || chr(10) || '  ' || url || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || '  ' || {_stripped('summary')}[1:240] ELSE '' END AS line FROM n WHERE n <= 3),
l AS (SELECT topic, count(*) AS k, string_agg(html, chr(10) ORDER BY n) AS html, string_agg(chr(10) || chr(10) || line, '' ORDER BY n) AS lines FROM i GROUP BY 1),
z AS (SELECT coalesce(l.topic, g.topic) AS topic, coalesce(k, 0) AS items, '<section><h2>T' || coalesce(l.topic, g.topic)[2:] || ' &middot; ' || coalesce(k, 0) || ' items</h2>' || chr(10) ||
 CASE WHEN parts IS NULL THEN '<p>No summary available for this period yet.</p>' ELSE '<p>' || {_bolded('parts[1]')} || '</p>' || CASE WHEN len(parts) > 1 THEN '<ul>' || array_to_string(list_transform(parts[2:], lambda b: '<li>' || {_bolded('b')} || '</li>'), '') || '</ul>' ELSE '' END END
 || chr(10) || coalesce(l.html, '<p>No recent items.</p>') || chr(10) || '</section>' AS html,
 '## T' || coalesce(l.topic, g.topic)[2:] || ' (' || coalesce(k, 0) || ' items)' || CASE WHEN parts IS NULL THEN '' ELSE chr(10) || parts[1] || array_to_string(list_transform(parts[2:], lambda b: chr(10) || '  • ' || {_BARE}), '') END || coalesce(lines, '') AS text FROM l FULL JOIN g ON l.topic = g.topic)"""


def _sections(spark, d):
    chosen = digest.select_items(items(spark, d), 3).withColumn("sentiment", F.col("language"))
    return digest.sections(chosen, spark.createDataFrame(list(_TOLD.items()), "topic string, content string"))


@query(_LETTER + " SELECT topic, items::INT AS items, html, text FROM z")
def k13_sections(spark, d):
    return _sections(spark, d)


@query(_LETTER + """ SELECT '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>News Digest</title></head><body><h1>News Digest</h1><p>2024-01-31</p>' || chr(10) || string_agg(html, chr(10) ORDER BY topic) || chr(10) || '</body></html>' || chr(10) AS html,
 'News Digest — 2024-01-31' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY topic) || chr(10) AS text FROM z""")
def k13_letter(spark, d):
    return digest.letter(_sections(spark, d), "2024-01-31")
