"""Retrieval, ranking, de-duplication, spam, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import as_of, candidates, hours_before, interactions, items, read, with_
from ..functions import spam as S
from ..functions import text as T
from ..operators import dedup, preference, recency
from ..operators import retrieval as R
from ..providers import SMALL_WORDS, language
from ..sources import feeds
from ..session import new_folder
from .item_queries import DIMS, PREFS
from .indexes import bm25_sql, indexed
from .registry import query

I, C = with_("items"), with_("candidates")
AT = "TIMESTAMP '2024-01-31 00:00:00'"


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def one_vector(spark, d, i: int = 7):
    return vectors(spark, d).where(F.col("id") == i)


def vec_sql(k: int, name: str = "v", q: int = 7) -> str:
    return f"""{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {q})), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT {k}))"""


def rrf_sql(a: str, b: str, wa: float, wb: float, gate: int = 200, name: str = "r") -> str:
    return f"""{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, l, k) - 1 AS rank FROM (SELECT id, round(sum(w / (61 + rank)), 9) AS score, min(l) AS l, arg_min(rank, l) AS k FROM
(SELECT id, rank, 0 AS l, {wa}::DOUBLE AS w FROM {a} WHERE rank < {gate} UNION ALL SELECT id, rank, 1, {wb}::DOUBLE FROM {b} WHERE rank < {gate}) GROUP BY id))"""


@query(I + ", " + bm25_sql("this from", 120) + " SELECT id, score, rank FROM b")
def r1_j1_bm25(spark, d):
    return indexed(spark, d).search("this from", 120)


@query("WITH " + vec_sql(180) + " SELECT id, score, rank FROM v")
def r2_vector_top(spark, d):
    return R.vector_top(vectors(spark, d), one_vector(spark, d), 180)


_FUSE = bm25_sql("this from", 120) + ", " + vec_sql(180) + ", "


@query(I + ", " + _FUSE + rrf_sql("b", "v", 0.7, 0.3, 40) + " SELECT id, score, rank FROM r")
def r3_r4_r5_fusion(spark, d):
    return R.rrf([indexed(spark, d).search("this from", 120), R.vector_top(vectors(spark, d), one_vector(spark, d), 180)], R.alpha_weights(0.7), gate=40)


_HYDRATED = f"""h AS (SELECT i.*, r.rank, r.score AS rrf FROM items i JOIN r USING (id) WHERE published_at >= {AT} - INTERVAL 168 HOUR AND NOT is_duplicate AND (relevance IS NULL OR relevance >= 4.0)),
o AS (SELECT *, row_number() OVER (PARTITION BY trim(lower(title))[1:80] ORDER BY rank) AS n FROM h)"""


@query(I + ", " + _FUSE + rrf_sql("b", "v", 0.5, 0.5) + ", " + _HYDRATED + " SELECT id, rank, rrf FROM o WHERE n = 1 ORDER BY rank LIMIT 60")
def r6_o3_d5_hybrid_search(spark, d):
    return R.search(items(spark, d), indexed(spark, d), vectors(spark, d), "this from", one_vector(spark, d), recency.cutoff(as_of(), 168)).select("id", "rank", "rrf")


_AUTH = "coalesce(CASE lower(source) WHEN 'src1' THEN 0.9 WHEN 'src2' THEN 0.7 WHEN 'src3' THEN 0.2 END::DOUBLE, 0.55::DOUBLE)"


def authority(spark):
    return spark.createDataFrame([("SRC1", 0.9), ("src2", 0.7), ("Src3", 0.2)], "source string, weight double")


@query(I + f" SELECT id, round(0.35::DOUBLE * raw_score + 0.25::DOUBLE * coalesce(relevance / 10, 0.5::DOUBLE) + 0.2::DOUBLE * {_AUTH} + 0.1::DOUBLE * exp(-greatest(0, date_diff('second', published_at, {AT}) / 3600.0::DOUBLE) / 48) + 0.1::DOUBLE * raw_score, 6) AS blended FROM items")
def r7_t12_blend(spark, d):
    return R.blend(items(spark, d), authority(spark), as_of(), F.col("raw_score")).select("id", "blended")


@query(with_("items", "interactions") + ", " + DIMS + ", " + PREFS + """, s AS (SELECT id, sum(round(2 / (1 + exp(-(CASE dimension WHEN 'source' THEN 0.3 WHEN 'tag' THEN 0.5 ELSE 0.4 END::DOUBLE) * score)) - 1, 9)) AS b FROM dims JOIN prefs USING (dimension, value) GROUP BY id)
SELECT id, round(least(3, greatest(-3, coalesce(b, 0))), 6) AS boost, CASE WHEN relevance IS NOT NULL THEN round(least(10, greatest(0, relevance + round(least(3, greatest(-3, coalesce(b, 0))), 6))), 6) END AS boosted FROM items LEFT JOIN s USING (id)""")
def r10_j7_preference_boost(spark, d):
    held = items(spark, d)
    return preference.boosted(held, preference.scores(interactions(spark, d), held)).select("id", "boost", "boosted")


@query("SELECT round(avg(v), 6) AS mean_of_unit, round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT m / sqrt(sum(m * m) OVER ()) AS v FROM (SELECT pos, avg(v::DOUBLE) AS m FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos))")
def r11_a14_mean_embedding(spark, d):
    one = R.mean_vector(vectors(spark, d)).select(F.explode("embedding").alias("v"))
    return one.agg(F.round(F.avg("v"), 6).alias("mean_of_unit"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"))


@query(I + ", " + _FUSE + rrf_sql("b", "v", 0.2, 0.8, name="x") + ", " + rrf_sql("b", "v", 0.8, 0.2, name="y") + " SELECT round(count(*) FILTER (p AND q) / count(*), 6) AS overlap FROM (SELECT bool_or(s = 0) AS p, bool_or(s = 1) AS q FROM (SELECT id, 0 AS s FROM x WHERE rank < 50 UNION ALL SELECT id, 1 FROM y WHERE rank < 50) GROUP BY id)")
def r13_a12_alpha_overlap(spark, d):
    lists = [indexed(spark, d).search("this from", 120), R.vector_top(vectors(spark, d), one_vector(spark, d), 180)]
    x, y = (R.rrf(lists, R.alpha_weights(a)).where("rank < 50") for a in (0.2, 0.8))
    return R.jaccard(x, y)


@query("SELECT item_id, array_to_string(w[1:3], ' ') AS head, array_to_string(w[-3:], ' ') AS tail FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark) WHERE len(w) >= 3")
def r15_fallback_plan(spark, d):
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return read(spark, d, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 3).select("item_id", F.array_join(F.slice("w", 1, 3), " ").alias("head"), F.array_join(F.slice("w", -3, 3), " ").alias("tail"))


@query("SELECT conv_id, least(5, greatest(1, 1 + least(3, n // 4) + least(1, k - 1)))::BIGINT AS score FROM (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS k FROM conversations GROUP BY 1)")
def r16_fallback_judge(spark, d):
    by = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("k"))
    return by.select("conv_id", F.least(F.lit(5), F.greatest(F.lit(1), 1 + F.least(F.lit(3), F.floor(F.col("n") / 4)) + F.least(F.lit(1), F.col("k") - 1))).cast("long").alias("score"))


_RANKED = ", a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY query ORDER BY label DESC, score DESC) AS best FROM candidates)"


@query(C + _RANKED + " SELECT query, round(CASE WHEN i > 0 THEN g / i ELSE 0 END, 6)::DOUBLE AS ndcg FROM (SELECT query, sum(CASE WHEN r <= 10 THEN label / log2(r + 1) ELSE 0 END) AS g, sum(CASE WHEN best <= 10 THEN label / log2(best + 1) ELSE 0 END) AS i FROM a GROUP BY query)")
def r17_ndcg(spark, d):
    return R.ndcg(candidates(spark, d))


@query(C + _RANKED + " SELECT query, round(coalesce(1.0::DOUBLE / min(r) FILTER (label = 1 AND r <= 10), 0), 6)::DOUBLE AS rr FROM a GROUP BY query")
def r18_mrr(spark, d):
    return R.mrr(candidates(spark, d))


@query(with_("ledger") + " SELECT model, CASE WHEN g < 0 OR p > 600 THEN 'KILL' WHEN g >= 0.03 AND p <= 400 THEN 'SHIP' ELSE 'AMBIGUOUS' END AS verdict FROM (SELECT model, quantile_cont(latency_ms, 0.95) AS p, (length(model) - 5) * 0.03 AS g FROM ledger GROUP BY model)")
def r19_verdict(spark, d):
    from ..adapters import ledger

    by = ledger(spark, d).groupBy("model").agg(F.percentile("latency_ms", 0.95).alias("p"))
    return by.select("model", R.verdict((F.length("model") - 5) * 0.03, F.col("p")).alias("verdict"))


def _research(*queries: str) -> str:
    """The twin of a loop that asks these queries: each item's best score."""
    return I + "".join(f", {bm25_sql(q, 12, f'q{i}')}" for i, q in enumerate(queries)) + " SELECT id, min(score) AS score FROM (" + " UNION ALL ".join(f"SELECT id, score FROM q{i}" for i in range(len(queries))) + ") GROUP BY id"


@query(_research("this from", "this from that with", "this from that", "from that with"))
def r14_research_loop(spark, d):
    """Rounds of sub-queries over the keyword index until nothing new is found; a round is one plan."""
    index, found, seen = indexed(spark, d), None, set()
    plan = ["this from", "this from that with"]
    for _ in range(3):
        new = [q for q in dict.fromkeys(plan) if q not in seen]
        if not new:
            break
        for q in new:
            seen.add(q)
            part = index.search(q, 12).select("id", "score")
            found = part if found is None else found.unionByName(part)
        plan = [p for q in new for p in (" ".join(q.split()[:3]), " ".join(q.split()[-3:]))]
    return found.groupBy("id").agg(F.min("score").alias("score"))


# --- duplicates --------------------------------------------------------------------------------------------------------


def fold_items(spark, d):
    held = items(spark, d)
    return held.withColumn("ord", F.col("id")).withColumn("url", F.concat(F.lit("https://x.example/"), F.md5(F.substring("content", 1, 200))))


@query(I + ", k AS (SELECT id, regexp_replace(regexp_replace(lower(title), '\\s+-\\s+[^-]{1,40}$', ''), '[^a-z0-9]', '', 'g')[1:80] AS key, length(content) * 0.001::DOUBLE + CASE WHEN coalesce(summary, '') <> '' THEN 2 ELSE 0 END + raw_score * 0.5::DOUBLE AS detail FROM items) SELECT id, CASE WHEN key = '' THEN id ELSE first(id) OVER (PARTITION BY key ORDER BY detail DESC, id) END AS survivor FROM k")
def d1_by_title_key(spark, d):
    keys = dedup.keyed(items(spark, d).withColumn("ord", F.col("id")))
    return dedup.by_key(keys, "title_key")


_DETAIL = "length(content) * 0.001::DOUBLE + CASE WHEN coalesce(summary, '') <> '' THEN 2 ELSE 0 END + raw_score * 0.5::DOUBLE"
_IR = I.replace("WITH ", "WITH RECURSIVE ", 1)

#: The ordered fold, a row a step: `held` are the rows entered, the last of a key is met; fold(id, kept, of).
_FOLD = f""", k AS (SELECT row_number() OVER (ORDER BY id) AS k, id, 'https://x.example/' || md5(content[1:200]) AS u, {_DETAIL} AS d,
 regexp_replace(lower(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '\\s+-\\s+[\\p{{L}}\\p{{N}}_][^-]{{0,40}}$', '')), '[^a-z0-9]', '', 'g')[1:80] AS t FROM items),
f AS (SELECT 0::BIGINT AS step, []::STRUCT(u VARCHAR, t VARCHAR, id BIGINT, d DOUBLE, alive BOOLEAN)[] AS held, []::STRUCT(id BIGINT, of BIGINT)[] AS flagged UNION ALL
 SELECT k, CASE WHEN dup THEN held ELSE list_append(list_transform(held, lambda x: {{'u': x.u, 't': x.t, 'id': x.id, 'd': x.d, 'alive': x.alive AND x.id IS DISTINCT FROM m.id}}), {{'u': u, 't': t, 'id': id, 'd': d, 'alive': true}}) END,
  CASE WHEN dup THEN list_append(flagged, {{'id': id, 'of': m.id}}) ELSE flagged END
 FROM (SELECT *, coalesce(NOT m.alive OR d <= m.d, false) AS dup FROM (SELECT f.*, k.*, coalesce(list_filter(held, lambda x: x.u = k.u)[-1], list_filter(held, lambda x: x.t = k.t AND k.t <> '')[-1]) AS m FROM f JOIN k ON k.k = f.step + 1))),
z AS (SELECT held, flagged FROM f ORDER BY step DESC LIMIT 1),
fold AS (SELECT x.id AS id, true AS kept, NULL::BIGINT AS of FROM (SELECT unnest(held) AS x FROM z) WHERE x.alive UNION ALL SELECT x.id, false, x.of FROM (SELECT unnest(flagged) AS x FROM z))"""


def greedy_sql(rows: str, pairs: str, out: str) -> str:
    """CTEs of the greedy fold, a pair a step: `out` (id, duplicate_of, cluster_id) from rows (id, detail), in order of id, and pairs (a, b)."""
    return f""", {out}e AS (SELECT row_number() OVER (ORDER BY a, b) AS k, CASE WHEN x.detail >= y.detail THEN a ELSE b END AS win, CASE WHEN x.detail >= y.detail THEN b ELSE a END AS lose FROM {pairs} JOIN {rows} x ON x.id = a JOIN {rows} y ON y.id = b),
{out}g AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone, NULL::BIGINT AS win, NULL::BIGINT AS lose UNION ALL
 SELECT k, CASE WHEN live THEN list_append(gone, l) ELSE gone END, CASE WHEN live THEN w END, CASE WHEN live THEN l END
 FROM (SELECT k, e.win AS w, e.lose AS l, gone, NOT list_contains(gone, e.win) AND NOT list_contains(gone, e.lose) AS live FROM {out}g g JOIN {out}e e ON e.k = g.step + 1)),
{out} AS (SELECT n.id, min(l.win) AS duplicate_of, coalesce(min(l.win), min(w.win)) AS cluster_id FROM (SELECT a AS id FROM {pairs} UNION SELECT b FROM {pairs}) n LEFT JOIN {out}g l ON l.lose = n.id LEFT JOIN {out}g w ON w.win = n.id GROUP BY n.id)"""


def vectors_sql(least: float) -> str:
    """Pairs (a, b, similarity) of the given vectors."""
    dot = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
    return f"SELECT a.vec_id AS a, b.vec_id AS b, {dot} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {dot} >= {least}"


def tfidf_sql(texts: str, out: str) -> str:
    """CTEs of the TF-IDF pairs: `out` (a, b, similarity) from texts (id, text)."""
    stop = ", ".join(f"'{w}'" for w in dedup.STOP_WORDS)
    return f""", {out}t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {texts}), {out}c AS (SELECT id, term, count(*) AS tf FROM {out}t WHERE term NOT IN ({stop}) GROUP BY 1, 2),
{out}v AS (SELECT term, sum(tf) AS a, count(*) AS df FROM {out}c GROUP BY term ORDER BY a DESC, term LIMIT 5000), {out}w AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM {texts}) + 1) / (df + 1)) + 1) AS w FROM {out}c JOIN {out}v USING (term)),
{out}u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {out}w),
{out} AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS similarity FROM {out}u a JOIN {out}u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= 0.82)"""


@query(_IR + _FOLD + " SELECT id, kept, of AS duplicate_of FROM fold")
def d1_j12_ordered_fold(spark, d):
    return dedup.fold(fold_items(spark, d))


@query(vectors_sql(0.4))
def d2_j10_vector_pairs(spark, d):
    return dedup.vector_pairs(vectors(spark, d), 0.4)


_VECTOR_FOLD = f"WITH RECURSIVE r AS (SELECT vec_id AS id, vec_id % 7 AS detail FROM embeddings), p AS ({vectors_sql(0.4)})" + greedy_sql("r", "p", "s")


@query(_VECTOR_FOLD + " SELECT id, duplicate_of, cluster_id FROM s")
def d2_semantic_fold(spark, d):
    held = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), (F.col("vec_id") % 7).cast("double").alias("detail"))
    return dedup.semantic_fold(held, dedup.vector_pairs(vectors(spark, d), 0.4), unique=True)


_TEXTS = ", texts AS (SELECT id, title || ' ' || content[1:200] AS text FROM items)"


@query(I + _TEXTS + tfidf_sql("texts", "p") + " SELECT a, b, similarity FROM p")
def d3_tfidf_pairs(spark, d):
    return dedup.tfidf_pairs(items(spark, d).select("id", F.concat("title", F.lit(" "), F.substring("content", 1, 200)).alias("text")), 0.82)


@query(_IR + f", r AS (SELECT id, {_DETAIL} AS detail FROM items)" + _TEXTS + tfidf_sql("texts", "p") + greedy_sql("r", "p", "s") + " SELECT id, duplicate_of FROM s")
def d3_tfidf_fold(spark, d):
    text = F.concat("title", F.lit(" "), F.substring("content", 1, 200))
    held = items(spark, d).select("id", F.col("id").alias("ord"), T.detail_score("content", "summary", "raw_score").alias("detail"), text.alias("text"))
    return dedup.tfidf_fold(held, 0.82)


_KEPT = f""", r AS (SELECT id, {_DETAIL} AS detail, coalesce(title, '') || ' ' || coalesce(content, '')[1:200] AS text FROM items WHERE id IN (SELECT id FROM fold WHERE kept)), vp AS ({vectors_sql(0.82)} AND a.vec_id IN (SELECT id FROM r) AND b.vec_id IN (SELECT id FROM r))"""
_SECOND = "SELECT fold.id, coalesce(of, duplicate_of) IS NOT NULL AS is_duplicate, coalesce(of, duplicate_of) AS duplicate_of, {} AS cluster_id, '{}' AS strategy FROM fold LEFT JOIN {} x ON x.id = fold.id"


@query(_IR + _FOLD + _KEPT + greedy_sql("r", "vp", "vs") + tfidf_sql("r", "tp") + greedy_sql("r", "tp", "ts") + " " + _SECOND.format("cluster_id", "semantic", "vs") + " UNION ALL " + _SECOND.format("NULL", "tfidf", "ts") + " UNION ALL SELECT id, NOT kept, of, NULL, 'none' FROM fold")
def d4_dispatcher(spark, d):
    held = fold_items(spark, d)
    found = [dedup.deduplicate(held, name, 0.82, vectors(spark, d)).withColumn("strategy", F.lit(name)) for name in ("semantic", "tfidf", "none")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(I + " SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY trim(lower(title))[1:80] ORDER BY id) AS n FROM items) WHERE n = 1")
def d5_title_first(spark, d):
    return R.one_title(items(spark, d), "id").select("id")


@query("SELECT doc_id, part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS n FROM (SELECT doc_id, 0 AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents)) WHERE n = 1")
def d6_d7_existing_first(spark, d):
    held = read(spark, d, "documents").select("doc_id")
    both = held.where("doc_id % 2 = 0").withColumn("part", F.lit(0)).unionByName(held.withColumn("part", F.lit(1)))
    return recency.first_seen(both, "doc_id", "part")


@query(_VECTOR_FOLD + " SELECT cluster_id, min(id) AS first, count(*) AS n FROM s WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def d8_clusters(spark, d):
    held = d2_semantic_fold(spark, d).where("cluster_id IS NOT NULL")
    return held.groupBy("cluster_id").agg(F.min("id").alias("first"), F.count("*").alias("n"))


# --- spam and sources --------------------------------------------------------------------------------------------------

def posts(spark, d):
    """Turns of conversations as posts."""
    likes, hours = (F.length("text") % 9).cast("int"), F.col("conv_id") % 200
    return read(spark, d, "conversations").select(F.md5(F.substring("text", 1, 40)).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text", likes.alias("likes"), (F.col("turn") % 2).cast("int").alias("reposts"), hours_before(as_of(), hours).alias("published_at"))


_POSTS = f"""p AS (SELECT md5(substr(text, 1, 40)) AS id, conv_id * 1000 + turn AS ord, text, lower(text) AS low, length(text) % 9 AS likes, turn % 2 AS reposts, {AT} - to_hours(conv_id % 200) AS published_at,
 len(list_distinct(regexp_extract_all(upper(text), '\\$[A-Z]{{1,5}}\\b'))) AS tags FROM conversations)"""


def _held(words: tuple[str, ...], by: str) -> str:
    """Whether, or how many, of the words stand in low."""
    quoted = [w.replace("'", "''") for w in words]
    return by.join(f"contains(low, '{w}')::INT" for w in quoted)


@query(f"""WITH {_POSTS}, s AS (SELECT *, CASE WHEN likes + 2 * reposts < 3 THEN 'engagement' WHEN published_at < {AT} - INTERVAL 168 HOUR THEN 'age'
 WHEN ({_held(S.PHRASES, " + ")}) > 0 OR tags >= 3 OR (regexp_matches(text, '@[A-Za-z0-9_]+') AND tags > 0 AND ({_held(S.HINTS, " + ")}) >= 2) THEN 'spam' ELSE 'none' END AS step FROM p)
SELECT ord, CASE WHEN ord > min(ord) FILTER (step = 'none') OVER (PARTITION BY id) THEN 'seen' ELSE step END AS dropped FROM s""")
def p1_p4_funnel(spark, d):
    return S.funnel(posts(spark, d), as_of()).select("ord", "dropped")


@query("SELECT doc_id, contains(lower(text), 'airdrop') OR contains(lower(text), 'token') AS phrase, len(list_distinct(regexp_extract_all(upper(text), '\\$[A-Z]{1,5}\\b'))) AS cashtags, regexp_matches(text, '@[A-Za-z0-9_]+') AS mention FROM documents")
def p1_p2_t24_signals(spark, d):
    return read(spark, d, "documents").select("doc_id", S.any_phrase("text", ("airdrop", "token")).alias("phrase"), F.size(T.cashtags("text")).cast("long").alias("cashtags"), F.col("text").rlike("@[A-Za-z0-9_]+").alias("mention"))


@query(f"""WITH t AS (SELECT doc_id, text, lower(text) AS low, len(list_distinct(regexp_extract_all(upper(text), '\\$[A-Z]{{1,5}}\\b'))) AS cashtags FROM documents)
SELECT doc_id, ({_held(S.PHRASES, " + ")}) > 0 OR cashtags >= 3 OR (regexp_matches(text, '@[A-Za-z0-9_]+') AND cashtags > 0 AND ({_held(S.HINTS, " + ")}) >= 2) AS spam FROM t""")
def p1_p3_spam(spark, d):
    return read(spark, d, "documents").select("doc_id", S.is_spam("text").alias("spam"))


_LOW = "abcdefghijklmnopqrstuvwxyz"


@query(I + f""", t AS (SELECT id, CASE WHEN id % 2 = 0 THEN translate(replace(title, ' ', ', '), '{_LOW}', '{_LOW.upper()}') ELSE title || ' #' || source END AS title, title || content AS rest FROM items), l AS (SELECT *, lower(title || ' ' || rest) AS low FROM t)
SELECT id, ({_held(S.VIDEO_PHRASES, " + ")}) > 0 OR length(title) - length(replace(replace(title, '#', ''), '$', '')) >= 4 OR regexp_matches(title, '[A-Z]{{1,5}}(\\s*[/|,]\\s*[A-Z]{{1,5}}){{3,}}') AS spam FROM l""")
def p6_video_spam(spark, d):
    """Items' titles as titles of videos, some as lists in capitals; contents as descriptions."""
    title = F.when(F.col("id") % 2 == 0, F.translate(F.replace("title", F.lit(" "), F.lit(", ")), _LOW, _LOW.upper())).otherwise(F.concat("title", F.lit(" #"), "source"))
    return items(spark, d).select("id", S.video_spam(title, F.concat("title", "content")).alias("spam"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 THEN url ELSE 'own' || page_id END AS url FROM pages")
def p7_shown_url(spark, d):
    """Pages' addresses, shortened ones, none, and the network's own."""
    k = F.col("page_id") % 4
    url = F.when(k == 3, F.col("url")).when(k == 0, F.concat(F.lit("https://t.co/"), "page_id")).when(k == 1, F.concat(F.lit("https://x.com/i/"), "page_id"))
    return read(spark, d, "pages").select("page_id", T.shown_url(url, F.concat(F.lit("own"), "page_id")).alias("url"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"#?]*)\"', 1))[1:5]) AS links FROM pages WHERE len(regexp_extract_all(html, 'href=\"(/[^\"#?]*)\"', 1)) > 0")
def s3_scrape_links(spark, d):
    return feeds.scrape(read(spark, d, "pages"), "/").groupBy("page_id").agg(F.count("*").alias("links"))


def _plain_sql(html: str) -> str:
    entities = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"))
    for name, char in entities:
        html = f"replace({html}, '{name}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({html}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


_INNER = {t: f"nullif({_plain_sql(f"regexp_extract(html, '<{t}[^>]*>(.*?)</{t}>', 1, 'si')")}, '')" for t in ("h1", "title")}
_BODY = _plain_sql("regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi')")
_MONTH = "regexp_extract(body, '\\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \\d{4})\\b', 1)"


@query(f"""SELECT page_id, coalesce({_INNER['h1']}, {_INNER['title']}, regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1)) AS title,
 strftime(try_strptime('1 ' || {_MONTH}, '%-d %B %Y'), '%Y-%m-%d') AS month, substr(body, 1, 3000) AS body FROM (SELECT *, {_BODY} AS body FROM pages)""")
def s3_page_items(spark, d):
    return feeds.page_item(read(spark, d, "pages")).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


def feed_xml(spark, d):
    """feed, xml: a feed for each source with an entry for each document, in order of id; texts are escaped or in CDATA, every
    fifth has no link. A feed is put together by source and hundred, as sources can be large."""
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 5), " ")
    stamp = F.date_format(hours_before(as_of(), F.col("doc_id") % 240), "EEE, dd MMM yyyy HH:mm:ss")
    link = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("<link>https://"), "source", F.lit(".example/"), "doc_id", F.lit("</link>")))
    entry = F.concat(F.lit("<item><title>No. "), "doc_id", F.lit(" &amp; more</title>"), link, F.lit("<description><![CDATA[<p>The <b>"), words, F.lit("</b></p>]]></description><pubDate>"), stamp, F.lit(" GMT</pubDate></item>"))
    block = F.floor(F.col("doc_id") / 500)
    rows = read(spark, d, "documents").select(F.concat_ws("/", "source", block).alias("feed"), "doc_id", entry.alias("entry")).groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("e"))
    return rows.select("feed", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.lit("</channel></rss>")).alias("xml"))


def _entries_sql(first: int) -> str:
    return f"""e AS (SELECT concat_ws('/', source, doc_id // 500) AS feed, doc_id, source, rtrim('The ' || coalesce(array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:5], ' '), '')) AS content, row_number() OVER (PARTITION BY concat_ws('/', source, doc_id // 500) ORDER BY doc_id) AS n FROM documents),
f AS (SELECT feed, 'No. ' || doc_id || ' & more' AS title, 'https://' || source || '.example/' || doc_id AS url, content FROM e WHERE n <= {first} AND doc_id % 5 <> 0 AND doc_id % 240 <= 168)"""


@query(f"WITH {_entries_sql(15)} SELECT * FROM f")
def s1_feed_entries(spark, d):
    return feeds.entries(feed_xml(spark, d), as_of()).select("feed", "title", "url", "content")


@query(f"""WITH {_entries_sql(20)} SELECT feed AS source, title, url, content, 0.5::DOUBLE AS raw_score FROM f""")
def s2_search_entries(spark, d):
    """The same feeds as results of a search; links of a news search are decoded."""
    return feeds.search_entries(feed_xml(spark, d).withColumnRenamed("feed", "source"), as_of()).select("source", "title", "url", "content", "raw_score")


@query("SELECT id, 'https://news.example/rss?q=' || regexp_replace(replace(replace(k, ' ', '+'), '&', '%26'), '%20', '+', 'g') || '&hl=en' AS url FROM (SELECT p_partkey AS id, p_name || ' & ' || p_partkey AS k FROM part)")
def s2_search_address(spark, d):
    """Addresses of searches from a template, a keyword each."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), feeds.search_address("https://news.example/rss?q={keyword}&hl=en", F.concat("p_name", F.lit(" & "), F.col("p_partkey").cast("string"))).alias("url"))


@query("""WITH t AS (SELECT role AS subreddit, conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS selftext, conv_id % 2 = 0 AS is_self, length(text) AS score FROM conversations),
c AS (SELECT *, max(score) OVER (PARTITION BY subreddit) AS high FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY id) AS n FROM t) WHERE n <= 25)
SELECT subreddit, id, round(least(1.0, greatest(0.0, score / high)), 6)::DOUBLE AS raw_score FROM c WHERE NOT (is_self AND coalesce(selftext, '') = '')""")
def s6_reddit(spark, d):
    kind = (F.col("conv_id") + F.col("turn")) % 3
    rows = read(spark, d, "conversations").select(
        F.col("role").alias("subreddit"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.substring("text", 1, 40).alias("title"),
        F.when(kind == 0, F.col("text")).when(kind == 1, "").alias("selftext"), (F.col("conv_id") % 2 == 0).alias("is_self"), F.length("text").cast("long").alias("score"),
    )
    return feeds.reddit(rows, 50, 2).select("subreddit", "id", F.round("raw_score", 6).alias("raw_score"))


@query(f"WITH {_POSTS} SELECT ord, round((likes + 2 * reposts) / (SELECT max(likes + 2 * reposts) FROM p), 6)::DOUBLE AS score FROM p WHERE likes + 2 * reposts >= 3")
def s7_a11_engagement(spark, d):
    return feeds.engagement(posts(spark, d), 3).select("ord", F.round("raw_score", 6).alias("score"))


@query(f"""WITH f AS (SELECT doc_id // 2 AS id, lang, split_part(text, chr(10), 1)[1:80] AS title, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS n FROM documents), s AS (SELECT doc_id * 3 AS id, n_chars AS views, n_chars % 7 AS likes FROM documents),
h AS (SELECT f.id, lang, title, lower(title) AS low, coalesce(views, 0) AS views, coalesce(likes, 0) AS likes FROM f LEFT JOIN s USING (id) WHERE n = 1), m AS (SELECT CASE WHEN max(views) > 0 THEN max(views) ELSE 1 END AS high FROM h)
SELECT id, views, round(least(1.0, (views * 0.001::DOUBLE + likes) / (high * 0.001::DOUBLE + 1)), 6)::DOUBLE AS capped FROM h, m WHERE NOT (likes = 0 AND views < 500) AND lang = 'en'
 AND NOT (({_held(S.VIDEO_PHRASES, " + ")}) > 0 OR length(title) - length(replace(replace(title, '#', ''), '$', '')) >= 4 OR regexp_matches(title, '[A-Z]{{1,5}}(\\s*[/|,]\\s*[A-Z]{{1,5}}){{3,}}'))""")
def s9_j9_f14_t32_videos(spark, d):
    """Documents as videos found, each twice, with statistics for some."""
    docs = read(spark, d, "documents")
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80)
    found = docs.select(F.floor(F.col("doc_id") / 2).alias("id"), F.col("doc_id").alias("ord"), title.alias("title"), F.col("lang").alias("language"))
    stats = docs.select((F.col("doc_id") * 3).alias("id"), F.col("n_chars").alias("views"), (F.col("n_chars") % 7).alias("likes"))
    return feeds.videos(found, stats).select("id", "views", F.col("raw_score").alias("capped"))


@query("SELECT repo, tag FROM (SELECT p_brand AS repo, p_name AS tag, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 3 AND p_size % 5 <> 0 AND p_size % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY p_partkey) = 1")
def s10_releases(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("tag"), (F.col("p_size") % 5 == 0).alias("draft"), (F.col("p_size") % 3 == 0).alias("prerelease"))
    return feeds.releases(rows).select("repo", "tag")


@query("""WITH t AS (SELECT p_brand AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, 'owner/part-' || p_partkey AS repo, p_partkey AS k, p_name, p_size * 1500 AS stars FROM part)
SELECT page, pos::INT AS pos, repo AS title, 'https://github.com/' || repo AS url, CASE WHEN k % 3 = 0 THEN 'Trending GitHub repository: ' || repo ELSE p_name || ' & more' END AS content, CASE WHEN k % 5 = 0 THEN 0 ELSE round(least(1.0, stars / 50000.0), 6) END::DOUBLE AS raw_score
FROM t WHERE pos < 25 AND k % 7 <> 0""")
def s10_trending(spark, d):
    """Trending pages, one a brand, that list parts as repositories; some rows lack a description, a star count, or an owner."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 7 == 0, "part-").otherwise("owner/part-"), k)
    about = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('<p class="col-9">\n  '), "p_name", F.lit(" &amp; more </p>")))
    count = F.when(k % 5 == 0, "many").otherwise(F.format_number(F.col("p_size") * 1500, 0))
    article = F.concat(F.lit('<article class="Box-row"><h2 class="h3"><a href="/'), name, F.lit('" data-x="1"> <span>x /</span> y</a></h2>'), about, F.lit('<a class="Link" href="/'), name, F.lit('/stargazers"><svg></svg> '), count, F.lit("</a></article>"))
    rows = read(spark, d, "part").groupBy(F.col("p_brand").alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", article.alias("a")))).alias("rows"))
    pages = rows.select("page", F.concat(F.lit("<html><body>"), F.array_join(F.transform("rows", lambda x: x["a"]), "\n"), F.lit("</body></html>")).alias("html"))
    return feeds.trending(pages).select("page", "pos", "title", "url", "content", F.round("raw_score", 6).alias("raw_score"))


@query("SELECT p_name AS repo, p_partkey AS stars, least(1.0, p_partkey / 1000.0)::DOUBLE AS raw_score FROM part ORDER BY p_partkey DESC, p_name LIMIT 20")
def s11_star_search(spark, d):
    return feeds.stars(read(spark, d, "part").select(F.col("p_name").alias("repo"), F.col("p_partkey").alias("stars")), 1000.0, 20)


@query("SELECT s_name AS source FROM supplier LEFT JOIN (SELECT s_name FROM supplier WHERE s_nationkey % 3 = 0 AND s_suppkey % 2 = 0) o USING (s_name) WHERE s_acctbal > 0 AND o.s_name IS NULL")
def s12_enabled_sources(spark, d):
    """Suppliers as sources, configured or not; the state of every second one, on or off."""
    s = read(spark, d, "supplier")
    state = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("source"), (F.col("s_nationkey") % 3 != 0).alias("is_enabled"))
    return feeds.enabled(s.select(F.col("s_name").alias("source"), (F.col("s_acctbal") > 0).alias("configured")), state).select("source")


@query("SELECT c_name AS source, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS last_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS fetched FROM customer")
def s16_collector_state(spark, d):
    """Customers as collectors' states in JSON, every fifth cut off."""
    state = F.to_json(F.struct(F.col("c_mktsegment").alias("last_id"), F.col("c_custkey").alias("fetched")))
    raw = read(spark, d, "customer").select(F.col("c_name").alias("source"), F.when(F.col("c_custkey") % 5 == 0, "broken").otherwise(state).alias("state"))
    return feeds.collector_state(raw).select("source", "last_id", "fetched")


@query(f"""WITH c AS (SELECT n_name AS channel, n_nationkey AS ord, CASE WHEN n_regionkey < 3 THEN r_name ELSE 'youtube' END AS topic FROM nation JOIN region ON n_regionkey = r_regionkey),
v AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT channel, topic, c_name AS title, 'https://www.youtube.com/watch?v=' || c_custkey AS url,
 CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END AS content, CASE WHEN c_custkey % 5 = 0 THEN '2024-01-31' ELSE '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END AS day
FROM v JOIN c ON c_nationkey = ord WHERE n <= 5 AND c_custkey % 7 <> 0""")
def s8_channel_topics(spark, d):
    """Customers as videos, nations as channels that are listed twice; some videos have no id, no text or no date that can be read."""
    nation, k = read(spark, d, "nation"), F.col("c_custkey")
    channels = nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("channel"))
    topics = nation.join(F.broadcast(read(spark, d, "region").where("r_regionkey < 3")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("channel"), F.col("r_name").alias("topic"))
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z"))
    videos = read(spark, d, "customer").join(F.broadcast(channels), F.col("c_nationkey") == F.col("ord")).select(
        "channel", k.alias("pos"), F.when(k % 7 != 0, k.cast("string")).alias("video_id"), F.col("c_name").alias("title"), F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("description"), F.when(k % 5 == 0, "lately").otherwise(day).alias("published"),
    )
    found = feeds.uploads(channels.union(channels.withColumn("ord", F.col("ord") + 100)), videos, topics, as_of())
    return found.select("channel", "topic", "title", "url", "content", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {_entries_sql(15)}, r AS (SELECT feed, n, title, url, ['t0', 't1', 't2'][(split_part(feed, '/', 2)::INT % 3 + 1)::INT] AS topic FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY split_part(title, ' ', 2)::INT) AS n FROM f)),
s AS (SELECT 'site' || page_id % 9 AS feed, ['t0', 't1', 't2'][(page_id % 9 % 3 + 1)::INT] AS topic, 'p' || page_id AS title, url FROM pages) SELECT feed, topic, title, url FROM r WHERE n <= 8 AND topic <> 't2' UNION ALL SELECT feed, topic, title, url FROM s WHERE topic <> 't2'""")
def s4_fetch(spark, d):
    """Feeds of two topics, eight entries each, then pages of sites of these topics."""
    name = lambda k: F.concat(F.lit("t"), k % 3)
    xml = feed_xml(spark, d)
    registry = xml.select("feed", name(F.split_part("feed", F.lit("/"), F.lit(2)).cast("int")).alias("topic"))
    pages = read(spark, d, "pages").select(F.concat(F.lit("site"), F.col("page_id") % 9).alias("feed"), F.col("page_id").cast("int").alias("pos"), F.concat(F.lit("p"), "page_id").alias("title"), "url")
    sites = pages.select("feed").distinct().withColumn("topic", name(F.substring("feed", 5, 1).cast("int")))
    return feeds.fetch(registry, feeds.entries(xml, as_of()), sites, pages, ("t0", "t1")).select("feed", "topic", "title", "url")


@query("""WITH l AS (SELECT page_id, 'video' || lpad((page_id % 50)::VARCHAR, 6, '0') AS video_id FROM pages UNION SELECT page_id, 'talk__-' || lpad((page_id % 7)::VARCHAR, 4, '0') FROM pages WHERE page_id % 2 = 0)
SELECT page_id, 'https://www.youtube.com/watch?v=' || video_id AS url, p_name AS title, p_name || ' — ' || p_brand AS content FROM l JOIN part ON video_id = CASE WHEN p_partkey % 2 = 0 THEN 'video' || lpad(p_partkey::VARCHAR, 6, '0') ELSE 'talk__-' || lpad(p_partkey::VARCHAR, 4, '0') END WHERE p_partkey < 50""")
def s3_linked_videos(spark, d):
    """Pages with links to videos, some twice, looked up among parts as the videos that are known."""
    link = lambda v: F.concat(F.lit("<a href='https://www.youtube.com/watch?v="), v, F.lit("'>see</a>"))
    k = F.col("page_id")
    a, b = F.concat(F.lit("video"), F.lpad((k % 50).cast("string"), 6, "0")), F.concat(F.lit("talk__-"), F.lpad((k % 7).cast("string"), 4, "0"))
    pages = read(spark, d, "pages").select("page_id", F.concat(link(a), F.col("html"), F.when(k % 2 == 0, link(b)).otherwise(""), link(a), F.lit("youtube.com/watch?v=short")).alias("html"))
    p = F.col("p_partkey")
    known = read(spark, d, "part").where("p_partkey < 50").select(F.when(p % 2 == 0, F.concat(F.lit("video"), F.lpad(p.cast("string"), 6, "0"))).otherwise(F.concat(F.lit("talk__-"), F.lpad(p.cast("string"), 4, "0"))).alias("video_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    return feeds.talks(feeds.video_links(pages), known).select("page_id", "url", "title", "content")


_VOTES = ", ".join(f"({{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in small)}))), 'code': '{code}'}})" for code, small in sorted(SMALL_WORDS.items()))


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(substr(text, 1, 500)), '[\\p{{L}}]+') AS w FROM documents), b AS (SELECT doc_id, text, list_max([{_VOTES}]) AS best FROM t)
SELECT doc_id, CASE WHEN length(trim(text)) < 10 OR best.n = 0 THEN 'en' ELSE best.code END AS language FROM b""")
def t15_x4_language(spark, d):
    return read(spark, d, "documents").select("doc_id", language("text").alias("language"))


@query(I + f""", t AS (SELECT id, title || ' ' || coalesce(content, '')[1:200] AS text FROM items), w AS (SELECT id, text, regexp_extract_all(lower(substr(text, 1, 500)), '[\\p{{L}}]+') AS w FROM t), b AS (SELECT id, text, list_max([{_VOTES}]) AS best FROM w)
SELECT id, CASE WHEN length(trim(text)) < 10 OR best.n = 0 THEN 'en' ELSE best.code END AS language FROM b""")
def s13_s5_collect(spark, d):
    """Two sources that can be read and one that cannot."""
    held = items(spark, d).select("id", "title", "content", "published_at")
    sources = {
        "even": lambda: held.where("id % 2 = 0"), "odd": lambda: held.where("id % 2 = 1"), "gone": lambda: read(spark, d, "nothing"),
    }
    rows, wrong = feeds.gather(spark, sources, new_folder(spark), language)
    if set(wrong) != {"gone"}:
        raise ValueError(str(wrong))
    return rows.select("id", "language")


# --- streams -------------------------------------------------------------------------------------------------------------


def _flow(spark, d):
    """events as a stream of files."""
    from ..streaming import flows

    src = f"{d.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(src).schema
    top = src.rpartition("/")[0]
    return flows, spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 10).parquet(top)


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def w2_w3_stream_arrivals(spark, d):
    """Every event is delivered twice and arrives once."""
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    stream = flows.arrivals(events.union(events).withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts")
    flows.drain(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w3_stream_upserts(spark, d):
    """Readers' last events as a table that each batch is merged into; a batch that is delivered again changes nothing."""
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    store = flows.upserts(f"{at}/table", "user_id", ["event_id", "event_type"], "event_id")

    def twice(batch, number):
        store(batch, number)
        store(batch, number)

    flows.drain_batches(events.select("user_id", "event_id", "event_type").union(events.select("user_id", "event_id", "event_type")), twice, f"{at}/checkpoint", "append")
    return flows.current(spark, f"{at}/table").select("user_id", "event_id", "event_type")


@query("SELECT event_type AS action, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def w8_stream_running_scores(spark, d):
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    sums = events.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flows.drain_batches(sums, flows.upserts(f"{at}/out", "action", ["n", "total"], "n"), f"{at}/checkpoint")
    return flows.current(spark, f"{at}/out").select("action", "n", F.round("total", 4).alias("total"))


@query("""WITH RECURSIVE e AS (SELECT event_id % 50 AS item_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' WHEN 'signup' THEN 'undownvote' END AS action FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS k FROM e WHERE action IS NOT NULL),
f AS (SELECT item_id, 0::BIGINT AS k, ''::VARCHAR AS active, 0::BIGINT AS seq, ''::VARCHAR AS action, NULL::VARCHAR AS cancel FROM (SELECT DISTINCT item_id FROM n)
 UNION ALL SELECT n.item_id, n.k, CASE WHEN n.action IN ('upvote', 'downvote') THEN n.action WHEN n.action = 'un' || active THEN '' ELSE active END, n.seq, n.action,
 CASE WHEN n.action IN ('upvote', 'downvote') AND active <> '' AND active <> n.action THEN 'un' || active END FROM f JOIN n ON n.item_id = f.item_id AND n.k = f.k + 1)
SELECT item_id, seq, action, cancel FROM f WHERE k > 0""")
def w7_stream_votes(spark, d):
    flows, events = _flow(spark, d)
    at = new_folder(spark)
    kind = F.col("event_type")
    acts = events.select((F.col("event_id") % 50).alias("item_id"), F.col("event_id").alias("seq"), F.when(kind == "purchase", "upvote").when(kind == "error", "downvote").when(kind == "signup", "undownvote").otherwise("read").alias("action"))
    flows.drain(flows.votes(acts), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("SELECT event_type AS action, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def w10_tumbling_days(spark, d):
    held = interactions(spark, d).join(read(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    return held.groupBy(F.col("event_type").alias("action"), F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("n")).select("action", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
