"""Small cases with known answers, and folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions import spam as S
from feedloom.functions import text as T
from feedloom.operators import dedup, recency, store
from feedloom.operators import retrieval as R
from feedloom.streaming import flows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


@pytest.mark.parametrize(("url", "want"), [
    ("https://A.example/Path/?utm_source=x&id=7#top", "https://a.example/path/?id=7"), ("https://a.example/p//", "https://a.example/p"),
    ("https://a.example/p?a=1&b=2&a=3&c=", "https://a.example/p?a=1&a=3&b=2"), ("https://a.example/p?ref=q", "https://a.example/p"), (None, None),
    ("https://a.example/p/?referrer=x&_hsmi=2&utm_id=5&igshid=6", "https://a.example/p/?utm_id=5&igshid=6"), ("https://a.example/p?q=a%20b+c&z=%7E*", "https://a.example/p?q=a+b+c&z=~%2a"),
    ("https://a.example/p?hsCtaTracking=1&x=%zz", "https://a.example/p?hsctatracking=1&x=%25zz"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, url, T.normalize_url) == want


@pytest.mark.parametrize(("title", "want"), [("Big News - The Paper", "bignews"), ("Well-known fact", "wellknownfact"), ("", ""), (None, None), ("  Rates rise - Wire  ", "ratesrise"), ("Rates rise - (wire)", "ratesrisewire"), ("A - B" + "c" * 41, "ab" + "c" * 41), ("A - B" + "c" * 40, "a")])
def test_title_key(spark, title, want):
    assert one(spark, title, T.title_key) == want


@pytest.mark.parametrize(("text", "want"), [("&lt;b&gt;x&lt;/b&gt; &amp; y", "x & y"), ("<p>a</p><p>b</p>", "a b"), ("", "")])
def test_strip_html(spark, text, want):
    assert one(spark, text, T.strip_html) == want


@pytest.mark.parametrize(("text", "want"), [
    ("our 100% win rate speaks", True), ("just copy my trades", True), ("a stock market guru", True), ("start earning today", True), ("$A $BB $CCC", True), ("$ABCDEF $ABCDEG $ABCDEH", False),
    ("@joe on $A", False), ("@joe on $A, his picks are crushing it", True), ("his picks are crushing it on $A", False), ("calm news", False),
])
def test_spam(spark, text, want):
    assert one(spark, text, S.is_spam) is want


def test_funnel_sees_kept_rows_only(spark):
    rows = [(1, 0, "never lose", 9), (1, 1, "calm", 9), (1, 2, "calm", 9), (2, 3, "calm", 0), (2, 4, "calm", 9)]
    held = spark.createDataFrame(rows, "id long, ord long, text string, likes long").withColumn("reposts", F.lit(0)).withColumn("published_at", F.lit("2024-01-30").cast("timestamp_ntz"))
    got = [r["dropped"] for r in S.funnel(held, F.lit("2024-01-31").cast("timestamp_ntz")).orderBy("ord").collect()]
    assert got == ["spam", "none", "seen", "engagement", "none"]


def test_unescape_all(spark):
    assert one(spark, "caf&eacute; &hellip;", T.unescape_all) == "café …"


def ranked(spark, ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, rank long")


def order(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    a, b = ranked(spark, [1, 2, 3]), ranked(spark, [3, 4])
    assert order(R.rrf([a, b]))[0] == 3
    assert order(R.rrf([a, b], [1, 0])) == [1, 2, 3]
    assert order(R.rrf([a, b], [0, 1])) == [3, 4]
    assert order(R.rrf([a, b], gate=0)) == [1, 3]
    assert set(order(R.rrf([a, b]))) == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        R.rrf([a, b], [1])


def test_alpha():
    assert R.alpha_weights(5) == [1, 0] and R.alpha_weights(-3) == [0, 1] and R.alpha_weights(None) == [0.5, 0.5]


@pytest.mark.parametrize("frame", [0, 12, None])
def test_greedy_fold_by_rounds(spark, frame):
    """Stars, cliques, chains and a random graph, against the pairs taken one by one; rounds, frames or both."""
    rng = random.Random(5)
    edges = {(0, k) for k in range(1, 25)} | {(a, b) for a in range(30, 40) for b in range(a + 1, 40)} | {(k, k + 1) for k in range(50, 58)}
    edges |= {tuple(sorted(rng.sample(range(70, 110), 2))) for _ in range(70)}
    place, detail = {i: (i * 37) % 113 if i >= 70 else i for i in range(110)}, {i: rng.randint(0, 4) * 1.0 for i in range(110)}
    order = sorted(tuple(sorted(e, key=place.get)) for e in edges)
    order.sort(key=lambda e: (place[e[0]], place[e[1]]))
    want, gone = {i: [None, None] for e in edges for i in e}, set()
    for a, b in order:
        if not {a, b} & gone:
            win, lose = (a, b) if detail[a] >= detail[b] else (b, a)
            gone.add(lose)
            want[lose] = [win, win]
            want[win][1] = win
    items = spark.createDataFrame([(i, place[i], detail[i]) for i in range(110)], "id long, ord long, detail double")
    pairs = spark.createDataFrame(sorted(edges) + sorted(edges)[:5], "a long, b long")
    got = {r["id"]: [r["duplicate_of"], r["cluster_id"]] for r in dedup.semantic_fold(items, pairs, frame).collect()}
    assert got == want
    assert dedup.semantic_fold(items, pairs.limit(0), frame).count() == 0


def test_fold_against_whole(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(i, i, rng.randrange(6), rng.randrange(8), rng.randrange(4)) for i in range(30)]
        items = spark.createDataFrame([(i, o, f"https://x.example/{u}", f"title {t}" if t else "", "c" * 100 * d, None, 0.0) for i, o, u, t, d in rows], "id long, ord long, url string, title string, content string, summary string, raw_score double")
        keys = dedup.keyed(items).orderBy("ord").collect()
        want = dedup.fold_rows([(k["id"], k["url_key"], k["title_key"], k["detail"]) for k in keys])
        got = {r["id"]: (r["kept"], r["duplicate_of"]) for r in dedup.fold(items).collect()}
        assert got == want


def test_components_chain(spark):
    nodes = spark.range(12).select("id")
    edges = spark.createDataFrame([(i, i + 1) for i in (0, 1, 2, 3, 4, 7, 8)], "a long, b long")
    got = {r["id"]: r["component"] for r in dedup.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(6)}, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


def test_merge_keeps_first_written(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, title string, score long")
    new = spark.createDataFrame([(2, "x", 9), (3, "c", 3)], "id long, title string, score long")
    assert sorted(map(tuple, store.merge(old, new, "id", ["score"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]


def test_widen(spark):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(i, "k", 1) for i in range(4)] + [(9, "k", 50)], "id long, k string, h int").withColumn("published_at", F.timestamp_add("HOUR", -F.col("h"), at))
    assert recency.widen(rows, at, 10, "k").count() == 5
    assert recency.widen(rows, at, 10, "k", least=4).count() == 4


def test_stream_votes(spark, tmp_path):
    acts = [(1, 0, "upvote"), (1, 1, "downvote"), (1, 2, "undownvote"), (1, 3, "upvote"), (2, 4, "downvote"), (2, 5, "read")]
    spark.createDataFrame(acts, "item_id long, seq long, action string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = flows.watch(spark, str(tmp_path / "in"), "item_id long, seq long, action string")
    flows.drain(flows.votes(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["seq"]: r["cancel"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: None, 1: "unupvote", 2: None, 3: None, 4: None}


def test_spam_phrases_and_hints(spark):
    from feedloom.functions import spam

    hard = ["guaranteed return", "100% win rate", "never lose", "copy my trades", "mirror my trades", "trading guru", "boost your income", "dm for signals", "go follow @", "live trades", "copyable strat"]
    weak = ["his picks", "their calls", "never go down", "incredible", "crushing it", "trade alerts", "been following", "thanks to @", "stock picks", "steady gains", "earn over"]
    texts = [f"So {p.title()} it is" for p in hard] + [f"@you $ABC {a}, {b}" for a, b in zip(weak, weak[1:])] + ["@you $ABC steady growth", "incredible stock picks"]
    got = [r["spam"] for r in spark.createDataFrame(list(enumerate(texts)), "id long, text string").orderBy("id").select(spam.is_spam("text").alias("spam")).collect()]
    assert got == [True] * (len(texts) - 2) + [False] * 2
    assert len(set(spam.PHRASES)) == 20 and len(set(spam.HINTS)) == 40


def words(seed, n, vocabulary=60):
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_tfidf_pairs_lose_none(spark):
    import math

    texts = [words(i, 12) for i in range(60)]
    texts += [t[:-1] + ["other"] for t in texts[:20]] + [t[:-3] for t in texts[20:30]] + [["the", "of"], [], ["a", "x"]]
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.tfidf_pairs(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string"), 0.5).collect()}
    kept = [[w for w in t if len(w) > 1 and w not in dedup.STOP_WORDS] for t in texts]
    df = {w: sum(w in t for t in kept) for t in kept for w in t}
    unit = []
    for t in kept:
        v = {w: t.count(w) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w in t}
        size = math.sqrt(sum(x * x for x in v.values()))
        unit.append({w: x / size for w, x in v.items()})
    dots = {(i, j): round(sum(x * unit[j].get(w, 0) for w, x in unit[i].items()), 6) for i in range(len(unit)) for j in range(i + 1, len(unit))}
    want = {k: s for k, s in dots.items() if s >= 0.5}
    assert len(want) > 25 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_dispatcher(spark):
    body = " ".join(words(1, 30, 500))
    rows = [
        (1, 0, "https://a.example/1", "First", body, "s", 0.0),
        (2, 1, "https://a.example/2", "Second", body + " more", None, 0.0),  # near 1, poorer
        (3, 2, "https://a.example/1", "Third", "short", None, 0.0),  # the address of 1
        (4, 3, "https://a.example/4", "Fourth", " ".join(words(2, 30, 500)), None, 0.0),
        (5, 4, "https://a.example/5", "Fifth", " ".join(words(3, 30, 500)), None, 0.0),
    ]
    held = spark.createDataFrame(rows, "id long, ord long, url string, title string, content string, summary string, raw_score double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.6, 0.8]), (5, [0.6, 0.8])], "id long, embedding array<double>")
    of = lambda df: {r["id"]: (r["is_duplicate"], r["duplicate_of"]) for r in df.collect()}
    none = {1: (False, None), 2: (False, None), 3: (True, 1), 4: (False, None), 5: (False, None)}
    assert of(dedup.deduplicate(held, "none")) == none == of(dedup.deduplicate(held, "semantic"))
    assert of(dedup.deduplicate(held, "tfidf", 0.7)) == none | {2: (True, 1)}
    got = of(dedup.deduplicate(held, "semantic", 0.82, vectors))
    assert {i for i, (gone, _) in got.items() if gone} == {3, 5} or {i for i, (gone, _) in got.items() if gone} == {3, 4}


def test_digests_and_settings(spark):
    schema = "date string, topic string, content string, item_count long, generated_at int"
    held = store.digest_rows(spark.createDataFrame([("d1", "AI", "a", 1, 1), ("d2", "ai", "b", 2, 2)], schema))
    held = store.put_digests(held, spark.createDataFrame([("d2", "Ai", "c", 3, 3), ("d2", "Rust", "r", 1, 3)], schema))
    assert sorted((r["id"], r["content"]) for r in held.collect()) == [("d1_ai", "a"), ("d2_ai", "c"), ("d2_rust", "r")]
    assert [store.get_digest(held, d, "AI").first()["content"] for d in ("d1", "d9")] == ["a", "c"]
    assert store.get_digest(held, "d1", "none").count() == 0
    assert sorted(r["id"] for r in store.delete_digest(held, "d2", "AI").collect()) == ["d1_ai", "d2_rust"]
    kept = store.put_settings(spark.createDataFrame([("k", "1", 1)], "key string, value string, updated_at int"), spark.createDataFrame([("k", "2", 2), ("l", "3", 2)], "key string, value string, updated_at int"))
    assert [store.get_setting(kept, k, "x").first()["value"] for k in ("k", "l", "m")] == ["2", "3", "x"]


def test_clear(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(7).write.parquet(path)
    assert [tuple(r) for r in store.clear(spark, {"t": path}).collect()] == [("t", 7)]
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).isEmpty()


def test_usage(spark):
    from feedloom.functions import text as T

    rows = [(0, None), (1, "no json"), (2, '{"usage": null}'), (3, '{"usage": {"prompt_tokens": 5, "completion_tokens": "7", "total_tokens": "many"}}')]
    got = spark.createDataFrame(rows, "id int, response string").select("id", *T.usage("response")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0)] * 3 + [(5, 7, 0)]


def test_tfidf_pairs_shuffle_no_candidates(spark, monkeypatch):
    """Copies are compared once, hot keys in tiles, texts of many terms under single terms: the same pairs each way."""
    texts = [words(i % 25, 12) for i in range(75)] + [[f"lone{i % 2}"] for i in range(12)] + [words(i, 12, 9) for i in range(30)]
    held = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    pairs = lambda: sorted(map(tuple, dedup.tfidf_pairs(held, 0.6).collect()))
    found, members = dedup._alike(held, 0.6, 5000, dedup.STOP_WORDS)
    assert members.count() == 87 and found.select("x", "y").distinct().count() == found.count() < len(pairs())
    want = pairs()
    assert {(a, b) for a, b, _ in want} >= {(i, i + 25) for i in range(50)} | {(75, 77), (76, 78)} and len({(a, b) for a, b, _ in want}) == len(want)
    unit = dedup.tfidf(held)
    x, y = (unit.select(F.col("id").alias(c), "term", F.col("w").alias(f"w{c}")) for c in "ab")
    plain = x.join(y, "term").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("s")).where("s >= 0.6")
    assert sorted((r.a, r.b) for r in plain.collect()) == [(a, b) for a, b, _ in want]
    monkeypatch.setattr(dedup, "TILE", 3)
    monkeypatch.setattr(dedup, "AT_ONCE", 5)
    assert pairs() == want
    monkeypatch.setattr(dedup, "PAIRED", 4)
    assert pairs() == want


def test_tfidf_fold_of_copies(spark):
    texts = [words(i % 9, 12) for i in range(40)] + [words(0, 12)[:-1] + ["other"], ["the"], ["lone"]]
    rows = [(i, (i * 7) % 43, (i * 5) % 11 * 1.0, " ".join(t)) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "id long, ord long, detail double, text string")
    found = {r["id"]: r["duplicate_of"] for r in dedup.tfidf_fold(held, 0.6).collect()}
    place, detail = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    pairs = sorted((tuple(sorted((r["a"], r["b"]), key=place.get)) for r in dedup.tfidf_pairs(held, 0.6).collect()), key=lambda e: (place[e[0]], place[e[1]]))
    want = dict.fromkeys((i for e in pairs for i in e))
    for a, b in pairs:
        if want[a] is None and want[b] is None:
            win, lose = (a, b) if detail[a] >= detail[b] else (b, a)
            want[lose] = win
    assert found == want and 41 not in found and len(want) >= 41


def test_copies_are_not_broadcast(spark, monkeypatch):
    """Classes of copies are dealt out in rows of several items: no table of items goes through the driver, and the pairs are the same."""
    texts = [words(i % 7, 12) for i in range(80)] + [words(i % 3, 12)[:-1] + ["other"] for i in range(20)] + [words(50 + i, 12) for i in range(5)]
    held = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    want = sorted(map(tuple, dedup.tfidf_pairs(held, 0.6).collect()))
    monkeypatch.setattr(dedup, "NEAR", 0, raising=False)
    pairs = dedup.tfidf_pairs(held, 0.6)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == want and len({w[:2] for w in want}) == len(want) > 700
    monkeypatch.setattr(dedup, "CHUNK", 3, raising=False)
    assert sorted(map(tuple, dedup.tfidf_pairs(held, 0.6).collect())) == want
    same = lambda i, j: sorted(texts[i]) == sorted(texts[j])
    assert {w[:2] for w in want if w[2] == 1.0} == {(i, j) for i in range(105) for j in range(i + 1, 105) if same(i, j)}


def test_fold_broadcasts_no_items(spark, monkeypatch):
    """Beyond NEAR rows, labels, items and what they replace meet by shuffles; only tables of large components are broadcast."""
    import re

    rows = [(i, (i * 7) % 61, (i * 5) % 11 * 1.0) for i in range(60)]
    held = spark.createDataFrame(rows, "id long, ord long, detail double")
    pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60) if i % 12 == j % 12 or j == i + 1 and j % 5], "a long, b long")
    fold = lambda: sorted(map(tuple, dedup.semantic_fold(held, pairs, unique=True).collect()))
    want = fold()
    monkeypatch.setattr(dedup, "NEAR", 0, raising=False)
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    assert fold() == want and len(want) == 60
    ran = [plans.executionsList().apply(i).physicalPlanDescription() for i in range(before, plans.executionsCount())]
    keys = [k for p in ran for k in re.findall(r"BroadcastHashJoin.*\nLeft keys \[\d+\]: \[(.*?)\]", p)]
    assert any("SortMergeJoin" in p for p in ran) and not [k for k in keys if not k.startswith("component#")]


def test_fold_calls_python_for_linked_rows_only(spark):
    """Rows without a shared key need no task of Python; components share tasks, and empty keys meet in their own component only."""
    schema = "id long, ord long, url string, title string, content string, summary string, raw_score double"
    apart = spark.createDataFrame([(i, i, f"https://x.example/{i}", f"title {i}", "c", None, 0.0) for i in range(9)], schema)
    found = dedup.fold(apart)
    assert "InPandas" not in found._jdf.queryExecution().toString() and found.where("kept").count() == 9
    both = spark.createDataFrame([(i, i, "", f"title {i // 2}", "c", None, 0.0) for i in range(6)], schema)
    got = {r["id"]: (r["kept"], r["duplicate_of"]) for r in dedup.fold(both).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 2), 4: (True, None), 5: (False, 4)}


def test_vectors_are_shuffled_as_blocks(spark, monkeypatch):
    """The same pairs whatever the blocks and parts; blocks are dealt to parts, not to all other blocks."""
    import numpy as np

    monkeypatch.setattr(dedup, "BLOCK", 4)
    monkeypatch.setattr(dedup, "PARTS", 3)
    rng = np.random.default_rng(1)
    held = rng.standard_normal((60, 8)).astype(np.float32)
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    held[50:55] = held[:5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)] + [(99, None)], "id long, embedding array<float>")
    pairs = dedup.vector_pairs(rows, 0.4)
    assert "block <= other" not in pairs._jdf.queryExecution().toString() and "CoGroup" not in pairs._jdf.queryExecution().toString()
    s = np.round(held.astype(float) @ held.astype(float).T, 6)
    want = sorted((i, j, s[i, j]) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.4)
    assert sorted(map(tuple, pairs.collect())) == want


def test_ranking_shuffles_few_rows(spark):
    """A query's first rows are taken in the tasks, sources' authority is no shuffle of the candidates."""
    from feedloom.plans import state_queries as Q
    from feedloom.providers import Providers

    held = spark.range(5000).selectExpr("'q' || id % 2 AS query", "id", "id AS ord", "'t' AS title", "'s' AS summary", "'c' AS content", "'src' || id % 9 AS source", "1.0D AS relevance", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS published_at", "0.5D AS raw_score")
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    found = R.rank_by_query(held, Q.authority(spark), at, Providers(embed=Q.vowels))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 60, Partial" in plan and "BroadcastHashJoin" in plan
    got = found.collect()
    assert sorted((r["query"], r["rank"]) for r in got) == [(q, k) for q in ("q0", "q1") for k in range(60)] and {r["id"] % 9 for r in got} <= {1, 2}
