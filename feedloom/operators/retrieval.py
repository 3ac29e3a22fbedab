"""Keyword and vector retrieval, fusion, blending and evaluation of rankings."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import freshness, search_terms, search_title_key
from ..providers import Providers, pair_score, similarity

if TYPE_CHECKING:
    from .keyword_index import KeywordIndex

K1, B = 1.2, 0.75
RRF_K = 60
#: Sources up to which their authority is sent to all tasks; a join by source deals all items to as many tasks as there are sources.
FEW = 10_000
GATE = 200


def postings(items: DataFrame) -> DataFrame:
    """id, term, tf over title and content."""
    text = F.concat_ws(" ", "title", "content")
    return items.select("id", F.explode(search_terms(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _count(array: str, word: str) -> Column:
    return F.size(F.filter(array, lambda t: t == F.lit(word)))


def bm25(items: DataFrame, query: str, k: int) -> DataFrame:
    """The k best items that hold every term of the query: id, score (negative, best first), rank from 0.

    One scan: lengths, frequencies and document counts come from the terms of each text without a shuffle of postings.
    """
    import re

    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    tokens = search_terms(F.concat_ws(" ", "title", "content"))
    counts = [_count("_t", w).alias(f"f{i}") for i, w in enumerate(terms)]
    docs = items.select("id", tokens.alias("_t")).select("id", F.size("_t").alias("dl"), *counts)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))))
    hit = docs.where(" AND ".join(f"f{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        raw = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
        f = F.col(f"f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = hit.select("id", F.round(-score, 6).alias("score")).orderBy("score", "id").limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy("score", "id")) - 1).cast("long"))  # k rows


def dot(a: str, b: str) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def vector_top(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """id, score, rank from 0 of the k vectors nearest to the one in query (embedding, one row)."""
    held = vectors.select("id", "embedding").join(F.broadcast(query.select(F.col("embedding").alias("q"))))
    best = held.select("id", F.round(dot("embedding", "q"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("long"))  # k rows


def rrf(lists: list[DataFrame], weights: list[float] | None = None, gate: int | None = GATE, k: int = RRF_K) -> DataFrame:
    """id, score, rank from 0 by weighted reciprocal rank fusion of lists (id, rank)."""
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError("as many weights as lists are needed")
    kept = [(i, df, w) for i, (df, w) in enumerate(zip(lists, weights, strict=True)) if w != 0]
    if not kept:
        return lists[0].select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    parts = []
    for i, df, w in kept:
        part = df if gate is None else df.where(F.col("rank") < max(1, gate))
        parts.append(part.select("id", F.lit(i).alias("list"), "rank", (F.lit(float(w)) / (F.lit(k) + F.col("rank") + 1)).alias("part")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = [F.desc("score"), F.col("first.list"), F.col("first.rank")]
    return fused.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).select("id", "score", "rank")  # as many rows as the gates let in


def alpha_weights(alpha: float | None, default: float = 0.5) -> list[float]:
    a = default if alpha is None else min(1.0, max(0.0, alpha))
    return [a, 1.0 - a]


def hydrate(fused: DataFrame, items: DataFrame, since: Column, languages: list[str] | None = None, duplicates: bool = False, least: float | None = 4.0, dismissed: DataFrame | None = None) -> DataFrame:
    """Items of the fused list that pass the filters: after the lists were cut, not before."""
    # lists that a limit cut are broadcast by their size; longer ones are not
    out = items.join(fused.select("id", F.col("score").alias("rrf"), "rank"), "id").where(F.col("published_at") >= since)
    if not duplicates:
        out = out.where(~F.col("is_duplicate"))
    if languages:
        out = out.where(F.col("language").isin(languages))
    if least is not None:
        out = out.where(F.col("relevance").isNull() | (F.col("relevance") >= least))
    return out if dismissed is None else out.join(dismissed, "id", "left_anti")


def one_title(ranked: DataFrame, order: str = "rank") -> DataFrame:
    """The first of each title."""
    first = F.row_number().over(Window.partitionBy(search_title_key("title")).orderBy(order))
    return ranked.withColumn("_n", first).where("_n = 1").drop("_n")


def search(items: DataFrame, keywords: KeywordIndex, vectors: DataFrame, query: str, query_vector: DataFrame, since: Column, limit: int = 60, alpha: float | None = None, **kw) -> DataFrame:
    """The best items by an index of keywords and by vectors, fused, filtered, one of each title."""
    fused = rrf([keywords.search(query, limit * 2), vector_top(vectors, query_vector, limit * 3)], alpha_weights(alpha))
    return one_title(hydrate(fused, items, since, **kw)).orderBy("rank").limit(limit)


def blend(items: DataFrame, authority: DataFrame, at: Column, semantic: Column) -> DataFrame:
    """items with authority and blended: .35 semantic, .25 relevance / 10 (or .5), .20 authority, .10 freshness, .10 raw score."""
    known = authority.select(F.lower("source").alias("_source"), "weight")
    known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
    held = items.join(known, F.lower(items["source"]) == F.col("_source"), "left").withColumn("authority", F.coalesce("weight", F.lit(0.55))).drop("_source", "weight")
    relevance = F.coalesce(F.col("relevance") / 10, F.lit(0.5))
    score = 0.35 * semantic + 0.25 * relevance + 0.20 * F.col("authority") + 0.10 * freshness("published_at", at) + 0.10 * F.col("raw_score")
    return held.withColumn("blended", F.round(score, 6))


def rerank(ranked: DataFrame, score: Column, query: str, depth: int = 20) -> DataFrame:
    """ranked (a query column, rank) with place: of each query the first `depth` by score, the others where they were."""
    head = ranked.where(F.col("rank") < depth)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), "rank")) - 1  # `depth` rows a query
    return head.withColumn("place", place.cast("long")).unionByName(ranked.where(F.col("rank") >= depth).withColumn("place", F.col("rank").cast("long")))


def rank_by_query(candidates: DataFrame, authority: DataFrame, at: Column, providers: Providers = Providers(), top: int = 60, depth: int = 20) -> DataFrame:
    """The `top` best of the candidates (query, id, ord and an item's columns) of each query, with rank from 0.

    Ranked by the blend with the embeddings' similarity, then the first `depth` by the cross-encoder; the others keep their
    places. Without an embedding model, or where it fails, candidates stay in their order (ord); without a cross-encoder, or
    where it fails for any of a query's first, these keep theirs. Each query keeps `top` rows a task before any are
    shuffled, so a query with most of the candidates is no hot key."""

    def place(*order: Column | str) -> Column:
        return (F.row_number().over(Window.partitionBy("query").orderBy(*order)) - 1).cast("long")

    def first(rows: DataFrame, *order: Column | str) -> DataFrame:  # a bound on the number itself is what Spark takes into the tasks
        number = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        return rows.withColumn("_n", number).where(F.col("_n") <= top).withColumn("rank", (F.col("_n") - 1).cast("long")).drop("_n")

    if providers.embed is None:
        return first(candidates, "ord", "id")
    text = lambda n: F.concat(F.col("title"), F.lit(" "), F.substring(F.coalesce("summary", "content"), 1, n))
    scored = blend(candidates.withColumn("semantic", similarity("query", text(300), providers.embed)), authority, at, F.col("semantic"))
    held = first(scored, F.desc_nulls_last("blended"), "ord", "id")
    if providers.cross is None:
        return held
    head = held.where(F.col("rank") < depth).select("query", "id", "rank", text(200).alias("_text"))
    scores = head.select("query", "id", "rank", pair_score("query", "_text", providers.cross).alias("cross"))
    whole = F.count("cross").over(Window.partitionBy("query")) == F.count("*").over(Window.partitionBy("query"))  # `depth` rows a query
    moved = scores.withColumn("cross", F.when(whole, F.col("cross"))).withColumn("_to", place(F.desc_nulls_last("cross"), "rank")).select(F.col("query").alias("_query"), F.col("rank").alias("_from"), "_to", "cross")
    met = held.join(moved, (F.col("query") == F.col("_query")) & (F.col("rank") == F.col("_from")), "left")
    return met.withColumn("rank", F.coalesce("_to", "rank")).drop("_query", "_from", "_to")


def ndcg(rows: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg of rows (query, label 0 or 1, score without ties)."""
    by = lambda *o: F.row_number().over(Window.partitionBy("query").orderBy(*o))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("label") / F.log2(F.col(r) + 1)).otherwise(0.0))
    ranked = rows.withColumn("r", by(F.desc("score"))).withColumn("best", by(F.desc("label"), F.desc("score")))
    sums = ranked.groupBy("query").agg(gain("r").alias("dcg"), gain("best").alias("ideal"))
    return sums.select("query", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def mrr(rows: DataFrame, k: int = 10) -> DataFrame:
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    first = F.min(F.when((F.col("label") == 1) & (F.col("r") <= k), F.col("r")))
    return ranked.groupBy("query").agg(F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("rr"))


def verdict(gain: Column, p95: Column) -> Column:
    return F.when((gain < 0) | (p95 > 600), "KILL").when((gain >= 0.03) & (p95 <= 400), "SHIP").otherwise("AMBIGUOUS")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """overlap of two id sets; 1 if both are empty."""
    both = a.select("id").distinct().withColumn("x", F.lit(1)).join(b.select("id").distinct().withColumn("y", F.lit(1)), "id", "full_outer")
    return both.agg(F.coalesce(F.round(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(1.0)).alias("overlap"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """embedding: the mean, of unit length."""
    means = vectors.select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    one = means.agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return one.select(F.transform("a", lambda x: x["v"] / F.col("n")).alias("embedding"))
