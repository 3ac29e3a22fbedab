"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A source's rate is its target over its size: the copies expected of each of its documents. Documents of a source
stand in an order that sorts by size; the k-th has the interval from (k - 1) rates to k rates, moved by one offset of
the source, and is taken once for each whole number that the interval crosses. Neighbours in the order have
nearly equal sizes, so the words taken differ from the target by little more than a document.

The order is (size bin, hash bin, size, hash of doc_id, doc_id): bins are counted by partial aggregation, bins' counts
are summed within the source, and rows are numbered only inside their bin; no task numbers a whole source. Size bins
are the sizes up to 31 and then sixteen for every power of two; each has 256 hash bins.

Targets: each source has its weight's share of all words, at most CAP times its size; what is over goes to the
others by weight until none is above. That is min(CAP x size, weight x level) for the one level that fills the whole.

Defined results: a null text has size 0. A null source is one source, last. Sources of size 0 have target 0 and give
nothing. A null doc_id sorts by an empty id's hash. Repeated rows are documents of their own; those alike in every key
of the order may swap places, which changes no count. An empty table gives an empty result. Offsets and hashes depend on
the seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: What stands between words. Splitting is many times faster than counting words one by one.
BETWEEN = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 17


def size(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "")).cast("long")


def size_bin(n: Column) -> Column:
    """Whole-number arithmetic only: the size, or 16 x the length of its binary form plus its next four digits."""
    digits = F.length(F.bin(n))
    return F.when(n < 32, n).otherwise(digits * 16 + F.call_function("shiftright", n, digits - 5) - 16 + 1024).cast("int")


def _hex(x: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(x.cast("string"), F.lit(""))).cast("binary"))


def offset(source: Column, seed: int = SEED) -> Column:
    """In [0, 1): the first 32 bits of a hash of the source."""
    return F.conv(F.substring(_hex(source, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target from source and source_size; one row a source, numbered in order."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (at + 1).cast("int")).cast("long")
    held = sources.select("source", "source_size", w.alias("weight"))
    # sources in the order in which a rising level meets their caps
    rise = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_)
    rest = total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    over = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the first source whose cap the level of all from it on does not pass sets the level
    levels = held.withColumn("rest", rest).withColumn("over", over).withColumn("at", F.row_number().over(rise))
    first = F.min(F.when(F.col("source_size") * cap * F.col("over") >= F.col("weight") * F.col("rest"), F.struct("at", "rest", "over"))).over(all_)
    flat = levels.withColumn("first", first)
    target = F.when(F.col("at") < F.col("first.at"), F.col("source_size") * cap).otherwise(F.col("weight") * F.col("first.rest") / F.col("first.over"))
    return flat.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies, which replace columns of these names; all others are kept, whatever they are called."""
    kept = docs.drop("size", "source_size", "target", "copies")
    whole = kept.select("doc_id", "source", size().alias("size"), F.struct("*").alias("_row"))
    return _mix(whole, _sizes(docs), weights, cap, seed).select("_row.*", "size", "source_size", "target", "copies")


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, written: the texts are read and split once for all sums."""
    return materialise(docs.select("doc_id", "source", size().alias("size")), "sizes")


def _binned(rows: DataFrame, seed: int) -> DataFrame:
    key = _hex(F.col("doc_id"), seed)
    return rows.withColumn("_key", key).withColumn("_b", size_bin(F.col("size"))).withColumn("_h", F.substring("_key", 1, 2))


def _mix(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    """rows (doc_id, source, size and a struct at most) with source_size, target and copies."""
    bins = ["_b", "_h"]
    counts = _binned(sizes, seed).groupBy("source", *bins).agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    base = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("source").orderBy(*bins)) - F.col("_n"))
    base = base.join(goal, base["source"].eqNullSafe(goal["source"])).select(base["source"].alias("_source"), *(F.col(b).alias(f"{b}2") for b in bins), "_base", "source_size", "target")
    own = F.row_number().over(Window.partitionBy("source", *bins).orderBy("size", "_key", "doc_id"))
    ranked = _binned(rows, seed).withColumn("_own", own)
    same = ranked["source"].eqNullSafe(base["_source"]) & (ranked["_b"] == base["_b2"]) & (ranked["_h"] == base["_h2"])
    rank = (F.col("_base") + F.col("_own")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u)
    return ranked.join(base, same).select(*rows.columns, F.col("source_size").cast("long").alias("source_size"), "target", F.least(copies, F.lit(cap)).cast("long").alias("copies"))


def report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row for each of docs (doc_id, source, text)."""
    sizes = _sizes(docs)
    return _mix(sizes, sizes, weights, cap, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; whatever their columns are called."""
    whole = docs.select("doc_id", "source", size().alias("size"), F.struct("*").alias("_row"))
    return _mix(whole, _sizes(docs), weights, cap, seed).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h,
  CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 5)::BIGINT) - 16 + 1024 END AS b FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER r, 0))::BIGINT AS rest,
  (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0))::BIGINT AS over_, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS pos
  FROM w WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT pos AS fat, rest AS frest, over_ AS fover FROM l WHERE source_size * 3 * over_ >= weight * rest ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, (CASE WHEN pos < fat THEN (source_size * 3)::DOUBLE ELSE (weight * frest)::DOUBLE / fover::DOUBLE END) AS target FROM l, f),
n AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY b, substr(h, 1, 2), size, h, doc_id) AS rank FROM k),
r AS (SELECT n.doc_id, n.size, t.source_size, t.target, n.rank::DOUBLE AS rank,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5('17:' || coalesce(n.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(rate * rank + u) - floor(rate * (rank - 1) + u), 3) * size)::BIGINT AS taken FROM r
"""
