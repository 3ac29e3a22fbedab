"""Nearest neighbours by shifted space-filling curves.

Vectors are projected on CURVES groups of DIMS orthogonal directions, shifted, and ordered by the Hilbert index of
their cell: one ordering for each group. Spark range-partitions the orderings (by index, then by id, so that equal
vectors need not share a task); in each, a query meets the WIDTH neighbours on either side within its range, and the
best of all orderings are merged and reranked by exact inner products.

That alone has a recall that falls with the dimension: on vectors without structure every neighbour is about as far
as any other and no ordering can know better. So an exact check follows: the ranges of the first ordering are
blocks with a centre and a radius; a block can hold a better neighbour only if query . centre + |query| x radius
reaches the query's k-th score so far, and only such blocks are searched. The result is exact whatever the data;
what structure there is decides how many blocks are spared. `check=False` gives the windows' result alone.

Bounds: at most MAX_BLOCKS blocks, so their centres are the same few MB on any data; a group of the check holds one
block and at most CHUNK queries.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part. Vectors of
different lengths have no product: each length is searched by itself, one after the other (lengths are few: a column has one, as a rule). A null vec_id takes no part. Repeated ids: each row is a candidate and
a query, an id is named once, with the best score of its rows, and never for itself; k counts ids. Equal scores go to the smaller vec_id. Fewer candidates
than k give them all; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

CURVES = 4
DIMS = 8
BITS = 7
WIDTH = 256
TOP = 20
BLOCK = 4096
MAX_BLOCKS = 4096
CHUNK = 4096
SEED = 5
#: More than the rounding of two ways to sum a product can differ, for unit vectors; scaled by the lengths.
SLACK = 1e-9


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of whole numbers below 2^bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def directions(dim: int, curve: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """DIMS directions of a curve and its shift; orthogonal to those of other curves as far as the dimension allows."""
    rng = np.random.default_rng([seed, dim])
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    rows = np.arange(curve * DIMS, (curve + 1) * DIMS) % dim
    return q[:, rows[: min(DIMS, dim)]], np.random.default_rng([seed, curve, 1]).random(min(DIMS, dim))


def keys(x: np.ndarray, curve: int) -> np.ndarray:
    a, shift = directions(x.shape[1], curve)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    spread = np.sqrt(x.shape[1])
    cell = np.floor((np.clip(unit @ a * spread, -3.5, 3.5) + 3.5 + shift) / 8 * (1 << BITS))
    return hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def best(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best ids of data as (query's row, data's row, score), an id by its best row: scores summed pair by pair, ties to smaller ids."""
    rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    scale = np.linalg.norm(queries, axis=1) * (np.linalg.norm(data, axis=1).max() if len(data) else 0)
    names, code = np.unique(ids, return_inverse=True)
    again = len(names) < len(ids)
    if again:
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(names)))
    for at in range(0, len(queries), 512):
        q, slack = queries[at : at + 512], SLACK * scale[at : at + 512, None]
        rough = q @ data.T
        rough[own[at : at + 512, None] == ids[None, :]] = -np.inf
        of_id = np.maximum.reduceat(rough[:, order], starts, axis=1) if again else rough
        floor = np.partition(of_id, -k, axis=1)[:, -k][:, None] if of_id.shape[1] > k else np.full((len(q), 1), -np.inf)
        if least is not None:
            floor = np.maximum(floor, least[at : at + 512, None])
        near = (rough >= floor - slack) & np.isfinite(rough)
        if again:  # of an id's rows, those that can be its best
            near &= rough >= of_id[:, code] - slack
        i, j = np.nonzero(near)
        s = np.concatenate([np.zeros(0), *((q[i[a : a + (1 << 15)]] * data[j[a : a + (1 << 15)]]).sum(axis=1) for a in range(0, len(i), 1 << 15))])
        if again:
            first = np.lexsort((j, -s, code[j], i))
            i, j, s = i[first], j[first], s[first]
            one = np.ones(len(i), bool)
            one[1:] = (i[1:] != i[:-1]) | (code[j[1:]] != code[j[:-1]])
            i, j, s = i[one], j[one], s[one]
        ranked = np.lexsort((ids[j], -s, i))
        i, j, s = i[ranked], j[ranked], s[ranked]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        rows.append(at + i[keep])
        cols.append(j[keep])
        values.append(s[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that take part."""
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    number = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return held.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & number & F.exists("embedding", lambda v: v != 0))


def _once(held: DataFrame) -> DataFrame:
    """held with one of each id's equal rows, which would crowd windows and meet in one block; nothing is done if ids do not repeat."""
    again = held.groupBy("vec_id").count().where("count > 1")
    return held if again.isEmpty() else materialise(held.dropDuplicates(["vec_id", "embedding"]), "vectors")


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("embedding"))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(keys(x, c)), batch.column("vec_id"), batch.column("embedding")], names=["curve", "key", "vec_id", "embedding"])


def _read_all(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _windows(every: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of the curves; what is held is two widths and a batch."""
        tail: pa.Table | None = None
        done = 0  # rows of the tail whose queries had their whole window

        def emit(t: pa.Table, low: int, high: int) -> Iterator[pa.RecordBatch]:
            curve, ids = t.column("curve").to_numpy(), t.column("vec_id").to_numpy()
            x = _matrix(t.column("embedding").combine_chunks())
            for at in range(low, high, WIDTH):
                to = min(at + WIDTH, high)
                a, b = max(0, at - WIDTH), min(len(ids), to + WIDTH)
                for c in np.unique(curve[at:to]):
                    q = at + np.flatnonzero((curve[at:to] == c) & (ids[at:to] % every == 0))
                    d = a + np.flatnonzero(curve[a:b] == c)
                    i, j, s = best(x[q], ids[q], x[d], ids[d], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][i]), pa.array(ids[d][j]), pa.array(s)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if tail is None else pa.concat_tables([tail, now])
            until = max(done, held.num_rows - WIDTH)
            yield from emit(held, done, until)
            cut = max(0, until - WIDTH)
            tail, done = held.slice(cut), until - cut
        if tail is not None:
            yield from emit(tail, done, tail.num_rows)

    return run


def search(vectors: DataFrame, every: int = 20, k: int = TOP, check: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`."""
    held = _once(usable(vectors))
    sizes = [r["n"] for r in held.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]
    if len(sizes) < 2:
        return _search(held, every, k, check)
    found = [_search(held.where(F.size("embedding") == n), every, k, check).select("query_id", "vec_id", "score") for n in sizes]
    return _top(reduce(DataFrame.union, found), k)


def _search(held: DataFrame, every: int, k: int, check: bool) -> DataFrame:
    n = held.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n // BLOCK))))
    ordered = held.mapInArrow(_ordered, "curve int, key long, vec_id long, embedding array<double>")
    dealt = ordered.repartitionByRange(CURVES * blocks, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    near = _top(dealt.mapInArrow(_windows(every, k), "query_id long, vec_id long, score double"), k)
    if not check:
        return near
    near = materialise(near, "near")
    found = _check(held, near, blocks, every, k)
    return _top(near.select("query_id", "vec_id", "score").union(found), k)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    one = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _check(held: DataFrame, near: DataFrame, blocks: int, every: int, k: int) -> DataFrame:
    """What blocks hold that reaches a query's k-th score so far."""
    spark = held.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column("vec_id"), batch.column("embedding")], names=["block", "vec_id", "embedding"])

    first = held.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(keys(_matrix(b.column("embedding")), 0)), b.column("vec_id"), b.column("embedding")], names=["key", "vec_id", "embedding"]) for b in batches if b.num_rows), "key long, vec_id long, embedding array<double>")
    placed = materialise(first.repartitionByRange(blocks, "key", "vec_id").mapInArrow(place, "block int, vec_id long, embedding array<double>"), "blocks")

    def extent(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, low = 0.0, 0, []
        for b in batches:
            low.append(_matrix(b.column("embedding")))
        x = np.concatenate(low)
        total, size = x.sum(axis=0), len(x)
        centre = total / size
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(np.linalg.norm(x - centre, axis=1).max())])], names=["block", "centre", "radius"])

    summary = placed.groupBy("block").applyInArrow(extent, "block int, centre array<double>, radius double").collect()  # MAX_BLOCKS rows at most
    if not summary:
        return near.select("query_id", "vec_id", "score")
    number = np.array([r["block"] for r in summary], np.int32)
    centres, radii = np.array([r["centre"] for r in summary]), np.array([r["radius"] for r in summary])
    bounds = spark.sparkContext.broadcast((number, centres, radii))
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    queries = held.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    chunks = int(max(1, -(-queries.count() // CHUNK)))
    queries = queries.join(least, "query_id", "left").select("query_id", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(chunks)).cast("int").alias("chunk"), F.coalesce("least", F.lit(float("-inf"))).alias("least"), "embedding")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, centres, radii = bounds.value
        for batch in batches:
            if batch.num_rows:
                q, least = _matrix(batch.column("embedding")), batch.column("least").to_numpy()
                size = np.linalg.norm(q, axis=1)
                reach = q @ centres.T + size[:, None] * radii[None, :] * (1 + SLACK) + SLACK * size[:, None]
                i, j = np.nonzero(reach >= least[:, None])
                for a in range(0, len(i), 4096):
                    took = batch.take(pa.array(i[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(number[j[a : a + 4096]]), *took.columns], names=["block", *took.schema.names])

    visits = queries.mapInArrow(visit, "block int, query_id long, chunk int, least double, embedding array<double>")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, ids = _matrix(left.column("embedding").combine_chunks()), left.column("vec_id").to_numpy()
        q, own = _matrix(right.column("embedding").combine_chunks()), right.column("query_id").to_numpy()
        i, j, s = best(q, own, x, ids, k, right.column("least").to_numpy())
        return pa.table({"query_id": own[i], "vec_id": ids[j], "score": s})

    spread = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return spread.groupBy("block", "chunk").cogroup(visits.groupBy("block", "chunk")).applyInArrow(meet, "query_id long, vec_id long, score double")
