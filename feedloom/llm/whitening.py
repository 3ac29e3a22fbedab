"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Every vector becomes whole numbers x = floor(256 c). The fit list is each distinct x once. A partition of it keeps its
count, its exact sums, its singular values and all its right singular vectors; it absorbs a batch by decomposing what it
holds, the batch (centred) and one row for the distance of the two means, stacked. States of partitions merge the same
way, FAN at a time, in rounds until one is left for each length of vectors. Nothing is truncated, so the last state is
the decomposition of the whole centred list up to rounding, without any product of the vectors with themselves.

Bounds: a state is a square of the vectors' length, whatever the rows; a task holds two states and one batch. The
driver holds the last state of each length.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; empty vectors have no
components, so they give no rows. Vectors of different lengths have no common covariance: each length is fitted by
itself (lengths are few: a column has one, as a rule). Null and repeated ids stay, each row with its own result, and
repeated vectors count once in the fit. Fewer dimensions than the components asked for give as many as there are. A
direction in which the list does not vary (one below RANK of the first) cannot be scaled: its `whitened` is null, and
it is left out of `identity_error`; a list that does not vary at all has null `explained` too. Entries beyond a long
take the nearest one; a deviation beyond a long is null. An empty table gives an empty result.
Other columns take no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import in_batches, materialise

SCALE = 256.0
TOP = 4
#: States merged in one task of a round.
FAN = 8
#: A singular value below this share of the largest one counts as zero.
RANK = 1e-10
_STATE = "dim int, slot long, n long, sums array<long>, values array<double>, vectors array<double>"


@dataclass(frozen=True)
class State:
    """What is known of a list of vectors: count, sums, singular values and right singular vectors (rows) of it, centred."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def decomposed(x: np.ndarray) -> State:
    """State of a block of whole numbers."""
    sums = x.sum(axis=0)
    values, vectors = _svd(x - sums / len(x))
    return State(len(x), sums, values, vectors)


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def merged(a: State, b: State) -> State:
    """State of both lists; the last row stands for what the means differ."""
    n = a.n + b.n
    between = np.sqrt(a.n / n * b.n) * (a.sums / a.n - b.sums / b.n)
    values, vectors = _svd(np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, between]))
    return State(n, a.sums + b.sums, values, vectors)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x (whole numbers) of the rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    held = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return held.select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's row numbers and vectors, for each length."""
    held = batch.column(column)
    ends = held.offsets.to_numpy()
    sizes, flat = np.diff(ends), held.flatten().to_numpy(zero_copy_only=False)
    starts = ends[:-1] - ends[0]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def _packed(dim: int, slot: int, s: State) -> pa.RecordBatch:
    lists = [pa.array([v.ravel().tolist()], t) for v, t in ((s.sums, pa.list_(pa.int64())), (s.values, pa.list_(pa.float64())), (s.vectors, pa.list_(pa.float64())))]
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([slot], pa.int64()), pa.array([s.n], pa.int64()), *lists], names=["dim", "slot", "n", "sums", "values", "vectors"])


def _unpacked(row: dict) -> State:
    return State(row["n"], np.array(row["sums"], np.int64), np.array(row["values"]), np.array(row["vectors"]).reshape(-1, row["dim"]))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state for each length that a partition holds."""
    held: dict[int, State] = {}
    for batch in batches:
        for at, x in _by_length(batch) if batch.num_rows else ():
            new = decomposed(x)
            d = x.shape[1]
            held[d] = merged(held[d], new) if d in held else new
    slot = TaskContext.get().partitionId()
    for d, s in held.items():
        yield _packed(d, slot, s)


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in batches:
        for row in batch.to_pylist():
            s = _unpacked(row)
            out = s if out is None else merged(out, s)
    yield _packed(key[0].as_py(), key[1].as_py(), out)


def fit(listed: DataFrame) -> dict[int, State]:
    """The state of the whole list (column x, each vector once) for each length of vectors."""
    states = materialise(in_batches(listed.select("x")).mapInArrow(_states, _STATE), "states")
    while (states.agg(F.max("slot")).first()[0] or 0) > 0:
        slot = F.floor(F.col("slot") / FAN).cast("long")
        states = materialise(states.withColumn("slot", slot).groupBy("dim", "slot").applyInArrow(_merge, _STATE), "states")
    return {r["dim"]: _unpacked(r.asDict()) for r in states.toLocalIterator()}


@dataclass(frozen=True)
class Model:
    """Count, sums, the components asked for (rows, of unit length), their deviations and shares of the variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - self.sums / self.n) @ self.components.T / self.scale


def model(s: State, top: int = TOP) -> Model:
    d = s.vectors.shape[1]
    values, vectors = s.values, s.vectors
    if len(values) < min(top, d):  # fewer vectors than components: any directions across those that vary
        more = np.linalg.svd(vectors, full_matrices=True)[2][len(values) :]
        vectors, values = np.vstack([vectors, more]), np.concatenate([values, np.zeros(d - len(values))])
    k = min(top, d)
    rows = vectors[:k]
    rows = rows * np.where(rows[np.arange(k), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    varies = values[:k] > RANK * values[0]
    total = (values**2).sum()
    explained = values[:k] ** 2 / total if total > 0 else np.full(k, np.nan)
    return Model(s.n, s.sums, rows, np.where(varies, values[:k] / np.sqrt(s.n), np.nan), explained)


def _identity_errors(listed: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry, for each length, of the covariance of the whitened list less the identity."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch) if batch.num_rows else ():
                w = models[x.shape[1]].whitened(x)
                sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + w.T @ w
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "entry", "value"])

    sums = in_batches(listed.select("x")).mapInArrow(products, "dim int, entry int, value double").groupBy("dim", "entry").agg(F.sum("value").alias("value"))
    worst: dict[int, float] = {}
    for r in sums.collect():  # components x components for each length
        m = models[r["dim"]]
        i, j = divmod(r["entry"], len(m.scale))
        if not np.isnan(m.scale[i] + m.scale[j]):
            worst[r["dim"]] = max(worst.get(r["dim"], 0.0), abs(r["value"] / m.n - (i == j)))
    return worst


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums over the dimensions of (n x - sums)^2; None beyond a long."""
    reach = n * max(int(x.max()), -int(x.min())) + int(np.abs(sums).max())
    if reach * reach * x.shape[1] < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in found]


def whiten(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and each of the first `top` components."""
    held = whole(vectors)
    listed = materialise(held.select("x").dropDuplicates(["x"]), "fit-list")
    models = {d: model(s, top) for d, s in fit(listed).items()}
    errors = _identity_errors(listed, models)
    id_type = held.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch) if batch.num_rows else ():
                m = models[x.shape[1]]
                k = len(m.scale)
                w, dev = m.whitened(x), deviations(x, m.n, m.sums)
                rows = np.repeat(at, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(rows), m.n)),
                        pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(m.explained, len(at)), from_pandas=True),
                        pa.array([errors.get(x.shape[1])] * len(rows), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return in_batches(held).mapInArrow(project, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
