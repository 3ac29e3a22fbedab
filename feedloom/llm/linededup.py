"""Removing runs of two lines and more that an earlier place holds.

Texts fall into chunks of lines. A chunk ends, and the next one begins, at a line where a rolling hash over the hashes of
the last WINDOW lines says so: boundaries move with the lines around them, not with what stands before. Neighbouring
chunks share the line between them, so that a chunk has two lines at least and each two lines in a row lie in one chunk.

A chunk that an earlier place holds goes whole. A passage shorter than its chunks has no chunk of its own, so of the
chunks that stay, each two lines in a row are looked up the same way; a run of lines repeats if and only if all its pairs
do, and none of two lines and more is lost. Chunks and pairs meet by a BLAKE2b name. The bytes under every name that
occurs twice are compared; should they differ anywhere, all is named anew with longer names.

Places are ordered by doc_id (null last), a digest of the text and the line; a pair that overlaps its first place (three
equal lines) is no repeat of it. The first of equal lines always stays. Single lines are not removed.
Rows of one doc_id are rows of their own; of rows that are equal in doc_id and text, one comes first. Each row of the
input gives one, also of an empty table none; a null text has no lines. Texts are cut whole, however long. Columns other
than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise, small

#: Lines under the rolling hash, and line steps in a chunk on average.
WINDOW, STEPS = 2, 4
#: Bytes of a name; the next length is taken where two different runs of lines have one name.
NAMES = (16, 32, 64)
#: Names at more places than this, and than one in HOT_SHARE of all, are looked up in a broadcast table: at most HOT_SHARE.
HOT, HOT_SHARE = 1000, 50_000
#: Tasks that choose the first of rows equal in doc_id and text.
SALTS = 64

_BASE, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def split(text: str | None) -> list[bytes]:
    return text.encode().split(b"\n") if text is not None else []


def bounds(lines: list[bytes]) -> list[int]:
    """The lines at which chunks begin and end, the first and the last among them; none of fewer than two lines."""
    if len(lines) < 2:
        return []
    hashes, out, rolled, oldest = [crc32(x) + 1 for x in lines], [0], 0, pow(_BASE, WINDOW, 1 << 64)
    for i, h in enumerate(hashes[:-1]):
        rolled = (rolled * _BASE + h - (hashes[i - WINDOW] * oldest if i >= WINDOW else 0)) & _MASK
        if i >= WINDOW - 1 and ((rolled * _MIX & _MASK) >> 32) % STEPS == 0:
            out.append(i)
    return [*out, len(lines) - 1]


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """First and last line of each chunk."""
    at = bounds(lines)
    return list(zip(at, at[1:]))


def pairs(lines: list[bytes]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(len(lines) - 1)]


def run_bytes(lines: list[bytes], first: int, last: int) -> bytes:
    return b"\n".join(lines[first : last + 1])


def _name(data: bytes, size: int) -> bytes:
    return blake2b(data, digest_size=size).digest()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few bytes of text each, or of one text."""
    for batch in batches:
        offsets = K.utf8(batch.column("text"))[1]
        for a, b in K.slices(offsets, K.SLICE):
            yield batch.slice(a, b - a)


def _named(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, mark, at (the first line), name and the pairs' names of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            own, at, names, held = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                lines = split(text)
                two = [_name(run_bytes(lines, *x), size) for x in pairs(lines)]
                for a, b in chunks(lines):
                    own.append(i)
                    at.append(a)
                    names.append(two[a] if b == a + 1 else _name(run_bytes(lines, a, b), size))
                    held.append(two[a:b])
            rows = pa.array(own, pa.int64())
            columns = [part.column("doc_id").take(rows), part.column("mark").take(rows), pa.array(at, pa.int32()), pa.array(names, pa.binary()), pa.array(held, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "at", "name", "pairs"])

    return run


def _runs(size: int, of: Callable[[list[bytes]], list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """name and bytes of each chunk or pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [run_bytes(lines, *x) for lines in map(split, part.column("text").to_pylist()) for x in of(lines)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x, size) for x in found], pa.binary()), pa.array(found, pa.binary())], names=["name", "bytes"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        texts, n, removed, digest = [], [], [], []
        for text, later, spots in zip(*(part.column(c).to_pylist() for c in ("text", "later", "spots")), strict=True):
            lines = text.split("\n") if text is not None else []
            if later and len(lines) > 1:  # an equal row holds every pair
                gone = set(range(len(lines)))
            else:
                gone = {p + k for p in spots or () for k in (0, 1)}
            kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if text is not None else None
            texts.append(kept)
            n.append(len(lines))
            removed.append(len(gone))
            digest.append(sha256(kept.encode()).hexdigest() if kept is not None else None)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "text", "n_lines", "n_removed", "kept_sha256"],
        )


def _firsts(found: DataFrame, name: str) -> DataFrame:
    """name, first (place) and n of the names at two places and more; found has doc_id, mark, at and name."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "at")
    return materialise(found.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), name)


def _with_first(found: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """found with the first place of its name, null where that is the only one."""
    often = F.col("n") > max(HOT, n // HOT_SHARE)
    hot, rest = F.broadcast(firsts.where(often).drop("n")), firsts.where(~often).drop("n")
    return found.join(hot, "name").unionByName(found.join(hot.select("name"), "name", "left_anti").join(rest, "name", "left"))


def _later() -> Column:
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))
    return F.col("first").isNotNull() & (~same | (F.col("at") > F.col("first.at") + 1))


def _equal(lines: DataFrame, firsts: DataFrame, size: int, of: Callable) -> bool:
    """Whether the bytes are one and the same under each name."""
    held = lines.select("text").mapInArrow(_runs(size, of), "name binary, bytes binary").join(small(firsts.select("name")), "name")
    return not held.groupBy("name").agg((F.min("bytes") != F.max("bytes")).alias("differ")).agg(F.max("differ")).first()[0]


def _repeats(lines: DataFrame, size: int) -> tuple[DataFrame, DataFrame] | None:
    """doc_id, mark, spots (the places whose two lines stand at an earlier place), and doc_id, mark of rows that are not alone
    in both; None if different bytes have one name of this size."""
    found = materialise(lines.mapInArrow(_named(size), "doc_id long, mark binary, at int, name binary, pairs array<binary>"), "line-chunks")
    firsts = _firsts(found, "first-chunks")
    if not _equal(lines, firsts, size, chunks):
        return None
    told = materialise(_with_first(found, firsts, found.count()).select("doc_id", "mark", "at", "pairs", _later().alias("gone")), "told-chunks")
    left = told.where("NOT gone").select("doc_id", "mark", F.col("at").alias("_at"), F.posexplode("pairs").alias("_i", "name")).select("doc_id", "mark", (F.col("_at") + F.col("_i")).alias("at"), "name")
    firsts = _firsts(left, "first-pairs")
    if not _equal(lines, firsts, size, pairs):
        return None
    again = _with_first(left, firsts, left.count()).where(_later()).select("doc_id", "mark", F.array("at").alias("run"))
    runs = told.where("gone").select("doc_id", "mark", F.sequence("at", F.col("at") + F.size("pairs") - 1).alias("run"))
    spots = runs.unionByName(again).groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("run")).alias("spots"))
    copies = found.where("at = 0").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    return materialise(spots, "line-spots"), materialise(copies, "line-copies")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """By doc_id, null or not, and mark."""
    other = small(right).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    return left.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how).drop("_id", "_mark")


def _but_one(rows: DataFrame) -> DataFrame:
    """rows with `later`: true for all but one of those equal in doc_id and mark; first one of each salt is chosen, then one of these."""
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    own = salted.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "mark", "_salt").orderBy(F.lit(0))))
    apart = F.when(F.col("_n") > 1, F.struct("_salt", "_n"))  # null for one row of each salt
    number = F.row_number().over(Window.partitionBy("doc_id", "mark", "_apart").orderBy(F.lit(0)))
    return own.withColumn("_apart", apart).withColumn("later", (F.col("_n") > 1) | (number > 1)).drop("_salt", "_n", "_apart")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, text (the lines kept, joined by line ends), n_lines, n_removed, kept_sha256 (of that text), one row for each of docs."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    several = F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    lines = held.where(several)
    found = next((x for size in NAMES if (x := _repeats(lines, size)) is not None), None)
    if found is None:
        raise ValueError("different lines have one name at every length")
    spots, copies = found
    alone = _joined(lines, copies, "left_anti").withColumn("later", F.lit(False))
    some = alone.unionByName(_but_one(_joined(lines, copies, "left_semi")))
    many = _joined(some, spots, "left").select("doc_id", "text", "later", "spots")
    few = held.where(~several).select("doc_id", "text", F.lit(False).alias("later"), F.lit(None).cast("array<int>").alias("spots"))
    return many.unionByName(few).mapInArrow(_cut, "doc_id long, text string, n_lines long, n_removed long, kept_sha256 string")
