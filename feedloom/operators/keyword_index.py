"""An inverted index of items' titles and contents: stemmed terms with positions, in a table bucketed by term.

Postings (term, id, positions, the item's length) are partitioned by bucket, a hash of the term, and sorted by term in
their files; a query reads its terms' buckets only, and of those the row groups that can hold its terms. A term that
stands in most items spreads over `spread` files of its bucket by item, so no task writes or reads it alone. Each item also
has a row of its own in the bucket OF_ITEMS, which is the list of indexed ids.

Items are added in segments. An item that comes again goes whole into the new segment and its id into that segment's
list of replaced ids; older postings of it no longer count. `compact` writes the live postings as one segment.

A query's words must all stand in an item; a word that the index splits (such as a_b) is a phrase: its parts must follow
each other, inside title or content. Scores are BM25 over both columns as one, negative, best first; ties by id.
Null ids take no part; ids are unique among the items of one change (store.merge sees to that); null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stemming
from . import versions
from .retrieval import B, K1

OF_ITEMS = -1
_MANIFEST = "segments array<int>, replaced array<int>, items long, words long, id_type string"


#: Bytes of an Arrow batch that is indexed, and of the texts whose postings are held at once: a posting takes far more memory than its
#: word's bytes.
A_BATCH, PIECE = 4 << 20, 256 << 10
#: Stems that a task remembers.
MEMO = 1 << 18


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to PIECE bytes of text, a longer row alone."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in ("title", "content"))
    upto, a = sizes.cumsum(), 0
    while a < batch.num_rows:
        b = max(a + 1, int(upto.searchsorted(upto[a] - sizes[a] + PIECE, "right")))
        yield batch.slice(a, b - a)
        a = b


class _Codes(dict):
    """word -> the number of its stem in names; words are stemmed as they are met."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.of: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        stem = stemming.stem(word)
        if stem not in self.of:
            self.of[stem] = len(self.names)
            self.names.append(stem)
        self[word] = self.of[stem]
        return self[word]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each item (no term), and one for each term of it. Positions of the content start beyond those of the title."""
    codes = _Codes()
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        n, found, heads, lengths = batch.num_rows, [], [], []
        for title, content in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist(), strict=True):
            head, body = stemming.words(title or ""), stemming.words(content or "")
            found += head
            found += body
            heads.append(len(head))
            lengths.append(len(head) + len(body))
        code = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
        size = np.array(lengths, np.int64)
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)
        place += place >= np.repeat(np.array(heads, np.int64), size)
        key = row * len(codes.names) + code
        order = np.argsort(key, kind="stable")  # by item and term, places as they come
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        own, at = np.unique(code[order][starts], return_inverse=True)
        terms = pa.array([codes.names[c] for c in own], pa.string()).take(pa.array(at, pa.int64()))
        rows = np.concatenate([np.arange(n), row[order][starts]])
        ends = pa.array(np.concatenate([np.zeros(n, np.int64), starts, [len(found)]]), pa.int32())
        positions = pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.concat_arrays([pa.nulls(n, pa.string()), terms]), positions, pa.array(size[rows], pa.int32())], names=["id", "term", "positions", "length"])
        if len(codes) > MEMO:  # a memo, not a table of all words
            codes = _Codes()


def phrases(query: str) -> list[list[str]]:
    """The query's words as lists of terms that must follow each other."""
    found = [[stemming.stem(t) for t in stemming.words(w)] for w in re.findall(r"\w+", query)]
    return [p for p in found if p]


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    path: str
    buckets: int = 256
    spread: int = 4

    def manifest(self) -> Row | None:
        return versions.latest(self.spark, self.path)

    def rows(self, only: list[str] | None = None, at: Row | None = None) -> DataFrame:
        """segment, bucket, term, id, positions, length of the live rows; of some terms, or (None) of all, items' own included."""
        now = at or self.manifest()
        if now is None:
            raise ValueError(f"no index in {self.path}")
        schema = f"id {now.id_type}, term string, positions array<int>, length int, segment int, bucket int"
        held = self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/segment={s}" for s in now.segments))
        if only is not None:
            of = {r.t: r.b for r in self.spark.createDataFrame([(t,) for t in only], "t string").select("t", self._bucket(F.col("t")).alias("b")).collect()}
            held = held.where(F.col("bucket").isin(*set(of.values())) & F.col("term").isin(*of))
        if not now.replaced:
            return held
        gone = self.spark.read.schema(f"id {now.id_type}, segment int").option("basePath", f"{self.path}/replaced").parquet(*(f"{self.path}/replaced/segment={s}" for s in now.replaced))
        gone = gone.groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_since"))
        return held.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_since")), "left_anti")

    def items(self, at: Row | None = None) -> DataFrame:
        """id, length of every indexed item."""
        return self.rows(at=at).where(F.col("bucket") == OF_ITEMS).select("id", "length")

    def _bucket(self, term: Column) -> Column:
        return F.when(term.isNull(), OF_ITEMS).otherwise(F.pmod(F.xxhash64(term), F.lit(self.buckets))).cast("int")

    def _deal(self, rows: DataFrame, segment: int) -> None:
        """Write postings as a segment. Buckets spread over several tasks by item, that of the items' own rows over many."""
        ways = F.when(F.col("bucket") == OF_ITEMS, self.buckets).otherwise(self.spread)
        dealt = rows.select("id", "term", "positions", "length", "bucket").repartition("bucket", F.pmod(F.xxhash64("id"), ways)).sortWithinPartitions("bucket", "term", "id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    def _write(self, items: DataFrame, segment: int) -> str:
        held = items.where(F.col("id").isNotNull()).select("id", "title", "content")
        id_type = held.schema["id"].dataType.simpleString()
        rows = held.mapInArrow(_postings, f"id {id_type}, term string, positions array<int>, length int")
        key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", self.spark.conf
        own = conf.get(key, None)
        conf.set(key, str(A_BATCH))  # ten thousand long texts are else one batch
        try:
            self._deal(rows.withColumn("bucket", self._bucket(F.col("term"))), segment)
        finally:
            conf.unset(key) if own is None else conf.set(key, own)
        return id_type

    def _commit(self, version: int, segments: list[int], replaced: list[int], id_type: str) -> None:
        """Publish segments; the corpus's counts come from the live rows of items."""
        n = self.items(Row(segments=segments, replaced=replaced, id_type=id_type)).agg(F.count("*").alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        versions.commit(self.spark, self.path, version, {"segments": segments, "replaced": replaced, "items": n["items"], "words": n["words"], "id_type": id_type}, _MANIFEST)

    def build(self, items: DataFrame) -> None:
        """A new first segment of all items; what was indexed before no longer counts."""
        now = self.manifest()
        number = now.version + 1 if now else 0
        self._commit(number, [number], [], self._write(items, number))

    def append(self, items: DataFrame) -> None:
        """Index the items whose ids are not indexed yet."""
        if self.manifest() is None:
            return self.build(items)
        now = self.manifest()
        self._write(items.join(self.items().select("id"), "id", "left_anti"), now.version + 1)
        self._commit(now.version + 1, [*now.segments, now.version + 1], list(now.replaced), now.id_type)

    def upsert(self, items: DataFrame) -> None:
        """Index the items, in place of what is indexed under their ids."""
        now = self.manifest()
        if now is None:
            return self.build(items)
        number = now.version + 1
        items.select("id").join(self.items().select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/replaced/segment={number}")
        self._write(items, number)
        self._commit(number, [*now.segments, number], [*now.replaced, number], now.id_type)

    def delete(self, ids: DataFrame) -> None:
        """Take items (id) out of the index."""
        now = self.manifest()
        number = now.version + 1
        ids.select("id").distinct().write.mode("overwrite").parquet(f"{self.path}/replaced/segment={number}")
        self._commit(number, list(now.segments), [*now.replaced, number], now.id_type)

    def compact(self) -> None:
        """The live rows as one segment."""
        now = self.manifest()
        number = now.version + 1
        self._deal(self.rows(), number)
        self._commit(number, [number], [], now.id_type)

    def search_many(self, queries: dict[str, str], k: int, among: DataFrame | None = None) -> DataFrame:
        """query, id, score, rank from 0 of the k best items of each query, all in one plan. Queries without words find nothing.

        Of `among` (id, published_at) only those items are ranked, newer ones first where scores are equal; what is rare is
        still judged by the whole index."""
        parsed = {q: phrases(text) for q, text in queries.items()}
        defs = [(t, q, n, i, len(p), len(ps)) for q, ps in parsed.items() for n, p in enumerate(ps) for i, t in enumerate(p)]
        schema = "term string, query string, phrase int, offset int, parts int, phrases int"
        wanted = F.broadcast(self.spark.createDataFrame(defs, schema))  # the words of the queries
        now = self.manifest()
        held = self.rows(sorted({d[0] for d in defs})).select("term", "id", "positions", "length").join(wanted, "term")
        starts = F.transform("positions", lambda x: x - F.col("offset"))
        by = held.groupBy("query", "phrase", "id").agg(F.collect_list(starts).alias("s"), F.first("length").alias("length"), F.first("parts").alias("parts"), F.first("phrases").alias("phrases"))
        common = F.reduce(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), F.array_intersect)
        hits = by.where(F.size("s") == F.col("parts")).withColumn("f", F.size(common)).where("f > 0").select("query", "phrase", "id", "f", "length", "phrases")
        df = F.broadcast(hits.groupBy("query", "phrase").agg(F.count("*").alias("df")))  # as many rows as the queries have words
        n, mean = F.lit(now["items"]), F.lit(now["words"] / max(1, now["items"]))
        raw = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.when(raw > 0, raw).otherwise(F.lit(1e-6)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / mean))
        whole = hits.join(df, ["query", "phrase"]).groupBy("query", "id").agg(F.sum(part).alias("score"), F.count("*").alias("n"), F.first("phrases").alias("phrases")).where("n = phrases")
        ranked = whole.select("query", "id", F.round(-F.col("score"), 12).alias("score"))  # common words differ beyond six digits
        order = ["score", "id"]
        if among is not None:
            ranked, order = ranked.join(among.select("id", "published_at"), "id"), ["score", F.desc("published_at"), "id"]
        place = (F.row_number().over(Window.partitionBy("query").orderBy(*order)) - 1).cast("long")
        return ranked.withColumn("rank", place).where(F.col("rank") < k).select("query", "id", F.round("score", 6).alias("score"), "rank")

    def search(self, query: str, k: int) -> DataFrame:
        """id, score, rank from 0 of the k best items."""
        return self.search_many({"q": query}, k).select("id", "score", "rank")
