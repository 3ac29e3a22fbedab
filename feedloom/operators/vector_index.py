"""The vectors of recent items as a versioned table, kept fresh by age.

A manifest names the segments, the items in them and when they were last known to be whole. An index younger than `ttl`
seconds is used as it is. An older one looks for items that it does not hold: none only renews the manifest, up to `most`
are embedded and appended as a segment, more (or no index at all) mean that all recent items are embedded anew. Appending
keeps items that have left the window since or became duplicates, as filters follow a search; a rebuild drops them.
The clock is an argument. Null ids take no part; a null title or content is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..providers import Providers, embedding
from . import versions
from .retrieval import vector_top

_MANIFEST = "segments array<int>, items long, built_at timestamp_ntz"


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    providers: Providers = field(default_factory=Providers)
    ttl: int = 600
    most: int = 200
    days: int = 7

    def manifest(self) -> Row | None:
        return versions.latest(self.spark, self.path)

    def vectors(self) -> DataFrame:
        """id, embedding of the indexed items."""
        now = self.manifest()
        if now is None or not now.segments:
            raise ValueError(f"no index in {self.path}")
        return self.spark.read.parquet(*(f"{self.path}/vectors/segment={s}" for s in now.segments))

    def recent(self, items: DataFrame, at: datetime) -> DataFrame:
        """Items of the window that are no duplicates."""
        held = F.col("id").isNotNull() & (F.col("published_at") >= F.lit(at - timedelta(days=self.days)).cast("timestamp_ntz"))
        return items.where(held & ~F.coalesce("is_duplicate", F.lit(False)))

    def _write(self, items: DataFrame, number: int) -> int:
        """Embed items as a segment; how many there were."""
        text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, 200))
        to = f"{self.path}/vectors/segment={number}"
        items.select("id", embedding(text, self.providers).alias("embedding")).write.mode("overwrite").parquet(to)
        return self.spark.read.parquet(to).count()

    def _commit(self, number: int, segments: list[int], items: int, at: datetime | None) -> None:
        versions.commit(self.spark, self.path, number, {"segments": segments, "items": items, "built_at": at}, _MANIFEST)

    def ensure_fresh(self, items: DataFrame, at: datetime) -> str:
        """What was needed: fresh, unchanged, appended or rebuilt."""
        now = self.manifest()
        if now is not None and now.built_at is not None and (at - now.built_at).total_seconds() < self.ttl:
            return "fresh"
        recent, number = self.recent(items, at), 0 if now is None else now.version + 1
        if now is not None and now.segments:
            new = recent.join(self.vectors().select("id"), "id", "left_anti")
            n = new.limit(self.most + 1).count()
            if n <= self.most:
                added = self._write(new, number) if n else 0
                self._commit(number, [*now.segments, number] if n else list(now.segments), now["items"] + added, at)
                return "appended" if n else "unchanged"
        n = self._write(recent, number)
        self._commit(number, [number], n, at)
        return "rebuilt"

    def invalidate(self) -> None:
        """Make the next use look for new items."""
        now = self.manifest()
        if now is not None:
            self._commit(now.version + 1, list(now.segments), now["items"], None)

    def search(self, query: str, k: int) -> DataFrame:
        """id, score, rank from 0 of the k items nearest to a text."""
        one = self.spark.createDataFrame([(query,)], "text string").select(embedding("text", self.providers).alias("embedding"))
        return vector_top(self.vectors(), one, k)
