"""Tables that grow by segments and are read at a version.

A change writes its segments first; then a manifest that names all segments that count is written aside and renamed to
its version's name. Readers take the latest manifest, so they see a change whole or not at all, and a failed change
leaves files that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession


class Conflict(RuntimeError):
    """Another change committed this version first."""


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    top, fs = _hadoop(spark, f"{path}/manifest")
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def latest(spark: SparkSession, path: str) -> Row | None:
    """The last manifest's one row, with version; None before the first."""
    found = committed(spark, path)
    return spark.read.parquet(f"{path}/manifest/version={found[-1]}").first() if found else None


def commit(spark: SparkSession, path: str, version: int, values: dict, schema: str) -> None:
    """Publish a manifest (values of the schema) as a version; raises Conflict if that version is there."""
    held: DataFrame = spark.createDataFrame([Row(version=version, **values)], f"version int, {schema}")
    aside, fs = _hadoop(spark, f"{path}/manifest/.new-{uuid.uuid4().hex}")
    held.coalesce(1).write.parquet(aside.toString())
    to = _hadoop(spark, f"{path}/manifest/version={version}")[0]
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, True)
        raise Conflict(f"version {version} of {path} is there")
