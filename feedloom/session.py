"""Sessions and what executors need from this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "feedloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library's results rely on (UTC) and those it wants (AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors once, for functions that run there in Python."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        made = Path(tempfile.mkdtemp(prefix="feedloom-src-")) / f"{root.name}.zip"
        with zipfile.ZipFile(made, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(made))
        _SHIPPED.add(app)
    return spark


def new_folder(spark: SparkSession) -> str:
    """A name of its own in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="feedloom-")
    return f"{base}/feedloom-streams/{uuid.uuid4().hex}"
