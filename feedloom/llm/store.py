"""Cutting lineage with tables written to the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local one, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="feedloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/feedloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, so that a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in Parquet up to which small() lets a join broadcast a written table.
SMALL = 2 << 20


def _folders(table: DataFrame) -> list:
    """Hadoop paths, with their file systems, of the folders that materialise() wrote for a table."""
    context = table.sparkSession.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(x) for x in {f.rpartition("/")[0] for f in table.inputFiles()} if "/feedloom/" in x]
    return [(p, p.getFileSystem(context._jsc.hadoopConfiguration())) for p in paths]


def is_small(table: DataFrame) -> bool:
    """Whether the files that a table is read from are few bytes; asks the file system, not Spark."""
    return sum(store.getContentSummary(path).getLength() for path, store in _folders(table)) <= SMALL


def small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small, else as it is."""
    return F.broadcast(table) if is_small(table) else table


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialise() once nothing that is still to run reads them, and give memory back.

    The driver's JVM then collects its garbage, upon which Spark drops the shuffle files of finished queries."""
    for df in tables:
        for path, store in _folders(df):
            store.delete(path, True)
    if tables:
        give_back()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Collect this process's garbage and, where its allocator can, return freed memory to the system."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of an Arrow batch; without a bound, ten thousand rows of long texts or large sets are one batch.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes too, unless its own bound is a smaller one."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    own = str(conf.get(key, None) or "")
    if not own.isdigit() or int(own) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df
