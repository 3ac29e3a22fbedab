"""Sharding by fixed virtual slots; DataFrame functions only.

Records hash into SLOTS virtual slots. Bytes and rows are summed by slot, and a slot-to-shard map is made from those
sums alone: the heaviest slot first, each to the lightest shard so far. The map has SLOTS rows whatever the data's
size, and up to 2 x HEAVY x shards more where slots are split. It is stored by version. A later run loads the latest
version and edits it, where shards were added or taken away, have drifted apart, or slots are new: only the slots that
have to move do, and the edited map is the next version. The law that holds is `bytes`: shards have nearly equal sizes.

Inside a shard, rows are numbered from 0 without gaps: a slot's rows follow those of the shard's slots before it, so
no task ever numbers a whole shard.

Defined results: size is the text's UTF-8 bytes plus 1, a null text has none; its text_crc32 is null. A null doc_id
hashes with its text like any other. Rows equal in id and text hash alike; where they, or anything else, make a slot
heavy, it is split by the rows' places in the input, so that no slot holds more than a sliver of a shard. An empty table gives an empty result; other columns are kept by `assign`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise

SLOTS = 4096
#: A slot with more than a HEAVY-th of a shard's fair share of bytes is split in as many parts as that share goes into it.
HEAVY = 64
LAW = "bytes"


def virtual_slot(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(F.col("text").cast("binary"))), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, part (a number of 63 bits by the row's place in the input: equal rows have no other difference)."""
    part = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), virtual_slot(slots).alias("vslot"), part.alias("part"))


def split(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """rows (of sized, written) with heavy slots split: part p of slot s becomes slot s + p x slots, and a slot's first part,
    which has a row, keeps its number. Slots stay as they are while none holds more than a HEAVY-th of a shard's fair share."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.min("part").alias("least"))
    total = F.sum("bytes").over(Window.partitionBy())  # at most `slots` rows
    parts = sums.withColumn("parts", F.ceil(F.col("bytes") / total * (shards * HEAVY)))
    heavy = parts.where("parts > 1").select(F.col("vslot").alias("_heavy"), "least", "parts")  # fewer than shards x HEAVY
    held = rows.join(F.broadcast(heavy), F.col("vslot") == F.col("_heavy"), "left")
    part = F.coalesce(F.pmod(F.col("part") - F.col("least"), F.col("parts")), F.lit(0))
    return held.withColumn("vslot", F.col("vslot") + part * slots).drop("part", "least", "parts", "_heavy")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """vslot, bytes, n: at most SLOTS rows."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def plan(slot_bytes: DataFrame, shards: int) -> DataFrame:
    """vslot, shard from vslot and bytes: a fold over one array with an entry for each slot and part."""
    one = slot_bytes.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        best = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        load = F.transform(acc["load"], lambda v, i: F.when(i == best, v - x["less"]).otherwise(v))
        return F.struct(load.alias("load"), F.array_append(acc["to"], best).alias("to"))

    placed = one.select("slots", F.aggregate("slots", start, put, lambda acc: acc["to"]).alias("to"))
    return placed.select(F.explode(F.arrays_zip(F.col("slots.vslot").alias("vslot"), F.col("to").alias("to"))).alias("x")).select(F.col("x.vslot").alias("vslot"), F.col("x.to").alias("shard"))


def rebalance(slot_bytes: DataFrame, old: DataFrame, shards: int, over: float = 0.005) -> DataFrame:
    """The map `old` (vslot, shard) edited for so many shards: a shard gives up its lightest slots only while it is heavier than
    its fair share by more than `over`; what is given up, and slots of shards that are gone, go to the lightest."""
    had = slot_bytes.join(old, "vslot", "left")
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # at most SLOTS rows
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    marked = had.withColumn("fair", F.sum("bytes").over(all_) / shards).withColumn("kept", F.col("shard").isNotNull() & (F.col("shard") < shards) & (kept <= F.col("fair") * (1 + over)))
    one = marked.agg(
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("slots"),
        *(F.coalesce(F.sum(F.when(F.col("kept") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).alias(f"l{k}") for k in range(shards)),
    )
    start = F.struct(F.array(*(F.col(f"l{k}").cast("long") for k in range(shards))).alias("load"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        best = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        load = F.transform(acc["load"], lambda v, i: F.when(i == best, v - x["less"]).otherwise(v))
        return F.struct(load.alias("load"), F.array_append(acc["to"], best).alias("to"))

    moved = one.select("slots", F.aggregate("slots", start, put, lambda acc: acc["to"]).alias("to"))
    moved = moved.select(F.explode(F.arrays_zip(F.col("slots.vslot").alias("vslot"), F.col("to").alias("to"))).alias("x")).select(F.col("x.vslot").alias("vslot"), F.col("x.to").alias("shard"))
    return marked.where("kept").select("vslot", "shard").union(moved)


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of the map; versions are never overwritten."""
    to = f"{path.rstrip('/')}/version={version}"
    slot_map.coalesce(1).write.mode("errorifexists").parquet(to)
    return slot_map.sparkSession.read.parquet(to)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def latest(spark: SparkSession, path: str) -> int | None:
    """The last version stored under a path; none before the first."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return max(int(f.rpartition("/version=")[2].partition("/")[0]) for f in held.inputFiles())  # a file for each version


def live_map(slot_bytes: DataFrame, shards: int, path: str) -> DataFrame:
    """The map under a path for these slots: version 0 if there is none yet, else the latest, edited where it has to be and then
    stored as the next version."""
    spark = slot_bytes.sparkSession
    version = latest(spark, path)
    if version is None:
        return store_map(plan(slot_bytes, shards), path, 0)
    old = load_map(spark, path, version)
    new = materialise(rebalance(slot_bytes, old, shards), "edited-map")
    changed = not new.join(old, ["vslot", "shard"], "left_anti").isEmpty()
    return store_map(new, path, version + 1) if changed else new


def number(rows: DataFrame, sums: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows (of split) with shard and slot, the place in the shard; sums are its slot_sizes."""
    # a row for each slot on the broadcast side
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n")
    placed = sums.join(F.broadcast(slot_map), "vslot").select("vslot", "shard", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("_own", own).join(F.broadcast(placed), "vslot").withColumn("slot", (F.col("base") + F.col("_own")).cast("long")).drop("_own", "base")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, one row for each of docs (doc_id, text); by the map that
    lives under map_path, or one made for this call."""
    rows = split(materialise(sized(docs, slots), "sizes"), shards, slots)
    sums = materialise(slot_sizes(rows), "slots")
    loads = sums.select("vslot", "bytes")
    slot_map = live_map(loads, shards, map_path) if map_path else plan(loads, shards)
    return number(rows, sums, slot_map).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def assign(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with the column shard, by a stored map: no shuffle. Rows of a slot that was split go where its first part is."""
    name = "_vslot"
    while name in docs.columns:
        name += "_"
    held = docs.drop("shard").withColumn(name, virtual_slot(slots))
    return held.join(F.broadcast(slot_map.withColumnRenamed("vslot", name)), name, "left").drop(name)
