"""Benchmark decontamination with a broadcast set of normalised n-grams; DataFrame functions only.

A-Z become a-z; words are runs of digits, a-z and characters beyond ASCII. An item's windows are its runs of `n`
words; an item of fewer words, but not none, is one window. The scan hashes the words that start at every position
of every text, in one generated stage with the lookup: the hashes of all windows are a broadcast table as long as
their number is at most BROADCAST_WINDOWS (counted first), else the join is a shuffled one. A hit of the hash counts
only if the words themselves are equal.

Defined results: a null text or item text has no words. An item without an id marks hits but is in no list of items;
items with equal ids are one item. Rows are matched with their hits by doc_id and a hash of the text, so repeated
rows, repeated ids and null ids each get their own right row. Empty tables give no hits. Other columns are kept by
`scrub`, whose result has the columns of docs and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 10
BROADCAST_WINDOWS = 500_000
#: What stands between words, before A-Z become a-z. Splitting is many times faster than finding words one by one.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """The words of a text, as an array; empty for a null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() is A-Z to a-z where every character is ASCII, and faster
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, BETWEEN), "")


def _hashes(array: str) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def _grams(hashes: str, n: int) -> Column:
    """Hashes of every n words, by start."""
    at = F.sequence(F.lit(0), F.size(hashes) - n)
    return F.when(F.size(hashes) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """hash, n, gram (the words), item_id: each item's windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0).withColumn("h", _hashes("w"))
    size = F.least(F.lit(n), F.size("w"))
    at = items.select("item_id", size.alias("n"), "w", "h", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("n"))
    return at.select(F.xxhash64(cut("h")).alias("hash"), "n", F.array_join(cut("w"), " ").alias("gram"), "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_hash, starts (array of start and length of hit windows), items (array of item ids), for texts with hits."""
    found = windows(benchmark, n)
    grams = found.select("hash", "gram").distinct()
    sizes = {r["n"]: r["count"] for r in found.select("n", "gram").distinct().groupBy("n").count().collect()}  # at most n rows
    if not sizes:
        sizes = {n: 0}
    few = sum(sizes.values()) <= BROADCAST_WINDOWS
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    texts = texts.withColumn("h", _hashes("w"))
    # explode, lookup and comparison are one generated stage, in which the array of words is never copied
    each = [F.struct(F.lit(k).alias("n"), _grams("h", k).alias("g")) for k in sorted(sizes)]
    spread = texts.select("doc_id", "text_hash", "w", (each[0] if len(each) == 1 else F.explode(F.array(*each))).alias("p"))
    spread = spread.select("doc_id", "text_hash", "w", F.col("p.n").alias("n"), F.col("p.g").alias("g"))
    # not outer, a filter on the array's size would split and hash every text twice
    scan = spread.select("doc_id", "text_hash", "w", "n", F.posexplode_outer("g").alias("at", "hash"))
    # words hold no |, so a gram and its | at the start of another such text is all of it; as an equality this would be hashed for every place
    same = F.startswith(F.concat(F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " "), F.lit("|")), F.concat("gram", F.lit("|")))
    if few:
        met = scan.join(F.broadcast(grams), "hash").where(same).select("doc_id", "text_hash", "at", "n", "gram")
    else:  # places travel without their texts, and those that some hash matches meet them again
        near = scan.select("doc_id", "text_hash", "at", "n", "hash").join(grams.select("hash").distinct(), "hash", "left_semi")
        near = near.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "n", "hash")).alias("places"))
        back = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "w").dropDuplicates(["_id", "_text"])
        near = near.join(back, near["doc_id"].eqNullSafe(back["_id"]) & (near["text_hash"] == back["_text"]))
        said = F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["hash"].alias("hash"), F.array_join(F.slice("w", x["at"] + 1, x["n"]), " ").alias("gram")))
        met = near.select("doc_id", "text_hash", F.explode(said).alias("x")).select("doc_id", "text_hash", "x.*").join(grams, ["hash", "gram"]).select("doc_id", "text_hash", "at", "n", "gram")
    by_gram = found.select("gram", "item_id")
    places = met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "n")).alias("starts"), F.collect_set("gram").alias("grams"))
    pairs = places.select("doc_id", "text_hash", "starts", F.explode("grams").alias("gram")).join(F.broadcast(by_gram) if few else by_gram, "gram")
    out = pairs.groupBy("doc_id", "text_hash").agg(F.first("starts").alias("starts"), F.collect_set("item_id").alias("items"))
    return out.select("doc_id", "text_hash", F.array_sort("starts").alias("starts"), F.array_sort("items").alias("items"))


def _covered(starts: Column) -> Column:
    """Words in the union of windows (at, n), sorted."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(acc["end"], x["at"]))).alias("sum"), F.greatest(acc["end"], x["at"] + x["n"]).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["sum"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row for each of docs (doc_id, text)."""
    found = hits(docs, benchmark, n).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")).cast("long").alias("n_words"))
    n_hit = F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long")
    return rows.join(found, rows.doc_id.eqNullSafe(found["_id"]) & (rows.text_hash == found["_hash"]), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def scrub(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words and what stands before them cut out."""
    h, starts = _name(docs, "_text_hash"), _name(docs, "_starts")
    found = hits(docs.select("doc_id", "text"), benchmark, n).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("starts").alias(starts))
    rows = docs.withColumn(h, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(found["_id"]) & (rows[h] == found["_hash"])
    if remove == "documents":
        return rows.join(found, same, "left_anti").drop(h)
    pieces = F.regexp_extract_all(rows["text"], F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + RAW_WORD), F.lit(0))
    tail = F.regexp_extract(rows["text"], r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    clean = F.filter(pieces, lambda p, i: ~F.exists(starts, lambda s: (i >= s["at"]) & (i < s["at"] + s["n"])))
    text = F.when(F.col(starts).isNull(), rows["text"]).otherwise(F.concat(F.array_join(clean, ""), tail))
    return rows.join(found, same, "left").select(*(text.alias(c) if c == "text" else rows[c] for c in docs.columns))
