"""Language identification by prediction by partial matching (PPM).

A model holds, for each language, a byte context tree of orders 0 to ORDER with frozen counts. A byte's code
length in a context is -log2(count / (total + distinct)) if the context has seen the byte; else it is the
escape's, -log2(distinct / (total + distinct)), plus the code length in the context one byte shorter; below
order 0 all 256 bytes are equally likely. A context that a language never saw costs nothing to leave. A text's
language is the one whose tree codes the whole text in the fewest bits.

Training is bounded: documents in the order of a hash of their id, at most `docs_per_lang` and `bytes_per_lang` a
language. Texts of up to a tenth of `bytes_per_lang` come first and are taken whole; of longer ones, which come after
them, the beginning is taken. So the bytes end less than a tenth short of the bound, or the documents do, and one long
text neither uses them up nor reaches the driver whole. Scoring reads every byte.

Defined results: a null text, or one without a letter, is `und` with score 0. Equal code lengths go to the
smaller language name. Without any training rows every text is `und`. Repeated rows are scored each; an empty
table gives an empty result; other columns pass through and new names replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import give_back, in_batches, materialise, small

ORDER = 4
#: Groups of input tasks among which the sample is chosen before the languages' own choice.
SALTS = 16
#: Bytes scored at once.
LONGEST = 1 << 18
UND = "und"


def _keys(data: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For orders 0 to `order`: each byte with so many before it, as one number; before a text stand zero bytes."""
    wide = data.astype(np.uint64)
    out = [wide]
    first = offsets[:-1][np.diff(offsets) > 0]
    for k in range(1, order + 1):
        key = out[-1].copy()
        key[k:] |= wide[:-k] << np.uint64(8 * k)
        for t in range(k):  # byte t of a text has only t bytes before it
            at = first + t
            at = at[at < len(key)]
            at = at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at - t, "right")]
            key[at] &= np.uint64((1 << (8 * (t + 1))) - 1)
        out.append(key)
    return out


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * K.BASE) >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """Rows of float32 by 64-bit key: open addressing in an array, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.index = np.zeros(size, np.int32)
        self.rows = rows.astype(np.float32)
        self.probes = 0
        rest, at = np.arange(len(keys)), _slot(keys, self.bits)
        while len(rest):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF))
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]] = keys[rest[won]]
            self.index[at[won]] = rest[won]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], (at[left] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row's number, or -1."""
        at = _slot(keys, self.bits)
        out = np.where(self.keys[at] == keys, self.index[at], -1)
        miss = np.flatnonzero((out < 0) & (self.keys[at] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(1, self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & (len(self.keys) - 1)
            held = self.keys[at[miss]]
            hit = held == keys[miss]
            out[miss[hit]] = self.index[at[miss[hit]]]
            miss = miss[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class Model:
    """Frozen trees of all languages; `symbol[k]` has code lengths by byte and k bytes before it, `escape[k]` by those k bytes."""

    def __init__(self, langs: list[str], symbol: list[Table], escape: list[Table]):
        self.langs, self.symbol, self.escape = langs, symbol, escape

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits by text and language; a text longer than a piece is read in pieces that overlap by the longest context."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        for a, b in K.slices(offsets, LONGEST):
            low, high = int(offsets[a]), int(offsets[b])
            if high - low > LONGEST:
                for at in range(low, high, LONGEST):
                    back = min(ORDER, at - low)
                    part = data[at - back : min(at + LONGEST, high)]
                    total[a] += self._bits(part, np.array([0, len(part)]))[back:].sum(axis=0, dtype=np.float64)
            elif high > low:
                own = offsets[a : b + 1] - low
                full = np.flatnonzero(np.diff(own) > 0)
                total[a + full] = np.add.reduceat(self._bits(data[low:high], own), own[:-1][full], axis=0, dtype=np.float64)
        return total

    def _bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys = _keys(data, offsets, len(self.symbol) - 1)
        bits = np.zeros((len(data), len(self.langs)), np.float32)
        rest = np.arange(len(data))
        for k in range(len(self.symbol) - 1, -1, -1):
            key = keys[k][rest]
            row = self.symbol[k].find(key)
            seen = row >= 0
            bits[rest[seen]] += self.symbol[k].rows[row[seen]]
            rest, key = rest[~seen], key[~seen]
            if not len(rest):
                return bits
            row = self.escape[k].find(key >> np.uint64(8))
            known = row >= 0
            bits[rest[known]] += self.escape[k].rows[row[known]]
        bits[rest] += np.float32(8)
        return bits


def fold(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts if isinstance(texts, pa.Array) else texts.combine_chunks())


def train(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """Count the contexts of each language's texts and freeze their code lengths."""
    langs = sorted(samples)
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        data, offsets = K.utf8(fold(pa.array(samples[lang], pa.string())))
        grams.append([np.unique(x, return_counts=True) for x in _keys(data, offsets, order)])
    symbol: list[Table] = []
    escape: list[Table] = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(order + 1):
        every = np.unique(np.concatenate([g[k][0] for g in grams])) if langs else np.zeros(0, np.uint64)
        contexts = np.unique(every >> np.uint64(8))
        cost = np.zeros((len(every), len(langs)), np.float64)
        leave = np.zeros((len(contexts), len(langs)), np.float64)
        if below is None:
            shorter = np.full((len(every), len(langs)), 8.0)
        else:
            # a gram's suffix is among the grams below, but for starts of texts, whose zero bytes it keeps
            mask = np.uint64((1 << (8 * k)) - 1)
            shorter = below[1][np.searchsorted(below[0], every & mask)]
        of = np.searchsorted(contexts, every >> np.uint64(8))
        for j, g in enumerate(grams):
            keys, counts = g[k]
            at = np.searchsorted(every, keys)
            held = np.zeros(len(every))
            held[at] = counts
            total = np.bincount(of, held, len(contexts))
            distinct = np.bincount(of, held > 0, len(contexts))
            seen = total > 0
            leave[seen, j] = -np.log2(distinct[seen] / (total[seen] + distinct[seen]))
            cost[:, j] = shorter[:, j] + leave[of, j]
            cost[at, j] = -np.log2(counts / (total[of[at]] + distinct[of[at]]))
        below = every, cost
        symbol.append(Table(every, cost))
        escape.append(Table(contexts, leave))
    return Model(langs, symbol, escape)


def sample(docs: DataFrame, docs_per_lang: int = 300, bytes_per_lang: int = 600_000) -> dict[str, list[str]]:
    """The bounded training sample; docs has doc_id, text and lang.

    Rows are chosen without their texts: by language and SALTS groups of input tasks first, then by language, so that a task
    ranks at most SALTS x docs_per_lang rows of the groups before it. The texts of the chosen are then looked up."""
    most = max(4, bytes_per_lang // 10)
    long = F.octet_length("text") > most
    text = F.when(long, F.substring("text", 1, most // 4)).otherwise(F.col("text"))  # a character has four bytes at most
    held = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = [F.col("doc_id"), F.col("lang"), F.xxhash64("text").alias("_tie")]
    order = [F.col("_long"), F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("_tie")]
    rows = held.select(*key, long.alias("_long"), F.octet_length(text).alias("_size"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    for group in (("lang", "_salt"), ("lang",)):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= docs_per_lang)
    rows = rows.withColumn("_bytes", F.sum("_size").over(Window.partitionBy("lang").orderBy("_n"))).where(F.col("_bytes") <= bytes_per_lang)
    chosen = materialise(rows.groupBy(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("_tie").alias("_same")).agg(F.count("*").alias("times")), "language-sample")
    texts = held.select(*key, text.alias("text")).join(small(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("_tie") == F.col("_same")))
    out: dict[str, list[str]] = {}
    for r in texts.groupBy("doc_id", "lang", "_tie").agg(F.first("text").alias("text"), F.first("times").alias("times")).collect():  # at most bytes_per_lang a language
        out.setdefault(r["lang"], []).extend([r["text"]] * r["times"])
    return out


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


#: Names of the columns made.
MADE = ("lang_pred", "score", "bits_per_byte")


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True, names: tuple[str, str, str] = MADE) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits_per_byte (of the best language; null for `und`), or under other names."""
    spark = docs.sparkSession
    made = list(names)
    keep = docs.drop(*made)
    schema = T.StructType([*(f for f in keep.schema.fields if keep_text or f.name != text), *(T.StructField(c, k) for c, k in zip(made, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])
    if not model.langs:
        return (keep if keep_text else keep.drop(text)).select("*", F.lit(UND).alias(made[0]), F.lit(0.0).alias(made[1]), F.lit(None).cast("double").alias(made[2]))
    held = spark.sparkContext.broadcast(model)
    letter = "_has_letter"
    while letter in keep.columns:
        letter += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            some = batch.column(batch.schema.get_field_index(letter)).to_numpy(zero_copy_only=False)
            data, offsets = K.utf8(fold(column))
            bits = m.lengths(data, offsets)
            size = np.maximum(np.diff(offsets), 1)
            rows = np.arange(len(bits))
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, np.int64)
            if len(m.langs) > 1:
                other = bits.copy()
                other[rows, best] = np.inf
                gap = (other.min(axis=1) - bits[rows, best]) / size
                score = 1 - np.exp2(-8 * gap)
            else:
                score = np.ones(len(bits))
            said = np.array(m.langs, object)[best]
            said[~some] = UND
            rest = batch.drop_columns([letter] if keep_text else [letter, text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(said, pa.string()), pa.array(np.where(some, np.clip(score, 0, 1), 0.0)), pa.array(bits[rows, best] / size, mask=~some)],
                names=[*rest.schema.names, *made],
            )

    return in_batches(keep).withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def identify(docs: DataFrame, docs_per_lang: int = 300, bytes_per_lang: int = 600_000, keep_text: bool = True, names: tuple[str, str, str] = MADE) -> DataFrame:
    """Train on labelled rows outside the held-out fold, then predict every row of docs (doc_id, text, lang, ...)."""
    model = train(sample(docs.where(~F.coalesce(held_out(), F.lit(False))), docs_per_lang, bytes_per_lang))
    found = predict(docs, model, keep_text=keep_text, names=names)
    del model
    give_back()
    return found
