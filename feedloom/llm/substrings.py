"""Removing long word sequences that already stand in an earlier document, by recompression.

Each text's words become symbols (hashes of their bytes). A round of recompression names runs of one symbol and
then pairs: every symbol falls left or right by a bit of its name and the round, and a left symbol followed by a
right one becomes one symbol. A name is a hash of what it stands for, so equal substrings get equal interior
symbols in every document of the corpus without a dictionary that all executors would share.

Which symbols a window of WINDOW words is sure to hold is not guessed: along with each symbol goes the interval of words
that decided it (a left symbol left alone needs the next symbol, and so on), and a symbol counts for a window only
if that interval lies inside. So two equal windows hold the same counted symbols. A window's anchor is the best of
them, of the highest level and then of the smallest hash; a window without any (short periods may leave one) is
its own anchor. Anchors that stand in one document only end the search for their windows; windows of the others
are named by 128 bits of hash and grouped, and those of a document with a larger id than the smallest that has
the window are repeats. Texts equal as a whole are handled before, as classes: the first document stands for all.

Verification compares whole windows: 50 word hashes, of 64 bits each, enter two independent 64-bit names.

Skew: names and windows that several texts of one batch share are settled there; at most two rows for each name and one
for each window of a batch travel on, so a passage that a third of all texts hold is no large group anywhere. What does
meet is sorted and read as a stream that holds one row.

Defined results: a null text has no words. Fewer words than WINDOW: nothing is removed. A repeated doc_id: rows
with one id are one document for windows (nothing is removed for standing in itself), each row gives a row. A
null doc_id sorts after all others and is one document. An empty table gives an empty result; texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise, release

WINDOW = 50
ROUNDS = 9
#: Levels at which runs are named before pairs.
RUN_LEVELS = (1, 4)
#: Stands for a null doc_id, after every other.
LAST = (1 << 63) - 1
#: Words that one pass of NumPy holds.
WORDS = 1 << 18


def _salt(level: int, by: np.uint64) -> np.uint64:
    return np.uint64(level * int(by) & 0xFFFFFFFFFFFFFFFF)


def _round(name: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, dep: np.ndarray, end: np.ndarray, level: int) -> list[np.ndarray]:
    """One naming of runs and one of pairs. Symbols come with their document, words [low, high) and deciding words [dep, end)."""
    n = len(name)
    if not n:
        return [name, doc, low, high, dep, end]
    if level in RUN_LEVELS:
        same = np.zeros(n, bool)  # equal to the one before it
        same[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        first = np.flatnonzero(~same)
        last = np.append(first[1:], n) - 1
        count = last - first + 1
        runs = count > 1
        new = name[first].copy()
        new[runs] = K.mix(new[runs] * K.STEP + count[runs].astype(np.uint64) + np.uint64(level << 8))
        # where a run ends, even of one symbol, its neighbours decide; at an edge of a text no window can tell
        left = np.zeros(len(first), bool)
        left[1:] = doc[first[1:] - 1] == doc[first[1:]]
        right = np.zeros(len(first), bool)
        right[:-1] = doc[last[:-1] + 1] == doc[last[:-1]]
        d = np.where(left, np.minimum(dep[first], dep[first - 1]), dep[first] - WINDOW)
        e = np.where(right, np.maximum(end[last], end[(last + 1) % n]), end[last] + WINDOW)
        name, doc, low, high, dep, end = new, doc[first], low[first], high[last], d, e
        n = len(name)
    bit = (K.mix(name + _salt(level, K.BASE)) & np.uint64(1)).astype(bool)  # true: right
    joined = np.zeros(n, bool)  # left symbol whose right neighbour joins it
    inner = doc[1:] == doc[:-1]
    joined[:-1] = ~bit[:-1] & bit[1:] & inner
    gone = np.zeros(n, bool)
    gone[1:] = joined[:-1]
    # one left alone was decided by its neighbour too: on its right if it is a left one, on its left if a right one
    d, e = dep.copy(), end.copy()
    alone = ~joined & ~gone
    to_right = np.flatnonzero(alone & ~bit)
    ok = np.zeros(len(to_right), bool)
    within = to_right < n - 1
    ok[within] = inner[to_right[within]]
    e[to_right] = np.where(ok, np.maximum(end[to_right], end[np.minimum(to_right + 1, n - 1)]), end[to_right] + WINDOW)
    d[to_right] = np.where(ok, np.minimum(dep[to_right], dep[np.minimum(to_right + 1, n - 1)]), dep[to_right])
    to_left = np.flatnonzero(alone & bit)
    ok = np.zeros(len(to_left), bool)
    within = to_left > 0
    ok[within] = inner[to_left[within] - 1]
    d[to_left] = np.where(ok, np.minimum(dep[to_left], dep[np.maximum(to_left - 1, 0)]), dep[to_left] - WINDOW)
    e[to_left] = np.where(ok, np.maximum(end[to_left], end[np.maximum(to_left - 1, 0)]), end[to_left])
    name = name.copy()
    at = np.flatnonzero(joined)
    name[at] = K.mix((name[at] * K.STEP) ^ K.mix(name[at + 1] + np.uint64(level)))
    high = high.copy()
    high[at] = high[at + 1]
    d[at] = np.minimum(dep[at], dep[at + 1])
    e[at] = np.maximum(end[at], end[at + 1])
    keep = ~gone
    return [name[keep], doc[keep], low[keep], high[keep], d[keep], e[keep]]


def anchors(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word, the anchor of the window that it starts (0: it starts none)."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][doc] - np.arange(n) if n else np.zeros(0, np.int64)
    anchor = np.zeros(n, np.uint64)
    open_ = np.flatnonzero(left >= WINDOW)
    at = np.arange(n)
    symbols = [hashes, doc, at, at + 1, at, at + 1]
    levels = []
    for level in range(1, ROUNDS + 1):
        symbols = _round(*symbols, level)
        levels.append((level, symbols))
    for level, (name, _, _, _, dep, end) in reversed(levels):
        if not len(open_):
            break
        fit = end - dep <= WINDOW
        rank = K.mix(name[fit] + _salt(level, K.STEP))
        dep, end = dep[fit], end[fit]
        # windows that start in [end - WINDOW, dep] hold the symbol; the smallest rank wins
        start = np.maximum(end - WINDOW, 0)
        width = dep - start + 1
        # in powers of two: a symbol covers its interval by two overlapping blocks
        size = 1 << max(0, int(WINDOW).bit_length() - 1)
        tables = {}
        power = np.frexp(width.astype(np.float64))[1] - 1
        for p in range(int(size).bit_length()):
            mine = power == p
            if mine.any():
                block = tables[p] = np.full(n + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
                np.minimum.at(block, start[mine], rank[mine])
                np.minimum.at(block, start[mine] + width[mine] - (1 << p), rank[mine])
        held = None
        for p in range(int(size).bit_length() - 1, -1, -1):
            own = tables.get(p)
            if held is not None:  # a block of 2^(p+1) is two of 2^p
                half = 1 << p
                spread = held.copy()
                np.minimum(spread[half:], held[:-half], out=spread[half:])
                held = spread if own is None else np.minimum(spread, own)
            else:
                held = own
        if held is None:
            continue
        got = held[open_]
        found = got != np.uint64(0xFFFFFFFFFFFFFFFF)
        anchor[open_[found]] = got[found]
        open_ = open_[~found]
    if len(open_):
        anchor[open_] = K.grams(hashes, WINDOW, salt=3)[open_]
    return anchor


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For runs of texts: the first one's number, word hashes, index of each text's first word."""
    data, offsets = K.utf8(column)
    for a, b in K.slices(offsets, K.SLICE):
        low = offsets[a]
        part = data[low : offsets[b]]
        starts, ends, first = K.words(part, offsets[a : b + 1] - low, K.SPACED)
        yield a, K.word_hashes(part, starts, ends), first, (starts, ends, part)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, n_words, mark and tag of the whole sequence of words, kept_sha256 if nothing is removed."""
    for batch in batches:
        n, mark, tag, kept = [], [], [], []
        for _, hashes, first, (starts, ends, part) in _texts(batch.column("text")):
            for i in range(len(first) - 1):
                s, e = first[i], first[i + 1]
                n.append(int(e - s))
                mark.append(_mark(hashes[s:e]))
                tag.append(int.from_bytes(mark[-1][:8], "big", signed=True))
                kept.append(_digest(part, starts[s:e], ends[s:e]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(tag, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_words", "mark", "tag", "sha"])


def _digest(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of these words joined by one space."""
    return sha256(_joined(part, starts, ends)).hexdigest()


def _joined(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return b""
    raw = part[starts[0] : ends[-1]].tobytes()
    if int((ends - starts).sum()) + len(starts) - 1 == len(raw):  # one byte between words, whatever it is
        return raw.translate(_SPACES)
    return b" ".join([raw[s:e] for s, e in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)])


_SPACES = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in range(256))


def _tag(hashes: np.ndarray) -> int:
    """64 bits of a text's mark."""
    return int.from_bytes(_mark(hashes)[:8], "big", signed=True)


def _mark(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, tag, known: the anchors of each text. Those that two texts of a run share are known; two stand for them."""
    for batch in batches:
        for _, hashes, first, _ in _texts(batch.column("text")):
            anchor = anchors(hashes, first)
            tag = np.repeat(np.array([_tag(hashes[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)], np.int64), np.diff(first))
            step = np.ones(len(anchor), bool)
            step[1:] = (anchor[1:] != anchor[:-1]) | (tag[1:] != tag[:-1])
            step &= anchor != 0
            name, tag = anchor[step].view(np.int64), tag[step]
            order = np.lexsort((tag, name))
            name, tag = name[order], tag[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (tag[1:] != tag[:-1])
            name, tag = name[new], tag[new]
            group, size = _groups(name)
            known = size[group] > 1
            low = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
            two = low[size > 1]
            open_ = np.concatenate([np.flatnonzero(~known), two, two + 1])
            done = np.flatnonzero(known)
            at = np.concatenate([open_, done])
            yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(tag[at]), pa.array(np.arange(len(at)) >= len(open_))], names=["name", "tag", "known"])


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: each one's group, and the groups' sizes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    group = np.cumsum(new) - 1
    return group, np.bincount(group)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name and tag, those whose name has several tags. Nothing but the last group's head is held."""
    last, head, said = None, 0, False
    for batch in batches:
        name, tag = batch.column("name").to_numpy(), batch.column("tag").to_numpy()
        if not len(name):
            continue
        group, size = _groups(name)
        start = np.cumsum(size) - size
        heads = tag[start].copy()
        told = np.zeros(len(size), bool)
        if last == name[0]:
            heads[0], told[0] = head, said
        differs = tag != heads[group]
        several = np.zeros(len(size), bool)
        several[group[differs]] = True
        now = several & ~told
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([name[differs], name[start[now]]])), pa.array(np.concatenate([tag[differs], heads[now]]))], names=["name", "tag"])
        last, head, said = name[-1], heads[-1], bool(told[-1] or several[-1])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w1, w2, doc, at: every window whose anchor is among the row's names; `at` holds 16 bits of the tag above its word.
    A window that stands in a smaller document of the same run is known to be a repeat: its w1 and w2 are null."""
    for batch in batches:
        docs, tags, names = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("names")
        ends, flat = names.offsets.to_numpy(), names.values.to_numpy()
        for a, hashes, first, _ in _texts(batch.column("text")):
            anchor = anchors(hashes, first)
            one, two = K.grams(hashes, WINDOW).view(np.int64), K.grams(hashes, WINDOW, salt=1).view(np.int64)
            keep = []
            for i in range(len(first) - 1):
                s, e = first[i], first[i + 1]
                if _tag(hashes[s:e]) == tags[a + i]:
                    own = flat[ends[a + i] : ends[a + i + 1]].view(np.uint64)
                    keep.append(s + np.flatnonzero(np.isin(anchor[s:e], own) & (anchor[s:e] != 0)))
            at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            of = np.searchsorted(first, at, "right") - 1
            doc, place = docs[a + of], (at - first[of]) | ((tags[a + of] & 0xFFFF) << 32)
            w1, w2 = one[at], two[at]
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc, place = w1[order], w2[order], doc[order], place[order]
            group, size = _groups(w1, w2)
            known = doc > doc[np.cumsum(size) - size][group] if len(size) else np.zeros(0, bool)
            for x in range(0, len(at), WORDS):
                part = slice(x, x + WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(w1[part], mask=known[part]), pa.array(w2[part], mask=known[part]), pa.array(doc[part]), pa.array(place[part])], names=["w1", "w2", "doc", "at"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window and document, those after the window's first document."""
    last, head = None, 0
    for batch in batches:
        w1, w2, doc = (batch.column(c).to_numpy() for c in ("w1", "w2", "doc"))
        if not len(doc):
            continue
        group, size = _groups(w1, w2)
        heads = doc[np.cumsum(size) - size]
        if last == (w1[0], w2[0]):
            heads[0] = head
        yield batch.select(["doc", "at"]).filter(pa.array(doc > heads[group]))
        last, head = (w1[-1], w2[-1]), heads[-1]


def spans(starts: list[int] | np.ndarray) -> np.ndarray:
    """Merged [from, to) of windows that start at these words, as rows."""
    s = np.unique(np.asarray(starts, np.int64))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > s[:-1] + WINDOW
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    return np.stack([s[new], s[last] + WINDOW], axis=1)


def _cutter(with_text: bool):
    """doc, tag, n_removed, sha and, if asked for, kept: the text without the words of the row's windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tags, removed, shas, texts = [], [], [], [], []
            parts, starts_of = batch.column("part").to_numpy(), batch.column("starts")
            bounds, flat = starts_of.offsets.to_numpy(), starts_of.values.to_numpy()
            for a, hashes, first, (starts, ends, part) in _texts(batch.column("text")):
                for i in range(len(first) - 1):
                    s, e = first[i], first[i + 1]
                    tag = _tag(hashes[s:e])
                    if tag & 0xFFFF != parts[a + i]:
                        continue  # another text of the same doc_id
                    tags.append(tag)
                    keep = np.ones(e - s, bool)
                    for x, y in spans(flat[bounds[a + i] : bounds[a + i + 1]]):
                        keep[x:y] = False
                    raw = part[starts[s] : ends[e - 1]].tobytes()
                    p, q = starts[s:e][keep] - starts[s], ends[s:e][keep] - starts[s]
                    kept = b" ".join([raw[x:y] for x, y in zip(p.tolist(), q.tolist(), strict=True)])
                    rows.append(a + i)
                    removed.append(int((~keep).sum()))
                    shas.append(sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode())
            ids = batch.select(["doc"]).take(pa.array(rows, pa.int64()))
            made = [pa.array(tags, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), *([pa.array(texts, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*ids.columns, *made], names=["doc", "tag", "n_removed", "sha", *(["kept"] if with_text else [])])

    return cut


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc, n_words, mark, tag, sha); heads, the first document of each class that can hold a window (mark, tag,
    doc); for heads, the starts of windows that a smaller document has too (doc, 16 bits of its tag, starts)."""
    given = _given(docs)
    rows = materialise(given.mapInArrow(_classes, "doc long, n_words long, mark binary, tag long, sha string"), "rows")
    heads = materialise(rows.where(F.col("n_words") >= WINDOW).groupBy("mark", "tag").agg(F.min("doc").alias("doc")), "heads")
    names = materialise(given.mapInArrow(_anchors, "name long, tag long, known boolean"), "names")
    met = names.where("not known").select("name", "tag").repartition("name").sortWithinPartitions("name", "tag").mapInArrow(_shared, "name long, tag long")
    shared = met.select("tag", "name").union(names.where("known").select("tag", "name"))
    wanted = materialise(shared.groupBy("tag").agg(F.collect_set("name").alias("names")).join(heads.select("tag", "doc"), "tag"), "wanted")
    release(names)
    found = given.join(wanted, "doc").select("doc", "tag", "names", "text").mapInArrow(_windows, "w1 long, w2 long, doc long, at long")
    found = materialise(found, "windows")
    release(wanted)
    known, open_ = found.where("w1 is null").select("doc", "at"), found.where("w1 is not null")
    later = open_.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc").mapInArrow(_later, "doc long, at long")
    part = F.call_function("shiftright", F.col("at"), F.lit(32))
    starts = known.union(later).groupBy("doc", part.alias("part")).agg(F.collect_list((F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")).alias("starts"))
    starts = materialise(starts, "starts")
    release(found)
    return rows, heads, starts


def _cut(docs: DataFrame, starts: DataFrame, with_text: bool) -> DataFrame:
    schema = "doc long, tag long, n_removed long, sha string" + ", kept string" * with_text
    return _given(docs).join(starts, "doc").select("doc", "part", "starts", "text").mapInArrow(_cutter(with_text), schema).dropDuplicates(["doc", "tag"])


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row for each of docs (doc_id, text)."""
    rows, heads, starts = repeats(docs)
    cut = _cut(docs, starts, False)
    known = heads.withColumnRenamed("doc", "head").join(cut.select(F.col("doc").alias("head"), "tag", "n_removed", F.col("sha").alias("cut_sha")), ["head", "tag"], "left").drop("tag")
    out = rows.join(known, "mark", "left")
    copy = F.col("head").isNotNull() & (F.col("doc") > F.col("head"))
    return out.select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def clean_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text of documents that lose words and are not whole copies, with the words they keep joined by one space."""
    _, _, starts = repeats(docs)
    return _cut(docs, starts, True).select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), F.col("kept").alias("text"))
