"""Token ids in training order as fixed-stride binary shards.

Each input partition is tokenised into one stream, a document's tokens followed by the end mark, and cut into sequences
of `length` ids (the last one of a partition is filled up with end marks). A first pass counts the sequences of each
partition, which gives every sequence a number from 0 without gaps. A keyed Feistel permutation of the next power
of four, walked along its cycles until it falls below the number of sequences, gives the number's slot in training order. A
shard is a range of slots; its task sorts them and writes `stride` bytes (little-endian 16-bit ids) for each, so slot s
is at (s mod per_shard) x stride in shard s div per_shard, and a run resumes anywhere by arithmetic.

Both passes read the same splits, so docs must be a table that has been written, not a plan whose rows may come in
another order. Shards are written under another name and renamed when whole: a task that runs again writes the same bytes.

Defined results: a null or empty text gives an end mark alone. Repeated rows are tokenised each. An empty table gives no
sequences. Texts of any length are cut at spaces, where pieces of the vocabulary's pattern start, so the ids are
those of the whole text. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import in_batches, new_path

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 1024
KEY = 20240131
SHARD_BYTES = 64 << 20
#: Segments whose ids a worker remembers.
REMEMBERED = 500_000

#: A space that a byte of this class follows starts a piece: ASCII but white space, or the first byte of U+00C0 to U+07FF.
_STARTS = np.array([0x21 <= i < 0x7F or 0xC3 <= i < 0xE0 for i in range(256)])


def encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    import tiktoken

    return tiktoken.Encoding("feedloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Known:
    """Rows by 64-bit key: open addressing in an array, for many keys at once; a key of 0 counts as 1."""

    def __init__(self):
        self.bits, self.n = 14, 0
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * K.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        keys = np.maximum(keys, np.uint64(1))
        at = self._first(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.rows[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.rows[at[open_[same]]]
            open_ = open_[~same & (held != 0)]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Keys that are not held yet, each once."""
        keys = np.maximum(keys, np.uint64(1))
        self.n += len(keys)
        if self.n * 3 > len(self.keys):
            some = self.keys != 0
            keys, rows = np.concatenate([self.keys[some], keys]), np.concatenate([self.rows[some], rows])
            self.bits = int(self.n * 4).bit_length()
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        at = self._first(keys)
        while len(keys):
            _, one = np.unique(at, return_index=True)
            one = one[self.keys[at[one]] == 0]
            self.keys[at[one]], self.rows[at[one]] = keys[one], rows[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, rows, at = keys[rest], rows[rest], (at[rest] + 1) & (len(self.keys) - 1)


class Tokenizer:
    """Ids of many texts at once: equal segments from space to space are encoded once and then looked up by hash."""

    def __init__(self, table: dict[bytes, int]):
        self.encode = encoder(table)
        self.bytes = np.zeros(max(table.values()) + 1, np.int64)
        self.bytes[list(table.values())] = [len(x) for x in table]
        self._forget()

    def _forget(self) -> None:
        # segment 0 is the end mark
        self.known, self.ids, self.start, self.size = Known(), np.array([END], np.uint16), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each segment, and where each text's segments end."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        if len(self.start) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self._forget()
        first = np.zeros(len(data), bool)
        first[:-1] = (data[:-1] == 0x20) & _STARTS[data[1:]]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        keys = K.word_hashes(data, starts, ends)
        of = self.known.find(keys)
        new = np.flatnonzero(of < 0)
        if len(new):
            fresh, one, back = np.unique(keys[new], return_index=True, return_inverse=True)
            made, size = self._encode(data, starts[new[one]], ends[new[one]])
            rows = np.arange(len(self.start), len(self.start) + len(size), dtype=np.int32)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, made])
            self.known.add(fresh, rows)
            of[new] = rows[back]
        return of, np.searchsorted(starts, offsets[1:])

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these segments, end to end, and how many each has. Those that start with their space end the one before
        them wherever they stand, so many are encoded as one text; a text's first segment may not."""
        size, out = np.zeros(len(starts), np.int64), [np.zeros(0, np.uint16)]
        alone = np.flatnonzero((data[starts] != 0x20) | ~_STARTS[data[np.minimum(starts + 1, len(data) - 1)]])
        cuts = np.union1d(np.union1d(alone, alone + 1), np.searchsorted(np.cumsum(ends - starts), np.arange(0, int((ends - starts).sum()), K.PIECE)))
        cuts = np.union1d(cuts, [0, len(starts)])
        raw = data.tobytes()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            got = np.array(self.encode(b"".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]).decode()), np.uint16)
            out.append(got)
            last = np.searchsorted(np.cumsum(self.bytes[got]), np.cumsum(ends[a:b] - starts[a:b])) + 1
            size[a:b] = np.diff(last, prepend=0)
        return np.concatenate(out), size

    def count(self, data: np.ndarray, offsets: np.ndarray) -> int:
        """How many ids the stream of these texts has."""
        of, _ = self._segments(data, offsets)
        return int(self.size[of].sum()) + len(offsets) - 1

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The stream of these texts, an end mark after each."""
        of, ends = self._segments(data, offsets)
        of = np.insert(of, ends, 0)
        n = self.size[of]
        to = np.cumsum(n)
        return self.ids[np.arange(to[-1]) + np.repeat(self.start[of] - to + n, n)] if len(of) else np.zeros(0, np.uint16)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = K.utf8(batch.column("text"))
        for a, b in K.slices(offsets, K.SLICE):
            low = offsets[a]
            yield data[low : offsets[b]], offsets[a : b + 1] - low


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, counts_only: bool = False) -> DataFrame:
    """part, at, n_tokens, ids (compressed): the sequences of each partition; or part, sequences, tokens, docs."""
    table = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))  # the vocabulary's size, whatever the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part = TaskContext.get().partitionId()
        made, rest, at, tokens, seen = Tokenizer(table.value), np.zeros(0, np.uint16), 0, 0, 0
        press = zstandard.ZstdCompressor(level=1)

        def rows(whole: np.ndarray, filled: int) -> pa.RecordBatch:
            n = len(whole) // length
            size = np.full(n, length, np.int32)
            if filled:
                size[-1] -= filled
            ids = pa.array([press.compress(x.tobytes()) for x in whole.reshape(n, length)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(size), ids], names=["part", "at", "n_tokens", "ids"])

        for data, offsets in _slices(batches):
            seen += len(offsets) - 1
            if counts_only:
                tokens += made.count(data, offsets)
                continue
            stream = made(data, offsets)
            stream = np.concatenate([rest, stream]) if len(rest) else stream
            whole = len(stream) // length * length
            if whole:
                yield rows(stream[:whole], 0)
                at += whole // length
            rest = stream[whole:]
        if counts_only:
            if seen:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sequences": [-(-tokens // length)], "tokens": [tokens], "docs": [seen]})
        elif len(rest):
            fill = length - len(rest)
            yield rows(np.concatenate([rest, np.full(fill, END, np.uint16)]), fill)

    schema = "part int, sequences long, tokens long, docs long" if counts_only else "part int, at long, n_tokens int, ids binary"
    return in_batches(docs).select("text").mapInArrow(run, schema)


def permute(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of these sequences among n: four Feistel rounds on halves of equal width, repeated while out of range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
            a, b = b, a ^ (K.mix(b + salt) & mask)
        return (a << np.uint64(half)) | b

    out = once(number.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def _writer(path: str, stride: int, per_shard: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots come sorted, one shard a partition; the file appears when it is whole."""
        import zstandard
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        unpress = zstandard.ZstdDecompressor()
        out, name, temporary = None, "", ""
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, slots = batch.column("shard").to_numpy(), batch.column("slot").to_numpy()
            if out is None:
                name = f"{base}/shard-{shards[0]:06d}.bin"
                temporary = f"{base}/_writing-{shards[0]:06d}-{TaskContext.get().taskAttemptId()}"
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(temporary)
            crc = []
            for x in batch.column("ids"):
                raw = unpress.decompress(x.as_py())
                crc.append(zlib.crc32(raw))
                out.write(raw)
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), pa.array(slots % per_shard * stride), batch.column("sequence"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["slot", "shard", "byte_offset", "sequence", "n_tokens", "crc32"])
        if out is not None:
            out.close()
            if store.get_file_info(name).type != fs.FileType.NotFound:  # of an earlier attempt, or of another run
                store.delete_file(name)
            store.move(temporary, name)

    return write


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, int]:
    """slot, sequence, n_tokens, ids for every sequence, and their number. docs must be a written table."""
    spark = docs.sparkSession
    counts = pack(docs, vocabulary, length, counts_only=True).collect()  # a row for each input partition
    counts.sort(key=lambda r: r["part"])
    base, total = np.cumsum([0, *(r["sequences"] for r in counts)]), sum(r["sequences"] for r in counts)
    held = spark.sparkContext.broadcast((np.array([r["part"] for r in counts], np.int32), base))  # 12 bytes a partition

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, at = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            parts, base = held.value
            own = at + base[np.searchsorted(parts, part)]
            yield pa.RecordBatch.from_arrays([pa.array(permute(own, total, key)), pa.array(own), batch.column("n_tokens"), batch.column("ids")], names=["slot", "sequence", "n_tokens", "ids"])

    return pack(docs, vocabulary, length).mapInArrow(number, "slot long, sequence long, n_tokens int, ids binary"), total


def _clear(path: str) -> None:
    """Take away the shards of an earlier run."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("shard-") and f.base_name.endswith(".bin"):
            store.delete_file(f.path)


def write(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards when its rows are asked for: slot, shard, byte_offset, sequence, n_tokens, crc32 of each sequence.

    Shards that an earlier run left under the path go at once; a shard is replaced whole when its rows are asked for again."""
    if path:
        _clear(path)
    path = path or new_path(docs.sparkSession, "shards")
    stride = 2 * length
    per_shard = max(1, shard_bytes // stride)
    rows, total = sequences(docs, vocabulary, length, key)
    shards = max(1, -(-total // per_shard))
    dealt = rows.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return dealt.mapInArrow(_writer(path, stride, per_shard), "slot long, shard int, byte_offset long, sequence long, n_tokens int, crc32 long")


def read_slots(path: str, first: int, n: int, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Ids of n slots from `first` on, by arithmetic alone; for the trainer, on a mounted folder."""
    stride = 2 * length
    per_shard = max(1, shard_bytes // stride)
    out = []
    for slot in range(first, first + n):
        with open(os.path.join(path.removeprefix("file://"), f"shard-{slot // per_shard:06d}.bin"), "rb") as f:
            f.seek(slot % per_shard * stride)
            out.append(np.frombuffer(f.read(stride), "<u2"))
    return np.stack(out)
