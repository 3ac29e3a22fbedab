"""NumPy kernels over the UTF-8 buffers of Arrow columns: words, hashes and slices without a Python loop per word.

A word class is a table of 256 booleans over bytes. Bytes of 0x80 and above belong to words in every class
used here, so classes of bytes and of characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the memory of the arrays, not the length of a text.
PIECE = 1 << 18
#: Bytes of texts looked at together where many equal words in one place save work.
SLICE = 1 << 21
#: Odd 64-bit constants; results do not depend on their being these.
BASE, STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def byte_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words of [^\x20\x09-\x0D]+.
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have become a-z.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POWERS:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS.extend((powers(BASE, PIECE + 1), powers(inverse, PIECE + 1)))
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, end to end, and n + 1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each text the index of its first word (n + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial by prefix sums, then mixed with the length."""
    power, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        if ends[to - 1] - low > PIECE:  # one word longer than a piece: fold its pieces
            whole = np.uint64(0)
            for a in range(low, ends[at], PIECE):
                part = data[a : min(a + PIECE, ends[at])].astype(np.uint64) + np.uint64(1)
                whole = mix(np.array([whole * STEP + (part * power[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[at] = whole
            at += 1
            continue
        part = data[low : ends[to - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s = starts[at:to] - low
        out[at:to] = (total[ends[at:to] - low] - total[s]) * inverse[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * STEP)


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of every n consecutive word hashes, by start; those that cross texts are the caller's to leave out."""
    power, inverse = _tables()
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(m, np.uint64)
    for at in range(0, m, PIECE - n):
        to = min(at + PIECE - n, m)
        part = hashes[at : to + n - 1] ^ np.uint64(salt)
        if salt:
            part = mix(part)
        part = part * power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        out[at:to] = (total[n:] - total[:-n]) * inverse[: to - at]
    return mix(out + np.uint64(n))


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts that hold at most so many bytes together, or one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
