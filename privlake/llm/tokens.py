"""Vectorised byte, word and shingle helpers that run inside Arrow tasks.

A batch's texts are handled as one UTF-8 buffer with offsets, as Arrow holds them: no helper loops over words in Python.
Null texts count as empty. Hashes are 64-bit with a full mixing step; they stand for words and shingles throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]`
SOLID = np.ones(256, dtype=bool)
SOLID[32] = SOLID[9:14] = False


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of `batch` whose texts have at most `limit` bytes together (one row at least), each with its bytes and offsets."""
    text = batch.column(column)
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    text = pc.fill_null(text, "")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(text))
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `table`, and each document's first run. Runs never cross documents."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = table[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    keep = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=U64)
    length = ends - starts
    h = mix((eights[starts] & keep[np.minimum(length, 8)]) + length.astype(U64) * U64(0x9E3779B97F4A7C15))
    at = 8
    more = np.flatnonzero(length > at)
    while len(more):
        h[more] = mix((h[more] * U64(0xD6E8FEB86659FD93)) ^ (eights[starts[more] + at] & keep[np.minimum(length[more] - at, 8)]))
        at += 8
        more = more[length[more] > at]
    return h


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words within a document, and each document's first one; position = word position."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if not starts[-1]:
        return np.zeros(0, dtype=U64), starts
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - first[:-1], counts)
    out = np.full(len(at), n, dtype=U64)
    for k in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + h[at + k]
    return mix(out), starts


def shingle_sets(h: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingles of `n` words in ascending order; all of its words as one if it has fewer; none without words."""
    s, starts = shingles(h, first, n)
    for d in range(len(first) - 1):
        words = first[d + 1] - first[d]
        if words >= n:
            yield np.unique(s[starts[d] : starts[d + 1]])
        elif words:
            yield shingles(h, first[d : d + 2], int(words))[0]
        else:
            yield s[:0]


def in_bits(h: np.ndarray, bits: np.ndarray, power: int | None = None) -> np.ndarray:
    """Which hashes have their bit set; see common.bitmap(). Without `power`, `bits` are 2**power bits, no more."""
    power = power or (8 * len(bits)).bit_length() - 1
    at = (h >> U64(64 - power)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
