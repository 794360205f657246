"""Words of Arrow text columns as numpy arrays: boundaries and 64-bit hashes, without Python strings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * K2
    x = (x ^ (x >> U(27))) * K3
    return x ^ (x >> U(31))


def give_back() -> None:
    """Return freed memory to the system: a worker idles between tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j
    give_back()


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and each text's offset; null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and for each text (plus one) the index of its first word."""
    w = table[data]
    before, after = np.empty_like(w), np.empty_like(w)
    if len(w):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = w[:-1], w[1:]
        at = off[:-1][off[:-1] < len(w)]
        before[at] = False
        at = off[1:][off[1:] > 0] - 1
        after[at] = False
    starts = np.flatnonzero(w & ~before)
    return starts, np.flatnonzero(w & ~after) + 1 - starts, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; hashes of different seeds are independent."""
    seed = mix(np.array([seed], U))
    view = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    keep = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
    h = mix((view[starts] & keep[np.minimum(lens, 8)] ^ seed) + lens.astype(U) * K1)
    at, k = np.flatnonzero(lens > 8), 8
    while at.size:
        h[at] = mix(h[at] * K1 + (view[starts[at] + k] & keep[np.minimum(lens[at] - k, 8)] ^ seed))
        k += 8
        at = at[lens[at] > k]
    return h


def word_hashes(col: pa.Array, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text (plus one) the index of its first word."""
    data, off = flat(col)
    if lower:
        data = LOWER[data]
    starts, lens, first = words(data, off, table)
    return hashes(data, starts, lens), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (over text boundaries too; callers mask those)."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.full(len(h) - n + 1, n, U) * K3
    for j in range(n):
        out = mix(out * K1 + h[j : len(h) - n + 1 + j])
    return out


def pack(*columns: np.ndarray, rising: bool = True) -> bytes:
    """Integer arrays of one length as bytes, by byte planes; the first is stored as differences if it is rising."""
    n = len(columns[0])
    first = columns[0].copy()
    if rising:
        first[1:] -= columns[0][:-1]
    planes = [np.array([n], "<i8").tobytes()]
    for c in (first, *columns[1:]):
        planes.append(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() if n else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *types, rising: bool = True) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for t in types:
        w = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * w
    if rising:
        out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def ids_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(column).cast(pa.int64())
