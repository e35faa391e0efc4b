"""Vectorised text kernels shared by the corpus operators.

Texts stay the UTF-8 bytes that Arrow hands over.  A word is a run of bytes that are not separators;
words get 64-bit hashes from lanes of eight bytes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

U64 = np.uint64
#: Bytes of text that one kernel call handles (a longer single text is one call of its own).
CHUNK_BYTES = 2 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

#: Separator tables: white space only, or everything but letters, digits and non-ASCII bytes.
SEP_SPACE = _SPACE
SEP_PUNCT = ~_WORD


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over 64 bits (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Bytes of a word that are hashed in lanes of 8; longer words go to XXH3.
LANE_BYTES = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


class Words:
    """Words of several texts: ``starts``/``ends`` index ``buf``; text d owns words ``first[d]:first[d + 1]``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SEP_SPACE, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        self.n_texts = len(offsets) - 1
        inside = ~sep[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True  # words never cross texts
        before = np.empty(len(buf) + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(len(buf) + 1, bool)
        after[-1] = False
        after[:-1] = inside
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes.  Eight bytes at a time go through a bijection, so words of up to eight bytes and of
        equal length never share a hash, and no arithmetic structure of longer ones does either."""
        size = self.ends - self.starts
        lanes = np.ndarray(len(self.buf) + 1, "<u8", np.concatenate([self.buf, np.zeros(8, np.uint8)]), strides=(1,))
        h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) ^ (lanes[self.starts] & _FIRST_BYTES[np.minimum(size, 8)]))
        for at in range(8, LANE_BYTES, 8):
            on = np.flatnonzero(size > at)
            if not len(on):
                return h
            h[on] = mix(h[on] * U64(0x9FB21C651E98DF25) ^ (lanes[self.starts[on] + at] & _FIRST_BYTES[np.minimum(size[on] - at, 8)]))
        for i in np.flatnonzero(size > LANE_BYTES).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.buf[self.starts[i] : self.ends[i]].tobytes())
        return h


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of every k consecutive values of ``h`` (len(h) - k + 1 of them), texts not regarded."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, mix(np.array([salt + 1], U64))[0])
    for j in range(k):
        out *= U64(0x9FB21C651E98DF25)
        out += h[j : j + n]
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have, out = 1, a
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without a copy, and offsets (nulls count as empty texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (at least one row)."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return what Arrow's pool and the C library hold free to the system.  Python workers are reused from stage to stage, and would
    otherwise keep the most that any step has needed, in pieces."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; when it ends, its memory is given back."""
    try:
        yield from batches
    finally:
        del batches
        give_back()


def longs(column: pa.Array) -> np.ndarray:
    """A long column as int64; nulls become the smallest long."""
    return column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as bytes objects, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class HashIndex:
    """Position of 64-bit keys in an array, looked up in bulk; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        slot = (mix(keys.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)
        self.order = np.argsort(slot, kind="stable")
        self.keys = keys.astype(U64)[self.order]
        bounds = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1))
        self.start = bounds.astype(np.int32)
        self.deepest = int(np.diff(bounds).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        wanted = wanted.astype(U64, copy=False)
        slot = (mix(wanted) >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, sought = at[left], end[left], wanted[left]
        for _ in range(self.deepest):
            hit = self.keys[at] == sought
            out[left[hit]] = self.order[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, sought = left[more], at[more], end[more], sought[more]
            if not len(left):
                break
        return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = struct.unpack_from("<I", raw)[0], 4
    kinds = [struct.unpack_from("<4sQ", raw, at + 12 * i) for i in range(n)]
    at += 12 * n
    out = []
    for kind, size in kinds:
        a = np.frombuffer(raw, np.dtype("<" + kind.decode().strip()), size, at)
        out.append(a)
        at += a.nbytes
    return out


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal (sorted) key tuples begin."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
