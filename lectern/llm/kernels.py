"""Vectorised text kernels shared by the operators of this subpackage.

Arrow string columns are cut into chunks of about ``CHUNK_BYTES`` bytes (a
longer document is a chunk of its own), so that the temporary arrays of a
kernel stay small whatever the batch holds.  A chunk is a flat ``uint8`` buffer
with document offsets; nothing here loops over bytes or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: bytes of a long text that are hashed together
PART = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
U64 = np.uint64

#: white space of the contracts: space and \t \n \v \f \r
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk(NamedTuple):
    first: int  # row of the batch that the first document is
    buf: np.ndarray  # uint8
    off: np.ndarray  # int64, one more than documents

    @property
    def n(self) -> int:
        return len(self.off) - 1


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


@lru_cache(maxsize=1)
def _trim():
    """What hands freed memory back to the system, where the C library can."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Memory that a batch has freed goes back, as other workers of the executor need it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    buf, off = column_bytes(col)
    if len(buf) > limit:
        yield from _cut(buf, off, limit)
        release()
    else:
        yield from _cut(buf, off, limit)


def _cut(buf: np.ndarray, off: np.ndarray, limit: int) -> Iterator[Chunk]:
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        to = min(to, n, at + 4096)
        yield Chunk(at, buf[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, BASE, U64)
        down = np.full(n + 1, INVERSE, U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to at least n, modulo 2**64."""
    return _powers(((int(n) >> 18) + 1) << 18)


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = sum of code(buf[k]) * BASE**k over i <= k < j."""
    out = np.zeros(len(buf) + 1, U64)
    if len(buf):
        up, _ = powers(len(buf))
        np.cumsum(byte_codes()[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U64))


def words(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word (maximal run of bytes marked in ``inside``) and, for
    each document, the number of the first of its words (one entry more than documents)."""
    if not len(chunk.buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(chunk.n + 1, np.int64)
    m = inside[chunk.buf]
    start, last = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = chunk.off[1:-1]
    edge = edge[(edge > 0) & (edge < len(m))]
    start[edge] = m[edge]
    last[edge - 1] = m[edge - 1]
    begin, end = np.flatnonzero(start), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, chunk.off)


def word_hashes(chunk: Chunk, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first word of each document, hash) of words split at WHITE."""
    begin, end, first = words(chunk, ~WHITE)
    out, at, since = np.empty(len(begin), U64), 0, 0
    while at < len(begin):  # some words at a time, so that a long text takes little more room than its words
        to = max(at + 1, int(np.searchsorted(end, since + PART)))
        stop = int(end[to - 1])
        buf = LOWER[chunk.buf[since:stop]] if lower else chunk.buf[since:stop]
        out[at:to] = span_hash(prefix_hash(buf), begin[at:to] - since, end[at:to] - since)
        at, since = to, stop
    return begin, end, first, out


def shingle_hashes(words_: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (empty when there are fewer)."""
    n = len(words_) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for i in range(k):
            h = h * U64(0xFF51AFD7ED558CCD) + words_[i : i + n]
        return mix(h + U64(k))


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least key in each window keys[i:i+width]."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, span = keys, np.arange(len(keys)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[: len(at) - step])
        span += step
    return at


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i], begin[i]+1, ... begin[i]+length[i]-1 for every i, concatenated."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(total)


def doc_of(first: np.ndarray, total: int) -> np.ndarray:
    """The document of each word, from the first word of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:total]
