"""Vectorised text kernels that run inside Spark's Arrow tasks.

Texts stay in their Arrow buffers; words are found as byte spans and hashed eight bytes at a time, so that no
Python string is made for a word. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2, _K = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of text handled at once; bounds a task's scratch memory at some tens of MB, or a few times one longer text.
CHUNK_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S33)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, at = len(column), column.offset
    _, off, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of rows i..j: ``text`` (lower-cased bytes), ``start``/``end`` in it, ``first[r]:first[r + 1]`` per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, space: np.ndarray = SPACE, lower: bool = True):
        base = offsets[i]
        self.bounds = offsets[i : j + 1] - base
        n = int(self.bounds[-1])
        self.text = np.zeros(n + 8, np.uint8)
        self.text[:n] = LOWER[data[base : base + n]] if lower else data[base : base + n]
        inside = ~space[self.text[:n]]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
            np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text, self.start, self.end)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``text`` has eight spare bytes at its end."""
    length = end - start
    h = mix((length.astype(np.uint64) + np.uint64(1)) * _K)
    if not len(start):
        return h
    words = np.lib.stride_tricks.as_strided(text[: len(text) - 7].view(), (len(text) - 7, 8), (1, 1))
    live, at, left = None, start, length
    while len(at):
        load = np.ascontiguousarray(words[at]).view(np.uint64).ravel() & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ load * _K)
            live = np.arange(len(start))
        else:
            h[live] = mix(h[live] ^ load * _K)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, one array for each place."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        h = mix(h * _M1 + x)
    return h


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles in text order and the first one of each row; a shorter text is one shingle as a whole."""
    h, count = words.hashes(), np.diff(words.first)
    total = len(h)
    made = fold([h[k : total - n + 1 + k] for k in range(n)]) if total >= n else np.zeros(0, np.uint64)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], np.uint64)
    take = np.flatnonzero(count >= n)
    if len(take):
        reps = size[take]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(first[take], reps) + inner] = made[np.repeat(words.first[take], reps) + inner]
    for r in np.flatnonzero((count > 0) & (count < n)):
        out[first[r]] = fold([h[k : k + 1] for k in range(words.first[r], words.first[r + 1])])[0]
    return out, first


def long_column(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def strings(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = text.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
