"""Numpy views of Arrow text columns: words, their hashes, and hashes of word windows.

All functions work on a slice of documents at a time (about half a megabyte of text), so a task's memory does not
follow the size of its partition. A text longer than that is a slice of its own: it takes some 5 bytes for each of its
bytes, for the places and hashes of its words; the tables for hashing stay as large as a slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
#: Bytes that end a word: the complement of [^\x20\x09-\x0D].
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Odd 64-bit multipliers of the two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def give_back() -> None:
    """Memory that was freed goes back to the machine: a Python worker lives on for other tasks, beside its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """run (batches to batches), which gives its memory back at the end of each task."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with at most `most` bytes; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (and the total at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    out = blank[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = out[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge & ~out)
    edge[-1] = True
    edge[:-1] = out[1:]
    edge[offsets[1:] - 1] = True
    ends = np.flatnonzero(edge & ~out) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a slice has bytes."""
    up, down = np.full(SLICE, base, np.uint64), np.full(SLICE, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: prefix sums of a polynomial, taken back to the word's start.

    Bytes are taken a slice at a time; a word that goes on in the next slice carries its sum along.
    """
    base, out = BASES[which], np.zeros(len(starts), np.uint64)
    up, down = _powers(base)
    sums = np.zeros(SLICE + 1, np.uint64)
    for low in range(0, len(data) if len(starts) else 0, SLICE):
        high = min(len(data), low + SLICE)
        i, j = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, high, side="left"))
        if i == j:
            continue
        part = data[low:high].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: high - low]
        np.cumsum(part, out=sums[1 : high - low + 1])
        a, b = np.maximum(starts[i:j], low) - low, np.minimum(ends[i:j], high) - low
        got = (sums[b] - sums[a]) * down[a]
        if starts[i] < low:
            got[:1] *= np.uint64(pow(base, low - int(starts[i]), 1 << 64))
        out[i:j] += got
    return mixed(out + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of the k words from each position on; positions without k words after them are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(BASES[which] ^ 0x5851F42D4C957F2D | 1), hashes[:n].copy()
    for j in range(1, k):
        out *= base
        out += hashes[j : j + n]
    return mixed(out)


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each position of window_hashes: whether its k words lie in one document."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + k <= ends[:n]
