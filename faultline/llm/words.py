"""Vectorised word and shingle hashes over the UTF-8 bytes of Arrow text columns.

A word is a run of ASCII letters or digits or of any other non-ASCII characters, after lower-casing
A-Z: the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. All hashes are 64 bits wide and the same in
every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes handled at once: bounds the temporary arrays of a task. A longer text is a block by itself.
BLOCK_BYTES = 512 << 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def tidy(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's generator that gives its free memory back to the system at the end; the worker lives on."""

    @wraps(task)
    def run(*args, **settings):
        try:
            yield from task(*args, **settings)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    out = np.array(h, np.uint64, order="C")
    flat = out.reshape(-1)
    # A few values at a time, so that they stay in the processor's cache.
    for low in range(0, len(flat), 1 << 15):
        part = flat[low:low + (1 << 15)]
        high = part >> np.uint64(33)
        part ^= high
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            part *= np.uint64(factor)
            part ^= np.right_shift(part, np.uint64(33), out=high)
    return out[()]


def _power(kind: str, size: int) -> np.ndarray:
    """The powers of the base, or of its inverse, modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have) < size:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        out = np.ones(max(size, BLOCK_BYTES + 1), dtype=np.uint64)
        done = 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[kind] = have = out
    return have


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows ``first`` to ``last`` with their bytes and offsets, a bounded size at a time."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) times the power of its place; spans hash in constant time from these."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data))[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which depend on their content alone."""
    return mix((prefix[ends] - prefix[starts]) * _power("down", len(prefix))[starts])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, which never cross an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """The words of a block of texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends = runs(IS_WORD[self.data], offsets)
        self.hashes = span_hash(prefix_hash(self.data), self.starts, self.ends)
        #: First word of each text, and the number of words.
        self.offsets = np.searchsorted(self.starts, offsets)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words and the offsets of the texts among them.

        A text of fewer words, but at least one, has one shingle of all its words.
        """
        return shingle_hashes(self.hashes, self.offsets, size)


def shingle_hashes(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(offsets)
    full = np.maximum(counts - size + 1, 0)
    made = np.where(full > 0, full, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    if not out_offsets[-1]:
        return np.zeros(0, np.uint64), out_offsets
    place = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1] - offsets[:-1], made)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    length = np.repeat(np.minimum(counts, size), made)
    out = np.zeros(len(place), dtype=np.uint64)
    short = bool((length < size).any())
    for j in range(size):
        word = padded[place + j]
        if short:
            word = np.where(j < length, word, np.uint64(j + 1))
        out = out * _STEP + word
    return mix(out), out_offsets


def distinct_per_text(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, and the texts' offsets among them."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = h.copy()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h[start:end].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(offsets)))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes ``start, start + 1, ...`` of all rows, one row after the other."""
    total = int(counts.sum())
    skipped = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + skipped
