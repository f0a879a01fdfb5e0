"""CRC-32 of many byte spans at once, and of what they give when they are joined."""

from __future__ import annotations

import zlib

import numpy as np

#: Spans up to this many bytes are read column by column; longer ones each by themselves.
_COLUMNS = 64


def _byte_steps() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


_STEPS = _byte_steps()


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as one table per byte."""
    return (
        tables[0][crc & np.uint32(255)] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)]
        ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)]
    )


def _zero_bytes() -> list[np.ndarray]:
    """Maps that append 1, 2, 4, ... zero bytes to what a checksum has read."""
    every = np.arange(256, dtype=np.uint32)
    parts = np.stack([every << np.uint32(8 * byte) for byte in range(4)])
    tables = [_STEPS[parts & np.uint32(255)] ^ (parts >> np.uint32(8))]
    for _ in range(31):
        tables.append(_through(tables[-1], tables[-1]))
    return tables


_ZEROS = _zero_bytes()


def joined(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """The checksum of two texts in a row, from the checksums of both."""
    out, left, k = first.copy(), second_length, 0
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = _through(_ZEROS[k], out[some])
        left, k = left >> 1, k + 1
    return out ^ second


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksums of the spans of ``data``."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    long = int(np.searchsorted(-lengths, -_COLUMNS, "left"))
    found = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    short, sizes = starts[long:], lengths[long:]
    for place in range(int(sizes[0]) if len(sizes) else 0):
        some = int(np.searchsorted(-sizes, -place, "left"))
        now = found[long:long + some]
        byte = data[short[:some] + place]
        found[long:long + some] = _STEPS[(now ^ byte) & np.uint32(255)] ^ (now >> np.uint32(8))
    found ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        found[i] = zlib.crc32(data[starts[i]:starts[i] + lengths[i]])
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = found
    return out
