"""CRC-32 of many byte runs at once, and of runs joined together."""

from __future__ import annotations

import zlib

import numpy as np

from . import _text

#: Bytes up to which runs go through the table together; longer ones are rare and go one by one.
LONG = 48

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, _TABLE >> np.uint32(1) ^ np.uint32(0xEDB88320), _TABLE >> np.uint32(1))


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: int = 0) -> np.ndarray:
    """CRC-32 of data[starts[i]:ends[i]], continued from the value before."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    sizes, at = sizes[order], starts[order]
    crc = np.full(len(starts), before ^ 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-sizes, -LONG, "left")) if len(sizes) else 0
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + sizes[k]].tobytes(), before) ^ 0xFFFFFFFF
    short = np.arange(long, len(sizes))
    for p in range(int(sizes[long]) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes[long:], -p, "left"))  # those longer than p bytes
        own = short[:n]
        crc[own] = _TABLE[(crc[own] ^ data[at[own] + p]) & 0xFF] ^ (crc[own] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _zeros(n: int) -> np.ndarray:
    """By byte of a value and its place: what n zero bytes after it make of it."""
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        column = _TABLE[column & 0xFF] ^ (column >> np.uint32(8))
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            with_bit = (np.arange(256) >> bit & 1).astype(bool)
            out[place, with_bit] ^= column[8 * place + bit]
    return out


_SHIFTS: dict[int, np.ndarray] = {}


def joined(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two runs one after another, from their own and the second's size (LONG at most)."""
    out = np.empty(len(first), np.uint32)
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    kinds, begin, count = np.unique(ordered, return_index=True, return_counts=True)
    for size, a, b in zip(kinds.tolist(), begin, begin + count, strict=True):
        if size not in _SHIFTS:
            _SHIFTS[size] = _zeros(size)
        table = _SHIFTS[size]
        own = order[a:b]
        x = first[own]
        out[own] = table[0, x & 0xFF] ^ table[1, x >> 8 & 0xFF] ^ table[2, x >> 16 & 0xFF] ^ table[3, x >> 24] ^ second[own]
    return out


def word_pairs(words: _text.Words, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CRC-32 of word at[i], a blank and word at[i] + 1, where own has those of single words."""
    blank = np.uint32(0x20)
    state = own ^ np.uint32(0xFFFFFFFF)
    spaced = (_TABLE[(state ^ blank) & 0xFF] ^ (state >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    sizes = (words.ends - words.starts)[at + 1]
    out = np.empty(len(at), np.uint32)
    short = sizes <= LONG
    out[short] = joined(spaced[at[short]], own[at[short] + 1], sizes[short])
    for k in np.flatnonzero(~short):
        out[k] = zlib.crc32(words.text(at[k] + 1), int(spaced[at[k]]))
    return out
