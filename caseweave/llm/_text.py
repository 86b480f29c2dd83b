"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Whole Arrow slices are split and hashed with
numpy, so no Python object is made per word.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once: bounds the working memory of a task (a longer single text is handled alone).
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)  # a random value for each byte
_P = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _P and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, min(2 * len(_POWERS[0]), 2 * SLICE_BYTES))
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


@dataclass
class Words:
    """The words of a slice: bytes data[starts[i]:ends[i]]; those of text t are first[t] to first[t + 1] - 1."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=total[1:])
        own = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix64(own + (self.ends - self.starts).astype(np.uint64) * _STEP)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows with about limit bytes of text each: (rows, bytes, offsets)."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """The words of the texts data[offsets[t]:offsets[t + 1]]; lower maps A-Z to a-z, space marks the bytes between words."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~space[data]
    before = np.zeros(n + 1, bool)
    before[1:] = word
    before[offsets] = False
    after = np.zeros(n + 1, bool)
    after[:n] = word
    after[offsets] = False
    starts = np.flatnonzero(word & ~before[:n])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values, also of runs that cross texts."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for t in range(k):
        out = out * np.uint64(_P) + hashes[t : t + n]
    return mix64(out + np.uint64(k))


def gram_counts(words: Words, k: int) -> np.ndarray:
    """How many runs of k words each text has."""
    return np.maximum(words.counts() - k + 1, 0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] values for each i, one after another."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)
