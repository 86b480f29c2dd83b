"""Distinct words of a corpus with weighted counts: what both language models are trained on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: Distinct words that a task holds before it hands them on.
HOLD = 150_000


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[starts[i]:ends[i]] as a binary column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    body = data[_text.ranges(starts, sizes)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


END_HASH = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """The words of a slice with an end token after each text, and a class of each text that its tokens belong to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes=None):
        self.words = words = _text.split(data, offsets)
        self.n = len(words.first) - 1
        self.plain = words.hashes()
        self.owner = words.owner()
        self.classes = np.zeros(self.n, np.int64) if classes is None else classes(words, self.plain)
        if classes is not None:
            self.plain = np.concatenate([self.plain, np.full(self.n, END_HASH)])
            self.owner = np.concatenate([self.owner, np.arange(self.n)])
        self.key = _text.mix64(self.plain + self.classes.astype(np.uint64)[self.owner] * np.uint64(0xD1342543DE82EF95)) if classes is not None else self.plain

    def texts(self, at: np.ndarray) -> pa.Array:
        """The bytes of the tokens at these places; a line break stands for the end."""
        w = self.words
        size = len(w.data)
        starts, ends = (np.concatenate([x, np.full(self.n, size + k)])[at] for x, k in ((w.starts, 0), (w.ends, 1)))
        return gather(np.append(w.data, np.uint8(10)), starts, ends)


def word_counts(rows: DataFrame, weights: list[str], classes=None) -> DataFrame:
    """rows (text, weights...) -> (hash, word, weights...): per lower-cased word the sums of its texts' integer weights.

    classes(words, hashes) may give each text a class; then words are counted by class, an end token is counted for
    each text, and the columns plain (the word's own hash) and g (the class) are added.  Each task sums what it has
    read before the shuffle, so a very common word is a few rows of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            found, first, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            others = [pa.concat_arrays([h[1][k] for h in held]).take(pa.array(first)) for k in range(3)]
            sums = [np.bincount(back, np.concatenate([h[2][k] for h in held]), len(found)) for k in range(len(weights))]
            return found, others, sums

        def out(part: tuple) -> pa.RecordBatch:
            columns = [pa.array(part[0].view(np.int64)), *part[1], *[pa.array(np.rint(s).astype(np.int64)) for s in part[2]]]
            return pa.RecordBatch.from_arrays(columns, ["hash", "word", "plain", "g", *weights])

        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                tokens = Tokens(data, offsets, classes)
                if not len(tokens.key):
                    continue
                found, first, back = np.unique(tokens.key, return_index=True, return_inverse=True)
                sums = [np.bincount(back, np.asarray(own.column(1 + k), np.float64)[tokens.owner], len(found)) for k in range(len(weights))]
                others = [tokens.texts(first), pa.array(tokens.plain[first].view(np.int64)), pa.array(tokens.classes[tokens.owner[first]].astype(np.int32))]
                held.append((found, others, sums))
                if sum(len(h[0]) for h in held) > 2 * HOLD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HOLD:
                        yield out(held.pop())
        if held:
            yield out(merged())

    made = rows.select("text", *weights).mapInArrow(run, "hash long, word binary, plain long, g int, " + ", ".join(f"{w} long" for w in weights))
    keep = ["word"] if classes is None else ["word", "plain", "g"]
    return made.groupBy("hash").agg(*[F.first(c).alias(c) for c in keep], *[F.sum(w).alias(w) for w in weights])


def coded(words: pa.Array, end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a blank after each (the end token stands alone): (bytes, word of each byte, place in the word)."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = words.buffers()[2]
    source = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    alone = (sizes == 1) & (source[np.minimum(offsets[:-1], max(0, len(source) - 1))] == end[0]) if len(source) else np.zeros(n, bool)
    own = sizes + ~alone
    starts = np.cumsum(own) - own
    data = np.full(int(own.sum()), 0x20, np.uint8)
    data[_text.ranges(starts, sizes)] = source
    owner = np.repeat(np.arange(n), own)
    return data, owner, np.arange(len(data)) - starts[owner]
