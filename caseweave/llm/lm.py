"""Compression-style language model: logistic mixing of hashed-context bit predictors.

A text is a class, its lower-cased words and an end symbol.  Two models of the same kind share the work.  Each word is
first coded as a symbol: one of the most frequent words, the end, or "another"; the symbol's bits are predicted in the
contexts of the symbols before it, so the order of words counts.  Another word is then spelled: every bit of every byte,
with a blank at the end, is predicted by several counters, each addressed by a hash of another context (the last one to
five bytes of the word, or all of it, most of them with the text's class) and the bits of the byte so far.

The predictors' logits are combined by weights that a gate chooses (the longest context seen before, and how often),
trained online, and the result is refined by an adaptive probability map per gate.  The bits' logarithms add up to the
log-probability of the text and to its bits per byte.

Classes are the components of a multinomial mixture over hashed short words, in effect the languages; a text is coded
with its likeliest class and pays for naming it, so scores are log-probabilities of one code.  Equal words of a class are
spelled alike: the corpus is reduced to distinct words with counts, which grow with it, dealt by their first bytes and
sorted, so that a shared prefix is worked through once and the counters of whole prefixes are exact, with no table that
could overflow.  Shorter contexts, whose number the alphabet bounds, are counted in tables of fixed size.  A word's own
occurrence is taken out of the counters when weights and maps are trained, so that they meet words as they will meet
unseen ones.  Everything is counted in integers and every shard of words trains in a fixed order, so scores do not
depend on how rows lie in files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import ready, written
from ._types import END_HASH, Tokens, coded, word_counts
from .toxicity import fold

#: Context lengths in bytes, whether the class belongs to it, bits of its table's size.
SHORT_CONTEXTS = ((1, True, 16), (2, True, 18), (3, True, 19), (4, True, 20), (5, False, 20))
#: Leading bytes by which words are dealt; longer prefixes are counted exactly, without and with the class.
LEAD = 3
N_INPUTS = len(SHORT_CONTEXTS) + 2
#: Confidence classes of a gate's longest context, and steps of the probability map.
GRADES, STEPS = 8, 33
END = b"\n"
#: Words of a shard, edges of an online step, words at once in the count; words at most in the broadcast part.
SHARD, LEARN, CHUNK, FREQUENT = 10_000, 8_000, 10_000, 1 << 19
_RATE = 0.5
#: Classes, hash buckets of their words, longest such word, texts that start the fit, passes over all texts.
CLASSES, BUCKETS, SHORT, STARTERS, PASSES = 6, 256, 4, 512, 3
#: Bits of a symbol: 0 is another word, 1 the end, the others frequent words.
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS


def _profile(words: _text.Words, hashes: np.ndarray) -> np.ndarray:
    """Counts of each text's short words by bucket."""
    short = (words.ends - words.starts) <= SHORT
    at = words.owner()[short] * BUCKETS + (hashes[short] % np.uint64(BUCKETS)).astype(np.int64)
    return np.bincount(at, minlength=(len(words.first) - 1) * BUCKETS).reshape(-1, BUCKETS)


class Mixture:
    """A multinomial mixture over profiles."""

    def __init__(self, sums: np.ndarray, mass: np.ndarray):
        word = (sums + 0.05) / (sums + 0.05).sum(axis=1, keepdims=True)
        self.word, self.share = np.log(word), np.log((mass + 1) / (mass + 1).sum())

    def logs(self, profiles: np.ndarray) -> np.ndarray:
        return profiles @ self.word.T + self.share

    def classes(self, words: _text.Words, hashes: np.ndarray) -> np.ndarray:
        return self.logs(_profile(words, hashes)).argmax(axis=1)

    def sums(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logs(profiles)
        r = np.exp(z - z.max(axis=1, keepdims=True))
        r = np.rint(r / r.sum(axis=1, keepdims=True) * 1024)  # whole numbers add up alike in any order
        return r.T @ profiles, r.sum(axis=0)


def fit_mixture(rows: DataFrame) -> Mixture:
    """Expectation-maximisation over the profiles of all texts, started on the few of the smallest hashes."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _text.slices(batch, "text"):
                words = _text.split(data, offsets)
                p = _profile(words, words.hashes())
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p.astype(np.uint32)], pa.binary())], ["p"])

    table = written(rows.select("text").mapInArrow(profiled, "p binary"), "lm-profiles")
    array = lambda column: np.frombuffer(b"".join(column), np.uint32).reshape(-1, BUCKETS).astype(np.float64)
    few = array([bytes(r["p"]) for r in table.distinct().orderBy(F.xxhash64("p"), "p").limit(STARTERS).collect()])
    # Start from texts far from each other: each next one is the least likely under those before.
    picks = few[:1] if len(few) else np.zeros((1, BUCKETS))
    while len(picks) < CLASSES and len(few):
        likely = (few @ np.log((picks + 0.5) / (picks + 0.5).sum(axis=1, keepdims=True)).T).max(axis=1)
        picks = np.concatenate([picks, few[np.argmin(likely)][None]])
    mixture = Mixture(picks + 0.5, np.ones(len(picks)))
    for _ in range(20):
        mixture = Mixture(*mixture.sums(few)) if len(few) else mixture

    for _ in range(PASSES):

        def sums(batches: Iterator[pa.RecordBatch], m=mixture) -> Iterator[pa.RecordBatch]:
            total, mass = np.zeros_like(m.word), np.zeros_like(m.share)
            for batch in batches:
                for k in range(0, len(batch), 1024):
                    a, b = m.sums(array(batch.column(0).slice(k, 1024).to_pylist()))
                    total, mass = total + a, mass + b
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (total, mass)], ["total", "mass"])

        parts = table.mapInArrow(sums, "total binary, mass binary").collect()  # one fixed-size row a task
        if parts:
            shape = mixture.word.shape
            mixture = Mixture(sum(np.frombuffer(r["total"]) for r in parts).reshape(shape), sum(np.frombuffer(r["mass"]) for r in parts))
    return mixture


# Bit predictors


def _counted(n0: np.ndarray, n1: np.ndarray, y: np.ndarray | None, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(logit, total count) of a counter; with y, as if one occurrence of those counted here had not been."""
    if y is not None:
        n0, n1 = np.maximum(n0 - (1 - y) * (weight > 0), 0), np.maximum(n1 - y * (weight > 0), 0)
    return np.log((n1 + 0.3) / (n0 + 0.3)), n0 + n1


def _inputs(counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(logits of the counters and a bias, gates) from the counters' (n0, n1), the longest context last."""
    size = len(counts[0][0])
    logits = np.full((len(counts) + 1, size), 0.3, np.float32)
    gate = np.zeros(size, np.int64)
    for k, (n0, n1) in enumerate(counts):
        logits[k], total = _counted(n0, n1, y, weight)
        seen = total > 0
        gate[seen] = 1 + k * GRADES + np.minimum(GRADES - 1, np.log2(np.maximum(total[seen], 1)).astype(np.int64) // 2)
    return logits, gate


class Mixer:
    """Weights by gate, and a probability map by gate and step of the mixed logit."""

    def __init__(self, inputs: int = N_INPUTS, weights: np.ndarray | None = None, tallies: np.ndarray | None = None):
        self.gates = inputs * GRADES + 1
        self.weights = np.full((self.gates, inputs + 1), 0.3, np.float64) if weights is None else weights
        self.tallies = np.zeros((self.gates, STEPS, 2)) if tallies is None else tallies

    def mixed(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights[gate]
        return np.clip(np.einsum("kn,nk->n", logits, w), -12, 12)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed logit and the map's, read between two steps."""
        at = (z + 12) * ((STEPS - 1) / 24)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        centre = np.linspace(-12, 12, STEPS)
        prior = 1 / (1 + np.exp(-centre))
        p = (self.tallies[..., 1] + 4 * prior) / (self.tallies.sum(axis=2) + 4)
        part = at - low
        q = p[gate, low] * (1 - part) + p[gate, low + 1] * part
        return 1 / (1 + np.exp(-0.5 * (z + np.log(q / (1 - q)))))

    def learn(self, logits: np.ndarray, gate: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One online step: a damped Newton step per gate, its curvature bounded from above so that no step goes astray;
        then the map's tallies."""
        if not len(gate):
            return
        z = self.mixed(logits, gate)
        slope = weight * (y - 1 / (1 + np.exp(-z)))
        order = np.argsort(gate, kind="stable")
        found, begin = np.unique(gate[order], return_index=True)
        for g, rows in zip(found.tolist(), np.split(order, begin[1:]), strict=True):
            x, w = logits[:, rows].astype(np.float64), weight[rows]
            bend = (x * (w * 0.25)) @ x.T
            bend[np.diag_indices_from(bend)] += 0.01 * w.sum() + 1.0
            self.weights[g] += _RATE * np.linalg.solve(bend, x @ slope[rows])
        np.clip(self.weights, -1, 3, out=self.weights)
        at = np.rint((self.mixed(logits, gate) + 12) * ((STEPS - 1) / 24)).astype(np.int64)
        self.tallies += np.bincount((gate * STEPS + at) * 2 + y, weight, self.gates * STEPS * 2).reshape(self.gates, STEPS, 2)


# Symbols


def _symbols(tokens: Tokens, keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each token, cell of its class, the two symbols before it in its text and itself)."""
    at = np.minimum(np.searchsorted(keys, tokens.plain), len(keys) - 1)
    symbol = np.where(keys[at] == tokens.plain, names[at], 0)
    order = np.argsort(tokens.owner, kind="stable")  # words, then the end, of each text
    own, s = tokens.owner[order], symbol[order]
    back = []
    for step in (1, 2):
        b = np.zeros(len(s), np.int64)
        b[step:] = np.where(own[step:] == own[:-step], s[:-step], 0)
        back.append(b)
    cell = np.empty(len(s), np.int64)
    cell[order] = ((tokens.classes[own] * SYMBOLS + back[1]) * SYMBOLS + back[0]) * SYMBOLS + s
    return symbol, cell


def symbol_counts(rows: DataFrame, mixture: Mixture, keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Uses by class, the two symbols before and the symbol: a table of fixed size."""
    size = CLASSES * SYMBOLS**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, data, offsets in _text.slices(batch, "text"):
                cells, n = np.unique(_symbols(Tokens(data, offsets, mixture.classes), keys, names)[1], return_counts=True)
                total[cells] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    made = rows.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    out = np.zeros(size)
    out[made["cell"].to_numpy()] = made["n"].to_numpy()
    return out.reshape(CLASSES, SYMBOLS, SYMBOLS, SYMBOLS)


def symbol_logs(counts: np.ndarray) -> np.ndarray:
    """log10 probability of a symbol by class and the two symbols before: its bits mixed from five contexts."""
    sums = [counts.sum(axis=axes, keepdims=True) for axes in ((0, 1, 2), (1, 2), (0, 1), (1,), ())]  # none; class; one before; both; all
    out = np.zeros(counts.shape)
    for j in range(SYMBOL_BITS):
        level = [x.reshape(*x.shape[:3], 1 << j, 2, -1).sum(axis=-1) for x in sums]  # contexts, bits so far, the bit
        full = level[-1]
        shape = full.shape[:-1]
        spread = [(np.broadcast_to(x[..., 0], shape).ravel(), np.broadcast_to(x[..., 1], shape).ravel()) for x in level]
        mixer = Mixer(len(spread))
        seen = np.flatnonzero(full.reshape(-1, 2).sum(axis=1))
        for _ in range(12):
            cases = [(seen[full.reshape(-1, 2)[seen, y] > 0], y) for y in (0, 1)]
            own = np.concatenate([c for c, _ in cases])
            bit = np.concatenate([np.full(len(c), y) for c, y in cases])
            logits, gate = _inputs([(a[own], b[own]) for a, b in spread], bit, np.ones(len(own)))
            mixer.learn(logits, gate, bit, full.reshape(-1, 2)[own, bit])
        mixer.tallies /= 12
        p = np.empty(len(spread[0][0]))
        for a in range(0, len(p), 1 << 17):
            logits, gate = _inputs([(m[a : a + (1 << 17)], n[a : a + (1 << 17)]) for m, n in spread])
            p[a : a + (1 << 17)] = mixer.refined(mixer.mixed(logits, gate), gate)
        p = p.reshape(shape)
        out += np.log10(np.stack([1 - p, p], axis=-1)).repeat(1 << (SYMBOL_BITS - 1 - j), axis=-1).reshape(counts.shape)
    return out.astype(np.float32)


# Spelling


class Edges:
    """The bytes of words sorted by class and word, each shared prefix once: bytes, places, context hashes, words of each.

    Made some words at a time: of all bytes only what stays is held at once.
    """

    def __init__(self, words: pa.Array, classes: np.ndarray):
        self.n = len(words)
        parts = [coded(words.slice(k, CHUNK), END) for k in range(0, self.n, CHUNK)]
        parts = [(data, np.bincount(owner, minlength=min(CHUNK, self.n - k * CHUNK))) for k, (data, owner, _) in enumerate(parts)]
        data, self.size = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate((np.uint8, np.int64)))
        self.start = np.cumsum(self.size) - self.size
        common = np.zeros(self.n, np.int64)
        live = 1 + np.flatnonzero(classes[1:] == classes[:-1])
        depth = 0
        while len(live):
            live = live[(self.size[live] > depth) & (self.size[live - 1] > depth)]
            live = live[data[self.start[live] + depth] == data[self.start[live - 1] + depth]]
            depth += 1
            common[live] = depth
        self.edge = np.empty(len(data), np.int32)
        latest = np.zeros(int(self.size.max(initial=0)), np.int64)  # by place, the last new edge and 1
        made, n = [self._made(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for a, z, own in self._parts():
            part, owner = data[own], np.repeat(np.arange(z - a), self.size[a:z])
            place = np.arange(len(part)) - (self.start[a:z] - self.start[a])[owner]
            new = place >= common[a:z][owner]
            # By place, the edge that a byte shares is the last new one.
            order = np.argsort(place, kind="stable")
            number = np.where(new, n + np.cumsum(new), latest[place])
            last = np.maximum.accumulate(place[order] << 40 | number[order]) & ((1 << 40) - 1)
            self.edge[own.start + order] = last - 1
            latest[place[order]] = last
            at = np.flatnonzero(new)
            made.append(self._made(part, place, at) | {"kind": classes[a:z][owner[at]].astype(np.uint8)})
            n += len(at)
        made[0]["kind"] = np.zeros(0, np.uint8)
        self.data, self.place, self.prefix, self.kind = (np.concatenate([m.pop(c) for m in made]) for c in ("data", "place", "prefix", "kind"))
        self.short = []
        for k, (_, with_class, _) in enumerate(SHORT_CONTEXTS):
            named = np.concatenate([m.pop(k) for m in made])
            self.short.append(_text.mix64(named + self.group if with_class else named))

    @staticmethod
    def _made(data: np.ndarray, place: np.ndarray, at: np.ndarray) -> dict:
        """Bytes, places, hashes of the whole prefix and of the short contexts without the class, of the bytes at these positions."""
        power, inverse = _text._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_text._BYTE[data] * power[: len(data)], out=total[1:])
        own = place[at]
        out = {"data": data[at], "place": own.astype(np.int32), "prefix": _text.mix64((total[at] - total[at - own]) * inverse[at - own] + own.astype(np.uint64))}
        before = np.zeros(len(at), np.uint64)
        for k, (back, *_) in enumerate(SHORT_CONTEXTS):
            last = np.where(own >= back, data[np.maximum(at - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            before = before * np.uint64(257) + last
            out[k] = before + (np.uint64(back) << np.uint64(58))
        return out

    def _parts(self) -> Iterator[tuple[int, int, slice]]:
        """Runs of words, from one to before another, and their bytes."""
        for a in range(0, self.n, CHUNK):
            z = min(a + CHUNK, self.n)
            yield a, z, slice(int(self.start[a]), int(self.start[z - 1] + self.size[z - 1]))

    @property
    def group(self) -> np.ndarray:
        return (self.kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3)

    def weights(self, per_word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.data))
        for a, z, own in self._parts():
            found, back = np.unique(self.edge[own], return_inverse=True)
            out[found] += np.bincount(back, np.repeat(per_word[a:z], self.size[a:z]), len(found))
        return out

    def totals(self, per_edge: np.ndarray) -> np.ndarray:
        parts = [np.bincount(np.repeat(np.arange(z - a), self.size[a:z]), per_edge[self.edge[own]], z - a) for a, z, own in self._parts()]
        return np.concatenate([np.zeros(0), *parts])

    def bit(self, j: int, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of bit j of these edges: its values, a number of the bits before it, the slots of the short contexts."""
        data = self.data[at]
        node = (data.astype(np.uint64) >> np.uint64(8 - j)) | np.uint64(1 << j)
        step = node * np.uint64(0x9E3779B97F4A7C15)
        slots = [((h[at] ^ step) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - size)).astype(np.int64) for h, (*_, size) in zip(self.short, SHORT_CONTEXTS, strict=True)]
        return ((data >> (7 - j)) & 1).astype(np.int64), step, slots


def _exact(key: np.ndarray, y: np.ndarray, weight: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Uses with a 0 and with a 1 of each key, none where the shard does not hold all of them."""
    _, back = np.unique(key, return_inverse=True)
    n1, every = np.bincount(back, weight * y)[back], np.bincount(back, weight)[back]
    return (every - n1) * known, n1 * known


def _whole(edges: Edges, weight: np.ndarray, lead: int, j: int, kind=np.float64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n0, n1) of the whole prefixes' counters at bit j of all edges, without and with the class."""
    known = edges.place >= lead
    node = (edges.data.astype(np.uint64) >> np.uint64(8 - j)) | np.uint64(1 << j)
    step, y = node * np.uint64(0x9E3779B97F4A7C15), (edges.data >> (7 - j)) & 1
    return [tuple(n.astype(kind, copy=False) for n in _exact(key ^ step, y, weight, known)) for key in (edges.prefix, edges.prefix + edges.group)]


def _counts(edges: Edges, j: int, at: slice, tables: list[np.ndarray], whole: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """At bit j of some of the edges: its values and the counters' (n0, n1)."""
    y, _, slots = edges.bit(j, at)
    return y, [(t[s, 0], t[s, 1]) for t, s in zip(tables, slots, strict=True)] + [(a[at], b[at]) for a, b in whole]


def count_tables(vocabulary: DataFrame) -> list[np.ndarray]:
    """Counter tables [slot, bit] of the short contexts, summed over the vocabulary's training counts c."""
    sizes = [1 << size for *_, size in SHORT_CONTEXTS]
    block = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * n) for n in sizes]
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                part = pa.table(batch.slice(k, CHUNK)).sort_by([("g", "ascending"), ("word", "ascending")]).combine_chunks()
                edges = Edges(part["word"].chunk(0), part["g"].to_numpy())
                weight = edges.weights(part["c"].to_numpy().astype(float))
                for j in range(8):
                    y, _, slots = edges.bit(j)
                    for table, slot in zip(tables, slots, strict=True):
                        np.add.at(table, 2 * slot + y, weight)
        for k, table in enumerate(tables):
            for b in range(0, len(table), block):
                own = table[b : b + block]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b // block], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["k", "b", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table["counts"].to_pylist())  # whole numbers: the same in any order
        return pa.table({"k": table["k"][:1], "b": table["b"][:1], "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    made = vocabulary.select("word", "g", "c").mapInArrow(run, "k int, b int, counts binary")
    rows = made.groupBy("k", "b").applyInArrow(add, "k int, b int, counts binary").collect()  # fixed size
    tables = [np.zeros(2 * n, np.float32) for n in sizes]
    for r in rows:
        own = np.frombuffer(r["counts"], np.float32)
        tables[r["k"]][r["b"] * block : r["b"] * block + len(own)] = own
    return [t.reshape(-1, 2) for t in tables]


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("g", "ascending"), ("word", "ascending")]).combine_chunks()


def _word_column(table: pa.Table) -> pa.Array:
    return pa.concat_arrays(table["word"].chunks).cast(pa.binary())


def learned(edges: Edges, weight: np.ndarray, tables: list[np.ndarray], lead: int = LEAD) -> Mixer:
    """A mixer that learnt every bit of every edge, some edges at a time.

    A common beginning makes a large shard, so only the whole prefixes' counters are held for all edges; those of the
    short contexts are looked up for the edges of a step.
    """
    mixer = Mixer()
    whole = [_whole(edges, weight, lead, j, np.float32) for j in range(8)]
    for k in range(0, len(edges.data), LEARN):
        at = slice(k, k + LEARN)
        for j in range(8):
            y, counts = _counts(edges, j, at, tables, whole[j])
            logits, gate = _inputs(counts, y, weight[at])
            mixer.learn(logits, gate, y, weight[at])
    return mixer


def train_mixer(vocabulary: DataFrame, tables, lead: int = LEAD) -> Mixer:
    """Each shard learns online over its words in their order; weights are averaged by mass, tallies added."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        edges = Edges(_word_column(table), table["g"].to_numpy())
        mixer = learned(edges, edges.weights(table["c"].to_numpy().astype(float)), tables.value, lead)
        values = (mixer.weights, mixer.tallies, mixer.tallies.sum(axis=(1, 2)))
        return pa.table({"shard": table["shard"][:1]} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("weights", "tallies", "mass"), values, strict=True)})

    # Sums of shards, a fixed-size row each, before they reach the driver.
    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        weights, tallies, mass = (np.stack([np.frombuffer(x) for x in table[c].to_pylist()]) for c in ("weights", "tallies", "mass"))
        total = (weights.reshape(len(mass), mass.shape[1], -1) * mass[:, :, None]).sum(axis=0)
        return pa.table({"weights": pa.array([total.tobytes()], pa.binary()), "tallies": pa.array([tallies.sum(axis=0).tobytes()], pa.binary()), "mass": pa.array([mass.sum(axis=0).tobytes()], pa.binary())})

    fields = "weights binary, tallies binary, mass binary"
    per = vocabulary.select("shard", "word", "g", "c").groupBy("shard").applyInArrow(run, f"shard long, {fields}")
    rows = per.groupBy(F.floor(F.col("shard") / 256).alias("many")).applyInArrow(add, fields).collect()
    mixer, seen = Mixer(), 0
    total = np.zeros_like(mixer.weights)
    for r in rows:
        total += np.frombuffer(r["weights"]).reshape(total.shape)
        seen = seen + np.frombuffer(r["mass"])
        mixer.tallies += np.frombuffer(r["tallies"]).reshape(mixer.tallies.shape)
    if rows:
        mixer.weights = np.where(seen[:, None] > 0, total / np.maximum(seen, 1e-9)[:, None], mixer.weights)
    return mixer


def log10_words(edges: Edges, weight: np.ndarray, tables: list[np.ndarray], mixer: Mixer, lead: int = LEAD) -> np.ndarray:
    """log10 probability of each word with its blank in its class."""
    total = np.zeros(len(edges.data))
    for j in range(8):
        whole = _whole(edges, weight, lead, j)
        for k in range(0, len(total), LEARN):
            at = slice(k, k + LEARN)
            y, counts = _counts(edges, j, at, tables, whole)
            logits, gate = _inputs(counts)
            p = mixer.refined(mixer.mixed(logits, gate), gate)
            total[at] += np.log10(np.where(y == 1, p, 1 - p))
    return edges.totals(total)


def _scored(vocabulary: DataFrame, tables, mixer: Mixer, lead: int) -> DataFrame:
    """hash, c (training count of the word in all classes), log10 probability"""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        edges = Edges(_word_column(table), table["g"].to_numpy())
        lp = log10_words(edges, edges.weights(table["c"].to_numpy().astype(float)), tables.value, mixer, lead)
        return pa.table({"hash": table["hash"], "c": table["all"], "lp": pa.array(lp)})

    return vocabulary.select("shard", "word", "g", "c", "hash", "all").groupBy("shard").applyInArrow(run, "hash long, c long, lp double")


def _frequent(scored: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The words used at least as often as a power of two that leaves FREQUENT of them at most: (bound, hashes, c, lp)."""
    grade = F.floor(F.log2(F.greatest("c", F.lit(1)))).cast("int")
    sizes = {r["g"]: r["n"] for r in scored.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect()}
    held, bound = 0, 1 << 62
    for g in sorted(sizes, reverse=True):
        if held + sizes[g] > FREQUENT:
            break
        held, bound = held + sizes[g], 1 << g
    rows = scored.filter(F.col("c") >= bound).toArrow()
    return bound, *(rows[c].to_numpy() for c in ("hash", "c", "lp"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    Rows of fold `held` teach nothing.  base_score is the add-one unigram model's.  Null and empty texts are the end
    token alone; a null doc_id is scored and never learnt from; repeated rows teach and score each; an empty table
    gives an empty result; other columns of docs are not read.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    train = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)
    mixture = fit_mixture(rows.filter(train))
    found = word_counts(rows.withColumn("c", train.cast("int")), ["c"], mixture.classes)
    vocabulary = written(found, "lm-vocabulary")
    per = written(vocabulary.groupBy("plain").agg(F.sum("c").alias("all")), "lm-words")
    facts = per.agg(F.count_if(F.col("all") > 0).alias("v"), F.coalesce(F.sum("all"), F.lit(0)).alias("n")).first()
    n, v = facts["n"], facts["v"]
    end = int(END_HASH.view(np.int64))
    top = per.filter((F.col("all") > 0) & (F.col("plain") != end)).orderBy(F.desc("all"), "plain").limit(SYMBOLS - 2).collect()
    keys = np.array([end, *(r["plain"] for r in top)], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, names = keys[order], order + 1
    logs = spark.sparkContext.broadcast(symbol_logs(symbol_counts(rows.filter(train), mixture, keys, names)))

    shards = max(1, v // SHARD)
    is_symbol = F.col("plain").isin([int(k) for k in keys.view(np.int64)])
    lead = LEAD + max(0, math.ceil(math.log(shards / 1000, 8)) if shards > 1000 else 0)
    spelled = vocabulary.filter(~is_symbol).withColumn("shard", F.pmod(F.xxhash64(F.substring("word", 1, lead)), F.lit(shards)))
    taught = spelled.filter("c > 0")
    share = spark.sparkContext.broadcast(count_tables(taught))
    mixer = train_mixer(taught, share, lead)
    scored = _scored(spelled.join(per, "plain"), share, mixer, lead)
    scored = written(scored.unionByName(vocabulary.filter(is_symbol).join(per, "plain").select("hash", F.col("all").alias("c"), F.lit(0.0).alias("lp"))), "lm-scored")
    bound, hashes, counts, lps = _frequent(scored)
    common = spark.sparkContext.broadcast((hashes.view(np.uint64), counts, lps))
    unit = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, c, lp = common.value
        order = np.argsort(frequent, kind="stable")
        frequent, c, lp = frequent[order], c[order], lp[order]
        cells = logs.value.reshape(-1)
        task, k = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                tokens = Tokens(data, offsets, mixture.classes)
                owner = tokens.owner
                found, back = np.unique(tokens.key, return_inverse=True)
                at = np.minimum(np.searchsorted(frequent, found), max(0, len(frequent) - 1))
                hit = frequent[at] == found if len(frequent) else np.zeros(len(found), bool)
                values = [np.where(hit, x[at], 0.0) if len(frequent) else np.zeros(len(found)) for x in ((c > 0).astype(float), np.log10(c + 1.0), lp)]
                sums = [np.bincount(owner, x[back], len(own)) for x in values]
                sums[2] += mixture.share[tokens.classes] / math.log(10)
                sums[2] += np.bincount(owner, cells[_symbols(tokens, keys, names)[1]], len(own))
                # Rare tokens wait for the join, text by text.
                rare = np.flatnonzero(~hit[back])
                rare = rare[np.argsort(owner[rare], kind="stable")]
                edge = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(own)))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(edge), pa.array(tokens.key[rare].view(np.int64)))
                row = task + k + np.arange(len(own))
                k += len(own)
                columns = [own.column(0), pa.array(row), pa.array(np.bincount(owner, minlength=len(own))), pa.array(np.diff(offsets)), *map(pa.array, sums), tail]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_tokens", "n_bytes", "known", "base", "lp", "tail"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = written(rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, n_bytes long, known double, base double, lp double, tail array<long>"), "lm-parts")
    tail = parts.select("row", F.explode("tail").alias("hash")).join(scored.filter(F.col("c") < bound), "hash")
    tail = tail.groupBy("row").agg(F.sum((F.col("c") > 0).cast("double")).alias("known2"), F.sum(F.log10(F.col("c") + 1)).alias("base2"), F.sum("lp").alias("lp2"))
    zero = F.lit(0.0)
    all_ = parts.drop("tail").join(tail, "row", "left")
    log10 = F.col("lp") + F.coalesce("lp2", zero)
    return all_.select(
        "doc_id",
        (F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) == held)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known2", zero)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        log10.alias("score"),
        "n_bytes",
        (-log10 * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
