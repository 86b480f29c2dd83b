"""Pairs of keys with events of one counterparty close in time, counted where they are found.

Keys are dealt into blocks, and a task gets the events of two blocks (a tile): every pair of keys is met in one tile
with all events of both, so its count is whole there and no row a pair is ever shuffled.  What is shuffled is each event
once a block, packed into arrays; the number of blocks grows with the events, as a tile holds ROWS of them.

A key of more than HEAVY events would fill a tile; its pairs, at most one a key, come from a join by counterparty and
time bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.checkpoints import cut, shipped

#: Events of a tile, about; events of a key beyond which it is joined by bucket; events, and pairs of events, at once.
ROWS, HEAVY, PACK, CHUNK = 2_000_000, 250_000, 4_096, 1_000_000
#: Bits of a tile's most common classes.
BITS = 1 << 30


def _coded(values: pa.Array, names: pa.Array) -> np.ndarray:
    """Places in names, -1 for those that are not there."""
    return pc.fill_null(pc.index_in(values, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted(values: pa.Array) -> pa.Array:
    values = pc.unique(values)
    return values.take(pc.array_sort_indices(values))


def _runs(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ..., of each length."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _near(left: tuple, right: tuple, n_right: int, width: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, n) of keys of the left and the right side (key, counterparty, time) with n pairs of near events."""
    (kl, dl, tl), (kr, dr, tr) = left, right
    times = np.unique(tr)
    base = len(times) + 1
    order = np.lexsort((tr, dr))
    at, who = dr[order] * base + np.searchsorted(times, tr[order]), kr[order]
    order = np.argsort(kl, kind="stable")
    order = order[dl[order] >= 0]
    kl, dl, tl = kl[order], dl[order], tl[order]
    lo = np.searchsorted(at, dl * base + np.searchsorted(times, tl - width, "left"))
    hi = np.searchsorted(at, dl * base + np.searchsorted(times, tl + width, "right"))
    some = hi > lo
    kl, lo, hi = kl[some], lo[some], hi[some]
    del left, right, kr, dr, tr, dl, tl, times, order, some, at
    if not len(kl):
        return
    first = np.flatnonzero(np.concatenate([[True], kl[1:] != kl[:-1]]))
    last, sums = np.append(first[1:], len(kl)), np.concatenate([[0], np.cumsum(hi - lo)])
    until, k = sums[last], 0
    while k < len(first):
        start = first[k]
        end = int(np.searchsorted(until, sums[start] + CHUNK, "right"))  # keys whose events fit
        if end <= k:
            # One key near very many events: how often each of them is met, from where its ranges begin and end.
            rows = slice(start, last[k])
            met = np.cumsum(np.bincount(lo[rows], minlength=len(who) + 1) - np.bincount(hi[rows], minlength=len(who) + 1))[:-1]
            n = np.bincount(who, met, n_right).astype(np.int64)
            y = np.flatnonzero(n)
            x, n, k = np.full(len(y), kl[start]), n[y], k + 1
        else:
            rows = slice(start, last[end - 1])
            size = hi[rows] - lo[rows]
            code = (np.repeat(kl[rows], size) - kl[start]) * n_right + who[_runs(lo[rows], size)]
            code.sort()
            new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            n, code, k = np.diff(np.append(new, len(code))), code[new], end
            x, y = code // n_right + kl[start], code % n_right
        if same:
            own = y > x
            x, y, n = x[own], y[own], n[own]
        yield x, y, n


def _sharing(left: tuple, right: tuple, n_left: int, n_right: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether x and y share a class, of (key, class) of both sides: the most common classes as bits, the rest looked up."""
    (kl, cl), (kr, cr) = left, right
    names, n = np.unique(np.concatenate([np.unique(cl), np.unique(cr)]), return_counts=True)
    names = names[n == 2]
    own = [np.isin(c, names) for c in (cl, cr)]
    (kl, cl), (kr, cr) = (kl[own[0]], np.searchsorted(names, cl[own[0]])), (kr[own[1]], np.searchsorted(names, cr[own[1]]))
    place = np.empty(len(names), np.int64)
    place[np.argsort(-(np.bincount(cl, minlength=len(names)) + np.bincount(cr, minlength=len(names))), kind="stable")] = np.arange(len(names))
    cl, cr = place[cl], place[cr]
    words = min((len(names) + 63) // 64, max(1, BITS // 64 // (n_left + n_right)))
    bits = []
    for key, c, size in ((kl, cl, n_left), (kr, cr, n_right)):
        table = np.zeros((words, size), np.uint64)
        order = np.argsort(c, kind="stable")
        ends = np.searchsorted(c[order], np.arange(words * 64 + 1))
        for b in range(words * 64):
            table[b // 64, key[order[ends[b] : ends[b + 1]]]] |= np.uint64(1) << np.uint64(b % 64)
        bits.append(table)
    rare = cl >= words * 64
    order = np.argsort(kl[rare], kind="stable")
    of, rare_c = kl[rare][order], cl[rare][order]
    begin, there = np.searchsorted(of, np.arange(n_left + 1)), np.sort(kr * len(names) + cr)

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(x), bool), np.arange(len(x))
        for w in range(words):
            hit = bits[0][w, x[open_]] & bits[1][w, y[open_]] != 0
            out[open_[hit]] = True
            open_ = open_[~hit]
        size = begin[x[open_] + 1] - begin[x[open_]]
        sums, k = np.cumsum(size), 0
        while len(rare_c) and k < len(open_):
            end = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + CHUNK, "right")))
            part = open_[k:end]
            wanted = np.repeat(y[part], size[k:end]) * len(names) + rare_c[_runs(begin[x[part]], size[k:end])]
            found = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
            out[np.repeat(part, size[k:end])[found]] = True
            k = end
        return out

    return run


def _tile(width: int, counts: bool, chosen: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        i, j = (table[c][0].as_py() for c in ("i", "j"))
        flat = lambda part, c: part[c].combine_chunks().flatten()
        events, classes, links = (table.filter(pc.is_valid(table[c])) for c in ("t", "c", "b"))
        sides = [events.filter(pc.equal(events["block"], x)) for x in ((i,) if i == j else (i, j))]
        if not all(len(s) for s in sides):
            return
        names = [_sorted(flat(s, "a")) for s in sides]
        places = _sorted(flat(sides[-1], "dst"))
        rows = [(_coded(flat(s, "a"), x), _coded(flat(s, "dst"), places), flat(s, "t").to_numpy()) for s, x in zip(sides, names, strict=True)]
        n = [len(x) for x in names]
        if chosen:
            members = [(_coded(flat(classes, "a"), x), flat(classes, "c").to_numpy(zero_copy_only=False)) for x in names]
            members = [(k[k >= 0], c[k >= 0]) for k, c in members]
            shared = _sharing(members[0], members[-1], n[0], n[-1])
            ends = [(_coded(flat(links, c), names[0]), _coded(flat(links, d), names[-1])) for c, d in (("a", "b"), ("b", "a"))]
            linked = np.unique(np.concatenate([(x * n[-1] + y)[(x >= 0) & (y >= 0)] for x, y in ends]))
        degrees = [np.zeros(k, np.int64) for k in n]
        found = _near(rows[0], rows[-1], n[-1], width, i == j)
        del table, events, classes, links, sides, rows, places  # only what the pairs are made from stays in memory
        for x, y, m in found:
            if chosen:
                own = shared(x, y) | np.isin(x * n[-1] + y, linked)
                x, y, m = x[own], y[own], m[own]
            if counts:
                degrees[0] += np.bincount(x, minlength=n[0])
                degrees[-1] += np.bincount(y, minlength=n[-1])
                continue
            a, b = names[0].take(pa.array(x)), names[-1].take(pa.array(y))
            yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(m)], ["a", "b", "n"])
        if counts:
            for x, d in zip(names, degrees, strict=True):
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(d > 0)), pa.array(d[d > 0])], ["entity", "n"])

    return run


class Proximity:
    """Unordered pairs of keys of events (key, dst, ts) with events of one counterparty at most so far apart.

    The join by bucket holds so many (block) keys of one counterparty and bucket in a task.
    """

    def __init__(self, events: DataFrame, key: str, ts: str, minutes: int, block: int = 1_000):
        self.width, self.block = minutes * 60 * 1_000_000, block
        own = events.filter(F.col(key).isNotNull() & F.col("dst").isNotNull() & F.col(ts).isNotNull())
        self.events = cut(own.select(F.col(key).alias("a"), "dst", F.unix_micros(F.col(ts)).alias("t")))
        self.heavy = cut(self.events.groupBy("a").count().filter(F.col("count") > HEAVY).select("a"))
        self.has_heavy = not self.heavy.isEmpty()
        n = self.events.count()
        self.blocks = max(-(-2 * n // ROWS), min(4, -(-n // 50_000)), 1)
        shipped(events.sparkSession)

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def _tiles(self, classes: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
        """i, j, block, a, dst, t, c, b: the events of each two blocks, with (entity, class) and links (a, b) of their keys."""
        kind, to = (dict(self.events.dtypes)[c] for c in ("a", "dst"))
        shape = {"a": kind, "dst": to, "t": "bigint", "c": "bigint", "b": kind}

        def packed(rows: DataFrame, names: list[str], *by: Column) -> DataFrame:
            part = F.pmod(F.xxhash64(*names), F.lit(max(1, rows.count() // (PACK * self.blocks)))).alias("part")
            rows = rows.groupBy(*by, part).agg(F.collect_list(F.struct(*names)).alias("x"))
            return cut(rows.select(*[b for b in rows.columns if b not in ("part", "x")], *[(F.col(f"x.{c}") if c in names else F.lit(None)).cast(f"array<{t}>").alias(c) for c, t in shape.items()]))

        everywhere = lambda rows: rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with")
        light = self.events.join(F.broadcast(self.heavy), "a", "left_anti") if self.has_heavy else self.events
        out = everywhere(packed(light, ["a", "dst", "t"], self._block(F.col("a")).alias("block")))
        if classes is not None:
            out = out.unionByName(everywhere(packed(classes.select(F.col("entity").alias("a"), F.col("class").alias("c")), ["a", "c"], self._block(F.col("a")).alias("block"))))
            ends = [self._block(F.col(c)) for c in ("a", "b")]
            pairs = packed(links.select("a", "b").distinct(), ["a", "b"], F.least(*ends).alias("i"), F.greatest(*ends).alias("j"))
            out = out.unionByName(pairs.withColumn("block", F.col("i")))
        return out

    def _run(self, tiles: DataFrame, counts: bool = False, chosen: bool = False) -> DataFrame:
        kind = dict(self.events.dtypes)["a"]
        # Twice as many tasks as tiles, as some of them fall together; given, as a tile is much work and few bytes.
        tiles = tiles.repartition(self.blocks * (self.blocks + 1), "i", "j")
        shape = f"entity {kind}, n long" if counts else f"a {kind}, b {kind}, n long"
        return tiles.groupBy("i", "j").applyInArrow(_tile(self.width, counts, chosen), shape)

    def _heavy_pairs(self) -> DataFrame:
        """Pairs of which an end is heavy: a row a heavy key, other key and bucket before they are added up."""
        own = self.events.groupBy("dst", F.floor(F.col("t") / self.width).alias("bucket"), "a").agg(F.array_sort(F.collect_list("t")).alias("times"))
        own = cut(own.join(F.broadcast(self.heavy.withColumn("heavy", F.lit(True))), "a", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))))
        sizes = own.groupBy("dst", "bucket").agg(F.ceil(F.count("*") / self.block).alias("blocks"))
        placed = own.join(sizes, ["dst", "bucket"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).drop("blocks")
        # A heavy row goes to its own bucket's and both neighbours' blocks, any row to one.
        reach = F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)]))
        heavy = own.filter("heavy").select("dst", F.col("a").alias("h"), F.col("times").alias("others"), reach.alias("bucket"))
        heavy = heavy.join(sizes, ["dst", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        both = placed.join(heavy, ["dst", "bucket", "block"]).filter((F.col("a") < F.col("h")) | (~F.col("heavy") & (F.col("a") != F.col("h"))))
        near = F.aggregate("times", F.lit(0).cast("long"), lambda n, x: n + F.size(F.filter("others", lambda y: F.abs(x - y) <= self.width)))
        counted = both.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b"), near.alias("n")).filter("n > 0")
        return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))

    def pairs(self) -> DataFrame:
        """a, b, n (pairs of events)."""
        found = self._run(self._tiles())
        return found.unionByName(self._heavy_pairs()) if self.has_heavy else found

    def degrees(self) -> DataFrame:
        """entity, n: how many keys a key is paired with."""
        found = self._run(self._tiles(), counts=True)
        if self.has_heavy:
            found = found.unionByName(self._heavy_pairs().select(F.explode(F.array("a", "b")).alias("entity"), F.lit(1).cast("long").alias("n")))
        return found.groupBy("entity").agg(F.sum("n").alias("n"))

    def chosen(self, classes: DataFrame, links: DataFrame) -> DataFrame:
        """Those of pairs() whose ends share a class of (entity, class) or are the ends of a link (a, b), in either order."""
        found = self._run(self._tiles(classes, links), chosen=True)
        if self.has_heavy:
            every = cut(self._heavy_pairs())
            of = lambda end: classes.select(F.col("entity").alias(end), "class")
            shared = every.select("a", "b").join(of("a"), "a").join(of("b"), ["b", "class"]).select("a", "b")
            ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            found = found.unionByName(every.join(shared.unionByName(ends).distinct(), ["a", "b"], "left_semi"))
        return found
