"""Trails, cycles, reach, chains and proximity against plain enumeration, and on hubs."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph, trails, windows

def table(spark, rows):
    """(src, dst, amount, minute) as transfers."""
    made = spark.createDataFrame([(k, s, d, float(a), int(m * 60_000_000)) for k, (s, d, a, m) in enumerate(rows)], "event_id long, src long, dst long, amount double, t long")
    return made.select("event_id", "src", "dst", F.col("amount").cast("decimal(18,2)").alias("amount"), F.timestamp_micros("t").alias("ts"))


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def brute_trails(rows, sources, targets, width, hops, closed=False):
    """(nodes, total, first minute, last minute) of every trail, or of every round where closed."""
    out, by = [], collections.defaultdict(list)
    for s, d, a, m in rows:
        by[s].append((d, a, m))

    def go(path, total, t0, t):
        for d, a, m in by[path[-1]]:
            if (t is None or m > t) and (t0 is None or m <= t0 + width) and len(path) <= hops:
                start = m if t0 is None else t0
                if closed and d == path[0] and len(path) > 1:
                    out.append((tuple(path), total + a, start, m))
                if d not in path:
                    if not closed and d in targets:
                        out.append((tuple(path) + (d,), total + a, start, m))
                    go([*path, d], total + a, start, m)

    for s in sources:
        go([s], 0.0, None, None)
    return out


def busy(seed, n, accounts, minutes):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        s, d = rng.randrange(accounts), rng.randrange(accounts)
        if s != d:
            rows.append((s, d, rng.randint(1, 40) / 4, rng.randrange(minutes)))
    return rows


@pytest.mark.parametrize("seed,accounts", [(1, 9), (2, 30), (3, 6)])
def test_trails_equal_the_enumeration(spark, seed, accounts):
    """Sources that are paid themselves, targets that pay on, equal times, parallel transfers."""
    rows = busy(seed, 70, accounts, 2000)
    sources, targets = list(range(0, accounts, 2)), list(range(0, accounts, 3))
    want = brute_trails(rows, sources, targets, 300, 4)
    got = trails.trails(table(spark, rows), nodes(spark, sources), nodes(spark, targets), 300, max_hops=4)
    best = {}
    for p, total, t0, t in want:
        key = (p[0], p[-1])
        own = (len(p) - 1, -total, ">".join(map(str, p)), round(t - t0, 2))
        best[key] = (min(best.get(key, (own, 0))[0], own), best.get(key, (own, 0))[1] + 1)
    found = {(r.source, r.target): ((r.hops, -r.total, r.path, r.minutes), r.n_paths) for r in got.pairs().collect()}
    assert found == best and len(best) > 3
    through = collections.Counter(x for p, *_ in want for x in p[1:-1])
    assert {r.node: (r.n_paths, r.share) for r in got.share().collect()} == {x: (n, pytest.approx(n / len(want), abs=6e-5)) for x, n in through.items()}
    assert {r.node for r in got.nodes().collect()} == {x for p, *_ in want for x in p}


def test_a_hub_is_not_multiplied_out(spark):
    """10,000 payments into an account and 10,000 out of it, within the window: 100 million trails, rows as the transfers."""
    n = 10_000
    rows = [(1_000 + k, 1, 2.0, k / 100) for k in range(n)] + [(1, 2 + k % 3, 1.0 + k % 7, 200 + k / 100) for k in range(n)]
    got = trails.trails(table(spark, rows), nodes(spark, range(1_000, 1_000 + n)), nodes(spark, [2, 3, 4]), 1440)
    assert got.ends.count() == 3 * n and sum(level.count() for level in got.levels) == n
    (row,) = got.share().collect()
    assert (row.node, row.n_paths, row.share) == (1, n * n, 1.0)
    pairs = got.pairs().agg(F.count("*").alias("n"), F.sum("n_paths").alias("all"), F.min("total").alias("low"), F.max("total").alias("high")).first()
    assert tuple(pairs) == (3 * n, n * n, 9.0, 9.0)


def test_equal_totals_tie_whatever_they_are_added_up_from(spark):
    """0.1 + 0.7 is less than 0.4 + 0.4 in doubles, and both are 0.80: the first path as text wins, then the fewest minutes."""
    rows = [(1, 2, 0.1, 0), (2, 9, 0.7, 5), (1, 3, 0.4, 0), (3, 9, 0.4, 3)]
    (one,) = trails.trails(table(spark, rows), nodes(spark, [1]), nodes(spark, [9]), 60).pairs().collect()
    assert (one.hops, one.total, one.path, one.minutes, one.n_paths) == (2, 0.8, "1>2>9", 5.0, 2)
    rows = [(1, 2, 0.1, 0), (2, 3, 0.2, 40), (1, 2, 0.15, 41), (2, 3, 0.15, 44)]
    (one,) = trails.trails(table(spark, rows), nodes(spark, [1]), nodes(spark, [3]), 43).pairs().collect()
    assert (one.total, one.path, one.minutes, one.n_paths) == (0.3, "1>2>3", 3.0, 2)


def test_no_trails(spark):
    t = table(spark, [(1, 2, 1, 0), (2, 3, 1, 5000)])
    got = trails.trails(t, nodes(spark, [1]), nodes(spark, [3]), 60)
    assert got.pairs().count() == got.share().count() == got.nodes().count() == 0
    assert trails.trails(t.limit(0), nodes(spark, []), nodes(spark, []), 60).pairs().count() == 0


@pytest.mark.parametrize("seed,accounts", [(4, 8), (5, 14)])
def test_timed_cycles_equal_the_enumeration(spark, seed, accounts):
    rows = busy(seed, 90, accounts, 3000)
    want = collections.Counter(p for p, *_ in brute_trails(rows, range(accounts), [], 600, 6, closed=True))
    got = {tuple(r.cycle): (r.length, r.n) for r in graph.timed_cycles(table(spark, rows), 600).collect()}
    assert got == {p: (len(p), n) for p, n in want.items()} and max(map(len, want)) >= 4


def test_static_cycles_equal_the_enumeration(spark):
    pairs = {(s, d) for s, d, *_ in busy(6, 22, 8, 10)}
    want = set()
    for k in range(2, 7):
        for p in itertools.permutations(range(8), k):
            if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, p[1:] + p[:1], strict=True)):
                want.add(p)
    got = graph.cycles(table(spark, [(a, b, 1, 0) for a, b in pairs] * 2)).collect()
    assert sorted(tuple(r.cycle) for r in got) == sorted(want) and len(want) > 5
    assert all(r.length == len(r.cycle) for r in got)


def test_reach_equals_breadth_first_search(spark):
    rows = [*busy(7, 150, 140, 10), *[(200 + k, 201 + k, 1, 0) for k in range(9)]]
    out = collections.defaultdict(set)
    for s, d, *_ in rows:
        out[s].add(d)
    want = {}
    for s in list(out):
        seen, front, depth = {s}, {s}, 0
        for level in range(1, 7):
            front = {d for x in front for d in out[x]} - seen
            seen |= front
            depth = level if front else depth
        want[s] = depth
    assert {r.node: r.depth for r in graph.reach(table(spark, rows)).collect()} == want


def test_layering_equals_the_enumeration(spark):
    rows = busy(8, 200, 12, 1500)
    depth = collections.Counter()

    def go(account, at, t0, t, k):
        depth[account] = max(depth[account], k)
        for s, d, _, m in rows:
            if k < 6 and s == at and t < m <= t0 + 30:
                go(account, d, t0, m, k + 1)

    for s, d, _, m in rows:
        go(s, d, m, m, 1)
    assert {r.account: r.depth for r in windows.layering_chains(table(spark, rows)).collect()} == depth and max(depth.values()) >= 4


def test_betweenness_of_a_long_line_is_the_same_both_ways(spark):
    """Forty levels, beyond any former cut."""
    edges = table(spark, [(k, k + 1, 1, 0) for k in range(40)] + [(3, 50, 1, 0), (50, 4, 1, 0)])
    one, two = ({r.node: round(r.betweenness, 10) for r in graph.betweenness(edges, dense=d).collect()} for d in (True, False))
    assert one == two and one[20] == round(21 * 20 / (41 * 40), 10)


def test_time_proximity_with_one_dominant_counterparty(spark, monkeypatch):
    """Half of all events at one counterparty, its buckets cut into blocks."""
    monkeypatch.setattr(windows, "BLOCK", 7)
    rng = random.Random(9)
    rows = [(rng.randrange(100, 140), 1 if k % 2 else rng.randrange(2, 6), 1, rng.randrange(400)) for k in range(300)]
    want = collections.Counter()
    for (a, x, _, m), (b, y, _, n) in itertools.permutations(rows, 2):
        if a < b and x == y and abs(m - n) <= 60:
            want[a, b] += 1
    got = windows.time_proximity(table(spark, rows), "src", "ts", 60).collect()
    assert {(r.a, r.b): r.n for r in got} == want
