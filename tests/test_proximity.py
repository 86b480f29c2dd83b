"""Keys near in time, by tiles and by buckets, against all pairs of events."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import links, proximity


def made(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, t long").select("src", "dst", F.timestamp_micros("t").alias("ts"))


@pytest.mark.parametrize("rows,heavy,chunk,bits", [(60, 1_000, 1_000_000, 1 << 30), (1_000, 30, 40, 64), (90, 12, 7, 64)])
def test_proximity_equals_all_pairs_of_events(spark, monkeypatch, rows, heavy, chunk, bits):
    """Blocks of few events, keys beyond a tile, keys near more events than are looked at at once, classes beyond the bits."""
    for name, value in (("ROWS", rows), ("HEAVY", heavy), ("PACK", 8), ("CHUNK", chunk), ("BITS", bits)):
        monkeypatch.setattr(proximity, name, value)
    rng = random.Random(rows)
    events = [(f"k{int(rng.paretovariate(0.7)) % 50:02d}", f"d{rng.randrange(4)}", rng.randrange(500) * 60_000_000) for _ in range(260)]
    want = collections.Counter()
    for (a, x, s), (b, y, t) in itertools.permutations(events, 2):
        if a < b and x == y and abs(s - t) <= 3_600_000_000:
            want[a, b] += 1
    near = proximity.Proximity(made(spark, [*events, (None, "d1", 0), ("k01", None, 0)]), "src", "ts", 60, block=5)
    assert near.has_heavy == (heavy < 100) and near.blocks == -(-2 * len(events) // rows)
    assert {(r.a, r.b): r.n for r in near.pairs().collect()} == want
    degrees = collections.Counter(x for pair in want for x in pair)
    assert {r.entity: r.n for r in near.degrees().collect()} == degrees
    # 150 classes: more than two words of bits.
    members = {(f"k{rng.randrange(50):02d}", c) for c in range(150) for _ in range(2)}
    own = collections.defaultdict(set)
    for e, c in members:
        own[e].add(c)
    ends = [tuple(rng.sample([f"k{k:02d}" for k in range(50)], 2)) for _ in range(40)]
    chosen = {p: n for p, n in want.items() if own[p[0]] & own[p[1]] or p in ends or p[::-1] in ends}
    got = near.chosen(spark.createDataFrame(sorted(members), "entity string, class long"), spark.createDataFrame(ends, "a string, b string"))
    assert {(r.a, r.b): r.n for r in got.collect()} == chosen and 0 < len(chosen) < len(want)


def test_no_row_a_pair_is_shuffled(spark):
    """What a tile finds is not dealt again: the plan ends in the tiles."""
    near = proximity.Proximity(made(spark, [("a", "x", 0), ("b", "x", 1)]), "src", "ts", 60)
    plan = near.pairs()._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange")


def test_surfaced_near_equals_surfaced_classes(spark):
    rng = random.Random(5)
    events = made(spark, [(f"k{rng.randrange(30):02d}", f"d{rng.randrange(3)}", rng.randrange(900) * 60_000_000) for _ in range(120)])
    flows = spark.createDataFrame(sorted({(f"k{rng.randrange(30):02d}", f"k{rng.randrange(30):02d}") for _ in range(40)}), "a string, b string").filter("a <> b")
    flows = links._linked(flows.withColumn("support", F.lit(1)), "FUND_FLOW")
    own = sorted({(f"v{v}", f"k{rng.randrange(30):02d}", k) for v in range(12) for k in ("SHARED_IMEI", "SHARED_IP_SUBNET") for _ in range(3)})
    classes = spark.createDataFrame(own, "value string, entity string, link_type string")
    smallest = classes.groupBy("value", "link_type").agg(F.min("entity").alias("smallest"), F.count("*").alias("users"))
    classes = classes.join(smallest, ["value", "link_type"]).withColumn("confidence", F.when(F.col("link_type") == "SHARED_IMEI", 0.95).otherwise(0.45))
    dismissed = flows.filter("a < 'k15'").select("a", "b", "link_type")
    near = proximity.Proximity(events, "src", "ts", 60)
    both = flows.unionByName(links._linked(near.pairs().withColumnRenamed("n", "support"), "TEMPORAL_PROXIMITY"))
    want = sorted(map(str, links.surfaced_classes(both, classes, dismissed).collect()))
    got = links.surfaced_near(flows, near, classes, dismissed)
    assert sorted(map(str, got.collect())) == want and 0 < got.filter("link_type = 'TEMPORAL_PROXIMITY'").count() < near.pairs().count()
