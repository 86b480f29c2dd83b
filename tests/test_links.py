"""Neighbours of shared values against the join of all pairs."""

import collections
import itertools
import os
import random

import pytest

from caseweave.operators import links
from caseweave.operators.adapter import device_events
from caseweave.plans import linking

SF = os.environ.get("CASEWEAVE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("listed", [0, 6, 10_000])
def test_class_neighbours_equal_the_pair_join(spark, monkeypatch, listed):
    monkeypatch.setattr(links, "LISTED", listed)
    rng = random.Random(3)
    rows = sorted({(kind, str(rng.randrange(12)), rng.randrange(40)) for kind in ("SHARED_IMEI", "SHARED_MAC") for _ in range(90)})
    users = collections.Counter((k, v) for k, v, _ in rows)
    rows = [(k, v, e, users[k, v]) for k, v, e in rows if users[k, v] > 1]
    n, others = collections.Counter(), collections.defaultdict(set)
    for (k, v, e, _), (j, w, f, _) in itertools.permutations(rows, 2):
        if (k, v) == (j, w):
            n[e, k] += 1
            others[e, k].add(f)
    got = links.class_neighbours(spark.createDataFrame(rows, "link_type string, value string, entity long, users long")).collect()
    assert {(r.entity, r.link_type): (r.n, r.others) for r in got} == {key: (n[key], len(x)) for key, x in others.items()}


def test_no_star_links_an_entity_with_itself(spark):
    uses = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", None), (4, "y", None)], "phone long, imei string, ts timestamp")
    got = links.as_stars(links.shared_classes(uses, "phone", "imei", "SHARED_IMEI")).collect()
    assert {(r.a, r.b, r.support) for r in got} == {(1, 2, 3), (1, 3, 3)}
    top = links.busiest(uses, "phone", "imei", 1).collect()
    assert [(r.place, r.value, r.users) for r in top] == [(1, "x", 3)]


def test_hubs_are_whole(spark):
    """Every entity of every value, also of values beyond the tenth and of values with few users."""
    rows = [(1000 * v + e, f"v{v:02d}", None) for v in range(14) for e in range(1 + v % 5)]
    uses = spark.createDataFrame([*rows, rows[0], (5, None, None), (None, "v00", None)], "phone long, imei string, ts timestamp")
    users = collections.Counter(v for _, v, _ in rows)
    place = {v: k for k, v in enumerate(sorted(users, key=lambda v: (-users[v], v)), 1)}
    got = links.hubs(uses, "phone", "imei").collect()
    assert sorted((r.place, r.value, r.entity, r.users) for r in got) == sorted((place[v], v, e, users[v]) for e, v, _ in rows)
    assert [(r.place, r.value) for r in links.busiest(uses, "phone", "imei", 2).collect()] == [(1, "v04"), (2, "v09")]


def test_hub_query_lists_every_use(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    uses = device_events(spark, SF).select("phone", "imei").dropna().distinct()
    got = linking.shared_imei_hubs(spark, SF)
    assert sorted((r.entity, r.value) for r in got.collect()) == sorted((r.phone, r.imei) for r in uses.collect())


def test_all_link_classes_hold_all_links_and_memberships(spark):
    """No link of all_links is missing, and every membership of every type is there."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    row = lambda r: (r.a, r.b, r.link_type, r.value, r.confidence, r.support)
    got = {row(r) for r in linking.all_link_classes(spark, SF).collect()}
    assert {row(r) for r in linking.all_links(spark, SF).collect()} <= got
    own = {(r.smallest, r.entity, r.link_type, r.value, r.confidence, r.users) for kind in linking.ACCOUNTS for r in linking.QUERIES[f"{kind.lower()}_classes"](spark, SF).collect()}
    assert own <= got and {x for x in got if x[2] in linking.ACCOUNTS} == own
