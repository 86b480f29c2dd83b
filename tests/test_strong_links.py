"""Links of high confidence alone do not need the pairs of accounts near in time."""

import os

import pytest

from caseweave.plans import linking

SF = os.environ.get("CASEWEAVE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("least", [0.75, 0.9])
def test_weak_pairs_are_not_made(spark, monkeypatch, least):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    row = lambda r: (r.a, r.b, r.link_type, r.value, r.confidence, r.support)
    want = sorted(map(str, map(row, linking._merged(spark, SF).filter(f"confidence >= {least}").collect())))
    monkeypatch.setattr(linking, "_near", None)
    got = linking._merged(spark, SF, least).filter(f"confidence >= {least}")
    assert sorted(map(str, map(row, got.collect()))) == want and want
    if least == 0.75:
        assert linking.links_above(spark, SF).count() == len(want)
