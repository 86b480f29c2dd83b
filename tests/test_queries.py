"""Every registered query with a SQL form against DuckDB, on the smallest tables."""

import glob
import json
import math
import os
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.config import BANDS
from caseweave.operators import anomaly
from caseweave.plans import MODULES, cases, evidence, flows, graphs, linking, reports

SF = os.environ.get("CASEWEAVE_TEST_SF", "/root/testdata/sf0.001")
CASES = [(name, module) for module in MODULES for name in module.QUERIES]


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, float):
            return f"{x:.6f}"
        if hasattr(x, "isoformat"):
            return x.replace(tzinfo=None).isoformat(" ")
        return str(int(x)) if isinstance(x, bool) else str(x)

    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name,module", CASES, ids=[c[0] for c in CASES])
def test_query(spark, name, module):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = module.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in module.SQL:
        assert df.columns
        return
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(module.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_anomaly_scores_against_brute_force(spark):
    """Every tree grown on the rows of the smallest hashes and every row walked down it, without Spark's grouping."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    frame = flows._frame(spark, SF)
    data = frame.toPandas()
    x = data[anomaly.FEATURES].astype(float).to_numpy()
    hashed = frame.select("entity", F.explode(F.sequence(F.lit(0), F.lit(anomaly.TREES - 1))).alias("tree")).withColumn("h", F.xxhash64(F.lit(42), "tree", "entity")).toPandas()
    place = {e: k for k, e in enumerate(data["entity"])}
    total = np.zeros(len(x))
    for tree, part in hashed.groupby("tree"):
        own = x[[place[e] for e in part.sort_values(["h", "entity"])["entity"][: anomaly.SAMPLE]]]
        nodes = anomaly._grow(own, np.random.default_rng([42, tree]), math.ceil(math.log2(max(2, len(own)))))
        for i, row in enumerate(x):
            at = 0
            while nodes[at][0] >= 0:
                at = nodes[at][2] if row[nodes[at][0]] < nodes[at][1] else nodes[at][3]
            total[i] += nodes[at][4]
    want = {e: round(2.0 ** (-s / anomaly.TREES / anomaly._usual(min(anomaly.SAMPLE, len(x)))), 6) for e, s in zip(data["entity"], total, strict=True)}
    got = cases.anomaly_scores(spark, SF).collect()
    assert {r.entity: r.anomaly_score for r in got} == pytest.approx(want, abs=2e-6)
    assert [r.anomaly_rank for r in sorted(got, key=lambda r: r.anomaly_rank)] == list(range(1, len(got) + 1))
    by = sorted(got, key=lambda r: r.anomaly_rank)
    assert all(a.anomaly_score >= b.anomaly_score - 1e-6 for a, b in zip(by, by[1:], strict=False))


def test_reranked_scores_against_brute_force(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    order = sorted(BANDS, key=BANDS.get, reverse=True)
    got = cases.reranked_scores(spark, SF).collect()
    want = sorted(got, key=lambda r: (order.index(r.band), r.anomaly_rank, -r.score, r.entity))
    assert [r.rank_in_case for r in want] == list(range(1, len(got) + 1))
    assert {r.entity: r.anomaly_rank for r in got} == {r.entity: r.anomaly_rank for r in cases.anomaly_scores(spark, SF).collect()}


def test_case_brief_against_its_parts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    (row,) = cases.case_brief(spark, SF).collect()
    brief = json.loads(row.brief)
    assert row.brief == json.dumps(brief, sort_keys=True, separators=(",", ":"))
    scores = sorted(flows.risk_scores(spark, SF).collect(), key=lambda r: (-r.score, r.entity))[:5]
    fired = {}
    for r in flows.risk_reasons(spark, SF).collect():
        if r.triggered:
            fired.setdefault(r.entity, []).append({"rule_code": r.rule_code, "points": r.points})
    of = lambda e: {"reasons": sorted(fired[e], key=lambda x: x["rule_code"])} if e in fired else {}
    assert brief["suspects"] == [{"band": r.band, "entity": r.entity, "score": r.score} | of(r.entity) for r in scores]
    taken = sorted(cases.case_seizures(spark, SF).collect(), key=lambda r: (-r.residual, r.entity))[:5]
    assert brief["seizures"] == [{"entity": r.entity, "residual": r.residual} for r in taken]
    heads = sorted(evidence.audit_heads(spark, SF).collect(), key=lambda r: r.case_id)[:5]
    assert brief["hashes"] == [{"case_id": r.case_id, "head_hash": r.head_hash} for r in heads]
    assert len(brief["timeline"]) == 10 and brief["clusters"] >= 1
    clusters = {}
    for r in graphs.graph_components(spark, SF).collect():
        clusters.setdefault(r.component, []).append(r.node)
    assert brief["clusters"] == len(clusters)
    assert brief["largest_clusters"] == [{"component": c, "first": sorted(m)[:10], "members": len(m)} for c, m in sorted(clusters.items(), key=lambda x: (-len(x[1]), x[0]))[:5]]
    files = sorted((r.name, r.sha256) for r in evidence.evidence_inventory(spark, SF).collect())
    assert brief["files"] == [{"name": n, "sha256": x} for n, x in files[:5]] and brief["n_files"] == len(files)
    (head,) = reports.case_by_id(spark, SF).collect()
    assert brief["header"] == {"status": head.status, "title": head.title}


def test_entity_uuids_against_the_standard_library(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = evidence.entity_uuids(spark, SF).collect()
    assert got and all(r.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"case-1:PHONE:{r.normalized}")) for r in got)


def test_forest_evaluation_against_its_parts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    flag = {r.entity: r.is_anomaly for r in cases.anomaly_scores(spark, SF).collect()}
    label = {r.entity: r.band != "LOW" for r in flows.risk_scores(spark, SF).collect()}
    (got,) = reports.forest_evaluation(spark, SF).collect()
    tp, fp, fn = (sum((flag[e], label[e]) == pair for e in flag) for pair in ((True, True), (True, False), (False, True)))
    assert (got.tp, got.fp, got.fn) == (tp, fp, fn)
    assert got.precision == round(tp / max(1, tp + fp), 6) and got.recall == round(tp / max(1, tp + fn), 6)


def test_graph_data_above_against_its_parts(spark):
    """On tables large enough to hold trails."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    top = {r.entity for r in sorted(flows.risk_scores(spark, sf).collect(), key=lambda r: (-r.score, r.entity))[:50]}
    hops = set()
    best = graphs._counted(spark, sf).pairs().collect()
    for r in best:
        nodes = [int(x) for x in r.path.split(">")]
        hops |= set(zip(nodes, nodes[1:], strict=False))
    links_ = [r for r in linking.all_links(spark, sf).collect() if r.a in top and r.b in top and r.confidence is not None and r.confidence >= 0.9]
    want = sorted((r.a, r.b, r.link_type, r.value or "", r.link_type == "FUND_FLOW" and (r.a, r.b) in hops) for r in links_)
    got = reports.graph_data_above(spark, sf).collect()
    assert sorted((r.a, r.b, r.link_type, r.value or "", r.on_best_path) for r in got) == want and best
