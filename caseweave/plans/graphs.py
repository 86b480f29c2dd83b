"""Queries over the transfer graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators import features, graph, links, trails
from caseweave.operators.adapter import EVENTS_SQL, transfers
from caseweave.operators.checkpoints import cut
from caseweave.plans._plain import plain
from caseweave.plans.flows import BETWEENNESS

#: A money trail is over a day after its first transfer.
TRAIL_MINUTES = 1440


def _edges(spark, sf_dir) -> DataFrame:
    return transfers(spark, sf_dir)


def _text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.array_join(F.transform(name, lambda x: x.cast("string")), ">"))


def _victims(edges: DataFrame) -> DataFrame:
    """node: accounts that only pay."""
    return features.node_flow(edges).filter("in_count = 0").select(F.col("entity").alias("node"))


def _cash_ends(edges: DataFrame) -> DataFrame:
    """node: accounts where money was withdrawn."""
    return edges.filter("event_type = 'ATM_WITHDRAWAL'").select(F.col("dst").alias("node")).distinct()


def _trails(spark, sf_dir) -> DataFrame:
    """Every trail of up to six transfers within a day, from victims to cash-out ends."""
    e = cut(_edges(spark, sf_dir))
    return cut(graph.paths(e, _victims(e), _cash_ends(e), timed=True, minutes=TRAIL_MINUTES))


def graph_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


def graph_patterns(spark, sf_dir):
    return graph.patterns(_edges(spark, sf_dir))


def graph_pagerank(spark, sf_dir):
    """To convergence."""
    return graph.pagerank(_edges(spark, sf_dir), tolerance=1e-10).select("node", F.round("rank", 7).alias("rank"))


def graph_components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


def _counted(spark, sf_dir) -> trails.Trails:
    """The same trails, counted and ranked only."""
    e = cut(_edges(spark, sf_dir))
    return trails.trails(e, _victims(e), _cash_ends(e), TRAIL_MINUTES)


def graph_cycles(spark, sf_dir):
    return _text(graph.timed_cycles(_edges(spark, sf_dir), TRAIL_MINUTES), "cycle")


def graph_static_cycles(spark, sf_dir):
    """Rings of two or three accounts whose transfers may come in any order."""
    return _text(graph.cycles(_edges(spark, sf_dir), max_length=3), "cycle")


def graph_static_paths(spark, sf_dir):
    """From victims to cash-out ends over at most one account between, whatever the order of the transfers."""
    e = cut(_edges(spark, sf_dir))
    found = graph.paths(e, _victims(e), _cash_ends(e), max_hops=2)
    return _text(found, "path").select("source", "target", "hops", "path", "total")


def graph_paths(spark, sf_dir):
    return _text(_trails(spark, sf_dir), "path").select("source", "target", "hops", "path", "total", "minutes")


def _best(spark, sf_dir) -> DataFrame:
    return _counted(spark, sf_dir).pairs().withColumn("total", F.round("total", 2))


def graph_best_paths(spark, sf_dir):
    return _best(spark, sf_dir).select("source", "target", "hops", "total", "n_paths")


def graph_best_captions(spark, sf_dir):
    return graph.caption(_best(spark, sf_dir)).select("source", "target", "caption")


def graph_path_share(spark, sf_dir):
    return _counted(spark, sf_dir).share()


def graph_reach(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


def observed_features(spark, sf_dir):
    """The features as the original code computes them: lifetime ratio, incident transfers, levels reached, hours in UTC."""
    t = cut(_edges(spark, sf_dir))
    flow = features.node_flow(t).select("entity", "passthrough_ratio", F.col("in_count").alias("fan_in_count"), F.col("out_count").alias("fan_out_count"))
    depth = graph.reach(t).select(F.col("node").alias("entity"), F.col("depth").cast("long").alias("layering_depth"))
    return flow.join(features.odd_hours(t, mode="observed"), "entity").join(depth, "entity", "left").withColumn("layering_depth", F.coalesce("layering_depth", F.lit(0)))


def graph_neighbourhood(spark, sf_dir):
    """Around the accounts of the largest turnover."""
    e = _edges(spark, sf_dir)
    top = features.node_flow(e).orderBy(F.desc("turnover"), "entity").limit(1)
    return graph.neighbourhood(e, top.select(F.col("entity").alias("node")))


def graph_betweenness(spark, sf_dir):
    return graph.betweenness(_edges(spark, sf_dir)).select("node", F.round("betweenness", 8).alias("betweenness"))


def graph_central(spark, sf_dir):
    """The top five per cent of betweenness."""
    return graph.central(graph.betweenness(_edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 8)))


def graph_roles(spark, sf_dir):
    t = transfers(spark, sf_dir)
    flow = features.node_flow(t)
    out = _cash_ends(t).withColumnRenamed("node", "entity")
    mules = flow.filter("passthrough_ratio >= 0.85 and in_count > 0 and out_count > 0")
    return graph.roles(flow.select("entity"), out, mules, flow.filter("in_count = 0"))


def graph_snapshot(spark, sf_dir):
    return graph.snapshot(_edges(spark, sf_dir), "run-1")


def graph_edge_table(spark, sf_dir):
    t = transfers(spark, sf_dir)
    known = t.select(F.col("src").alias("entity")).distinct()
    _, edges = graph.build(known, links.fund_flow(t).select("a", "b", "link_type"), t)
    return plain(edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("amount").alias("total")))


ROUNDS = 40
_BASE = (
    "WITH RECURSIVE "
    + EVENTS_SQL
    + """,
pe AS (SELECT DISTINCT src, dst FROM tr),
vi AS (SELECT src AS node FROM tr WHERE src NOT IN (SELECT dst FROM tr) GROUP BY src),
co AS (SELECT DISTINCT dst AS node FROM tr WHERE event_type = 'ATM_WITHDRAWAL'),
trail(source, e, path, total, t0, t) AS (
  SELECT src, dst, [src, dst], amount::DOUBLE, ts, ts FROM tr WHERE src IN (FROM vi)
  UNION ALL SELECT source, dst, list_append(path, dst), total + amount::DOUBLE, t0, ts FROM trail JOIN tr ON e = src AND ts > t AND ts <= t0 + INTERVAL '1440 minutes'
  WHERE NOT list_contains(path, dst) AND len(path) < 7),
paths AS (
  SELECT source, e AS target, len(path) - 1 AS hops, path AS nodes, array_to_string(path, '>') AS path, round(total, 2) AS total, round((epoch_us(t) - epoch_us(t0)) / 60e6, 2) AS minutes
  FROM trail WHERE e IN (FROM co)),
ring(start, e, path, t0, t, closed) AS (
  SELECT src, dst, [src, dst], ts, ts, false FROM tr
  UNION ALL SELECT start, dst, list_append(path, dst), t0, ts, dst = start FROM ring JOIN tr ON e = src AND ts > t AND ts <= t0 + INTERVAL '1440 minutes'
  WHERE NOT closed AND (dst = start OR NOT list_contains(path, dst)) AND len(path) < 7),
deg AS MATERIALIZED (SELECT node, count(*) FILTER (o = 0) AS in_degree, count(*) FILTER (o = 1) AS out_degree
        FROM (SELECT src AS node, 1 AS o FROM tr UNION ALL SELECT dst, 0 FROM tr) GROUP BY node),
wt AS (SELECT src, dst, count(*)::DOUBLE AS w FROM tr GROUP BY src, dst),
sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM wt),
nn AS (SELECT count(*) AS n FROM deg),
r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM deg, nn)"""
    + "".join(
        f""",
r{k} AS MATERIALIZED (SELECT d.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce((SELECT sum(r) FROM r{k - 1} JOIN deg USING (node) WHERE out_degree = 0), 0) / n
         + 0.85::DOUBLE * coalesce(g.got, 0) AS r
         FROM deg d CROSS JOIN nn LEFT JOIN (SELECT dst, sum(p * r) AS got FROM sh JOIN r{k - 1} ON node = src GROUP BY dst) g ON g.dst = d.node)"""
        for k in range(1, ROUNDS + 1)
    )
    + ",\n"
    + BETWEENNESS
    + """,
und AS (SELECT src, dst FROM pe UNION SELECT dst, src FROM pe),
lab AS (SELECT src AS node, src AS root FROM und UNION SELECT u.dst, l.root FROM lab l JOIN und u ON u.src = l.node),
far AS (SELECT src AS node, dst AS x, 1 AS d FROM pe UNION ALL SELECT f.node, e.dst, f.d + 1 FROM (SELECT DISTINCT node, x, d FROM far) f JOIN pe e ON f.x = e.src WHERE f.d < 6),
dist AS (SELECT node, x, min(d) AS d FROM far WHERE node <> x GROUP BY node, x),
flow AS (SELECT entity, sum(amount) FILTER (i = 1) AS ia, sum(amount) FILTER (i = 0) AS oa, count(*) FILTER (i = 1) AS ic, count(*) FILTER (i = 0) AS oc, sum(amount)::DOUBLE AS turnover
         FROM (SELECT src AS entity, 0 AS i, amount FROM tr UNION ALL SELECT dst, 1, amount FROM tr) GROUP BY entity),
top1 AS (SELECT entity AS node FROM flow ORDER BY round(turnover, 2) DESC, entity LIMIT 1),
near AS (SELECT node FROM top1 UNION SELECT dst FROM und WHERE src IN (FROM top1) UNION SELECT b.dst FROM und a JOIN und b ON a.dst = b.src WHERE a.src IN (FROM top1))
"""
)

QUERIES = {
    f.__name__: f
    for f in (
        graph_degrees, graph_patterns, graph_pagerank, graph_components, graph_cycles, graph_static_cycles, graph_static_paths, graph_paths, graph_best_paths, graph_best_captions, graph_path_share, graph_reach, observed_features,
        graph_neighbourhood, graph_betweenness, graph_central, graph_roles, graph_snapshot, graph_edge_table,
    )
}

_BEST = """SELECT source, target, hops::INT AS hops, total, n_paths, minutes FROM (
  SELECT *, count(*) OVER (PARTITION BY source, target) AS n_paths, row_number() OVER (PARTITION BY source, target ORDER BY hops, -total, path, minutes) AS r FROM paths) WHERE r = 1"""
SQL = {
    "graph_degrees": _BASE + "SELECT * FROM deg",
    "graph_patterns": _BASE + "SELECT node, in_degree >= 8 AS is_fan_in, out_degree >= 8 AS is_fan_out, in_degree > 0 AND out_degree > 0 AS is_pass_through FROM deg",
    "graph_pagerank": _BASE + f"SELECT node, round(r, 7) AS rank FROM r{ROUNDS}",
    "graph_components": _BASE + "SELECT node, min(root) AS component FROM lab GROUP BY node",
    "graph_cycles": _BASE + "SELECT (len(path) - 1)::INT AS length, array_to_string(path[1:-2], '>') AS cycle, count(*) AS n FROM ring WHERE closed GROUP BY ALL",
    "graph_paths": _BASE + "SELECT source, target, hops::INT AS hops, path, total, minutes FROM paths",
    "graph_static_cycles": _BASE
    + """SELECT 2::INT AS length, a.src || '>' || a.dst AS cycle FROM pe a JOIN pe b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT 3, a.src || '>' || a.dst || '>' || b.dst FROM pe a JOIN pe b ON a.dst = b.src JOIN pe c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""",
    "graph_static_paths": _BASE
    + """, hop AS (SELECT src, dst, sum(amount::DOUBLE) AS amount FROM tr GROUP BY src, dst)
SELECT src AS source, dst AS target, 1::INT AS hops, src || '>' || dst AS path, round(amount, 2) AS total FROM hop WHERE src IN (FROM vi) AND dst IN (FROM co)
UNION ALL SELECT a.src, b.dst, 2, a.src || '>' || a.dst || '>' || b.dst, round(a.amount + b.amount, 2) FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src IN (FROM vi) AND b.dst IN (FROM co) AND a.src <> b.dst""",
    "graph_best_paths": _BASE + f"SELECT source, target, hops, total, n_paths FROM ({_BEST})",
    "graph_best_captions": _BASE + f"SELECT source, target, hops || ' hops, ' || format('{{:,.2f}}', total) || ', ' || format('{{:,.1f}}', minutes) || ' minutes' AS caption FROM ({_BEST})",
    "graph_path_share": _BASE
    + """SELECT node, count(*) AS n_paths, round(count(*) / (SELECT count(*) FROM paths), 4) AS share
FROM (SELECT unnest(nodes[2:-2]) AS node FROM paths WHERE hops > 1) GROUP BY node""",
    "graph_reach": _BASE + "SELECT node, max(d)::BIGINT AS depth FROM dist GROUP BY node",
    "observed_features": _BASE
    + """, od AS (SELECT entity, count(*) FILTER (hour(ts) < 5) AS odd_hour_txn_count FROM (SELECT src AS entity, ts FROM tr UNION ALL SELECT dst, ts FROM tr) GROUP BY entity)
SELECT f.entity, round(CASE WHEN ia > 0 THEN least(1.0::DOUBLE, coalesce(oa, 0)::DOUBLE / ia::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS passthrough_ratio, ic AS fan_in_count, oc AS fan_out_count, odd_hour_txn_count,
       coalesce((SELECT max(d) FROM dist WHERE node = f.entity), 0)::BIGINT AS layering_depth FROM flow f JOIN od USING (entity)""",
    "graph_neighbourhood": _BASE + "SELECT src, dst FROM tr WHERE src IN (FROM near) AND dst IN (FROM near)",
    "graph_betweenness": _BASE + "SELECT node, round(betweenness, 8) AS betweenness FROM bc",
    "graph_central": _BASE
    + """, m AS (SELECT node, round(betweenness, 8) AS betweenness FROM bc)
SELECT node, betweenness, betweenness >= (SELECT quantile_cont(betweenness, 0.95) FROM m) AND betweenness > 0 AS is_central FROM m""",
    "graph_roles": _BASE
    + """SELECT entity, CASE WHEN entity IN (FROM co) THEN 'CASHOUT' WHEN round(CASE WHEN ia > 0 THEN least(1.0::DOUBLE, coalesce(oa, 0)::DOUBLE / ia::DOUBLE) ELSE 0 END, 4) >= 0.85 AND ic > 0 AND oc > 0 THEN 'MULE'
  WHEN ic = 0 THEN 'VICTIM' ELSE 'INTERMEDIARY' END AS role FROM flow""",
    "graph_snapshot": _BASE
    + "SELECT 'run-1' AS run_id, n AS node_count, (SELECT count(*) FROM tr) AS edge_count, CASE WHEN n <= 5000 THEN n ELSE 500 END AS betweenness_k FROM (SELECT count(*) AS n FROM deg)",
    "graph_edge_table": _BASE
    + """SELECT 'TRANSFER' AS edge_type, count(*) AS n, sum(amount)::DOUBLE AS total FROM tr WHERE dst IN (SELECT src FROM tr)
UNION ALL SELECT 'FUND_FLOW', (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM tr)), NULL::DOUBLE""",
}
