"""Queries over transfers: flows, windows, features, rules and scores."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.config import RULES, rules_hash, rules_with
from caseweave.operators import features, links, rules, windows
from caseweave.operators.adapter import EVENTS_SQL, address_owners, device_events, events, mail_texts, transfers
from caseweave.operators.checkpoints import cut, exists, shared_folder
from caseweave.plans._plain import plain
from caseweave.sources import files

#: What an officer of a small district overrides.
OVERRIDES = {"R02": {"threshold": 3.0}, "R03": {"threshold": 3.0}, "R07": {"min_turnover": 5000.0}}


def _calls(spark, sf_dir: str) -> DataFrame:
    """Calls into accounts just before their debits; a phone belongs to the account of its number."""
    calls = events(spark, sf_dir).filter("event_type = 'CALL' and dst is not null")
    owners = transfers(spark, sf_dir).select(F.col("src").alias("phone"), F.col("src").alias("account")).distinct()
    return windows.call_then_transfer(calls, transfers(spark, sf_dir), owners)


def _spoofed(spark, sf_dir: str) -> DataFrame:
    return features.spoofed_flags(files.parsed_mails(mail_texts(spark, sf_dir)), address_owners(spark, sf_dir))


def _attributes(spark, sf_dir: str) -> DataFrame:
    """entity, attributes_json: what is known of each account; the age is missing from some."""
    own = transfers(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("entity")).distinct()
    age = F.when(F.col("entity") % 13 != 0, (F.col("entity") % 90).cast("string"))
    return own.select("entity", F.to_json(F.struct(age.alias("account_age_days"), F.lit("SAVINGS").alias("kind"))).alias("attributes_json"))


#: The feature frame of each application and folder, written once: every query about scores begins with it.
_frames: dict[tuple[str, str], DataFrame] = {}


def _frame(spark, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames or not exists(_frames[key]):
        _frames[key] = cut(_made_frame(spark, sf_dir))
    return _frames[key]


def _made_frame(spark, sf_dir: str) -> DataFrame:
    t = cut(transfers(spark, sf_dir))
    extra = [features.call_flags(_calls(spark, sf_dir)), _spoofed(spark, sf_dir), features.centrality(t), features.account_ages(_attributes(spark, sf_dir))]
    return features.feature_frame(t, device_events(spark, sf_dir), extra=extra)


def _overridden(spark) -> dict:
    """The rules with OVERRIDES, read from a file as an installation does."""
    path = f"{shared_folder(spark)}/caseweave/rules-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(OVERRIDES),)], "value string").coalesce(1).write.text(path)
    return rules_with(json.loads(spark.read.text(path, wholetext=True).filter("value <> ''").first()[0]))


def fund_flow_pairs(spark, sf_dir):
    f = links.fund_flow(transfers(spark, sf_dir))
    return plain(f.select("a", "b", "support", "total_amount", "first_at", "last_at"))


def node_flow(spark, sf_dir):
    return plain(features.node_flow(transfers(spark, sf_dir)))


def fan_in(spark, sf_dir):
    return windows.distinct_in_window(transfers(spark, sf_dir), "dst", "src", "ts", "2 hours").select(F.col("dst").alias("entity"), "most")


def fan_out(spark, sf_dir):
    return windows.distinct_in_window(transfers(spark, sf_dir), "src", "dst", "ts", "2 hours").select(F.col("src").alias("entity"), "most")


def pass_through_window(spark, sf_dir):
    return plain(windows.windowed_pass_through(transfers(spark, sf_dir)))


def layering(spark, sf_dir):
    return windows.layering_chains(transfers(spark, sf_dir))


def sim_switch(spark, sf_dir):
    return features.sim_switch(device_events(spark, sf_dir))


def device_share(spark, sf_dir):
    return features.device_share(device_events(spark, sf_dir))


def odd_hours_ist(spark, sf_dir):
    return features.odd_hours(transfers(spark, sf_dir))


def odd_hours_utc(spark, sf_dir):
    return features.odd_hours(transfers(spark, sf_dir), mode="observed")


def cash_out(spark, sf_dir):
    return features.cash_out(transfers(spark, sf_dir))


def call_then_transfer(spark, sf_dir):
    return _calls(spark, sf_dir)


def call_then_transfer_flags(spark, sf_dir):
    return features.call_flags(_calls(spark, sf_dir))


def spoofed_header_flags(spark, sf_dir):
    return _spoofed(spark, sf_dir)


def account_ages(spark, sf_dir):
    return features.account_ages(_attributes(spark, sf_dir))


def feature_frame(spark, sf_dir):
    return plain(_frame(spark, sf_dir)).select(
        "entity", "in_amount", "out_amount", "turnover", "passthrough_ratio", "fan_in_count", "fan_out_count", "layering_depth", "sim_switch_count", "device_share_count", "account_age_days", "odd_hour_txn_count", "has_cash_out", "has_spoofed_header", "has_call_then_transfer", "betweenness_centrality", "unique_counterparties"
    )


def feature_json(spark, sf_dir):
    """The counts of the feature frame as one JSON object an account."""
    f = _frame(spark, sf_dir).select("entity", "fan_in_count", "fan_out_count", "layering_depth", "account_age_days", "has_cash_out", "has_spoofed_header", "has_call_then_transfer")
    return features.as_json(f)


def risk_scores(spark, sf_dir):
    scored = rules.ranked(rules.scored(_frame(spark, sf_dir), RULES))
    return scored.select("entity", "score", "band", "rules_fired", "rank_in_case", F.lit(rules_hash(RULES)).alias("weights_hash"))


def risk_scores_overridden(spark, sf_dir):
    """Scores under rules of which a file overrides some settings."""
    own = _overridden(spark)
    scored = rules.ranked(rules.scored(_frame(spark, sf_dir), own))
    return scored.select("entity", "score", "band", "rules_fired", "rank_in_case", F.lit(rules_hash(own)).alias("weights_hash"))


def risk_scores_unbanded(spark, sf_dir):
    return rules.ranked(rules.scored(_frame(spark, sf_dir), RULES), within_band=False).select("entity", "score", "rank_in_case")


def risk_reasons(spark, sf_dir):
    return rules.reasons(_frame(spark, sf_dir), RULES).select("entity", "rule_code", "triggered", "raw_value", "threshold", "points", "text", "display_order")


def top_reasons(spark, sf_dir):
    return rules.top_reasons(rules.reasons(_frame(spark, sf_dir), RULES)).select("entity", "rule_code", "points", "place")


def band_counts(spark, sf_dir):
    return rules.band_counts(rules.scored(_frame(spark, sf_dir), RULES))


def score_histogram(spark, sf_dir):
    return rules.histogram(rules.scored(_frame(spark, sf_dir), RULES))


def composite_scores(spark, sf_dir):
    return rules.composite(_frame(spark, sf_dir)).select("entity", "composite", "composite_band")


#: bc (node, betweenness) of the graph of tr: shortest paths level by level from every node, then back.
_LEVELS = 6
BETWEENNESS = (
    "be AS MATERIALIZED (SELECT DISTINCT src, dst FROM tr), bn AS (SELECT src AS node FROM be UNION SELECT dst FROM be), v0 AS (SELECT node AS pv, node, 1.0::DOUBLE AS sigma FROM bn), s0 AS (SELECT pv, node FROM v0)"
    + "".join(
        f""",
v{k} AS MATERIALIZED (SELECT l.pv, e.dst AS node, sum(l.sigma) AS sigma FROM v{k - 1} l JOIN be e ON e.src = l.node
  WHERE (l.pv, e.dst) NOT IN (FROM s{k - 1}) GROUP BY ALL),
s{k} AS MATERIALIZED (FROM s{k - 1} UNION ALL SELECT pv, node FROM v{k})"""
        for k in range(1, _LEVELS + 1)
    )
    + f", d{_LEVELS} AS (SELECT *, 0.0::DOUBLE AS delta FROM v{_LEVELS})"
    + "".join(
        f""",
d{k} AS MATERIALIZED (SELECT v.pv, v.node, v.sigma, coalesce(sum(v.sigma / d.sigma * (1 + d.delta)), 0) AS delta
  FROM v{k} v LEFT JOIN (SELECT e.src, x.* FROM d{k + 1} x JOIN be e ON e.dst = x.node) d ON d.pv = v.pv AND d.src = v.node GROUP BY ALL)"""
        for k in range(_LEVELS - 1, 0, -1)
    )
    + ", bc AS (SELECT n.node, coalesce(sum(delta), 0) / greatest(1, ((SELECT count(*) FROM bn) - 1) * ((SELECT count(*) FROM bn) - 2)) AS betweenness FROM bn n LEFT JOIN ("
    + " UNION ALL ".join(f"SELECT node, delta FROM d{k}" for k in range(1, _LEVELS + 1))
    + ") t ON t.node = n.node GROUP BY n.node)"
)

_FRAME_TEXT = (
    "WITH "
    + EVENTS_SQL
    + """,
ori AS (
  SELECT src AS entity, dst AS other, 0 AS incoming, amount, ts, event_type FROM tr
  UNION ALL SELECT dst, src, 1, amount, ts, event_type FROM tr),
flow AS (
  SELECT entity, coalesce(sum(amount) FILTER (incoming = 1), 0)::DECIMAL(18,2) AS in_amount,
         coalesce(sum(amount) FILTER (incoming = 0), 0)::DECIMAL(18,2) AS out_amount,
         count(*) FILTER (incoming = 1) AS in_count, count(*) FILTER (incoming = 0) AS out_count,
         count(DISTINCT other) AS unique_counterparties FROM ori GROUP BY entity),
flowed AS (
  SELECT *, round((in_amount + out_amount)::DOUBLE, 2) AS turnover,
         round(CASE WHEN in_amount > 0 THEN least(1.0::DOUBLE, out_amount::DOUBLE / in_amount::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS passthrough_ratio FROM flow),
odd AS (SELECT entity, count(*) FILTER (hour(ts + INTERVAL '330 minutes') < 5) AS odd_hour_txn_count, count(*) FILTER (hour(ts) < 5) AS odd_utc FROM ori GROUP BY entity),
cash AS (SELECT entity, max(CASE WHEN event_type = 'ATM_WITHDRAWAL' THEN 1 ELSE 0 END)::INT AS has_cash_out FROM ori GROUP BY entity),
fin AS (
  SELECT dst AS entity, max(n) AS most FROM (
    SELECT a.event_id, a.dst, count(DISTINCT b.src) AS n FROM tr a JOIN tr b ON a.dst = b.dst AND b.ts BETWEEN a.ts - INTERVAL '2 hours' AND a.ts
    GROUP BY a.event_id, a.dst) GROUP BY dst),
fout AS (
  SELECT src AS entity, max(n) AS most FROM (
    SELECT a.event_id, a.src, count(DISTINCT b.dst) AS n FROM tr a JOIN tr b ON a.src = b.src AND b.ts BETWEEN a.ts - INTERVAL '2 hours' AND a.ts
    GROUP BY a.event_id, a.src) GROUP BY src),
h1 AS (SELECT src AS account, dst, ts AS t0, ts AS t FROM tr),
"""
    + "".join(
        f"h{k} AS (SELECT h.account, r.dst, h.t0, min(r.ts) AS t FROM h{k - 1} h JOIN tr r ON h.dst = r.src AND r.ts > h.t AND r.ts <= h.t0 + INTERVAL '30 minutes' GROUP BY ALL),\n"
        for k in range(2, 7)
    )
    + """lay AS (
  SELECT account, max(depth)::BIGINT AS depth FROM (
    SELECT account, 1 AS depth FROM h1 UNION ALL SELECT account, 2 FROM h2 UNION ALL SELECT account, 3 FROM h3 UNION ALL SELECT account, 4 FROM h4
    UNION ALL SELECT account, 5 FROM h5 UNION ALL SELECT account, 6 FROM h6) GROUP BY account),
share AS (
  SELECT d.phone AS entity, max(n) AS device_share_count FROM (SELECT DISTINCT phone, imei FROM dev) d
  JOIN (SELECT imei, count(DISTINCT phone) AS n FROM dev GROUP BY imei) USING (imei) GROUP BY d.phone),
sims AS (
  SELECT imei, max(n) AS most FROM (
    SELECT a.event_id, a.imei, count(DISTINCT b.imsi) AS n FROM dev a JOIN dev b ON a.imei = b.imei AND b.ts BETWEEN a.ts - INTERVAL '7 days' AND a.ts
    GROUP BY a.event_id, a.imei) GROUP BY imei),
sim AS (SELECT d.phone AS entity, max(most) AS sim_switch_count FROM (SELECT DISTINCT phone, imei FROM dev) d JOIN sims USING (imei) GROUP BY d.phone),
calls AS (SELECT * FROM ev WHERE event_type = 'CALL' AND dst IS NOT NULL),
firsts AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, min(ts) AS t FROM calls GROUP BY ALL),
fresh AS (SELECT c.* FROM calls c JOIN firsts f ON f.x = least(c.src, c.dst) AND f.y = greatest(c.src, c.dst) AND f.t = c.ts),
ctt AS (
  SELECT d.src AS victim, c.event_id AS call_id, d.event_id AS transfer_id FROM fresh c JOIN tr d ON d.src = c.dst WHERE d.ts >= c.ts AND d.ts < c.ts + INTERVAL '15 minutes'),
spoof AS (
  SELECT DISTINCT entity, 1 AS has_spoofed_header FROM (SELECT s AS entity FROM ml WHERE other OR spf OR dkim UNION SELECT r FROM ml WHERE other OR spf OR dkim)
  WHERE entity IN (SELECT entity FROM flow)),
pass AS (
  SELECT account, sum(credit)::DOUBLE AS credited, sum(least(credit, debited))::DOUBLE AS forwarded,
         round(sum(least(credit, debited))::DOUBLE / sum(credit)::DOUBLE, 4) AS ratio
  FROM (SELECT c.dst AS account, c.event_id, any_value(c.amount) AS credit, coalesce(sum(d.amount), 0) AS debited
        FROM tr c LEFT JOIN tr d ON d.src = c.dst AND d.ts BETWEEN c.ts AND c.ts + INTERVAL '60 minutes' GROUP BY c.dst, c.event_id) GROUP BY account),
"""
    + BETWEENNESS
    + """,
frame AS (
  SELECT f.entity, in_amount, out_amount, turnover, coalesce(pass.ratio, 0.0::DOUBLE) AS passthrough_ratio, coalesce(fin.most, 0) AS fan_in_count, coalesce(fout.most, 0) AS fan_out_count,
         coalesce(lay.depth, 0) AS layering_depth, coalesce(sim_switch_count, 0) AS sim_switch_count, coalesce(device_share_count, 0) AS device_share_count,
         CASE WHEN f.entity % 13 <> 0 THEN (f.entity % 90)::INT ELSE 365 END AS account_age_days, odd_hour_txn_count, has_cash_out,
         coalesce(has_spoofed_header, 0) AS has_spoofed_header, CASE WHEN f.entity IN (SELECT victim FROM ctt) THEN 1 ELSE 0 END AS has_call_then_transfer,
         coalesce(round(bc.betweenness, 8), 0.0::DOUBLE) AS betweenness_centrality, unique_counterparties
  FROM flowed f LEFT JOIN pass ON pass.account = f.entity LEFT JOIN spoof USING (entity) LEFT JOIN bc ON bc.node = f.entity LEFT JOIN odd USING (entity) LEFT JOIN cash USING (entity) LEFT JOIN fin USING (entity) LEFT JOIN fout USING (entity)
  LEFT JOIN lay ON lay.account = f.entity LEFT JOIN share USING (entity) LEFT JOIN sim USING (entity)),
ruled AS (
  SELECT entity, unnest([
    {'c': 'R01', 'v': passthrough_ratio::DOUBLE, 't': 0.85::DOUBLE, 'f': passthrough_ratio >= 0.85, 'w': 18.0::DOUBLE, 'o': 1},
    {'c': 'R02', 'v': fan_in_count::DOUBLE, 't': :fan_in::DOUBLE, 'f': fan_in_count >= :fan_in, 'w': 12.0::DOUBLE, 'o': 2},
    {'c': 'R03', 'v': fan_out_count::DOUBLE, 't': :fan_out::DOUBLE, 'f': fan_out_count >= :fan_out, 'w': 12.0::DOUBLE, 'o': 3},
    {'c': 'R04', 'v': layering_depth::DOUBLE, 't': 3.0::DOUBLE, 'f': layering_depth >= 3, 'w': 12.0::DOUBLE, 'o': 4},
    {'c': 'R05', 'v': sim_switch_count::DOUBLE, 't': 3.0::DOUBLE, 'f': sim_switch_count >= 3, 'w': 10.0::DOUBLE, 'o': 5},
    {'c': 'R06', 'v': device_share_count::DOUBLE, 't': 3.0::DOUBLE, 'f': device_share_count >= 3, 'w': 8.0::DOUBLE, 'o': 6},
    {'c': 'R07', 'v': turnover::DOUBLE, 't': :turnover::DOUBLE, 'f': account_age_days < 30 AND turnover > :turnover, 'w': 10.0::DOUBLE, 'o': 7},
    {'c': 'R08', 'v': has_cash_out::DOUBLE, 't': 1.0::DOUBLE, 'f': has_cash_out >= 1, 'w': 14.0::DOUBLE, 'o': 8},
    {'c': 'R09', 'v': has_spoofed_header::DOUBLE, 't': 1.0::DOUBLE, 'f': has_spoofed_header >= 1, 'w': 8.0::DOUBLE, 'o': 9},
    {'c': 'R10', 'v': odd_hour_txn_count::DOUBLE, 't': 5.0::DOUBLE, 'f': odd_hour_txn_count >= 5, 'w': 5.0::DOUBLE, 'o': 10},
    {'c': 'R11', 'v': has_call_then_transfer::DOUBLE, 't': 1.0::DOUBLE, 'f': has_call_then_transfer >= 1, 'w': 12.0::DOUBLE, 'o': 11},
    {'c': 'R12', 'v': betweenness_centrality::DOUBLE, 't': 0.05::DOUBLE, 'f': betweenness_centrality >= 0.05, 'w': 10.0::DOUBLE, 'o': 12}]) AS r FROM frame),
reason AS (
  SELECT entity, r.c AS rule_code, r.f::INT AS triggered, round(r.v, 4) AS raw_value, r.t AS threshold, CASE WHEN r.f THEN r.w ELSE 0.0::DOUBLE END AS points,
         replace(CASE r.c """
    + " ".join(f"WHEN '{c}' THEN CASE WHEN r.f THEN '{yes}' ELSE '{no}' END" for c, (_, _, yes, no) in rules.MEASURES.items())
    + """ END, '%s', regexp_replace(round(r.v, 4)::DECIMAL(38,4)::VARCHAR, '\\.?0+$', '')) AS text, r.o AS display_order FROM ruled),
scored AS (
  SELECT entity, round(least(100.0::DOUBLE, sum(points)), 2) AS score, coalesce(string_agg(rule_code, ',' ORDER BY rule_code) FILTER (triggered = 1), '') AS rules_fired
  FROM reason GROUP BY entity),
banded AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM scored)
"""
)



def _frame_sql(own: dict) -> str:
    """The frame, its reasons and scores under these rules."""
    values = {":fan_in": own["R02"]["threshold"], ":fan_out": own["R03"]["threshold"], ":turnover": own["R07"]["min_turnover"]}
    text = _FRAME_TEXT
    for name, value in values.items():
        text = text.replace(name, repr(float(value)))
    return text


_FRAME = _frame_sql(RULES)

QUERIES = {
    f.__name__: f
    for f in (
        fund_flow_pairs, node_flow, fan_in, fan_out, pass_through_window, layering, sim_switch, device_share, odd_hours_ist, odd_hours_utc, cash_out,
        call_then_transfer, call_then_transfer_flags, spoofed_header_flags, account_ages, feature_frame, feature_json, risk_scores, risk_scores_overridden, risk_scores_unbanded, risk_reasons, top_reasons, band_counts, score_histogram, composite_scores,
    )
}

SQL = {
    "fund_flow_pairs": _FRAME + "SELECT src AS a, dst AS b, count(*) AS support, sum(amount)::DOUBLE AS total_amount, min(ts) AS first_at, max(ts) AS last_at FROM tr GROUP BY src, dst",
    "node_flow": _FRAME + "SELECT * REPLACE (in_amount::DOUBLE AS in_amount, out_amount::DOUBLE AS out_amount) FROM flowed",
    "fan_in": _FRAME + "SELECT * FROM fin",
    "fan_out": _FRAME + "SELECT * FROM fout",
    "pass_through_window": _FRAME + "SELECT * FROM pass",
    "layering": _FRAME + "SELECT * FROM lay",
    "sim_switch": _FRAME + "SELECT * FROM sim",
    "device_share": _FRAME + "SELECT * FROM share",
    "odd_hours_ist": _FRAME + "SELECT entity, odd_hour_txn_count FROM odd",
    "odd_hours_utc": _FRAME + "SELECT entity, odd_utc AS odd_hour_txn_count FROM odd",
    "cash_out": _FRAME + "SELECT * FROM cash",
    "call_then_transfer": _FRAME + "SELECT * FROM ctt",
    "call_then_transfer_flags": _FRAME + "SELECT DISTINCT victim AS entity, 1 AS has_call_then_transfer FROM ctt",
    "spoofed_header_flags": _FRAME + "SELECT * FROM spoof",
    "account_ages": _FRAME + "SELECT entity, CASE WHEN entity % 13 <> 0 THEN (entity % 90)::INT END AS account_age_days FROM flow",
    "feature_json": _FRAME
    + """SELECT entity, '{"account_age_days":' || account_age_days || ',"fan_in_count":' || fan_in_count || ',"fan_out_count":' || fan_out_count || ',"has_call_then_transfer":' || has_call_then_transfer
  || ',"has_cash_out":' || has_cash_out || ',"has_spoofed_header":' || has_spoofed_header || ',"layering_depth":' || layering_depth || '}' AS features_json FROM frame""",
    "feature_frame": _FRAME + "SELECT * REPLACE (in_amount::DOUBLE AS in_amount, out_amount::DOUBLE AS out_amount) FROM frame",
    "risk_scores": _FRAME
    + """SELECT entity, score, band, rules_fired,
  row_number() OVER (ORDER BY CASE band WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, score DESC, entity) AS rank_in_case, '""" + rules_hash(RULES) + """' AS weights_hash FROM banded""",
    "risk_scores_overridden": _frame_sql(rules_with(OVERRIDES))
    + """SELECT entity, score, band, rules_fired,
  row_number() OVER (ORDER BY CASE band WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, score DESC, entity) AS rank_in_case, '""" + rules_hash(rules_with(OVERRIDES)) + """' AS weights_hash FROM banded""",
    "risk_scores_unbanded": _FRAME + "SELECT entity, score, row_number() OVER (ORDER BY score DESC, entity) AS rank_in_case FROM banded",
    "risk_reasons": _FRAME + "SELECT * FROM reason",
    "top_reasons": _FRAME
    + "SELECT entity, rule_code, points, place FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY points DESC, display_order) AS place FROM reason WHERE triggered = 1) WHERE place <= 3",
    "band_counts": _FRAME + "SELECT band, count(*) AS accounts FROM banded GROUP BY band",
    "score_histogram": _FRAME + "SELECT least(floor(score / 10), 9)::BIGINT AS bin, count(*) AS accounts FROM banded GROUP BY 1",
    "composite_scores": _FRAME
    + """, comp AS (
  SELECT entity, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, passthrough_ratio * 40.0::DOUBLE + layering_depth * 10.0::DOUBLE + fan_in_count * 1.5::DOUBLE + fan_out_count * 1.5::DOUBLE + sim_switch_count * 3.0::DOUBLE + betweenness_centrality * 10.0::DOUBLE)), 2) AS composite FROM frame)
SELECT *, CASE WHEN composite > 79 THEN 'CRITICAL' WHEN composite > 59 THEN 'HIGH' WHEN composite > 29 THEN 'MEDIUM' ELSE 'LOW' END AS composite_band FROM comp""",
}

