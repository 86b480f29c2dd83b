"""Queries about a case, and the anomaly stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.config import RULES
from caseweave.functions import normalize
from caseweave.operators import anomaly, cases, graph, ingest, links, mapping, rules
from caseweave.operators.adapter import address_owners, device_events, events, mail_texts, table, transfers
from caseweave.operators.checkpoints import cut
from caseweave.plans import evidence, flows, graphs, linking, sources
from caseweave.plans._plain import plain
from caseweave.sources import files


def _scores(spark, sf_dir) -> DataFrame:
    return rules.scored(flows._frame(spark, sf_dir), RULES)


def case_dashboard(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source").distinct()
    return cases.dashboard(own, transfers(spark, sf_dir), links.fund_flow(transfers(spark, sf_dir)), _scores(spark, sf_dir))


def case_timeline(spark, sf_dir):
    return plain(cases.timeline(transfers(spark, sf_dir), F.lit(7).cast("long")))


def case_timelines(spark, sf_dir):
    return plain(cases.timeline(transfers(spark, sf_dir), kind="TRANSFER"))


def case_appearances(spark, sf_dir):
    ends = transfers(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("entity"), F.concat(F.lit("file-"), (F.col("event_id") % 5).cast("string")).alias("file"))
    return cases.appearances(ends)


def case_seizures(spark, sf_dir):
    t = transfers(spark, sf_dir).withColumn("balance_after", (F.col("amount") * 10).cast("decimal(18,2)"))
    return cases.seizures(t, _scores(spark, sf_dir), 30.0)


def case_neighbours(spark, sf_dir):
    """By account and link type: links (by value where one is shared) and different neighbours."""
    flows_ = cases.neighbours(links.fund_flow(transfers(spark, sf_dir)))
    direct = flows_.groupBy("entity", "link_type").agg(F.count("*").alias("n"), F.count_distinct("other").alias("others"))
    # Pairs of accounts near in time stand once, so as many links as neighbours; they are counted where they are found.
    near = linking._near(spark, sf_dir).degrees().select("entity", F.lit("TEMPORAL_PROXIMITY").alias("link_type"), "n", F.col("n").alias("others"))
    return direct.unionByName(near).unionByName(links.class_neighbours(cut(linking._account_classes(spark, sf_dir))))


def case_neighbour_classes(spark, sf_dir):
    return cases.neighbour_counts(links.fund_flow(transfers(spark, sf_dir)), linking._classes(spark, sf_dir, "SHARED_IMEI"))


def score_history(spark, sf_dir):
    runs = None
    for k, least in enumerate((0, 50, 100)):
        t = transfers(spark, sf_dir).filter(F.col("amount") >= least)
        from caseweave.operators import features

        f = features.node_flow(t).select("entity", "passthrough_ratio", F.col("in_count").alias("fan_in_count"))
        one = f.select(F.lit("case-1").alias("case_id"), "entity", F.lit(k).alias("run_no"), F.round(F.col("passthrough_ratio") * 50 + F.least("fan_in_count", F.lit(50)), 4).alias("score"))
        runs = one if runs is None else runs.unionByName(one)
    return cases.history(runs)


def current_scores(spark, sf_dir):
    versions = transfers(spark, sf_dir).select(F.col("src").alias("entity"), (F.col("event_id") % 3).alias("run_no"), F.lit("case-1").alias("case_id")).distinct()
    return graph.current(versions, ["entity"])


def _reasons(spark, sf_dir) -> DataFrame:
    return rules.reasons(flows._frame(spark, sf_dir), RULES)


def _refs(spark, sf_dir, reasons: DataFrame) -> DataFrame:
    t = cut(transfers(spark, sf_dir))
    rows = cases.rule_events(t, device_events(spark, sf_dir), flows._calls(spark, sf_dir))
    name = F.concat(F.lit("file-"), (F.col("event_id") % 5).cast("string"))
    places = events(spark, sf_dir).select("event_id", name.alias("file"), F.col("event_id").alias("source_row"), F.sha2(name, 256).alias("sha256"))
    raw = mail_texts(spark, sf_dir)
    mails = cases.mail_refs(raw, files.parsed_mails(raw), address_owners(spark, sf_dir))
    return cases.evidence_refs(reasons, rows, places, 3, mails)


def reason_evidence(spark, sf_dir):
    """Of every fired reason three of the events or mails that met the rule, with their place in the evidence."""
    return _refs(spark, sf_dir, _reasons(spark, sf_dir))


def unsupported_reasons(spark, sf_dir):
    """How many fired reasons no evidence supports: none."""
    reasons = cut(_reasons(spark, sf_dir))
    return cases.unsupported(reasons, _refs(spark, sf_dir, reasons)).groupBy("rule_code").agg(F.count("*").alias("n"))


def entity_reasons(spark, sf_dir):
    """One account in depth, that of the highest score: its reasons, fired or not, and their evidence."""
    top = _scores(spark, sf_dir).orderBy(F.desc("score"), "entity").limit(1).select("entity", "score", "band")
    own = cut(_reasons(spark, sf_dir).join(F.broadcast(top), "entity"))
    refs = _refs(spark, sf_dir, own).groupBy("entity", "rule_code").agg(F.array_join(F.array_sort(F.collect_list(F.concat("file", F.lit(":"), F.col("source_row").cast("string")))), ",").alias("evidence"))
    return own.join(refs, ["entity", "rule_code"], "left").select("entity", "score", "band", "rule_code", "triggered", "points", "evidence")


def _cases(spark, sf_dir) -> DataFrame:
    name = F.coalesce("source", F.lit("none"))
    own = table(spark, sf_dir, "documents").groupBy(name.alias("case_id")).agg(F.count("*").alias("files"))
    status = F.when(F.col("files") % 2 == 0, "OPEN").otherwise("CLOSED")
    return own.select("case_id", F.concat(F.lit("Case of "), F.col("case_id")).alias("title"), status.alias("status"), "files")


def link_checks(spark, sf_dir):
    """Rules of links over flows, some of which got a wrong confidence or end."""
    f = links.fund_flow(transfers(spark, sf_dir))
    f = f.withColumn("confidence", F.when((F.col("a") + F.col("b")) % 7 == 0, 1.1).otherwise(F.col("confidence"))).withColumn("b", F.when(F.col("a") % 5 == 0, F.col("a")).otherwise(F.col("b")))
    return ingest.quality(f, ingest.LINK_CHECKS)


def score_checks(spark, sf_dir):
    """Rules of scores, over all scores and once more with some out of range."""
    s = _scores(spark, sf_dir).select("entity", "score", "band")
    wrong = s.select("entity", (F.col("score") + F.when(F.col("entity") % 4 == 0, 200).otherwise(0)).alias("score"), F.when(F.col("entity") % 9 == 0, "SEVERE").otherwise(F.col("band")).alias("band"))
    return ingest.quality(s.unionByName(wrong), ingest.SCORE_CHECKS)


def _odd_entities(spark, sf_dir) -> DataFrame:
    own = ingest.entities(evidence._mentions(spark, sf_dir, "true")).withColumn("n", F.substring("normalized", -8, 8).cast("bigint"))
    return own.withColumn("entity_type", F.when(F.col("n") % 6 == 0, "CAR").when(F.col("n") % 10 == 1, "").otherwise(F.col("entity_type"))).withColumn("normalized", F.when(F.col("n") % 10 == 3, " ").otherwise(F.col("normalized")))


def entity_checks(spark, sf_dir):
    return ingest.quality(_odd_entities(spark, sf_dir), ingest.ENTITY_CHECKS)


def valid_entities(spark, sf_dir):
    return ingest.valid_entities(_odd_entities(spark, sf_dir)).select("n", "entity_type", "occurrences")


def case_search(spark, sf_dir):
    return cases.found_cases(_cases(spark, sf_dir), text="A", status="OPEN")


def case_list(spark, sf_dir):
    """All cases, those of most files first."""
    return cases.listed(_cases(spark, sf_dir), [F.desc("files"), F.col("case_id")])


def recent_events(spark, sf_dir):
    return plain(cases.listed(transfers(spark, sf_dir), [F.desc("ts"), F.col("event_id")], 100)).select("place", "event_id", "src", "dst", "amount")


def ordered_rejects(spark, sf_dir):
    """Rejects by file and row."""
    bad = ingest.rejects(ingest.events(evidence._rows(spark, sf_dir), "BANK"))
    return cases.listed(bad, [F.col("evidence_file_id"), F.col("source_row")]).select("place", "evidence_file_id", "source_row", "reason", "raw_line")


def case_timeline_filtered(spark, sf_dir):
    return plain(cases.timeline(transfers(spark, sf_dir), kind="UPI_TXN", amount_text="9"))


def entity_search(spark, sf_dir):
    """Phones with these digits, and their account's score where it is at least MEDIUM."""
    own = ingest.entities(evidence._mentions(spark, sf_dir, "true"))
    hit = cases.search(own, "+91980000", "PHONE").withColumn("entity", F.substring("normalized", -8, 8).cast("bigint"))
    return hit.join(_scores(spark, sf_dir).filter("band <> 'LOW'"), "entity").select("entity", "normalized", "occurrences", "score", "band")


def entity_by_id(spark, sf_dir):
    """The entity of the smallest id."""
    own = ingest.entities(evidence._mentions(spark, sf_dir, "true")).withColumn("id", normalize.entity_id(F.col("case_id"), F.col("entity_type"), F.col("normalized")))
    return own.join(own.agg(F.min("id").alias("id")), "id").select("id", "normalized", "occurrences")


def scores_on_path(spark, sf_dir):
    """MEDIUM accounts on a day-long trail from a victim to a cash-out end for which the cash-out rule fired."""
    on = graphs._counted(spark, sf_dir).nodes()
    return cases.found_scores(_scores(spark, sf_dir), "MEDIUM", on, "R08").select("entity", "score", "band", "rules_fired")


def case_gates(spark, sf_dir):
    """Whether a brief may be made of each conversation's case."""
    said = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id"))
    own = said.agg(F.count_if(F.col("role") == "user").alias("suspects"), (F.max("turn") * 6).alias("hours_since_check"), F.count_if(F.length("text") < 20).alias("low_confidence_mappings"))
    return cases.gates(own)


def graph_data(spark, sf_dir):
    """Flows among the 50 accounts of the highest scores, with their number of transfers and total."""
    t = transfers(spark, sf_dir)
    top = _scores(spark, sf_dir).orderBy(F.desc("score"), "entity").limit(50).select(F.col("entity").alias("node"))
    inside = links.fund_flow(t).select(F.col("a").alias("src"), F.col("b").alias("dst"), "support", "total_amount")
    kept = inside.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return plain(kept)


def cluster_members(spark, sf_dir):
    """The accounts of each cluster of flows and shared handsets."""
    flows_ = links.fund_flow(transfers(spark, sf_dir)).select("a", "b")
    shared = flows_.unionByName(links.as_stars(linking._classes(spark, sf_dir, "SHARED_IMEI")).select("a", "b"))
    return graph.components(shared.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def pipeline_steps(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("action"), F.col("turn").alias("ts"))
    return cases.pipeline_status(said, ["system", "user", "assistant"])


def top_subgraph(spark, sf_dir):
    return graph.top_subgraph(transfers(spark, sf_dir), _scores(spark, sf_dir)).distinct()


def rule_weights(spark, sf_dir):
    """The rules with how often each fires: the weights table of the case."""
    fired = rules.reasons(flows._frame(spark, sf_dir), RULES).groupBy("rule_code").agg(F.sum("triggered").alias("fired"))
    table_ = spark.createDataFrame([(c, r["name"], r["weight"]) for c, r in RULES.items()], "rule_code string, name string, weight double")
    return table_.join(fired, "rule_code", "left")


def anomaly_scores(spark, sf_dir):
    return anomaly.isolation_scores(flows._frame(spark, sf_dir)).select("entity", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "anomaly_rank")


def reranked_scores(spark, sf_dir):
    frame = flows._frame(spark, sf_dir)
    return anomaly.reranked(rules.scored(frame, RULES), anomaly.isolation_scores(frame)).select("entity", "score", "band", "anomaly_rank", "rank_in_case")


def flag_evaluation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") < 400).cast("int").alias("flag"))
    return anomaly.evaluation(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label")))


def case_brief(spark, sf_dir):
    """The case of most files in brief."""
    scores, t = cut(_scores(spark, sf_dir)), transfers(spark, sf_dir)
    head = cut(_cases(spark, sf_dir).orderBy(F.desc("files"), "case_id").limit(1))
    own = evidence.evidence_inventory(spark, sf_dir).select("name", "sha256")
    return cases.brief(
        scores, cases.seizures(t, scores, 30.0), graph.components(t), "case-1", events=t, audit_heads=evidence.audit_heads(spark, sf_dir),
        header=head, reasons=_reasons(spark, sf_dir), files=own,
    )


def brief_gates(spark, sf_dir):
    """Whether a brief may be made of each conversation's case, from its integrity, the age of its last entry, its accounts' scores
    and the mappings of its files."""
    chain = evidence._chain(spark, sf_dir)
    checked = chain.groupBy("case_id").agg((F.max("seq") * 3).alias("hours"))
    suspects = _scores(spark, sf_dir).select((F.col("entity") % 150).alias("case_id"), "score")
    made = mapping.by_alias(sources._layouts(spark, sf_dir)).select((F.col("file_id") % 150).alias("case_id"), F.when(F.col("field") == "callee", 0.6).otherwise(F.col("confidence")).alias("confidence"), (F.col("file_id") % 3 != 0).alias("is_confirmed"))
    facts = cases.gate_facts(evidence.case_integrity(spark, sf_dir), checked, suspects, made)
    return facts.join(cases.gates(facts), "case_id")


def case_steps(spark, sf_dir):
    """The steps of each case that are done, from what they left: evidence, its chain, a mapping, scores."""
    chain = evidence._chain(spark, sf_dir).select("case_id", F.col("seq").cast("long").alias("ts"))
    files_ = table(spark, sf_dir, "documents").select((F.col("doc_id") % 150).alias("case_id"), F.col("doc_id").alias("ts"))
    mapped = mapping.by_alias(sources._layouts(spark, sf_dir)).select((F.col("file_id") % 150).alias("case_id"), F.col("file_id").alias("ts"))
    scored = _scores(spark, sf_dir).filter("band <> 'LOW'").select((F.col("entity") % 150).alias("case_id"), F.col("entity").alias("ts"))
    return cases.pipeline_status(cases.step_actions(evidence=files_, audit=chain, mapping=mapped, score=scored), ["evidence", "audit", "mapping", "score"])


_BASE = flows._FRAME
QUERIES = {
    f.__name__: f
    for f in (
        case_dashboard, case_timeline, case_timelines, case_appearances, case_seizures, case_neighbours, score_history, current_scores, reason_evidence, entity_reasons, pipeline_steps,
        top_subgraph, rule_weights, anomaly_scores, reranked_scores, flag_evaluation, case_brief, case_neighbour_classes, unsupported_reasons, link_checks, score_checks, entity_checks, valid_entities, case_search, case_list, recent_events,
        ordered_rejects, case_timeline_filtered, entity_search, entity_by_id, scores_on_path, case_gates, brief_gates, case_steps, graph_data, cluster_members,
    )
}

#: refs: three of what met each fired rule.  Windows and chains are those that reached the most, the first in time of them.
_EVIDENCE = (
    _BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, credited AS (SELECT o.*, EXISTS (SELECT 1 FROM tr c WHERE c.dst = o.entity AND c.ts BETWEEN o.ts - INTERVAL '60 minutes' AND o.ts) AS after_credit
  FROM (SELECT src AS entity, 0 AS incoming, amount, ts, event_type, event_id FROM tr UNION ALL SELECT dst, 1, amount, ts, event_type, event_id FROM tr) o),
p2 AS (SELECT entity, arg_min(ts, {'n': -n, 't': ts}) AS at FROM (
  SELECT a.dst AS entity, a.ts, count(DISTINCT b.src) AS n FROM tr a JOIN tr b ON a.dst = b.dst AND b.ts BETWEEN a.ts - INTERVAL '2 hours' AND a.ts GROUP BY a.event_id, a.dst, a.ts) GROUP BY entity),
p3 AS (SELECT entity, arg_min(ts, {'n': -n, 't': ts}) AS at FROM (
  SELECT a.src AS entity, a.ts, count(DISTINCT b.dst) AS n FROM tr a JOIN tr b ON a.src = b.src AND b.ts BETWEEN a.ts - INTERVAL '2 hours' AND a.ts GROUP BY a.event_id, a.src, a.ts) GROUP BY entity),
p5 AS (SELECT imei, max(n) AS n, arg_min(ts, {'n': -n, 't': ts}) AS at FROM (
  SELECT a.imei, a.ts, count(DISTINCT b.imsi) AS n FROM dev a JOIN dev b ON a.imei = b.imei AND b.ts BETWEEN a.ts - INTERVAL '7 days' AND a.ts GROUP BY a.event_id, a.imei, a.ts) GROUP BY imei),
hs5 AS (SELECT phone, arg_min(imei, {'n': -n, 'i': imei}) AS imei FROM (SELECT DISTINCT phone, imei FROM dev) JOIN p5 USING (imei) GROUP BY phone),
links4(account, dst, t0, t, ids, k) AS (
  SELECT src, dst, ts, ts, [event_id], 1 FROM tr
  UNION ALL SELECT l.account, r.dst, l.t0, r.ts, list_append(l.ids, r.event_id), l.k + 1 FROM links4 l JOIN tr r ON l.dst = r.src AND r.ts > l.t AND r.ts <= l.t0 + INTERVAL '30 minutes' WHERE l.k < 6),
p4 AS (SELECT account AS entity, unnest(ids) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY k DESC, t0, t, ids) AS r FROM links4) WHERE r = 1),
met AS (
  SELECT entity, 'R01' AS rule_code, event_id, amount FROM credited WHERE incoming = 0 AND after_credit
  UNION SELECT p.entity, 'R02', t.event_id, t.amount FROM p2 p JOIN tr t ON t.dst = p.entity AND t.ts BETWEEN p.at - INTERVAL '2 hours' AND p.at
  UNION SELECT p.entity, 'R03', t.event_id, t.amount FROM p3 p JOIN tr t ON t.src = p.entity AND t.ts BETWEEN p.at - INTERVAL '2 hours' AND p.at
  UNION SELECT entity, 'R04', event_id, amount FROM p4 JOIN tr USING (event_id)
  UNION SELECT h.phone, 'R05', d.event_id, 0 FROM hs5 h JOIN p5 p ON p.imei = h.imei JOIN dev d ON d.imei = h.imei AND d.ts BETWEEN p.at - INTERVAL '7 days' AND p.at
  UNION SELECT phone, 'R06', event_id, 0 FROM dev UNION SELECT entity, unnest(['R07', 'R12']), event_id, amount FROM credited
  UNION SELECT entity, 'R08', event_id, amount FROM credited WHERE event_type = 'ATM_WITHDRAWAL' UNION SELECT entity, 'R10', event_id, amount FROM credited WHERE hour(ts + INTERVAL '330 minutes') < 5
  UNION SELECT victim, 'R11', transfer_id, 0 FROM ctt),
mails AS (
  SELECT m.doc_id, s, r, 'mail-' || m.doc_id AS file, sha256(concat_ws(chr(13) || chr(10),
    'Return-Path: <' || CASE WHEN lookalike THEN 'bounce@bannk.example' WHEN other THEN 'bounce@other.test' ELSE 'u' || s || '@bank.example' END || '>',
    'Received: from a.example' || chr(13) || chr(10) || chr(9) || 'by b.example', 'Received: from b.example by c.example',
    'Authentication-Results: c.example; spf=' || CASE WHEN spf THEN 'fail' ELSE 'pass' END || '; dkim=' || CASE WHEN dkim THEN 'fail' ELSE 'pass' END || '; dmarc=none',
    'From: Someone <u' || s || '@bank.example>', 'To: u' || r || '@mail.example', 'Subject: Statement ' || m.doc_id, 'Date: Wed, 04 Mar 2026 10:23:00 +0530', '', substr(text, 1, 200))) AS sha256
  FROM ml m JOIN documents d USING (doc_id) WHERE other OR spf OR dkim),
refs AS (
  SELECT entity, rule_code, event_id, 'file-' || (event_id % 5) AS file, event_id AS source_row, sha256('file-' || (event_id % 5)) AS sha256 FROM (
    SELECT r.entity, r.rule_code, event_id, row_number() OVER (PARTITION BY r.entity, r.rule_code ORDER BY amount DESC, event_id) AS n
    FROM reason r JOIN met m ON m.entity = r.entity AND m.rule_code = r.rule_code WHERE triggered = 1) WHERE n <= 3
  UNION ALL SELECT entity, rule_code, NULL, file, 1, sha256 FROM (
    SELECT r.entity, r.rule_code, file, sha256, row_number() OVER (PARTITION BY r.entity ORDER BY file) AS n
    FROM reason r JOIN (SELECT s AS entity, file, sha256 FROM mails UNION SELECT r, file, sha256 FROM mails) m ON m.entity = r.entity WHERE triggered = 1 AND rule_code = 'R09') WHERE n <= 3)
"""
)
_LINE = "row_number() OVER w AS place, event_id, event_type, ts, amount::DOUBLE AS amount, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6, 3) AS minutes_since"
SQL = {
    "case_dashboard": _BASE
    + """SELECT (SELECT count(DISTINCT source) FROM documents WHERE source IS NOT NULL) + (SELECT count(*) FROM (SELECT 1 FROM documents WHERE source IS NULL LIMIT 1)) AS files,
  (SELECT count(*) FROM tr) AS rows, count(*) AS entities, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM tr)) AS links, max(score) AS top_score,
  arg_min(band, {'s': -score, 'e': entity}) AS top_band, arg_min(entity, {'s': -score, 'e': entity}) AS top_entity FROM banded""",
    "case_timeline": _BASE + f"SELECT 7::BIGINT AS entity, {_LINE} FROM tr WHERE src = 7 OR dst = 7 WINDOW w AS (ORDER BY ts, event_id)",
    "case_timelines": _BASE
    + f"SELECT entity, {_LINE} FROM (SELECT *, unnest([src, dst]) AS entity FROM tr WHERE event_type = 'TRANSFER') WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)",
    "case_appearances": _BASE + "SELECT entity, 'file-' || (event_id % 5) AS file, count(*) AS n FROM (SELECT event_id, unnest([src, dst]) AS entity FROM tr) GROUP BY ALL",
    "case_seizures": _BASE
    + """SELECT entity, band, round(residual, 2) AS residual, balance, last_ts, 'HDFC0' || lpad((entity % 1000)::VARCHAR, 6, '0') AS ifsc,
  'Freeze account ' || entity || ' at HDFC0' || lpad((entity % 1000)::VARCHAR, 6, '0') || ': ' || format('{:,.2f}', round(residual, 2)) || ' left' AS advice FROM banded JOIN (
  SELECT entity, sum(x)::DOUBLE AS residual, max(ts) AS last_ts, (arg_max(-x * 10, {'t': ts, 'e': event_id}) FILTER (o = 1))::DOUBLE AS balance
  FROM (SELECT dst AS entity, amount AS x, ts, event_id, 0 AS o FROM tr UNION ALL SELECT src, -amount, ts, event_id, 1 FROM tr) GROUP BY entity) USING (entity)
WHERE score >= 30 AND residual > 0""",
    "case_neighbours": linking._BASE
    + """, nb AS (SELECT a AS entity, b AS other, link_type FROM pairs UNION ALL SELECT b, a, link_type FROM pairs
  UNION ALL SELECT x.entity, y.entity, x.link_type FROM cls x JOIN cls y ON x.link_type = y.link_type AND x.value = y.value AND x.entity <> y.entity)
SELECT entity, link_type, count(*) AS n, count(DISTINCT other) AS others FROM nb GROUP BY ALL""",
    "case_neighbour_classes": linking._BASE
    + """SELECT entity, link_type, NULL::VARCHAR AS value, count(DISTINCT other) AS others FROM (SELECT src AS entity, dst AS other, 'FUND_FLOW' AS link_type FROM tr UNION ALL SELECT dst, src, 'FUND_FLOW' FROM tr) GROUP BY ALL
UNION ALL SELECT entity, link_type, value, users - 1 FROM c_SHARED_IMEI""",
    "cluster_members": linking._BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, und AS (SELECT a AS src, b AS dst FROM (FROM pairs UNION ALL FROM stars) WHERE link_type IN ('SHARED_IMEI', 'FUND_FLOW')), two AS (SELECT src, dst FROM und UNION SELECT dst, src FROM und),
lab AS (SELECT src AS node, src AS root FROM two UNION SELECT u.dst, l.root FROM lab l JOIN two u ON u.src = l.node)
SELECT node, min(root) AS component FROM lab GROUP BY node""",
    "unsupported_reasons": _BASE + "SELECT rule_code, count(*) AS n FROM reason WHERE false GROUP BY rule_code",
    "link_checks": _BASE
    + """, p AS (SELECT DISTINCT src, dst FROM tr)
SELECT unnest(['confidence is a share', 'ends differ', 'support is positive']) AS "check", unnest([count(*) FILTER ((src + dst) % 7 = 0), count(*) FILTER (src % 5 = 0), 0]) AS failed FROM p""",
    "score_checks": _BASE
    + """SELECT unnest(['score is of 100', 'band is known']) AS "check", unnest([count(*) FILTER (entity % 4 = 0), count(*) FILTER (entity % 9 = 0)]) AS failed FROM banded""",
    "entity_checks": _BASE
    + """, n AS (SELECT DISTINCT src AS n FROM ev)
SELECT unnest(['type is known', 'occurs', 'value is there']) AS "check", unnest([count(*) FILTER (n % 6 = 0 OR n % 10 = 1), 0, count(*) FILTER (n % 10 = 3)]) AS failed FROM n""",
    "valid_entities": _BASE
    + """SELECT src AS n, CASE WHEN src % 6 = 0 THEN 'CAR' ELSE 'PHONE' END AS entity_type, count(*) AS occurrences FROM ev WHERE NOT (src % 10 = 3) AND NOT (src % 10 = 1 AND src % 6 <> 0) GROUP BY src""",
    "case_search": "WITH " + (_CASES := """c AS (SELECT coalesce(source, 'none') AS case_id, 'Case of ' || coalesce(source, 'none') AS title, CASE WHEN count(*) % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status, count(*) AS files
  FROM documents GROUP BY coalesce(source, 'none'))
""")
    + "SELECT * FROM c WHERE status = 'OPEN' AND (contains(lower(title), 'a') OR contains(lower(case_id), 'a'))",
    "case_list": "WITH " + _CASES + "SELECT *, row_number() OVER (ORDER BY files DESC, case_id) AS place FROM c",
    "recent_events": _BASE + "SELECT row_number() OVER (ORDER BY ts DESC, event_id) AS place, event_id, src, dst, amount::DOUBLE AS amount FROM tr QUALIFY place <= 100",
    "ordered_rejects": evidence._BANK
    + """SELECT row_number() OVER (ORDER BY evidence_file_id, source_row) AS place, evidence_file_id, source_row, reason, raw_line FROM why WHERE reason IS NOT NULL""",
    "case_timeline_filtered": _BASE
    + f"SELECT entity, {_LINE} FROM (SELECT *, unnest([src, dst]) AS entity FROM tr WHERE event_type = 'UPI_TXN' AND contains(amount::VARCHAR, '9')) WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)",
    "entity_search": _BASE
    + """, ph AS (SELECT '+9198' || lpad(src::VARCHAR, 8, '0') AS normalized, src AS entity, count(*) AS occurrences FROM ev GROUP BY src)
SELECT entity, normalized, occurrences, score, band FROM ph JOIN banded USING (entity) WHERE contains(normalized, '+91980000') AND band <> 'LOW'""",
    "entity_by_id": evidence._PHONES
    + """, i AS (SELECT sha256('case-1:PHONE:' || normalized) AS id, normalized, count(*) AS occurrences FROM ph GROUP BY normalized)
SELECT id, normalized, occurrences FROM i ORDER BY id LIMIT 1""",
    "scores_on_path": _BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, trail(source, e, path, t0, t) AS (
  SELECT src, dst, [src, dst], ts, ts FROM tr WHERE src NOT IN (SELECT dst FROM tr)
  UNION ALL SELECT source, dst, list_append(path, dst), t0, ts FROM trail JOIN tr ON e = src AND ts > t AND ts <= t0 + INTERVAL '1440 minutes' WHERE NOT list_contains(path, dst) AND len(path) < 7),
onp AS (SELECT DISTINCT unnest(path) AS node FROM trail WHERE e IN (SELECT dst FROM tr WHERE event_type = 'ATM_WITHDRAWAL'))
SELECT entity, score, band, rules_fired FROM banded WHERE band = 'MEDIUM' AND contains(rules_fired, 'R08') AND entity IN (FROM onp)""",
    "case_gates": """SELECT conv_id AS case_id, coalesce(max(turn) * 6 < 24 AND count(*) FILTER (role = 'user') >= 1 AND count(*) FILTER (length(text) < 20) = 0, false) AS ready FROM conversations GROUP BY conv_id""",
    "brief_gates": f"""WITH st AS ({evidence.SQL["case_integrity"]}), age AS (SELECT case_id, max(seq) * 3 AS hours FROM ({evidence.SQL["audit_chain"]}) GROUP BY case_id),
sus AS (SELECT entity % 150 AS case_id, count(*) AS suspects FROM ({flows.SQL["risk_scores"]}) WHERE score >= 30 GROUP BY 1),
low AS (SELECT file_id % 150 AS case_id, count(*) FILTER (field = 'callee' AND file_id % 3 = 0) AS low FROM ({sources.SQL["alias_mapping"]}) GROUP BY 1),
facts AS (
  SELECT a.case_id, CASE WHEN status <> 'COMPROMISED' THEN hours END AS hours_since_check, coalesce(suspects, 0) AS suspects, coalesce(low, 0) AS low_confidence_mappings
  FROM age a LEFT JOIN st USING (case_id) LEFT JOIN sus USING (case_id) LEFT JOIN low USING (case_id))
SELECT *, coalesce(hours_since_check < 24 AND suspects >= 1 AND low_confidence_mappings = 0, false) AS ready FROM facts""",
    "case_steps": f"""WITH act AS (
  SELECT doc_id % 150 AS case_id, 'evidence' AS step, doc_id AS ts FROM documents UNION ALL SELECT conv_id, 'audit', turn FROM conversations WHERE text IS NOT NULL
  UNION ALL SELECT file_id % 150, 'mapping', file_id FROM ({sources.SQL["alias_mapping"]}) UNION ALL SELECT entity % 150, 'score', entity FROM ({flows.SQL["risk_scores"]}) WHERE band <> 'LOW'),
every AS (SELECT DISTINCT case_id FROM act)
SELECT e.case_id, s.step, max(ts) IS NOT NULL AS done, max(ts) AS last FROM every e CROSS JOIN (SELECT unnest(['evidence', 'audit', 'mapping', 'score']) AS step) s
LEFT JOIN act ON act.case_id = e.case_id AND act.step = s.step GROUP BY ALL""",
    "graph_data": _BASE
    + """, top AS (SELECT entity FROM banded ORDER BY score DESC, entity LIMIT 50)
SELECT src, dst, count(*) AS support, sum(amount)::DOUBLE AS total_amount FROM tr WHERE src IN (FROM top) AND dst IN (FROM top) GROUP BY src, dst""",
    "score_history": _BASE
    + "".join(
        f""", g{k} AS (SELECT entity, {k} AS run_no, round(CASE WHEN ia > 0 THEN least(1.0::DOUBLE, coalesce(oa, 0)::DOUBLE / ia::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS p, ic
  FROM (SELECT entity, sum(amount) FILTER (incoming = 1) AS ia, sum(amount) FILTER (incoming = 0) AS oa, count(*) FILTER (incoming = 1) AS ic FROM ori WHERE amount >= {m} GROUP BY entity))"""
        for k, m in enumerate((0, 50, 100))
    )
    + """, vs AS (SELECT entity, run_no, round(p * 50 + least(ic, 50), 4) AS score FROM (FROM g0 UNION ALL FROM g1 UNION ALL FROM g2))
SELECT *, round(score - lag(score) OVER (PARTITION BY entity ORDER BY run_no), 4) AS change, run_no = (SELECT max(run_no) FROM vs) AS is_current FROM vs""",
    "current_scores": _BASE + "SELECT src AS entity, max(event_id % 3) AS run_no, 'case-1' AS case_id FROM tr GROUP BY src",
    "reason_evidence": _EVIDENCE + "SELECT * FROM refs",
    "entity_reasons": _EVIDENCE
    + """SELECT r.entity, score, band, r.rule_code, r.triggered, r.points, (SELECT string_agg(file || ':' || source_row, ',' ORDER BY file || ':' || source_row) FROM refs x WHERE x.entity = r.entity AND x.rule_code = r.rule_code) AS evidence
FROM reason r JOIN (SELECT entity, score, band FROM banded ORDER BY score DESC, entity LIMIT 1) USING (entity)""",
    "pipeline_steps": """SELECT c.conv_id AS case_id, s.step, max(turn) FILTER (role = step) IS NOT NULL AS done, max(turn) FILTER (role = step) AS last
FROM conversations c, (SELECT unnest(['system', 'user', 'assistant']) AS step) s GROUP BY ALL""",
    "top_subgraph": _BASE
    + ", top AS (SELECT entity FROM banded ORDER BY score DESC, entity LIMIT 50) SELECT DISTINCT src, dst FROM tr WHERE src IN (FROM top) AND dst IN (FROM top)",
    "rule_weights": _BASE
    + "SELECT rule_code, name, weight, fired FROM (VALUES "
    + ", ".join(f"('{c}', '{r['name']}', {r['weight']}::DOUBLE)" for c, r in RULES.items())
    + ") t(rule_code, name, weight) LEFT JOIN (SELECT rule_code, sum(triggered)::BIGINT AS fired FROM reason GROUP BY rule_code) USING (rule_code)",
    "flag_evaluation": """WITH b AS (SELECT (n_chars < 400)::INT AS flag, 1 - quality AS label FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (flag = 1 AND label = 1) AS tp, count(*) FILTER (flag = 1 AND label = 0) AS fp, count(*) FILTER (flag = 0 AND label = 1) AS fn FROM b)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS "precision", round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
}
