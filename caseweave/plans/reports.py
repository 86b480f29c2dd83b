"""Queries behind reports: registers and exports, lists in order, phone contents, formats from files, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.config import FORMATS
from caseweave.functions import normalize
from caseweave.operators import anomaly, cases, features, links, mapping
from caseweave.operators.adapter import EVENTS_SQL, device_events, events, transfers
from caseweave.operators.checkpoints import shared_folder
from caseweave.plans import cases as case_plans
from caseweave.plans import evidence, flows, graphs, linking, sources
from caseweave.plans._plain import plain
from caseweave.sources import files, formats


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/caseweave/{name}-{uuid.uuid4().hex}"


def case_by_id(spark, sf_dir):
    """The case of most files, by its id."""
    every = case_plans._cases(spark, sf_dir)
    wanted = every.agg(F.min_by("case_id", F.struct(-F.col("files"), "case_id")).alias("id"))
    return every.join(F.broadcast(wanted), F.col("case_id") == F.col("id")).drop("id")


def seizure_list(spark, sf_dir):
    """Accounts to freeze, those with most left in them first."""
    return cases.listed(case_plans.case_seizures(spark, sf_dir), [F.desc("residual"), F.col("entity")]).select("place", "entity", "band", "residual")


def audit_recent(spark, sf_dir):
    return cases.last_entries(evidence._chain(spark, sf_dir))


def audit_in_order(spark, sf_dir):
    """All audit entries by case and number."""
    chain = evidence._chain(spark, sf_dir).select("case_id", "seq", "action", "entry_hash")
    return cases.listed(chain, [F.col("case_id"), F.col("seq")])


def case_timeline_ends(spark, sf_dir):
    """Events of which an end's number holds the digits 14."""
    return plain(cases.timeline(transfers(spark, sf_dir), end_text="14"))


def link_rationales(spark, sf_dir):
    """A sentence for every link of every type."""
    pairs, classes = linking._pairs_and_classes(spark, sf_dir)
    stars = links.as_stars(classes).select("a", "b", "link_type", "value", "support", F.lit(None).cast("decimal(18,2)").alias("total_amount"))
    direct = pairs.select("a", "b", "link_type", F.lit(None).cast("string").alias("value"), "support", "total_amount")
    return links.rationale(direct.unionByName(stars)).select("a", "b", "link_type", "value", "rationale")


def graph_data_above(spark, sf_dir):
    """Links of at least 0.9 among the 50 accounts of the highest scores, and whether one is a hop of a best trail."""
    top = case_plans._scores(spark, sf_dir).orderBy(F.desc("score"), "entity").limit(50).select(F.col("entity").alias("node"))
    strong = linking._merged(spark, sf_dir, 0.9).filter("confidence >= 0.9").select("a", "b", "link_type", "value")
    kept = strong.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")
    nodes = F.split("path", ">")
    hops = graphs._counted(spark, sf_dir).pairs().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda k: F.struct(F.get(nodes, k - 1).cast("long").alias("a"), F.get(nodes, k).cast("long").alias("b")))).alias("h"))
    hops = hops.select("h.a", "h.b", F.lit(True).alias("hop")).distinct()
    return kept.join(hops, ["a", "b"], "left").select("a", "b", "link_type", "value", (F.coalesce("hop", F.lit(False)) & (F.col("link_type") == "FUND_FLOW")).alias("on_best_path"))


def _phones(spark, sf_dir) -> dict[str, DataFrame]:
    """A dump of each phone with its device, its contacts and its messages, as JSON text, read back."""
    uses = device_events(spark, sf_dir)
    at = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    contact = F.struct(F.concat(F.lit("Name "), F.col("imei").cast("string")).alias("name"), F.col("imei").cast("string").alias("number"), F.lit("2026-01-01").alias("added"))
    sent = F.col("event_id") % 3 == 0
    message = F.struct(F.when(sent, F.col("phone")).otherwise(F.col("imei")).cast("string").alias("from"), F.when(sent, F.col("imei")).otherwise(F.col("phone")).cast("string").alias("to"), at.alias("date"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("body"))
    device = F.struct(
        F.lpad(F.min("imei").cast("string"), 15, "0").alias("imei"), F.concat(F.lit("android-"), (F.col("phone") % 53).cast("string")).alias("android_id"),
        F.concat(F.lit("model "), (F.col("phone") % 7).cast("string")).alias("model"), F.col("phone").cast("string").alias("phone_number"),
    )
    one = uses.groupBy("phone").agg(F.to_json(F.struct(device.alias("device_info"), F.collect_set(contact).alias("contacts"), F.collect_list(message).alias("sms_messages"))).alias("value"))
    path = _place(spark, "phones")
    one.select("value").write.text(path)
    raw = spark.read.schema(files.PHONE_DUMP).json(path)
    return files.flattened_dumps(raw.withColumn("path", F.concat(F.lit("dump-"), F.col("device_info.phone_number"))))


def dump_contacts(spark, sf_dir):
    return _phones(spark, sf_dir)["contacts"].select("owner", "name", "number")


def dump_devices(spark, sf_dir):
    return _phones(spark, sf_dir)["devices"].select("phone_number", "imei", "android_id", "model")


def dump_messages(spark, sf_dir):
    return _phones(spark, sf_dir)["events"].select("path", "event_type", "src", "dst", "occurred_at")


#: A kind that no release knows: its headers are those of an installation's own telephone company.
LOCAL = {"LOCAL_CDR": {"detect": ["ani", "first cgi"], "columns": {"caller": ["MSISDN", "ANI"], "callee": ["Dialed Number"], "start_time": ["Start Time"]}, "dates": ["yyyy-MM-dd HH:mm:ss"], "required": ["caller"]}}


def _loaded(spark) -> dict:
    path = _place(spark, "formats")
    formats.save(LOCAL, spark, path)
    return formats.load(spark, path, FORMATS)


def plugin_kinds(spark, sf_dir):
    """Kinds of files by their headers, among them one that a format file adds."""
    rows = sources._with_heads(spark, sf_dir).select("file_id", "headers", F.lit("").alias("head"))
    return mapping.detected(rows, _loaded(spark))


def plugin_mapping(spark, sf_dir):
    """Headers of the added kind's files by its aliases."""
    h = sources._layouts(spark, sf_dir).filter("file_id % 4 = 1").withColumn("kind", F.lit("LOCAL_CDR"))
    return mapping.by_alias(h, _loaded(spark)).select("file_id", "source", "field")


def exported_register(spark, sf_dir):
    """The evidence register as CSV, read back."""
    path = _place(spark, "register")
    files.export(evidence.evidence_inventory(spark, sf_dir), path)
    return spark.read.option("header", "true").schema("name string, case_id string, size_bytes long, sha256 string, is_duplicate boolean").csv(path)


def exported_audit(spark, sf_dir):
    """The audit log as JSON lines, read back."""
    path = _place(spark, "audit")
    files.export(evidence.audit_chain(spark, sf_dir), path, "json")
    return spark.read.schema("case_id long, seq long, payload_hash string, prev_hash string, entry_hash string").json(path)


def exported_graph(spark, sf_dir):
    """The flows as a graph of nodes and edges in Parquet, read back: degrees from the edges, for every node."""
    nodes_at, edges_at = _place(spark, "nodes"), _place(spark, "edges")
    flow = links.fund_flow(transfers(spark, sf_dir))
    files.export(flow.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes_at, "parquet")
    files.export(flow.select("a", "b", "support", "total_amount"), edges_at, "parquet")
    nodes, edges = spark.read.parquet(nodes_at), spark.read.parquet(edges_at)
    return nodes.join(edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("flows"), F.sum("support").alias("transfers")), "node", "left")


def normalized_handles(spark, sf_dir):
    """SIM numbers, payment handles and free text by their types' rules, right and wrong ones."""
    e = events(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("IMSI"), F.lit("UPI_HANDLE"), F.lit("PERSON")), (F.col("event_id") % 3 + 1).cast("int"))
    sim = F.concat(F.lit("404-45-"), F.lpad(F.col("src").cast("string"), 10, "0"), F.when(F.col("event_id") % 2 == 0, "7").otherwise(""))
    raw = F.when(kind == "IMSI", sim).when(kind == "UPI_HANDLE", F.concat(F.lit("  User"), F.col("src").cast("string"), F.lit("@OkBank "))).otherwise(F.concat(F.lit("  Name "), F.col("src").cast("string"), F.lit(" ")))
    return e.select("event_id", kind.alias("entity_type"), normalize.normalized(kind, raw).alias("normalized"))


def overridden_features(spark, sf_dir):
    """Features of which an officer corrected some: what was stated wins over what was computed."""
    t = transfers(spark, sf_dir)
    stated = features.node_flow(t).filter("entity % 10 = 4").select("entity", F.lit(7).alias("account_age_days"), F.when(F.col("entity") % 20 == 4, F.lit(99)).alias("fan_in_count"))
    return features.feature_frame(t, overrides=stated).select("entity", "account_age_days", "fan_in_count", "sim_switch_count")


def forest_evaluation(spark, sf_dir):
    """How the forest's flags agree with the rules' bands: recall, precision, false flags."""
    frame = flows._frame(spark, sf_dir)
    flags = anomaly.isolation_scores(frame).select(F.col("entity").alias("id"), F.col("is_anomaly").cast("int").alias("flag"))
    return anomaly.evaluation(flags, case_plans._scores(spark, sf_dir).select(F.col("entity").alias("id"), (F.col("band") != "LOW").cast("int").alias("label")))


QUERIES = {
    f.__name__: f
    for f in (
        case_by_id, seizure_list, audit_recent, audit_in_order, case_timeline_ends, link_rationales, graph_data_above, dump_contacts, dump_devices, dump_messages, plugin_kinds, plugin_mapping,
        exported_register, exported_audit, exported_graph, normalized_handles, overridden_features, forest_evaluation,
    )
}

_CHAIN = evidence._CHAIN.rstrip().rstrip(",")
_EV = "WITH " + EVENTS_SQL
SQL = {
    "case_by_id": "WITH " + case_plans._CASES + "SELECT * FROM c ORDER BY files DESC, case_id LIMIT 1",
    "seizure_list": "SELECT row_number() OVER (ORDER BY residual DESC, entity) AS place, entity, band, residual FROM (" + case_plans.SQL["case_seizures"] + ")",
    "audit_recent": _CHAIN + " SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS place, seq, action, entry_hash FROM chain QUALIFY place <= 5",
    "audit_in_order": _CHAIN + " SELECT case_id, seq, action, entry_hash, row_number() OVER (ORDER BY case_id, seq) AS place FROM chain",
    "case_timeline_ends": case_plans._BASE
    + f"SELECT entity, {case_plans._LINE} FROM (SELECT *, unnest([src, dst]) AS entity FROM tr WHERE contains(src::VARCHAR, '14') OR contains(dst::VARCHAR, '14')) WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)",
    "link_rationales": linking._BASE
    + """, sums AS (SELECT src AS a, dst AS b, sum(amount)::DOUBLE AS total FROM tr GROUP BY src, dst)
SELECT k.a, k.b, link_type, value, CASE WHEN link_type = 'FUND_FLOW' THEN 'Money moved directly: ' || format('{:,.2f}', total) || ' in ' || support || ' transfers.'
  WHEN link_type = 'RECURRING_BENEFICIARY' THEN 'Both paid one beneficiary, as did ' || support || ' payers in all.'
  WHEN link_type = 'TEMPORAL_PROXIMITY' THEN 'Paid one account within an hour of each other, times: ' || support || '.'
  ELSE 'Both used one ' || lower(replace(link_type, 'SHARED_', '')) || '; users: ' || support || '.' END AS rationale
FROM (FROM pairs UNION ALL FROM stars) k LEFT JOIN sums s ON link_type = 'FUND_FLOW' AND s.a = k.a AND s.b = k.b""",
    "dump_contacts": _EV + "SELECT DISTINCT phone::VARCHAR AS owner, 'Name ' || imei AS name, imei::VARCHAR AS number FROM dev",
    "dump_devices": _EV + "SELECT phone::VARCHAR AS phone_number, lpad(min(imei)::VARCHAR, 15, '0') AS imei, 'android-' || (phone % 53) AS android_id, 'model ' || (phone % 7) AS model FROM dev GROUP BY phone",
    "dump_messages": _EV
    + """SELECT 'dump-' || phone AS path, 'SMS' AS event_type, (CASE WHEN event_id % 3 = 0 THEN phone ELSE imei END)::VARCHAR AS src, (CASE WHEN event_id % 3 = 0 THEN imei ELSE phone END)::VARCHAR AS dst,
  date_trunc('second', ts) - INTERVAL 330 MINUTE AS occurred_at FROM dev""",
    "plugin_kinds": _EV + "SELECT DISTINCT src AS file_id, CASE src % 4 WHEN 0 THEN 'CDR' WHEN 1 THEN 'LOCAL_CDR' WHEN 2 THEN 'BANK' ELSE 'UPI' END AS kind FROM tr",
    "plugin_mapping": _EV
    + "SELECT file_id, s AS source, f AS field FROM (SELECT DISTINCT src AS file_id FROM tr WHERE src % 4 = 1), (VALUES ('MSISDN', 'caller'), ('Dialed Number', 'callee'), ('Start Time', 'start_time')) t(s, f)",
    "exported_register": evidence.SQL["evidence_inventory"],
    "exported_audit": evidence.SQL["audit_chain"],
    "exported_graph": _EV
    + """, f AS (SELECT src, dst, count(*) AS n FROM tr GROUP BY src, dst), o AS (SELECT src AS node, count(*) AS flows, sum(n)::BIGINT AS transfers FROM f GROUP BY src)
SELECT node, flows, transfers FROM (SELECT src AS node FROM f UNION SELECT dst FROM f) LEFT JOIN o USING (node)""",
    "normalized_handles": _EV
    + """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'IMSI' WHEN 1 THEN 'UPI_HANDLE' ELSE 'PERSON' END AS entity_type,
  CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 1 THEN '40445' || lpad(src::VARCHAR, 10, '0') END WHEN 1 THEN 'user' || src || '@okbank' ELSE 'Name ' || src END AS normalized FROM ev""",
    "overridden_features": flows._FRAME
    + """SELECT entity, CASE WHEN entity % 10 = 4 THEN 7 ELSE 365 END AS account_age_days, CASE WHEN entity % 20 = 4 THEN 99 ELSE coalesce(fin.most, 0) END AS fan_in_count, 0 AS sim_switch_count
FROM flowed LEFT JOIN fin USING (entity)""",
}
