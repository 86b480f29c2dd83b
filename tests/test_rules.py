"""Micro fixtures with known values: flows, rules, graph metrics, anomaly invariants, chains, ingest, sources."""

import datetime as dt
import json
import zipfile

import hashlib

import pytest
from pyspark.sql import functions as F

from caseweave import config
from caseweave.functions import normalize, parsing
from caseweave.operators import anomaly, cases, features, graph, ingest, integrity, links, mapping, rules, windows
from caseweave.sources import files
from caseweave.streaming.fan import fan_in_stream

T0 = dt.datetime(2026, 3, 4, 4, 53)


def money(spark, pairs):
    data = [(k, T0 + dt.timedelta(minutes=m), "TRANSFER", a, b, float(x)) for k, (a, b, x, m) in enumerate(pairs)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, event_type string, src string, dst string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_pass_through_and_turnover(spark):
    t = money(spark, [("A", "B", 100000, 0), ("B", "C", 95000, 5)])
    b = features.node_flow(t).filter("entity = 'B'").first()
    assert (b.passthrough_ratio, b.turnover) == (0.95, 195000.0)
    w = windows.windowed_pass_through(t).filter("account = 'B'").first()
    assert w.ratio == 0.95
    assert windows.layering_chains(t).filter("account = 'A'").first().depth == 2


def extreme(spark, **values):
    row = features.DEFAULTS | values
    kinds = {k: "double" for k in row}
    return spark.createDataFrame([("x", *map(float, row.values()))], "entity string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


def test_all_rules_fire_and_cap(spark):
    f = extreme(
        spark, passthrough_ratio=1, fan_in_count=99, fan_out_count=99, layering_depth=6, sim_switch_count=9, device_share_count=9, account_age_days=1, turnover=9e6,
        has_cash_out=1, has_spoofed_header=1, odd_hour_txn_count=50, has_call_then_transfer=1, betweenness_centrality=0.5,
    )
    s = rules.scored(f).first()
    assert (s.score, s.band) == (100.0, "CRITICAL")
    r = rules.reasons(f).collect()
    assert len(r) == 12 and all(x.triggered for x in r) and sum(x.points for x in r) == 131


def test_clean_account_is_low(spark):
    f = extreme(spark)
    assert tuple(rules.scored(f).select("score", "band").first()) == (0.0, "LOW")
    assert rules.reasons(f).filter("triggered = 1").count() == 0


@pytest.mark.parametrize("code", list(config.RULES))
def test_each_rule_at_its_threshold(spark, code):
    value, setting, *_ = rules.MEASURES[code]
    least = config.RULES[code][setting]
    more = {"account_age_days": 5} if code == "R07" else {}
    just = least + 1 if code == "R07" else least
    assert rules.scored(extreme(spark, **{value: just}, **more)).first().rules_fired == code
    assert rules.scored(extreme(spark, **{value: least - 0.01}, **more)).first().rules_fired == ""


def test_config_overrides_are_checked():
    assert config.rules_with({"R02": {"threshold": 3.0}})["R02"]["threshold"] == 3.0
    assert config.rules_hash() != config.rules_hash(config.rules_with({"R02": {"threshold": 3.0}}))
    with pytest.raises(KeyError):
        config.rules_with({"R02": {"treshold": 3.0}})


def test_betweenness_by_joins_and_in_tasks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 24)}") for _ in range(90)], "src string, dst string")
    inside = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    few = {r.node: r.betweenness for r in graph.betweenness(edges, pivots=7).collect()}
    monkeypatch.setattr(graph, "DENSE_NODES", 0)
    assert {r.node: r.betweenness for r in graph.betweenness(edges).collect()} == pytest.approx(inside) and max(inside.values()) > 0
    assert {r.node: r.betweenness for r in graph.betweenness(edges, pivots=7).collect()} == pytest.approx(few)


def test_betweenness_of_the_frame_is_exact_beyond_5000_nodes(spark):
    """5,200 payers of two accounts, which pay a third: half of all paths from payers lead over each."""
    n = 5_200
    edges = spark.range(n).select((F.col("id") + 10).alias("src"), (F.col("id") % 2).alias("dst")).unionByName(spark.createDataFrame([(0, 2), (1, 2)], "src long, dst long"))
    got = {r.entity: r.betweenness_centrality for r in features.centrality(edges).filter("betweenness_centrality > 0").collect()}
    assert got == {k: round(n / 2 / ((n + 2) * (n + 1)), 8) for k in (0, 1)}


def test_rules_from_a_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"R02": {"threshold": 5}}')
    assert config.rules_from(str(path))["R02"]["threshold"] == 5
    for wrong in ("{", "[]", '{"R99": {"threshold": 1}}', '{"R02": 3}'):
        path.write_text(wrong)
        with pytest.raises((ValueError, KeyError)):
            config.rules_from(str(path))
    with pytest.raises(FileNotFoundError):
        config.rules_from(str(tmp_path / "gone.json"))


def test_betweenness_and_pagerank_on_a_line(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    b = dict(graph.betweenness(e).collect())
    assert b == {"a": 0.0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0.0}
    r = dict(graph.pagerank(e, tolerance=1e-10).collect())
    assert sum(r.values()) == pytest.approx(1) and r["a"] < r["b"] < r["c"] < r["d"]


def test_paths_cycles_components(spark):
    t = money(spark, [("v", "m", 100, 0), ("m", "n", 96, 4), ("n", "z", 90, 11), ("n", "m", 1, 12), ("p", "q", 1, 0)])
    p = graph.paths(t, spark.createDataFrame([("v",)], "node string"), spark.createDataFrame([("z",)], "node string"), timed=True).collect()
    assert [(x.hops, x.path, x.total, x.minutes) for x in p] == [(3, ["v", "m", "n", "z"], 286.0, 11.0)]
    assert [x.cycle for x in graph.cycles(t).collect()] == [["m", "n"]]
    assert graph.components(t).select("component").distinct().count() == 2
    assert dict(graph.reach(t).collect())["v"] == 3


def test_anomaly_invariants(spark):
    rows = [(f"e{k}", *[float((k * 7 + j) % 5) for j in range(12)], 0.0) for k in range(60)] + [("odd", *[99.0] * 13)]
    f = spark.createDataFrame(rows, "entity string, " + ", ".join(f"{c} double" for c in anomaly.FEATURES))
    a = anomaly.isolation_scores(f, trees=20).collect()
    assert sorted(x.anomaly_rank for x in a) == list(range(1, 62))
    assert next(x for x in a if x.entity == "odd").anomaly_rank == 1
    again = anomaly.isolation_scores(f.repartition(7), trees=20).collect()
    assert {x.entity: x.anomaly_score for x in a} == pytest.approx({x.entity: x.anomaly_score for x in again})
    assert anomaly.isolation_scores(f.limit(10)).filter("anomaly_score is not null").count() == 0


def entries(spark, n=5):
    rows = [("c", k, f"2026-03-04T04:5{k}:00Z", "B-17", f"act{k}", "file" if k % 2 else None, f"f{k}" if k % 2 else None) for k in range(n)]
    return spark.createDataFrame(rows, "case_id string, seq int, occurred_at string, officer_badge string, action string, target_type string, target_id string")


def test_audit_mutations(spark):
    made = integrity.hashed_entries(entries(spark), {"a": F.col("action")})
    chain = integrity.chained(made).cache()
    check = lambda c: integrity.verified(c, {"a": F.col("action")}).first()
    assert check(chain).ok
    for column in ("action", "occurred_at", "officer_badge", "target_id", "payload_hash", "entry_hash", "prev_hash"):
        assert check(chain.withColumn(column, F.when(F.col("seq") == 2, "x").otherwise(F.col(column)))).first_bad_seq == 2
    assert check(chain.filter("seq <> 3")).first_bad_seq == 4
    swapped = chain.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")))
    assert check(swapped).first_bad_seq == 1
    more = integrity.chained(made.filter("seq > 2"), integrity.heads(chain.filter("seq <= 2")))
    assert more.filter("seq = 4").first().entry_hash == chain.filter("seq = 4").first().entry_hash


def test_audit_hash_of_eight_fields(spark):
    """The entry hash joins the previous hash, six fields and the payload's hash with unit separators, nulls as empty."""
    chain = integrity.chained(integrity.hashed_entries(entries(spark), {"note": F.lit("né"), "action": F.col("action")})).orderBy("seq").collect()
    prev = "0" * 64
    for r in chain:
        payload = hashlib.sha256(('{"action":"' + r.action + '","note":"né"}').encode()).hexdigest()
        parts = [prev, str(r.seq), r.occurred_at, r.officer_badge, r.action, r.target_type or "", r.target_id or "", payload]
        assert (r.payload_hash, r.prev_hash) == (payload, prev)
        prev = hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
        assert r.entry_hash == prev


def test_normalisers(spark):
    one = lambda f, x: spark.range(1).select(f(F.lit(x))).first()[0]
    assert {one(normalize.phone, x) for x in ("9876543210", "09876543210", "919876543210", "+91 98765-43210")} == {"+919876543210"}
    assert one(normalize.bank_account, "HDFC0001001001") != one(normalize.bank_account, "SBI0001001001")
    assert one(normalize.upi, " Mule1@YBL ") == "mule1@ybl"
    assert one(normalize.mac, "AA-BB-CC-00-11-22") == "aa:bb:cc:00:11:22"
    assert one(normalize.email, "Ab@X.COM") == "Ab@x.com"
    assert one(normalize.ip_prefix, "10.001.2.3") == "10.1.2.0/24"
    assert one(normalize.ip_prefix, "2001:0db8:0:1:0:0:0:5") == "2001:db8:0:1::/64"
    assert [one(normalize.classified, x) for x in ("351234567890001", "a@ybl", "a@b.com", "1.2.3.4", "9876543210", "123456789")] == ["IMEI", "UPI_HANDLE", "EMAIL", "IP", "PHONE", "BANK_ACCOUNT"]
    assert [str(one(parsing.amount, x)) for x in ("Rs. 480", "-50", "Rs. 1,234.50", "₹7", "n/a")] == ["480.00", "-50.00", "1234.50", "7.00", "None"]


def test_mapping_and_detection(spark):
    f = spark.createDataFrame(
        [("a", ["A Party No", "B Party No", "Call Date", "Duration", "IMEI", "Cell ID"], ""), ("b", ["x"], "Received: from y"), ("c", ["@"], "pay to me@okbank now"), ("d", ["a-party", "a party"], "")],
        "file_id string, headers array<string>, head string",
    )
    assert dict(mapping.detected(f).collect()) == {"a": "CDR", "b": "EML", "c": "UPI", "d": "UNKNOWN"}
    h = spark.createDataFrame([("a", "CDR", x, k) for k, x in enumerate(["A Party No", "Called No", "Start Time", "Durations", "Zebra"])], "file_id string, kind string, source string, place int")
    got = {r.source: (r.field, r["class"]) for r in mapping.proposed(h).collect()}
    assert got["A Party No"] == ("caller", "High") and got["Called No"] == ("callee", "High") and got["Durations"][0] == "duration_s" and "Zebra" not in got
    kinds = spark.createDataFrame([("a", "CDR")], "file_id string, kind string")
    assert mapping.missing_fields(kinds, mapping.proposed(h)).first().missing == []


def test_delimited_rows_and_ingest(spark, tmp_path):
    (tmp_path / "cdr.csv").write_text('﻿Caller,Callee,Start Time,Note\n98765 43210,09876543211,04/03/2026 10:23:00,"a, b"\nx,y\n9876543210,9876543212,soon,z\n', encoding="utf-8")
    rows = files.delimited(spark, str(tmp_path / "cdr.csv"))
    got = {r.source_row: (r.reason, r.cells[-1]) for r in rows.collect()}
    assert got == {2: (None, "a, b"), 3: ("missing cells", "y"), 4: (None, "z")}
    named = rows.filter("reason is null").select(F.lit("f").alias("evidence_file_id"), "source_row", F.lit("s").alias("source_sha256"), "raw_line", files.cell("Caller").alias("caller"), files.cell("Callee").alias("callee"), files.cell("Start Time").alias("start_time"))
    out = ingest.events(named, "CDR")
    e = ingest.good(out).first()
    assert (e.src, e.dst, str(e.occurred_at)) == ("+919876543210", "+919876543211", "2026-03-04 04:53:00")
    assert [tuple(r) for r in ingest.rejects(out).collect()] == [("f", 4, "unreadable time", "9876543210,9876543212,soon,z")]
    # no provenance, no event
    assert ingest.good(ingest.events(named.withColumn("source_sha256", F.lit(None).cast("string")), "CDR")).count() == 0


def test_workbook_mail_and_dump(spark, tmp_path):
    book = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Amount</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>12.5</v></c></row></sheetData></worksheet>')
    assert [(r.source_row, r.cells) for r in files.workbooks(spark, str(book)).collect()] == [(2, ["12.5"])]
    (tmp_path / "m.eml").write_text("From: Bank <help@bank.com>\nReturn-Path: <x@evil.net>\nReceived: a\nReceived: b\nAuthentication-Results: mx;\n spf=fail dkim=pass dmarc=none\n\nhello\n")
    m = files.mails(spark, str(tmp_path / "m.eml")).first()
    assert (m.sender, m.return_path, m.spf, m.dkim, m.hops, m.spoofed) == ("help@bank.com", "x@evil.net", "fail", "pass", 2, True)
    (tmp_path / "d.json").write_text(json.dumps({"device_info": {"phone_number": "1", "imei": "2"}, "call_log": [{"number": "9", "type": "INCOMING", "date": "04/03/2026 10:23:00", "duration": 5}], "sms_messages": [{"from": "8", "to": "1", "date": "04/03/2026 10:24:00", "body": "x"}]}))
    e = files.phone_dumps(spark, str(tmp_path / "d.json"))["events"].orderBy("occurred_at").collect()
    assert [(x.event_type, x.src, x.dst) for x in e] == [("CALL", "9", "1"), ("SMS", "8", "1")]
    inv = {r.path.rsplit("/", 1)[1]: r.problem for r in files.inventory(spark, str(tmp_path), most=400).collect()}
    assert inv["m.eml"] is None and inv["b.xlsx"] == "TOO_LARGE"


def test_entity_upsert_keeps_role(spark):
    old = spark.createDataFrame([("c", "PHONE", "+919876543210", 1, "9876543210", "SUSPECT", T0, T0)], "case_id string, entity_type string, normalized string, occurrences long, raw string, role string, first_seen timestamp, last_seen timestamp")
    new = old.select("case_id", "entity_type", "normalized", "occurrences", F.lit("09876543210").alias("raw"), F.lit("UNKNOWN").alias("role"), (F.col("first_seen") + F.expr("interval 1 day")).alias("first_seen"), (F.col("last_seen") + F.expr("interval 1 day")).alias("last_seen"))
    m = ingest.upserted_entities(old, new).first()
    assert (m.occurrences, m.role, m.raw, m.last_seen) == (2, "SUSPECT", "9876543210", T0 + dt.timedelta(days=1))


def test_links_and_corroboration(spark):
    use = spark.createDataFrame([("p1", "i1", T0), ("p2", "i1", T0), ("p3", "i2", T0)], "phone string, imei string, ts timestamp")
    strong = links.shared_attribute(use, "phone", "imei", "SHARED_IMEI")
    assert [(r.a, r.b, r.support) for r in strong.collect()] == [("p1", "p2", 2)]
    weak = strong.withColumn("link_type", F.lit("TEMPORAL_PROXIMITY")).withColumn("confidence", F.lit(0.35))
    assert links.surfaced(weak).count() == 0
    assert links.surfaced(weak.unionByName(strong)).count() == 2
    assert links.rationale(strong).first().rationale.startswith("Both used one imei")


def test_classes_have_no_user_bound(spark):
    uses = spark.createDataFrame([(p, i, T0) for i, n in ((1, 60), (2, 3), (3, 1)) for p in range(100 * i % 300, 100 * i % 300 + n)] + [(110, 2, T0)], "phone long, imei long, ts timestamp")
    rows = uses.collect()
    brute = {(x.phone, y.phone) for x in rows for y in rows if x.imei == y.imei and x.phone < y.phone}
    classes = links.shared_classes(uses, "phone", "imei", "SHARED_IMEI")
    got = classes.collect()
    assert {(x.entity, y.entity) for x in got for y in got if x.value == y.value and x.entity < y.entity} == brute
    assert {(r.value, r.users, r.smallest) for r in got} == {("1", 60, 100), ("2", 4, 110)} and len(got) == 64
    weak = spark.createDataFrame([(100, 159, 1), (101, 110, 1), (105, 200, 1), (900, 901, 1)], "a long, b long, support long")
    weak = links._linked(weak, "TEMPORAL_PROXIMITY")
    dismissed = spark.createDataFrame([(100, 159, "SHARED_IMEI")], "a long, b long, link_type string")
    pairs = lambda df: {(r.a, r.b) for r in df.filter("link_type = 'TEMPORAL_PROXIMITY'").collect()}
    assert pairs(links.surfaced_classes(weak, classes)) == {(100, 159), (101, 110)}
    assert pairs(links.surfaced_classes(weak, classes, dismissed)) == {(101, 110)}
    counts = {(r.entity, r.value): r.others for r in cases.neighbour_counts(weak, classes).collect()}
    assert counts[(100, "1")] == 59 and counts[(110, "2")] == 3 and counts[(900, None)] == 1


def test_fan_in_stream(spark, tmp_path):
    money(spark, [(f"s{k}", "hub", 1, k) for k in range(9)] + [("s0", "hub", 1, 900)]).select("src", "dst", "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, dst string, ts timestamp").parquet(str(tmp_path / "in"))
    q = fan_in_stream(stream).writeStream.format("memory").queryName("fan").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fan").filter("account = 'hub' and sources >= 8").count() > 0


def test_missing_features_get_defaults(spark):
    t = money(spark, [("A", "B", 10, 0)])
    f = features.feature_frame(t, overrides=spark.createDataFrame([("A", 3)], "entity string, account_age_days int")).orderBy("entity").collect()
    assert [x.account_age_days for x in f] == [3, 365] and f[0].betweenness_centrality == 0.0


def test_delimited_edge_cases(spark, tmp_path):
    """Empty first cell, quoted separators, quotes and line breaks, Latin-1, byte order mark, blank lines, missing cells."""
    (tmp_path / "a.csv").write_bytes("\ufeffx,y,z\n,b,c\n\"1,2\",\"say \"\"hi\"\"\",\"two\nlines\"\n\nq,r\n a , ,\n".encode())
    (tmp_path / "b.csv").write_bytes("name,town\nJosé,Köln\n".encode("latin-1"))
    rows = files.delimited(spark, str(tmp_path)).collect()
    a = {r.source_row: r for r in rows if r.path.endswith("a.csv")}
    assert a[2].headers == ["x", "y", "z"] and a[2].cells == ["", "b", "c"] and a[2].reason is None
    assert a[3].cells == ["1,2", 'say "hi"', "two\nlines"] and a[6].reason == "missing cells" and a[7].cells == ["a", "", ""]
    (b,) = [r for r in rows if r.path.endswith("b.csv")]
    assert b.cells == ["José", "Köln"]


def test_workbook_sheet_order_and_dates(spark, tmp_path):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda body: f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" sheetId="2" r:id="rId2"/><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row><c r="A1"><v>wrong</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row><c r="A1" t="inlineStr"><is><t>when</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" s="1"><v>46085.5</v></c><c r="B2"><v>7</v></c></row>'))
    (row,) = files.workbooks(spark, str(tmp_path)).collect()
    assert row.headers == ["when", "n"] and row.cells == ["2026-03-04 12:00:00", "7"]


def test_file_problems(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "big.csv").write_text("x" * 100)
    (tmp_path / "bin.csv").write_bytes(b"\x00\x01")
    wanted = spark.createDataFrame([(f"{n}.csv",) for n in ("ok", "empty", "big", "bin", "gone")], "name string")
    got = {r.name: r.problem for r in files.problems(spark, str(tmp_path), wanted, most=50).collect()}
    assert got == {"ok.csv": None, "empty.csv": "EMPTY", "big.csv": "TOO_LARGE", "bin.csv": "CORRUPT", "gone.csv": "MISSING"}


@pytest.mark.parametrize(
    "value,kind",
    [
        ("351234567890001", "IMEI"), ("35-123456-789000-1", "IMEI"), ("mule1@ybl", "UPI_HANDLE"), ("a+b@ybl", "UPI_HANDLE"), ("a@b.co", "EMAIL"), ("10.0.0.1", "IP"), ("+91 98765 43210", "PHONE"),
        ("9876543210", "PHONE"), ("1234567890123", "UNKNOWN"), ("123456789", "BANK_ACCOUNT"), ("123456789012345678", "BANK_ACCOUNT"), ("", "UNKNOWN"), ("hello", "UNKNOWN"),
    ],
)
def test_classification(spark, value, kind):
    assert spark.createDataFrame([(value,)], "v string").select(normalize.classified(F.col("v"))).first()[0] == kind


def test_ip_forms_and_uuids(spark):
    import ipaddress
    import uuid

    ips = ["2001:0DB8::0001", "::", "::1", "fe80:0:0:0:0:0:0:1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "1::2:0:0:3:4", "010.001.000.255"]
    rows = spark.createDataFrame([(x,) for x in [*ips, "1:2", "g::1", "::1::", None, "12345::"]], "v string").select("v", normalize.ip(F.col("v")).alias("ip"), normalize.ip_prefix(F.col("v")).alias("net")).collect()
    for r in rows:
        if r.v in ips and ":" in r.v:
            assert r.ip == str(ipaddress.ip_address(r.v))
            assert r.net == str(ipaddress.ip_network(f"{r.v}/64", strict=False))
        elif r.v in ips:
            assert (r.ip, r.net) == ("10.1.0.255", "10.1.0.0/24")
        else:
            assert r.net is None
    one = spark.createDataFrame([("c", "PHONE", "+91é")], "c string, t string, n string").select(normalize.entity_uuid(F.col("c"), F.col("t"), F.col("n"))).first()[0]
    assert one == str(uuid.uuid5(uuid.NAMESPACE_DNS, "c:PHONE:+91é"))


def test_fuzzy_mapping_against_brute_force(spark):
    heads = ["Callr Number", "amnt", "IMEI Number", "Time of Start", "zzz"]
    rows = spark.createDataFrame([("f", "CDR", h, k) for k, h in enumerate(heads)], "file_id string, kind string, source string, place int")
    got = {r.source: (r.field, round(r.confidence, 6)) for r in mapping.proposed(rows).collect()}
    from caseweave.config import CANONICAL_FIELDS

    def ratio(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        import functools

        @functools.cache
        def common(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + common(i + 1, j + 1) if a[i] == b[j] else max(common(i + 1, j), common(i, j + 1))

        return 2 * common(0, 0) / (len(a) + len(b))

    best = {}
    for k, h in enumerate(heads):
        score, field = max((ratio(h.lower(), f.replace("_", " ")), [-ord(c) for c in f], f) for f in CANONICAL_FIELDS)[::2]
        if score >= 0.6:
            best.setdefault(field, []).append((-score, k, h))
    want = {min(v)[2]: (f, round(-min(v)[0], 6)) for f, v in best.items()}
    assert got == want and want


def test_bulk_load_and_scan(spark, tmp_path):
    frame = lambda *cases: spark.createDataFrame([(c, k) for k, c in enumerate(cases)], "case_id string, x int")
    files.bulk_load(frame("a", "b"), frame("a"), frame("b"), str(tmp_path / "t"), "run-1")
    files.bulk_load(frame("a"), frame("b"), frame("b"), str(tmp_path / "t"), "run-2")
    assert files.scan_case(spark, str(tmp_path / "t/events"), "a").count() == 2 and files.scan_case(spark, str(tmp_path / "t/rejects"), "b").count() == 2


def test_numbers_over_ranges(spark):
    from caseweave.operators.ranking import numbered

    rows = spark.range(500).select((F.col("id") % 7).alias("s"), F.col("id").alias("k")).repartition(5)
    got = numbered(rows, [F.desc("s"), F.col("k")], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (-r.s, r.k))] == list(range(1, 501))


def test_distinct_in_window_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.randint(0, 6), 1_700_000_000 + rng.randint(0, 40) * 600) for _ in range(200)]
    frame = spark.createDataFrame(rows, "k int, o int, s long").select("k", "o", F.timestamp_seconds("s").alias("ts"))
    got = {r.k: r.most for r in windows.distinct_in_window(frame, "k", "o", "ts", "2 hours").collect()}
    want = {k: max(len({o for q, o, t in rows if q == k and s - 7200 <= t <= s}) for p, _, s in rows if p == k) for k in range(4)}
    assert got == want
