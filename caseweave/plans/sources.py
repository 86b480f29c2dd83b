"""Queries that write evidence files from the tables, read them back, map their headers and ingest them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.config import FORMATS
from caseweave.functions import normalize
from caseweave.operators import features, ingest, mapping
from caseweave.operators.adapter import EVENTS_SQL, device_events, events, mail_texts, sessions, table, transfers
from caseweave.operators.checkpoints import shared_folder
from caseweave.plans._plain import plain
from caseweave.sources import files


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/caseweave/{name}-{uuid.uuid4().hex}"


def _as_files(rows: DataFrame, head: str, name: str) -> str:
    """rows (f, k, value) as a text file for each f, its header line first; where they are."""
    path = _place(rows.sparkSession, name)
    first = rows.select("f").distinct().select("f", F.lit(-1).cast("long").alias("k"), F.lit(head).alias("value"))
    every = first.unionByName(rows.select("f", F.col("k").cast("long").alias("k"), "value"))
    every.repartition("f").sortWithinPartitions("f", "k").select("f", "value").write.partitionBy("f").text(path)
    return f"{path}/*/*.txt"


def _bank_files(spark, sf_dir) -> DataFrame:
    """Bank sheets of five files: quoted amounts, a line break in some narrations, an empty first cell, a cell too many."""
    e = transfers(spark, sf_dir)
    time = F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "dd/MM/yyyy HH:mm:ss")
    money = F.concat(F.lit('"'), F.format_number(F.col("amount").cast("double"), 2), F.lit('"'))
    said = F.when(F.col("event_id") % 10 == 0, F.lit('"one ""quoted""\nword, two"')).otherwise(F.lit("rent"))
    cells = [F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(time), F.concat(F.lit("HDFC"), F.col("src").cast("string")), F.concat(F.lit("SBI"), F.col("dst").cast("string")), money, said]
    line = F.concat_ws(",", *cells, F.when(F.col("event_id") % 19 == 0, F.lit("more")))
    rows = e.select((F.col("event_id") % 5).alias("f"), F.col("event_id").alias("k"), line.alias("value"))
    path = _as_files(rows, "Txn Date,Account No,Beneficiary Account,Amount,Narration", "bank")
    return files.delimited(spark, path).withColumn("file", F.regexp_extract("path", "f=([0-9]+)", 1).cast("int"))


def evidence_files(spark, sf_dir):
    """The documents of each source as one text file: size, digests and kind of the files."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and source is not null")
    line = F.regexp_replace("text", "\\r?\\n", " ")
    path = _as_files(docs.select(F.col("source").alias("f"), F.col("doc_id").alias("k"), line.alias("value")), "Txn Date,Account No,Narration", "register")
    found = files.register(spark, path.rsplit("/", 2)[0])
    return found.select(F.regexp_extract("path", "f=([^/]+)/", 1).alias("source"), "size_bytes", "sha256", "md5", "kind")


def delimited_rows(spark, sf_dir):
    cells = [F.try_element_at("cells", F.lit(k + 1)).alias(n) for k, n in enumerate(("date", "debit", "credit", "amount", "narration"))]
    return _bank_files(spark, sf_dir).select("file", "source_row", F.size("cells").alias("n_cells"), "reason", *cells)


def delimited_events(spark, sf_dir):
    """The sheets mapped by their headers and ingested."""
    rows = _bank_files(spark, sf_dir).filter("reason is null")
    named = {"Txn Date": "d", "Account No": "a", "Beneficiary Account": "b", "Amount": "m"}
    flat = rows.select(F.lit("case-1").alias("case_id"), F.col("file").cast("string").alias("evidence_file_id"), "source_row", F.sha2("raw_line", 256).alias("source_sha256"), "raw_line", *[files.cell(h).alias(h) for h in named])
    made = ingest.events(ingest.mapped(flat, {"txn_time": "Txn Date", "debit_account": "Account No", "credit_account": "Beneficiary Account", "amount": "Amount"}), "BANK")
    return plain(made.select("evidence_file_id", "source_row", "src", "dst", "amount", "occurred_at", "reason"))


def _layouts(spark, sf_dir) -> DataFrame:
    """file_id, kind, source, place: the headers of an evidence file for each account, in one of four layouts."""
    own = transfers(spark, sf_dir).select(F.col("src").alias("file_id")).distinct()
    layouts = [
        ("CDR", ["A Party No", "B Party No", "Call Date", "Duration", "IMEI", "IMSI", "Cell ID", "Call Type"]),
        ("CDR", ["MSISDN", "Dialed Number", "Start Time", "Dur(s)", "Equipment ID", "SIM ID", "First CGI", "Type", "ANI"]),
        ("BANK", ["Txn Date", "Account No", "Beneficiary Account", "Amount", "Dr/Cr", "Reference No", "Balance", "Channel", "Value Date"]),
        ("UPI", ["Settlement Date", "Payer VPA", "Payee VPA", "Txn Amount", "UTR", "Senders Email"]),
    ]
    pick = (F.col("file_id") % 4).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in layouts]), pick + 1)
    heads = F.element_at(F.array(*[F.array(*map(F.lit, h)) for _, h in layouts]), pick + 1)
    return own.select("file_id", kind.alias("kind"), F.posexplode(heads).alias("place", "source"))


def _with_heads(spark, sf_dir) -> DataFrame:
    h = _layouts(spark, sf_dir)
    return h.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("headers"), F.first("kind").alias("kind"))


def detected_kinds(spark, sf_dir):
    """Kinds by content: by headers, else by what stands in the first lines."""
    head = F.when(F.col("file_id") % 8 == 5, "Received: from x").when(F.col("file_id") % 8 == 6, '{"device_info": {}}').otherwise("no marks here")
    known = F.when(F.col("file_id") % 8 == 7, F.array(F.lit("x"))).otherwise(F.col("headers"))
    rows = _with_heads(spark, sf_dir).select("file_id", known.alias("headers"), head.alias("head"))
    return mapping.detected(rows)


def header_signatures(spark, sf_dir):
    return _with_heads(spark, sf_dir).select("file_id", mapping.signature(F.col("headers")).alias("signature"))


def alias_mapping(spark, sf_dir):
    return mapping.by_alias(_layouts(spark, sf_dir))


def proposed_mapping(spark, sf_dir):
    """Aliases, then similarity; with its class and whether it counts as confirmed."""
    made = mapping.proposed(_layouts(spark, sf_dir))
    said = made.filter("confidence < 1 and file_id % 2 = 1").select("file_id", "source", "field")
    return mapping.confirmed(made, said).select("file_id", "source", "field", F.round("confidence", 4).alias("confidence"), "class", "is_confirmed")


def mapping_conflicts(spark, sf_dir):
    return mapping.conflicts(mapping.claims(_layouts(spark, sf_dir)))


def missing_fields(spark, sf_dir):
    """Required fields that no header gives, after the first header of every third file was lost."""
    h = _layouts(spark, sf_dir).filter("not (file_id % 3 = 0 and place = 0)")
    return mapping.missing_fields(h.select("file_id", "kind").distinct(), mapping.by_alias(h)).select("file_id", F.array_join("missing", ",").alias("missing"))


def remembered_mapping(spark, sf_dir):
    """Layouts confirmed for accounts below ten, found again by their signature."""
    h = _layouts(spark, sf_dir)
    signed = h.groupBy("file_id").agg(mapping.signature(F.collect_list("source")).alias("signature"))
    saved = mapping.by_alias(h.filter("file_id < 10")).join(signed, "file_id").select("signature", "source", "field").distinct()
    return mapping.remembered(h, saved)


def parsed_mails(spark, sf_dir):
    return files.parsed_mails(mail_texts(spark, sf_dir)).select("path", "sender", "recipient", "spf", "dkim", "hops", "lookalike", "spoofed")


def _dumps(spark, sf_dir) -> dict[str, DataFrame]:
    """A phone dump for each phone, as JSON text, read back."""
    uses = device_events(spark, sf_dir)
    call = F.struct(
        F.col("imei").cast("string").alias("number"),
        F.when(F.col("event_id") % 2 == 0, "OUTGOING").otherwise("INCOMING").alias("type"),
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("date"),
        (F.col("event_id") % 600).cast("int").alias("duration"),
    )
    app = F.struct(F.concat(F.lit("app."), (F.col("phone") % 9).cast("string")).alias("package"), F.sha2((F.col("phone") % 9).cast("string"), 256).alias("certificate_sha256"), F.array(F.lit("READ_SMS")).alias("risky_permissions"))
    kit = F.struct(F.concat(F.lit("kit"), (F.col("phone") % 4).cast("string"), F.lit(".apk")).alias("filename"), F.sha2(F.concat(F.lit("kit"), (F.col("phone") % 4).cast("string")), 256).alias("sha256"), F.array(F.lit("http://a"), F.lit("http://b")).alias("embedded_urls"))
    one = uses.groupBy("phone").agg(F.to_json(F.struct(
        F.struct(F.col("phone").cast("string").alias("phone_number")).alias("device_info"),
        F.collect_list(call).alias("call_log"),
        F.collect_set(app).alias("installed_apps"),
        F.collect_set(kit).alias("apk_artifacts"),
    )).alias("value"))
    path = _place(spark, "dumps")
    one.select("value").write.text(path)
    raw = spark.read.schema(files.PHONE_DUMP).json(path)
    return files.flattened_dumps(raw.withColumn("path", F.concat(F.lit("dump-"), F.col("device_info.phone_number"))))


def dump_events(spark, sf_dir):
    return _dumps(spark, sf_dir)["events"].select("path", "event_type", "src", "dst", "occurred_at", "duration_sec")


def dump_apps(spark, sf_dir):
    d = _dumps(spark, sf_dir)
    apps = d["apps"].select("owner", F.col("package").alias("name"), F.col("certificate_sha256").alias("sha256"), F.col("risky_permissions").alias("n"))
    return apps.unionByName(d["artifacts"].select("owner", F.col("filename").alias("name"), "sha256", F.col("urls").alias("n")))


def session_events(spark, sf_dir):
    """IP session records through a file, their headers and ingest."""
    s = sessions(spark, sf_dir)
    at = F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws(",", F.concat(F.lit("98"), F.lpad(F.col("phone").cast("string"), 8, "0")), at, "ip", "mac", (F.col("event_id") % 900).cast("string"))
    path = _as_files(s.select((F.col("event_id") % 3).alias("f"), F.col("event_id").alias("k"), line.alias("value")), "MSISDN,Start Time,IP Address,MAC Address,Data Uploaded (KB)", "ipdr")
    rows = files.delimited(spark, path).filter("reason is null")
    named = {"caller": "MSISDN", "start_time": "Start Time", "ip_address": "IP Address", "mac_address": "MAC Address", "bytes_up_kb": "Data Uploaded (KB)"}
    flat = rows.select(F.regexp_extract("path", "f=([0-9]+)", 1).alias("evidence_file_id"), "source_row", F.sha2("raw_line", 256).alias("source_sha256"), *[files.cell(h).alias(h) for h in named.values()])
    made = ingest.good(ingest.events(ingest.mapped(flat, named), "IPDR"))
    return made.select("evidence_file_id", "source_row", "event_type", "src", "occurred_at", "ip_address", normalize.mac(F.col("mac_address")).alias("mac_address"), F.col("bytes_up_kb").cast("int").alias("bytes_up_kb"))


def feature_csv(spark, sf_dir):
    """Precomputed features, written as CSV and scanned with a schema."""
    path = _place(spark, "features")
    files.export(plain(features.node_flow(transfers(spark, sf_dir))).select("entity", "in_count", "out_count", "turnover"), path)
    return spark.read.option("header", "true").schema("entity long, in_count long, out_count long, turnover double").csv(path)


def saved_runs(spark, sf_dir):
    """Flow counts saved in two runs by case, and one case of them scanned."""
    path = _place(spark, "runs")
    own = features.node_flow(transfers(spark, sf_dir)).select(F.concat(F.lit("case-"), (F.col("entity") % 3).cast("string")).alias("case_id"), "entity", "in_count")
    files.save_run(own, path, "run-1")
    files.save_run(own.withColumn("in_count", F.col("in_count") + 1), path, "run-2")
    return files.scan_case(spark, path, "case-1").select("case_id", "run_id", "entity", "in_count")


_ALIASES = ", ".join(f"('{k}', '{f}', '{a.replace(chr(39), chr(39) * 2)}')" for k, spec in FORMATS.items() for f, names in spec["columns"].items() for a in names)
_BASE = (
    "WITH "
    + EVENTS_SQL
    + rf""",
bk AS (
  SELECT event_id % 5 AS file, event_id, row_number() OVER w + 1 + coalesce(sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS source_row,
         CASE WHEN event_id % 17 = 0 THEN '' ELSE strftime(ts + INTERVAL 330 MINUTE, '%d/%m/%Y %H:%M:%S') END AS date, 'HDFC' || src AS debit, 'SBI' || dst AS credit,
         format('{{:,.2f}}', amount::DOUBLE) AS amount, amount AS number, ts, CASE WHEN event_id % 10 = 0 THEN 'one "quoted"' || chr(10) || 'word, two' ELSE 'rent' END AS narration
  FROM tr WINDOW w AS (PARTITION BY event_id % 5 ORDER BY event_id)),
fl AS (SELECT DISTINCT src AS file_id FROM tr),
lay AS (SELECT * FROM (VALUES
  (0, 'CDR', ['A Party No', 'B Party No', 'Call Date', 'Duration', 'IMEI', 'IMSI', 'Cell ID', 'Call Type']),
  (1, 'CDR', ['MSISDN', 'Dialed Number', 'Start Time', 'Dur(s)', 'Equipment ID', 'SIM ID', 'First CGI', 'Type', 'ANI']),
  (2, 'BANK', ['Txn Date', 'Account No', 'Beneficiary Account', 'Amount', 'Dr/Cr', 'Reference No', 'Balance', 'Channel', 'Value Date']),
  (3, 'UPI', ['Settlement Date', 'Payer VPA', 'Payee VPA', 'Txn Amount', 'UTR', 'Senders Email'])) t(m, kind, heads)),
hd AS (SELECT file_id, kind, unnest(heads) AS source, generate_subscripts(heads, 1) - 1 AS place FROM fl JOIN lay ON file_id % 4 = m),
norm AS (SELECT *, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS n FROM hd),
al AS (SELECT DISTINCT kind, field, trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) AS n FROM (VALUES {_ALIASES}) t(kind, field, a)),
claim AS (SELECT file_id, source, field, place FROM norm JOIN al USING (kind, n)),
sure AS (
  SELECT file_id, source, field FROM (SELECT *, row_number() OVER (PARTITION BY file_id, source ORDER BY field) AS q
    FROM (SELECT *, row_number() OVER (PARTITION BY file_id, field ORDER BY place) AS r FROM claim) WHERE r = 1) WHERE q = 1)
"""
)

QUERIES = {
    f.__name__: f
    for f in (
        evidence_files, delimited_rows, delimited_events, detected_kinds, header_signatures, alias_mapping, proposed_mapping, mapping_conflicts, missing_fields, remembered_mapping,
        parsed_mails, dump_events, dump_apps, session_events, feature_csv, saved_runs,
    )
}

SQL = {
    "evidence_files": """WITH f AS (SELECT source, 'Txn Date,Account No,Narration' || chr(10) || string_agg(regexp_replace(text, '\\r?\\n', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS body
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source)
SELECT source, strlen(body)::BIGINT AS size_bytes, sha256(body) AS sha256, md5(body) AS md5, 'BANK' AS kind FROM f""",
    "delimited_rows": _BASE
    + """SELECT file::INT AS file, source_row, CASE WHEN event_id % 19 = 0 THEN 6 ELSE 5 END AS n_cells, CASE WHEN event_id % 19 = 0 THEN 'surplus cells' END AS reason,
  date, debit, credit, amount, narration FROM bk""",
    "delimited_events": _BASE
    + """SELECT file::VARCHAR AS evidence_file_id, source_row, debit AS src, credit AS dst, number::DOUBLE AS amount, CASE WHEN event_id % 17 <> 0 THEN date_trunc('second', ts) END AS occurred_at,
  CASE WHEN event_id % 17 = 0 THEN 'no time' WHEN number < 0 THEN 'negative amount' END AS reason FROM bk WHERE event_id % 19 <> 0""",
    "detected_kinds": _BASE
    + "SELECT file_id, CASE WHEN file_id % 8 = 5 THEN 'EML' WHEN file_id % 8 = 6 THEN 'ANDROID_DUMP' WHEN file_id % 8 IN (1, 7) THEN 'UNKNOWN' ELSE kind END AS kind FROM fl JOIN lay ON file_id % 4 = m",
    "header_signatures": _BASE + "SELECT file_id, array_to_string(list_sort(list_transform(heads, lambda h: lower(trim(h)))), ',') AS signature FROM fl JOIN lay ON file_id % 4 = m",
    "alias_mapping": _BASE + "SELECT *, 1.0::DOUBLE AS confidence FROM sure",
    "mapping_conflicts": _BASE + "SELECT file_id, field, count(*) AS n FROM claim GROUP BY ALL HAVING count(*) > 1",
    "remembered_mapping": _BASE
    + """, known AS (SELECT DISTINCT file_id % 4 AS m, source, field FROM sure WHERE file_id < 10)
SELECT file_id, source, field, 1.0::DOUBLE AS confidence FROM fl JOIN known ON file_id % 4 = m""",
    "parsed_mails": _BASE
    + """SELECT 'mail-' || doc_id AS path, 'u' || s || '@bank.example' AS sender, 'u' || r || '@mail.example' AS recipient, CASE WHEN spf THEN 'fail' ELSE 'pass' END AS spf,
  CASE WHEN dkim THEN 'fail' ELSE 'pass' END AS dkim, 2 AS hops, lookalike, other OR spf OR dkim AS spoofed FROM ml""",
    "dump_events": _BASE
    + """SELECT 'dump-' || phone AS path, 'CALL' AS event_type, (CASE WHEN event_id % 2 = 0 THEN phone ELSE imei END)::VARCHAR AS src, (CASE WHEN event_id % 2 = 0 THEN imei ELSE phone END)::VARCHAR AS dst,
  date_trunc('second', ts) - INTERVAL 330 MINUTE AS occurred_at, (event_id % 600)::INT AS duration_sec FROM dev""",
    "dump_apps": _BASE
    + """SELECT DISTINCT phone::VARCHAR AS owner, 'app.' || (phone % 9) AS name, sha256((phone % 9)::VARCHAR) AS sha256, 1 AS n FROM dev
UNION ALL SELECT DISTINCT phone::VARCHAR, 'kit' || (phone % 4) || '.apk', sha256('kit' || (phone % 4)), 2 FROM dev""",
    "session_events": _BASE
    + """SELECT (event_id % 3)::VARCHAR AS evidence_file_id, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) + 1 AS source_row, 'DATA_SESSION' AS event_type, '+9198' || lpad(src::VARCHAR, 8, '0') AS src,
  date_trunc('second', ts) AS occurred_at, '10.' || (dst % 7) || '.' || (src % 25) || '.' || (event_id % 250) AS ip_address, 'aa:bb:cc:00:' || lpad((dst % 100)::VARCHAR, 2, '0') || ':0f' AS mac_address,
  (event_id % 900)::INT AS bytes_up_kb FROM ev WHERE event_type = 'LOGIN' AND dst IS NOT NULL""",
    "feature_csv": _BASE
    + """SELECT entity, count(*) FILTER (i = 1) AS in_count, count(*) FILTER (i = 0) AS out_count, round(sum(amount)::DOUBLE, 2) AS turnover
FROM (SELECT src AS entity, 0 AS i, amount FROM tr UNION ALL SELECT dst, 1, amount FROM tr) GROUP BY entity""",
    "saved_runs": _BASE
    + """, c AS (SELECT entity, count(*) FILTER (i = 1) AS n FROM (SELECT src AS entity, 0 AS i FROM tr UNION ALL SELECT dst, 1 FROM tr) WHERE entity % 3 = 1 GROUP BY entity)
SELECT 'case-1' AS case_id, 'run-1' AS run_id, entity, n AS in_count FROM c UNION ALL SELECT 'case-1', 'run-2', entity, n + 1 FROM c""",
}
_REQUIRED = ", ".join(f"('{k}', '{x}')" for k, spec in FORMATS.items() for x in spec["required"])
SQL["missing_fields"] = _BASE.replace("SELECT file_id, kind, unnest(heads) AS source, generate_subscripts(heads, 1) - 1 AS place FROM fl JOIN lay ON file_id % 4 = m", "SELECT * FROM (SELECT file_id, kind, unnest(heads) AS source, generate_subscripts(heads, 1) - 1 AS place FROM fl JOIN lay ON file_id % 4 = m) WHERE NOT (file_id % 3 = 0 AND place = 0)") + f""",
need AS (SELECT file_id, field FROM (SELECT DISTINCT file_id, kind FROM hd) JOIN (VALUES {_REQUIRED}) t(kind, field) USING (kind))
SELECT file_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT EXISTS (SELECT 1 FROM sure s WHERE s.file_id = need.file_id AND s.field = need.field)), '') AS missing FROM need GROUP BY file_id"""
