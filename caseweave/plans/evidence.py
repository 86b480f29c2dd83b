"""Queries over evidence: identifiers, normalisation, ingest, digests and audit chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions import normalize, parsing
from caseweave.operators import ingest, integrity
from caseweave.operators.adapter import EVENTS_SQL, device_events, events, table
from caseweave.operators.checkpoints import shared_folder
from caseweave.plans._plain import plain
from caseweave.sources import versioned


def text_identifiers(spark, sf_dir):
    found = normalize.text_identifiers(table(spark, sf_dir, "documents"))
    return found.groupBy("kind", "raw").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def classified_identifiers(spark, sf_dir):
    found = normalize.text_identifiers(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "raw", normalize.classified(F.col("raw")).alias("entity_type")).distinct()


def _raw_phones(spark, sf_dir) -> DataFrame:
    """Four ways of writing the number of a user, by event."""
    n = F.lpad(F.col("src").cast("string"), 8, "0")
    forms = [F.concat(F.lit("98"), n), F.concat(F.lit("098"), n), F.concat(F.lit("+91 98"), n), F.concat(F.lit("9198"), n)]
    pick = (F.col("event_id") % 4).cast("int")
    return events(spark, sf_dir).select("event_id", "ts", F.element_at(F.array(*forms), pick + 1).alias("raw"))


def normalized_phones(spark, sf_dir):
    return _raw_phones(spark, sf_dir).select("event_id", normalize.phone(F.col("raw")).alias("phone"))


def normalized_devices(spark, sf_dir):
    raw = F.concat(F.lit("35-1234-"), F.lpad(F.col("imei").cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("phone").cast("string"), 6, "0"))
    mac = F.concat(F.lit("AA-BB-CC-"), F.lpad(F.col("imsi").cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("imei") % 100).cast("string"), 2, "0"), F.lit("-0F"))
    rows = device_events(spark, sf_dir).select("event_id", raw.alias("r"), mac.alias("m"))
    return rows.select("event_id", normalize.imei(F.col("r")).alias("imei"), normalize.imei_ok(F.col("r")).alias("imei_luhn_ok"), normalize.imei_base(F.col("r")).alias("imei_base"), normalize.mac(F.col("m")).alias("mac"))


def ip_prefixes(spark, sf_dir):
    found = normalize.text_identifiers(table(spark, sf_dir, "documents")).filter("kind = 'IP'")
    return found.select("doc_id", "raw", normalize.ip(F.col("raw")).alias("ip"), normalize.ip_prefix(F.col("raw")).alias("net")).distinct()


def ipv6_prefixes(spark, sf_dir):
    """Addresses made of event numbers, written in long and short forms, and their /64."""
    low = F.lower(F.hex(F.col("event_id") % 4096))
    long = F.concat(F.lit("2001:0DB8:0000:00"), F.lpad(F.upper(F.hex(F.col("event_id") % 256)), 2, "0"), F.lit(":0000:0000:0000:"), F.lpad(F.upper(low), 4, "0"))
    short = F.concat(F.lit("2001:db8:0:"), F.lower(F.hex(F.col("event_id") % 256)), F.lit("::"), low)
    raw = F.when(F.col("event_id") % 2 == 0, long).otherwise(short)
    rows = events(spark, sf_dir).select("event_id", raw.alias("raw"))
    return rows.select("event_id", normalize.ip(F.col("raw")).alias("ip"), normalize.ip_prefix(F.col("raw")).alias("net"))


def entity_uuids(spark, sf_dir):
    own = ingest.entities(_mentions(spark, sf_dir, "true"))
    return own.select("normalized", normalize.entity_uuid(F.col("case_id"), F.col("entity_type"), F.col("normalized")).alias("id"))


def email_forms(spark, sf_dir):
    """Addresses in texts with their domain in lower case, and the domain."""
    found = normalize.text_identifiers(table(spark, sf_dir, "documents")).filter("kind = 'EMAIL'")
    return found.select("doc_id", normalize.email(F.col("raw")).alias("email"), normalize.email_domain(F.col("raw")).alias("domain")).distinct()


def parsed_times(spark, sf_dir):
    """Event times written in three ways and read back, from Indian time to UTC, with the number of readings."""
    t = F.col("ts")
    forms = [F.date_format(t, "dd/MM/yyyy HH:mm:ss"), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("soon")]
    rows = events(spark, sf_dir).select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 3 + 1).cast("int")).alias("raw"))
    patterns = ["dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    return rows.select("event_id", parsing.ist_to_utc(parsing.parsed_time(F.col("raw"), patterns)).alias("at"), parsing.readings(F.col("raw"), patterns).alias("readings"))


def parsed_amounts(spark, sf_dir):
    value = F.format_number(F.col("o_totalprice"), 2)
    forms = [F.concat(F.lit("Rs. "), value), F.concat(F.lit("-"), value), F.concat(F.lit("₹"), value), F.lit("n/a")]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("raw"))
    return plain(rows.select("o_orderkey", parsing.amount(F.col("raw")).alias("amount")))


def _rows(spark, sf_dir) -> DataFrame:
    """Bank rows as text, as an evidence file holds them; some without a readable time, some negative."""
    e = events(spark, sf_dir).filter("event_type in ('TRANSFER', 'UPI_TXN')")
    bad = F.when(F.col("event_id") % 50 == 0, F.lit("yesterday")).otherwise(F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "dd/MM/yyyy HH:mm:ss"))
    return e.select(
        F.lit("case-1").alias("case_id"),
        F.concat(F.lit("file-"), (F.col("event_id") % 5).cast("string")).alias("evidence_file_id"),
        F.col("event_id").alias("source_row"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("source_sha256"),
        bad.alias("txn_time"),
        F.concat(F.lit("HDFC"), F.lpad(F.col("src").cast("string"), 10, "0")).alias("debit_account"),
        F.concat(F.lit("SBI "), F.lpad(F.col("dst").cast("string"), 10, "0")).alias("credit_account"),
        F.when(F.col("event_id") % 70 == 1, F.concat(F.lit("-"), F.col("amount").cast("string"))).otherwise(F.concat(F.lit("Rs "), F.col("amount").cast("string"))).alias("amount"),
        F.when(F.col("event_id") % 9 == 0, "ATM").otherwise("NEFT").alias("channel"),
        F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("raw_line"),
    )


def ingested_events(spark, sf_dir):
    good = ingest.good(ingest.events(_rows(spark, sf_dir), "BANK"))
    return plain(good.select("source_row", "event_type", F.date_trunc("second", "occurred_at").alias("occurred_at"), "src", "dst", "amount"))


def ingest_rejects(spark, sf_dir):
    return ingest.reject_summary(ingest.events(_rows(spark, sf_dir), "BANK"))


def ingest_counts(spark, sf_dir):
    return ingest.row_counts(ingest.events(_rows(spark, sf_dir), "BANK"))


def ingest_quality(spark, sf_dir):
    return ingest.quality(ingest.events(_rows(spark, sf_dir), "BANK"))


def _mentions(spark, sf_dir, condition: str) -> DataFrame:
    raw = _raw_phones(spark, sf_dir).filter(condition)
    return raw.select(F.lit("case-1").alias("case_id"), F.lit("PHONE").alias("entity_type"), normalize.phone(F.col("raw")).alias("normalized"), "raw", "ts")


def resolved_entities(spark, sf_dir):
    return ingest.entities(_mentions(spark, sf_dir, "true"))


def entity_upsert(spark, sf_dir):
    old = ingest.entities(_mentions(spark, sf_dir, "event_id < 600")).withColumn("role", F.when(F.substring("normalized", -1, 1) == "3", "SUSPECT").otherwise("UNKNOWN"))
    new = ingest.entities(_mentions(spark, sf_dir, "event_id >= 600")).withColumn("role", F.when(F.substring("normalized", -1, 1) == "4", "VICTIM").otherwise("UNKNOWN"))
    return ingest.upserted_entities(old, new)


def entity_versions(spark, sf_dir):
    """The same two loads merged into a versioned table; the second rewrites only the buckets that its phones fall into."""
    path = f"{shared_folder(spark)}/caseweave/entities-{uuid.uuid4().hex}"
    keys = ["case_id", "entity_type", "normalized"]
    for condition, digit, role in (("event_id < 600", "3", "SUSPECT"), ("event_id >= 600", "4", "VICTIM")):
        load = ingest.entities(_mentions(spark, sf_dir, condition)).withColumn("role", F.when(F.substring("normalized", -1, 1) == digit, role).otherwise("UNKNOWN"))
        versioned.merge(load, path, keys, lambda old, new: ingest.upserted_entities(old, new).select(*new.columns))
    return versioned.read(spark, path)


def evidence_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = integrity.inventory(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text", "source").filter("text is not null"), "name", "text")
    cases = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("case_id"))
    return integrity.duplicates(files.join(cases, "name")).select("name", "case_id", "size_bytes", "sha256", "is_duplicate")


def manifest_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text").filter("text is not null")
    then = integrity.inventory(docs.filter("name % 17 <> 3"), "name", "text")
    now = integrity.inventory(docs.filter("name % 13 <> 5").withColumn("text", F.when(F.col("name") % 19 == 7, F.concat("text", F.lit("."))).otherwise(F.col("text"))), "name", "text")
    return integrity.manifest_diff(then, now)


def _payload() -> dict:
    return {"role": F.col("action"), "text": F.sha2("text", 256)}


def _chain(spark, sf_dir) -> DataFrame:
    """Each conversation as a case's audit log: a turn is an entry, its role the action, its text the payload."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    actions = rows.select(
        F.col("conv_id").alias("case_id"),
        F.col("turn").alias("seq"),
        F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
        F.concat(F.lit("B-"), (F.col("conv_id") % 5).cast("string")).alias("officer_badge"),
        F.col("role").alias("action"),
        F.when(F.col("turn") % 3 != 2, "conversation").alias("target_type"),
        F.when(F.col("turn") % 3 != 2, F.col("conv_id").cast("string")).alias("target_id"),
        "text",
    )
    return integrity.chained(integrity.hashed_entries(actions, _payload()))


def _tampered(spark, sf_dir) -> DataFrame:
    """The chains after some texts, some actions and some stored hashes were changed."""
    c, second = _chain(spark, sf_dir), F.col("seq") == 1
    c = c.withColumn("text", F.when((F.col("case_id") % 7 == 3) & second, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    c = c.withColumn("action", F.when((F.col("case_id") % 11 == 4) & second, F.lit("system")).otherwise(F.col("action")))
    return c.withColumn("payload_hash", F.when((F.col("case_id") % 13 == 5) & second, F.reverse("payload_hash")).otherwise(F.col("payload_hash")))


def audit_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("case_id", "seq", "payload_hash", "prev_hash", "entry_hash")


def audit_heads(spark, sf_dir):
    return integrity.heads(_chain(spark, sf_dir))


def audit_entries(spark, sf_dir):
    """What one officer did as a user in the first two minutes."""
    found = integrity.filtered(_chain(spark, sf_dir), action="user", officer="B-2", since="2026-01-01T00:00:00Z", until="2026-01-01T00:02:00Z")
    return found.select("case_id", "seq", "occurred_at", "officer_badge", "action", "entry_hash")


def audit_verification(spark, sf_dir):
    """Tampered chains, and rows dropped from others."""
    chain = _tampered(spark, sf_dir).filter(~((F.col("case_id") % 5 == 2) & (F.col("seq") == 1)))
    return integrity.verified(chain, _payload())


def audit_appended(spark, sf_dir):
    """Chains whose later half was appended to the heads of the earlier one: the same hashes as in one go."""
    whole = _chain(spark, sf_dir)
    old = whole.filter("seq < 3")
    new = whole.filter("seq >= 3").drop("prev_hash", "entry_hash")
    return old.unionByName(integrity.chained(new, integrity.heads(old))).select("case_id", "seq", "payload_hash", "prev_hash", "entry_hash")


def case_integrity(spark, sf_dir):
    files = manifest_diff(spark, sf_dir).select((F.col("name") % 150).alias("case_id"), "status")
    return integrity.case_status(integrity.verified(_tampered(spark, sf_dir), _payload()), files, "case_id")


def evidence_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text").filter("text is not null")
    return integrity.manifest_lines(integrity.inventory(docs, "name", "text"), _chain(spark, sf_dir)).distinct()


def evidence_active(spark, sf_dir):
    """Files without the excluded ones; an exclusion without a reason is none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text").filter("text is not null")
    reason = F.when(F.col("name") % 29 == 0, " ").otherwise("not of this case")
    out = docs.filter("name % 23 = 0 or name % 29 = 0").select("name", reason.alias("reason"))
    return integrity.excluded(integrity.inventory(docs, "name", "text"), out)


def evidence_status(spark, sf_dir):
    """The register with what became of each file since its manifest."""
    return integrity.inventory(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text").filter("text is not null"), "name", "text").join(manifest_diff(spark, sf_dir), "name", "left")


_CHAIN = r"""WITH RECURSIVE base AS (
  SELECT conv_id AS case_id, turn AS seq, strftime(TIMESTAMP '2026-01-01' + INTERVAL 1 MINUTE * turn, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, 'B-' || (conv_id % 5) AS officer_badge,
         role AS action, CASE WHEN turn % 3 <> 2 THEN 'conversation' ELSE '' END AS target_type, CASE WHEN turn % 3 <> 2 THEN conv_id::VARCHAR ELSE '' END AS target_id,
         sha256('{"role":"' || role || '","text":"' || sha256(text) || '"}') AS payload_hash FROM conversations WHERE text IS NOT NULL),
parts AS (SELECT *, concat_ws(chr(31), seq, occurred_at, officer_badge, action, target_type, target_id, payload_hash) AS p, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS pos FROM base),
chain AS (
  SELECT case_id, seq, occurred_at, officer_badge, action, pos, p, payload_hash, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || chr(31) || p) AS entry_hash FROM parts WHERE pos = 1
  UNION ALL SELECT b.case_id, b.seq, b.occurred_at, b.officer_badge, b.action, b.pos, b.p, b.payload_hash, c.entry_hash, sha256(c.entry_hash || chr(31) || b.p)
  FROM chain c JOIN parts b ON b.case_id = c.case_id AND b.pos = c.pos + 1),
v1 AS (
  SELECT case_id, seq, entry_hash, prev_hash,
         seq = 1 AND (case_id % 7 = 3 OR (case_id % 11 = 4 AND action <> 'system') OR (case_id % 13 = 5 AND reverse(payload_hash) <> payload_hash)) AS flip FROM chain),
"""
_MANIFEST = """docs AS (SELECT doc_id AS name, text FROM documents WHERE text IS NOT NULL),
thn AS (SELECT name, sha256(text) AS x FROM docs WHERE name % 17 <> 3),
nw AS (SELECT name, sha256(CASE WHEN name % 19 = 7 THEN text || '.' ELSE text END) AS y FROM docs WHERE name % 13 <> 5),
diff AS (SELECT coalesce(thn.name, nw.name) AS name, CASE WHEN y IS NULL THEN 'MISSING' WHEN x IS NULL THEN 'NEW' WHEN x = y THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM thn FULL JOIN nw USING (name))
"""
_VERIFIED = """dropped AS (SELECT * FROM v1 WHERE NOT (case_id % 5 = 2 AND seq = 1)),
linked AS (SELECT *, lag(entry_hash) OVER w AS p, lag(seq) OVER w AS s FROM dropped WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
checked AS (SELECT case_id, seq, flip OR prev_hash <> coalesce(p, repeat('0', 64)) OR seq <> coalesce(s + 1, 0) AS bad FROM linked)
"""
_IDS = r"""WITH adr AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]')) AS raw FROM documents),
found AS (
  SELECT doc_id, 'EMAIL' AS kind, raw FROM adr WHERE regexp_matches(raw, '@[^@]*\.[A-Za-z]{2,}$')
  UNION ALL SELECT doc_id, 'UPI_HANDLE', raw FROM adr WHERE regexp_matches(raw, '@[A-Za-z]+$')
  UNION ALL SELECT doc_id, 'IP', unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) FROM documents
  UNION ALL SELECT doc_id, 'PHONE', unnest(regexp_extract_all(text, '\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\+91[ -]?[0-9]{10}\b|\b[6-9][0-9]{9}\b')) FROM documents
  UNION ALL SELECT doc_id, 'IMEI', unnest(regexp_extract_all(text, '\b[0-9]{15,16}\b')) FROM documents)
"""
_BANK = (
    "WITH "
    + EVENTS_SQL
    + """, bank AS (
  SELECT event_id AS source_row, 'file-' || (event_id % 5) AS evidence_file_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('second', ts) END AS occurred_at,
         CASE WHEN event_type = 'UPI_TXN' OR event_type = 'TRANSFER' THEN CASE WHEN event_id % 9 = 0 THEN 'ATM_WITHDRAWAL' ELSE 'TRANSFER' END END AS event_type,
         'HDFC' || lpad(src::VARCHAR, 10, '0') AS src, 'SBI' || lpad(dst::VARCHAR, 10, '0') AS dst, CASE WHEN event_id % 70 = 1 THEN -amount ELSE amount END::DOUBLE AS amount, 'line ' || event_id AS raw_line
  FROM ev WHERE event_type IN ('TRANSFER', 'UPI_TXN')),
why AS (SELECT *, CASE WHEN occurred_at IS NULL THEN 'unreadable time' WHEN amount < 0 THEN 'negative amount' END AS reason FROM bank)
"""
)
_PHONES = (
    "WITH "
    + EVENTS_SQL
    + """, ph AS (
  SELECT event_id, ts, '+9198' || lpad(src::VARCHAR, 8, '0') AS normalized,
         CASE event_id % 4 WHEN 0 THEN '98' WHEN 1 THEN '098' WHEN 2 THEN '+91 98' ELSE '9198' END || lpad(src::VARCHAR, 8, '0') AS raw FROM ev),
ent AS (SELECT CASE WHEN event_id < 600 THEN 0 ELSE 1 END AS load, normalized, count(*) AS occurrences, arg_min(raw, {'t': ts, 'r': raw}) AS raw, min(ts) AS first_seen, max(ts) AS last_seen
        FROM ph GROUP BY 1, 2)
"""
)

QUERIES = {
    f.__name__: f
    for f in (
        text_identifiers, classified_identifiers, normalized_phones, normalized_devices, ip_prefixes, ipv6_prefixes, entity_uuids, email_forms, parsed_times, parsed_amounts, ingested_events, ingest_rejects,
        ingest_counts, ingest_quality, resolved_entities, entity_upsert, entity_versions, evidence_inventory, manifest_diff, audit_chain, audit_appended, audit_heads, audit_entries, audit_verification, case_integrity,
        evidence_manifest, evidence_active, evidence_status,
    )
}

SQL = {
    "text_identifiers": _IDS + "SELECT kind, raw, count(*) AS n, count(DISTINCT doc_id) AS documents FROM found GROUP BY kind, raw",
    "classified_identifiers": _IDS
    + r""", v AS (SELECT DISTINCT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM found)
SELECT doc_id, raw, CASE WHEN len(d) = 15 THEN 'IMEI' WHEN regexp_matches(raw, '(?i)^[\w.+-]+@[a-z]+$') THEN 'UPI_HANDLE'
  WHEN regexp_matches(raw, '(?i)^[\w.+-]+@[\w.-]+\.[a-z]{2,}$') THEN 'EMAIL' WHEN regexp_matches(raw, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 'IP'
  WHEN regexp_matches(raw, '^[+]?[0-9][0-9\s().-]{7,}$') AND len(d) BETWEEN 10 AND 12 THEN 'PHONE' WHEN regexp_matches(raw, '^([0-9]{9}|[0-9]{18})$') THEN 'BANK_ACCOUNT' ELSE 'UNKNOWN' END AS entity_type FROM v""",
    "normalized_phones": _PHONES + "SELECT event_id, normalized AS phone FROM ph",
    "normalized_devices": "WITH "
    + EVENTS_SQL
    + """, d AS (SELECT event_id, '351234' || lpad(imei::VARCHAR, 3, '0') || lpad(phone::VARCHAR, 6, '0') AS i, imsi, imei FROM dev),
l AS (SELECT *, list_sum(list_transform(range(15), lambda k: CASE WHEN k % 2 = 0 THEN i[15 - k]::INT ELSE (i[15 - k]::INT * 2) % 10 + (i[15 - k]::INT * 2) // 10 END)) AS s FROM d)
SELECT event_id, i AS imei, s % 10 = 0 AS imei_luhn_ok, i[1:14] AS imei_base, 'aa:bb:cc:' || lpad(imsi::VARCHAR, 2, '0') || ':' || lpad((imei % 100)::VARCHAR, 2, '0') || ':0f' AS mac FROM l""",
    "ip_prefixes": _IDS
    + r"""SELECT DISTINCT doc_id, raw, CASE WHEN ok THEN clean ELSE raw END AS ip, CASE WHEN regexp_matches(CASE WHEN ok THEN clean ELSE raw END, '^\d+\.\d+\.\d+\.\d+$')
  THEN regexp_replace(CASE WHEN ok THEN clean ELSE raw END, '\.[0-9]+$', '.0/24') END AS net
FROM (SELECT doc_id, raw, list_bool_and(list_transform(string_split(raw, '.'), lambda x: x::INT <= 255)) AS ok,
             array_to_string(list_transform(string_split(raw, '.'), lambda x: x::INT::VARCHAR), '.') AS clean FROM found WHERE kind = 'IP')""",
    "ipv6_prefixes": """SELECT event_id, CASE WHEN event_id % 256 = 0 AND event_id % 4096 = 0 THEN '2001:db8::' WHEN event_id % 256 = 0 THEN '2001:db8::' || lower(to_hex(event_id % 4096))
  ELSE '2001:db8:0:' || lower(to_hex(event_id % 256)) || '::' || CASE WHEN event_id % 4096 = 0 THEN '' ELSE lower(to_hex(event_id % 4096)) END END AS ip,
  CASE WHEN event_id % 256 = 0 THEN '2001:db8::/64' ELSE '2001:db8:0:' || lower(to_hex(event_id % 256)) || '::/64' END AS net FROM events""",
    "email_forms": _IDS + "SELECT DISTINCT doc_id, split_part(raw, '@', 1) || '@' || lower(split_part(raw, '@', 2)) AS email, lower(split_part(raw, '@', 2)) AS domain FROM found WHERE kind = 'EMAIL'",
    "parsed_times": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) - INTERVAL '330 minutes' END AS at,
  CASE event_id % 3 WHEN 0 THEN CASE WHEN day(ts) <= 12 AND day(ts) <> month(ts) THEN 2 ELSE 1 END WHEN 1 THEN 1 ELSE 0 END::INT AS readings FROM events""",
    "parsed_amounts": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN -round(o_totalprice, 2) WHEN 3 THEN NULL ELSE round(o_totalprice, 2) END AS amount FROM orders",
    "ingested_events": _BANK + "SELECT source_row, event_type, occurred_at, src, dst, amount FROM why WHERE reason IS NULL",
    "ingest_rejects": _BANK + "SELECT reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY reason",
    "ingest_counts": _BANK
    + "SELECT evidence_file_id, count(*) AS total, count(*) FILTER (reason IS NULL) AS parsed, count(*) FILTER (reason IS NOT NULL) AS rejected FROM why GROUP BY evidence_file_id",
    "ingest_quality": _BANK
    + """SELECT unnest(['amount is not negative', 'duration is not negative', 'type is known', 'ends differ', 'time is known']) AS "check",
  unnest([count(*) FILTER (amount < 0), 0, 0, count(*) FILTER (src = dst), count(*) FILTER (occurred_at IS NULL)]) AS failed FROM why""",
    "resolved_entities": _PHONES
    + "SELECT 'case-1' AS case_id, 'PHONE' AS entity_type, normalized, count(*) AS occurrences, arg_min(raw, {'t': ts, 'r': raw}) AS raw, min(ts) AS first_seen, max(ts) AS last_seen FROM ph GROUP BY normalized",
    "entity_upsert": _PHONES
    + """SELECT 'case-1' AS case_id, 'PHONE' AS entity_type, normalized, sum(occurrences)::BIGINT AS occurrences, arg_min(raw, load) AS raw,
  CASE WHEN right(normalized, 1) = '3' AND min(load) = 0 THEN 'SUSPECT' WHEN right(normalized, 1) = '4' AND max(load) = 1 THEN 'VICTIM' ELSE 'UNKNOWN' END AS role,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM ent GROUP BY normalized""",
    "evidence_inventory": """SELECT 'doc-' || doc_id AS name, source AS case_id, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS sha256,
  row_number() OVER (PARTITION BY source, sha256(text) ORDER BY 'doc-' || doc_id) > 1 AS is_duplicate FROM documents WHERE text IS NOT NULL""",
    "manifest_diff": "WITH " + _MANIFEST + "SELECT * FROM diff",
    "audit_chain": _CHAIN.rstrip().rstrip(",") + " SELECT case_id, seq, payload_hash, prev_hash, entry_hash FROM chain",
    "audit_appended": _CHAIN.rstrip().rstrip(",") + " SELECT case_id, seq, payload_hash, prev_hash, entry_hash FROM chain",
    "audit_heads": _CHAIN.rstrip().rstrip(",") + " SELECT case_id, max(seq) AS head_seq, arg_max(entry_hash, seq) AS head_hash FROM chain GROUP BY case_id",
    "audit_entries": _CHAIN.rstrip().rstrip(",")
    + " SELECT case_id, seq, occurred_at, officer_badge, action, entry_hash FROM chain WHERE action = 'user' AND officer_badge = 'B-2' AND occurred_at <= '2026-01-01T00:02:00Z'",
    "audit_verification": _CHAIN + _VERIFIED + "SELECT case_id, count(*) AS entries, count(*) FILTER (bad) = 0 AS ok, min(seq) FILTER (bad) AS first_bad_seq FROM checked GROUP BY case_id",
    "case_integrity": _CHAIN
    + _MANIFEST
    + """, whole AS (SELECT case_id, bool_or(flip) AS broken FROM v1 GROUP BY case_id),
f AS (SELECT name % 150 AS case_id, count(*) FILTER (status IN ('CHANGED', 'MISSING')) AS bad FROM diff GROUP BY 1)
SELECT coalesce(w.case_id, f.case_id) AS case_id, CASE WHEN coalesce(broken, false) OR coalesce(bad, 0) > 0 THEN 'COMPROMISED' WHEN broken IS NOT NULL AND bad IS NOT NULL THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status
FROM whole w FULL JOIN f ON w.case_id = f.case_id""",
    "evidence_manifest": _CHAIN.rstrip().rstrip(",")
    + """ SELECT DISTINCT '{"kind":"file","name":"' || doc_id || '","sha256":"' || sha256(text) || '"}' AS line FROM documents WHERE text IS NOT NULL
UNION ALL SELECT '{"case_id":"' || case_id || '","hash":"' || arg_max(entry_hash, seq) || '","kind":"head","seq":' || max(seq) || '}' FROM chain GROUP BY case_id""",
    "evidence_active": """SELECT doc_id AS name, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS sha256 FROM documents
WHERE text IS NOT NULL AND NOT (doc_id % 23 = 0 AND doc_id % 29 <> 0)""",
    "evidence_status": "WITH " + _MANIFEST + "SELECT d.doc_id AS name, octet_length(encode(d.text))::BIGINT AS size_bytes, sha256(d.text) AS sha256, status FROM documents d LEFT JOIN diff ON diff.name = d.doc_id WHERE d.text IS NOT NULL",
}
SQL["entity_versions"] = SQL["entity_upsert"]
