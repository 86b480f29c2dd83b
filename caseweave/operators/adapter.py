"""Driver tables as canonical events, entities and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: event_type of the table -> canonical event type
TYPES = {"purchase": "TRANSFER", "view": "UPI_TXN", "error": "ATM_WITHDRAWAL", "click": "CALL", "signup": "LOGIN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, event_type, src, dst, amount (decimal); accounts and phones share one id space."""
    kind = F.col("event_type")
    name = F.lit("LOGIN")
    for theirs, ours in TYPES.items():
        name = F.when(kind == theirs, ours).otherwise(name)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        name.alias("event_type"),
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("bigint").alias("dst"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that move money between two different accounts."""
    return events(spark, sf_dir).filter("event_type in ('TRANSFER', 'UPI_TXN', 'ATM_WITHDRAWAL') and dst is not null and src <> dst")


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, phone, imei, imsi of calls."""
    calls = events(spark, sf_dir).filter("event_type = 'CALL' and dst is not null")
    return calls.select("event_id", "ts", F.col("src").alias("phone"), F.col("dst").alias("imei"), ((F.col("event_id") + F.col("src")) % 40).alias("imsi"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, phone, mac, ip of data sessions."""
    rows = events(spark, sf_dir).filter("event_type = 'LOGIN' and dst is not null")
    mac = F.concat(F.lit("AA-BB-CC-00-"), F.lpad((F.col("dst") % 100).cast("string"), 2, "0"), F.lit("-0F"))
    ip = F.concat(F.lit("10."), (F.col("dst") % 7).cast("string"), F.lit("."), (F.col("src") % 25).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"))
    return rows.select("event_id", "ts", F.col("src").alias("phone"), mac.alias("mac"), ip.alias("ip"))


def installed_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, phone, android_id, certificate_sha256: the apps on the handset of each call."""
    cert = F.sha2(F.concat(F.lit("cert-"), (F.col("imei") % 37).cast("string")), 256)
    return device_events(spark, sf_dir).select("ts", "phone", F.concat(F.lit("android-"), (F.col("imei") % 53).cast("string")).alias("android_id"), cert.alias("certificate_sha256"))


def mail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, value: a mail for each document, from one account's address to another's; some headers are forged."""
    n = F.col("doc_id")
    sender = F.concat(F.lit("u"), (n % 1500).cast("string"), F.lit("@bank.example"))
    recipient = F.concat(F.lit("u"), (n * 7 % 1500).cast("string"), F.lit("@mail.example"))
    back = F.when(n % 21 == 0, "bounce@bannk.example").when(n % 35 == 0, "bounce@other.test").otherwise(sender)
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("Return-Path: <"), back, F.lit(">")),
        F.lit("Received: from a.example\r\n\tby b.example"),
        F.lit("Received: from b.example by c.example"),
        F.concat(F.lit("Authentication-Results: c.example; spf="), F.when(n % 33 == 0, "fail").otherwise("pass"), F.lit("; dkim="), F.when(n % 55 == 0, "fail").otherwise("pass"), F.lit("; dmarc=none")),
        F.concat(F.lit("From: Someone <"), sender, F.lit(">")),
        F.concat(F.lit("To: "), recipient),
        F.concat(F.lit("Subject: Statement "), n.cast("string")),
        F.lit("Date: Wed, 04 Mar 2026 10:23:00 +0530"),
        F.lit(""),
        F.substring("text", 1, 200),
    )
    return table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.concat(F.lit("mail-"), n.cast("string")).alias("path"), lines.alias("value"))


def address_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, entity: both addresses of every account."""
    own = transfers(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("entity")).distinct()
    forms = F.array(*[F.concat(F.lit("u"), F.col("entity").cast("string"), F.lit(d)) for d in ("@bank.example", "@mail.example")])
    return own.select("entity", F.explode(forms).alias("address"))


#: The same views for DuckDB.
EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'TRANSFER' WHEN 'view' THEN 'UPI_TXN' WHEN 'error' THEN 'ATM_WITHDRAWAL'
         WHEN 'click' THEN 'CALL' ELSE 'LOGIN' END AS event_type,
         user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, CAST(value AS DECIMAL(18,2)) AS amount
  FROM events),
tr AS (SELECT * FROM ev WHERE event_type IN ('TRANSFER', 'UPI_TXN', 'ATM_WITHDRAWAL') AND dst IS NOT NULL AND src <> dst),
dev AS (SELECT event_id, ts, src AS phone, dst AS imei, (event_id + src) % 40 AS imsi FROM ev WHERE event_type = 'CALL' AND dst IS NOT NULL),
ml AS (
  SELECT doc_id, doc_id % 1500 AS s, doc_id * 7 % 1500 AS r, doc_id % 21 = 0 OR doc_id % 35 = 0 AS other, doc_id % 21 = 0 AS lookalike,
         doc_id % 33 = 0 AS spf, doc_id % 55 = 0 AS dkim FROM documents WHERE doc_id IS NOT NULL)
"""
