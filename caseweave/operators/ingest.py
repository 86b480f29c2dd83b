"""Rows of evidence files into events, entities and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.config import EVENT_TYPES, FIELD_TYPES, FORMATS
from caseweave.functions import normalize, parsing


def _filled(rows: DataFrame, *names: str) -> Column:
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def mapped(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source columns renamed to canonical fields and trimmed; source_row and the file's columns stay."""
    kept = [c for c in ("case_id", "evidence_file_id", "source_row", "source_sha256", "raw_line") if c in rows.columns]
    return rows.select(*kept, *[F.trim(F.col(f"`{source}`")).alias(field) for field, source in mapping.items()])


def events(rows: DataFrame, kind: str, date_format: str | None = None) -> DataFrame:
    """Canonical events of mapped rows; `reason` says why a row is rejected, null where it is good.

    Times are Indian and become UTC; a time that no format reads rejects the row.  An endpoint that cannot be
    normalised stays null and sets quality_flag.
    """
    src, dst = _filled(rows, "caller", "debit_account"), _filled(rows, "callee", "credit_account")
    time = _filled(rows, "start_time", "txn_time", "date")
    typed = lambda raw, field: F.when(raw.contains("@"), normalize.classified(raw)).otherwise(F.lit(FIELD_TYPES[field]))
    call = kind in ("CDR", "IPDR")
    src_type, dst_type = typed(src, "caller" if call else "debit_account"), typed(dst, "callee" if call else "credit_account")
    out = rows.select(
        *[c for c in ("case_id", "evidence_file_id", "source_row", "source_sha256") if c in rows.columns],
        F.lit(EVENT_TYPES.get(kind, "OTHER")).alias("event_type"),
        parsing.ist_to_utc(parsing.parsed_time(time, FORMATS[kind]["dates"], date_format)).alias("occurred_at"),
        src_type.alias("src_type"),
        normalize.normalized(src_type, src).alias("src"),
        dst_type.alias("dst_type"),
        normalize.normalized(dst_type, dst).alias("dst"),
        normalize.imei(_filled(rows, "imei")).alias("imei"),
        normalize.imei_ok(_filled(rows, "imei")).alias("imei_luhn_ok"),
        normalize.imsi(_filled(rows, "imsi")).alias("imsi"),
        parsing.amount(_filled(rows, "amount")).alias("amount"),
        parsing.amount(_filled(rows, "balance_after")).alias("balance_after"),
        _filled(rows, "duration_s").try_cast("int").alias("duration_sec"),
        *[_filled(rows, c).alias(c) for c in ("ip_address", "mac_address", "bytes_up_kb", "bytes_down_kb", "destination_ip") if c in rows.columns],
        F.col("raw_line") if "raw_line" in rows.columns else F.lit(None).cast("string").alias("raw_line"),
        _filled(rows, "channel").alias("channel"),
        _filled(rows, "reference_no").alias("reference_no"),
        time.alias("raw_time"),
        (src.isNotNull() & normalize.normalized(src_type, src).isNull()).alias("quality_flag"),
    )
    cash = (F.col("event_type") == "TRANSFER") & F.upper(F.coalesce("channel", F.lit(""))).contains("ATM")
    out = out.withColumn("event_type", F.when(cash, "ATM_WITHDRAWAL").otherwise(F.col("event_type")))
    reason = (
        F.when(F.col("raw_time").isNull(), "no time")
        .when(F.col("occurred_at").isNull(), "unreadable time")
        .when(F.col("evidence_file_id").isNull() | F.col("source_row").isNull() | F.col("source_sha256").isNull(), "no provenance")
        .when(F.col("amount") < 0, "negative amount")
    )
    return out.withColumn("reason", reason).drop("raw_time")


def good(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is not null").select("evidence_file_id", "source_row", "reason", "raw_line")


def row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("evidence_file_id").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("parsed"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def reject_summary(rows: DataFrame) -> DataFrame:
    return rejects(rows).groupBy("reason").agg(F.count("*").alias("n"))


def entities(mentions: DataFrame) -> DataFrame:
    """One entity per (case_id, entity_type, normalized): occurrences, the first raw value, first and last time."""
    out = mentions.filter("normalized is not null").groupBy("case_id", "entity_type", "normalized")
    return out.agg(F.count("*").alias("occurrences"), F.min_by("raw", F.struct("ts", "raw")).alias("raw"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def upserted_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences add up; the first raw value stays; a known role is kept; the later last_seen wins."""
    both = old.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1)))
    known = F.col("role") != "UNKNOWN"
    return both.groupBy("case_id", "entity_type", "normalized").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min_by("raw", "load").alias("raw"),
        F.coalesce(F.min_by(F.when(known, F.col("role")), F.when(known, F.col("load"))), F.lit("UNKNOWN")).alias("role"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


#: name -> condition that every row of canonical events keeps
CHECKS = {
    "amount is not negative": "amount >= 0",
    "duration is not negative": "duration_sec >= 0",
    "type is known": "event_type in ('TRANSFER', 'UPI_TXN', 'ATM_WITHDRAWAL', 'CALL', 'LOGIN', 'DATA_SESSION', 'SMS', 'EMAIL', 'CASHOUT', 'OTHER')",
    "ends differ": "src <> dst",
    "time is known": "occurred_at is not null",
}


LINK_CHECKS = {"confidence is a share": "confidence between 0 and 1", "ends differ": "a <> b", "support is positive": "support > 0"}
SCORE_CHECKS = {"score is of 100": "score between 0 and 100", "band is known": "band in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')"}
ENTITY_CHECKS = {
    "type is known": "entity_type in ('PHONE', 'IMEI', 'IMSI', 'UPI_HANDLE', 'BANK_ACCOUNT', 'EMAIL', 'IP', 'MAC', 'DEVICE_ID', 'APK_CERT', 'PERSON', 'LOCATION', 'OTHER')",
    "occurs": "occurrences >= 1",
    "value is there": "trim(normalized) <> ''",
}


def valid_entities(rows: DataFrame) -> DataFrame:
    """Entities with a type, a value and a case; the others are dropped."""
    return rows.filter("trim(entity_type) <> '' and trim(normalized) <> '' and trim(case_id) <> ''")


def quality(rows: DataFrame, checks: dict[str, str] | None = None) -> DataFrame:
    """check, failed: rows that break each condition; a null does not break it, but for conditions on null."""
    checks = checks or CHECKS
    made = [F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(f"c{k}") for k, c in enumerate(checks.values())]
    one = rows.agg(*made)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{k}").alias("failed")) for k, n in enumerate(checks)])).alias("x")).select("x.*")
