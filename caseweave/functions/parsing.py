"""Dates, amounts and canonical JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_time(c: Column, patterns: list[str], first: str | None = None) -> Column:
    """The first pattern that fits, the mapping's own before the others; null where none does."""
    tries = [F.try_to_timestamp(F.trim(c), F.lit(p)) for p in ([first] if first else []) + patterns]
    return F.coalesce(*tries)


def ist_to_utc(c: Column) -> Column:
    return F.to_utc_timestamp(c, "Asia/Kolkata")


def ist_hour(c: Column) -> Column:
    return F.hour(F.from_utc_timestamp(c, "Asia/Kolkata"))


def readings(c: Column, patterns: list[str]) -> Column:
    """How many different times the patterns read from a text: over one is ambiguous."""
    return F.size(F.array_distinct(F.filter(F.array(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in patterns]), lambda t: t.isNotNull())))


def amount(c: Column) -> Column:
    """Decimal of a written amount: currency signs and commas go, the sign stays; null where it is not a number."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?i)(-?)\s*(rs\.?|inr|₹)\s*", "$1"), "[, ]", "")
    return body.try_cast("decimal(18,2)")


def finite(c: Column) -> Column:
    """Null, NaN and infinite as 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; null fields stay as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def payload_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def entry_hash(*parts: Column) -> Column:
    """SHA-256 over the parts with the unit separator between them; a null part counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
