"""Identifier normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone(c: Column) -> Column:
    """E.164 for India; digits of any other length are kept behind a plus sign."""
    d = digits(c)
    n = F.length(d)
    return (
        F.when(n == 0, F.lit(None))
        .when((n == 12) & d.startswith("91"), F.concat(F.lit("+"), d))
        .when(n == 10, F.concat(F.lit("+91"), d))
        .when((n == 11) & d.startswith("0"), F.concat(F.lit("+91"), F.substring(d, 2, 10)))
        .otherwise(F.concat(F.lit("+"), d))
    )


def imei(c: Column) -> Column:
    """Fifteen digits, else null; whether they pass the check digit is imei_ok's to say."""
    return F.when(F.length(digits(c)) == 15, digits(c))


def imei_ok(c: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", imei(c)), F.lit(False))


def imei_base(c: Column) -> Column:
    """The 14 digits that an IMEI shares with its IMEISV."""
    return F.substring(digits(c), 1, 14)


def imsi(c: Column) -> Column:
    return F.when(F.length(digits(c)) == 15, digits(c))


def upi(c: Column) -> Column:
    return F.lower(F.trim(c))


def bank_account(c: Column) -> Column:
    """Bank letters in front, then the digits: accounts of two banks with equal digits stay apart."""
    prefix = F.upper(F.regexp_extract(F.trim(c), "^([A-Za-z]*)", 1))
    return F.when(F.length(digits(c)) > 0, F.concat(prefix, digits(c)))


def ipv4(c: Column) -> Column:
    """Canonical dotted form without leading zeros; anything else is only trimmed and lower-cased."""
    part = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    whole = rf"^{part}\.{part}\.{part}\.{part}$"
    return F.when(F.trim(c).rlike(whole), F.regexp_replace(F.trim(c), whole, "$1.$2.$3.$4")).otherwise(F.lower(F.trim(c)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _filled(text: Column) -> Column:
    """The eight groups of a lower-case IPv6 address, its "::" filled up; null where it is none."""
    parts = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def fill(sides: Column) -> Column:
        head, tail = parts(F.get(sides, F.lit(0))), parts(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        missing = lambda x: 8 - F.size(x["head"]) - F.size(x["tail"])
        fits = lambda x: F.when(F.size(sides) == 1, missing(x) == 0).otherwise((F.size(sides) == 2) & (missing(x) >= 1))
        whole = lambda x: F.concat(x["head"], F.array_repeat(F.lit("0"), F.greatest(missing(x), F.lit(0))), x["tail"])
        return _let(F.struct(head.alias("head"), tail.alias("tail")), lambda x: F.when(fits(x), whole(x)))

    groups = _let(F.split(text, "::"), fill)
    tidy = lambda g: F.when(F.forall(g, lambda x: F.length(x) <= 4), F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", "")))
    return F.when(text.rlike("^[0-9a-f:]*:[0-9a-f:]*$"), _let(groups, tidy))


def _short(text: Column) -> Column:
    """Eight groups joined by colons with the first longest run of at least two zeros as "::"."""
    out = text
    for n in range(2, 9):  # a longer run replaces a shorter one's result
        zeros = ":".join(["0"] * n)
        out = F.when(text.rlike(rf"(^|:){zeros}(:|$)"), F.regexp_replace(text, rf"^(.*?)(^|:){zeros}(:|$)(.*)$", "$1::$4")).otherwise(out)
    return out


def ipv6(c: Column) -> Column:
    """Canonical form; null where it is no IPv6 address."""
    return _let(F.array_join(_filled(F.lower(F.trim(c))), ":"), _short)


def ip(c: Column) -> Column:
    """Canonical IPv4 or IPv6; anything else is trimmed and lower-cased."""
    return F.coalesce(F.when(c.contains(":"), ipv6(c)), ipv4(c))


def ip_prefix(c: Column) -> Column:
    """/24 of an IPv4 address, /64 of an IPv6 one."""
    v4 = lambda x: F.when(x.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.substring_index(x, ".", 3), F.lit(".0/24")))
    front = F.array_join(F.concat(F.slice(_filled(F.lower(F.trim(c))), 1, 4), F.array_repeat(F.lit("0"), 4)), ":")
    return F.coalesce(_let(ipv4(c), v4), F.when(c.contains(":"), F.concat(_let(front, _short), F.lit("/64"))))


def mac(c: Column) -> Column:
    """Lower-case pairs with colons, where twelve letters or digits are given."""
    body = F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return F.when(F.length(body) == 12, F.regexp_replace(body, "(..)(?=.)", "$1:")).otherwise(F.lower(F.trim(c)))


def email(c: Column) -> Column:
    """The domain in lower case, the local part as it is."""
    t = F.trim(c)
    return F.when(F.instr(t, "@") > 0, F.concat(F.substring_index(t, "@", 1), F.lit("@"), F.lower(F.element_at(F.split(t, "@", 2), 2)))).otherwise(t)


def email_domain(c: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(c), "@", 2), 2))


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "PHONE": phone, "IMEI": imei, "IMSI": imsi, "UPI_HANDLE": upi, "BANK_ACCOUNT": bank_account, "IP": ip, "MAC": mac, "EMAIL": email,
}


def normalized(entity_type: Column, raw: Column) -> Column:
    """By entity type; other types are trimmed."""
    out = F.trim(raw)
    for name, f in NORMALIZERS.items():
        out = F.when(entity_type == name, f(raw)).otherwise(out)
    return out


def classified(value: Column) -> Column:
    """Entity type by the look of a value; the first that fits, UNKNOWN if none does."""
    v, d = F.trim(value), digits(value)
    return (
        F.when(F.length(d) == 15, "IMEI")
        .when(v.rlike("(?i)^[\\w.+-]+@[a-z]+$"), "UPI_HANDLE")
        .when(v.rlike("(?i)^[\\w.+-]+@[\\w.-]+\\.[a-z]{2,}$"), "EMAIL")
        .when(v.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), "IP")
        .when(v.rlike("^[+]?[0-9][0-9\\s().-]{7,}$") & F.length(d).between(10, 12), "PHONE")
        .when(v.rlike("^([0-9]{9}|[0-9]{18})$"), "BANK_ACCOUNT")
        .otherwise("UNKNOWN")
    )


def entity_id(case_id: Column, entity_type: Column, norm: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(case_id, F.lit("")), entity_type, norm), 256)


#: Fixed value: the name space of entity ids, that of domain names in RFC 9562.
NAMES = "6ba7b8109dad11d180b400c04fd430c8"


def entity_uuid(case_id: Column, entity_type: Column, norm: Column, space: str = NAMES) -> Column:
    """The version-5 UUID of case:type:value in a name space."""
    name = F.concat_ws(":", F.coalesce(case_id, F.lit("")), entity_type, norm)
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Identifiers in free text.  An address without a dot behind its @ is a payment handle.
TEXT_PATTERNS = {
    "ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "PHONE": r"\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\+91[ -]?[0-9]{10}\b|\b[6-9][0-9]{9}\b",
    "IMEI": r"\b[0-9]{15,16}\b",
}


def text_identifiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per identifier found in a text: doc_id, kind (EMAIL, UPI_HANDLE, IP, PHONE, IMEI), raw."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("raws")) for k, p in TEXT_PATTERNS.items()]
    found = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*kinds)).alias("f"))
    rows = found.select("doc_id", "f.kind", F.explode("f.raws").alias("raw"))
    domain = F.substring_index("raw", "@", -1)
    kind = F.when(F.col("kind") != "ADDRESS", F.col("kind")).when(domain.rlike("[.][A-Za-z]{2,}$"), "EMAIL").when(domain.rlike("^[A-Za-z]+$"), "UPI_HANDLE")
    return rows.select("doc_id", kind.alias("kind"), "raw").filter("kind is not null")
