"""Rules, bands, link confidences, evidence formats and the canonical field dictionary."""

from __future__ import annotations

import hashlib
import json

# Weights, thresholds and windows of the twelve rules.
RULES: dict[str, dict] = {
    "R01": {"name": "Rapid pass-through", "weight": 18.0, "threshold": 0.85, "window_minutes": 60.0},
    "R02": {"name": "Fan-in", "weight": 12.0, "threshold": 8.0, "window_hours": 2.0},
    "R03": {"name": "Fan-out", "weight": 12.0, "threshold": 8.0, "window_hours": 2.0},
    "R04": {"name": "Layering depth", "weight": 12.0, "threshold": 3.0, "window_minutes": 30.0},
    "R05": {"name": "SIM-switch velocity", "weight": 10.0, "threshold": 3.0, "window_days": 7.0},
    "R06": {"name": "Device sharing", "weight": 8.0, "threshold": 3.0},
    "R07": {"name": "New account, high volume", "weight": 10.0, "max_age_days": 30.0, "min_turnover": 500000.0},
    "R08": {"name": "Cash-out terminal", "weight": 14.0, "threshold": 1.0},
    "R09": {"name": "Spoofed header", "weight": 8.0, "threshold": 1.0},
    "R10": {"name": "Odd-hour burst", "weight": 5.0, "threshold": 5.0},
    "R11": {"name": "Call-then-transfer", "weight": 12.0, "threshold": 1.0, "window_minutes": 15.0},
    "R12": {"name": "Centrality", "weight": 10.0, "threshold": 0.05},
}

# Lowest score of each band.
BANDS = {"CRITICAL": 80.0, "HIGH": 60.0, "MEDIUM": 30.0, "LOW": 0.0}

# Confidence of each link type, and the one from which a link is shown by itself.
CONFIDENCE = {
    "SHARED_IMEI": 0.95,
    "SHARED_IMSI": 0.95,
    "SHARED_MAC": 0.90,
    "SHARED_APK_CERT": 0.90,
    "RECURRING_BENEFICIARY": 0.80,
    "FUND_FLOW": 1.00,
    "SHARED_IP_SUBNET": 0.45,
    "TEMPORAL_PROXIMITY": 0.35,
    "SHARED_EMAIL_DOMAIN": 0.40,
    "SHARED_DEVICE": None,
}
ACTIVE_CONFIDENCE = 0.75

# Header aliases, detection headers and date patterns (Spark's) of each kind of evidence.
FORMATS: dict[str, dict] = {
    "CDR": {
        "detect": ["msisdn", "a-party", "a party", "calling", "imei", "cell id", "cell_id"],
        "columns": {
            "caller": ["calling no", "calling number", "a-party", "a party", "a party no", "msisdn", "caller", "from number", "a_party", "ani"],
            "callee": ["called no", "dialed number", "b-party", "b party", "b party no", "callee", "to number", "b_party", "dnis", "dialed"],
            "start_time": ["call date", "date time", "start time", "call_start", "datetime", "date_time", "time", "start_date"],
            "duration_s": ["duration", "dur(s)", "call duration", "duration_sec", "dur_s", "seconds"],
            "imei": ["imei", "equipment id", "imei_no", "equipment_id"],
            "imsi": ["imsi", "sim id", "imsi_no", "sim_id"],
            "cell_id": ["cell id", "first cgi", "lac-ci", "cell_id", "cgi", "tower_id", "site_id"],
            "call_type": ["type", "call type", "in/out", "call_type", "direction"],
        },
        "dates": ["dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MMM-yy hh:mm a", "dd-MM-yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm"],
        "required": ["caller", "callee", "start_time"],
    },
    "BANK": {
        "detect": ["debit", "credit", "balance", "narration", "account no", "txn date", "transaction date"],
        "columns": {
            "txn_time": ["date", "txn date", "transaction date", "value date", "posting date"],
            "debit_account": ["account no", "account number", "debit account", "dr account", "sender account"],
            "credit_account": ["beneficiary account", "credit account", "cr account", "receiver account"],
            "amount": ["amount", "txn amount", "debit amount", "credit amount", "dr", "cr"],
            "direction": ["dr/cr", "type", "transaction type", "dr cr"],
            "reference_no": ["reference no", "ref no", "utr", "rrn", "transaction id", "txn id"],
            "balance_after": ["balance", "closing balance", "available balance", "balance after txn"],
            "channel": ["channel", "mode", "payment mode"],
        },
        "dates": ["dd/MM/yyyy", "dd-MMM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy"],
        "required": ["txn_time", "debit_account", "amount"],
    },
    "UPI": {
        "detect": ["upi", "vpa", "@", "payer vpa", "payee vpa", "utr"],
        "columns": {
            "txn_time": ["date", "txn date", "transaction date", "settlement date"],
            "debit_account": ["payer vpa", "payer upi", "sender vpa", "from vpa"],
            "credit_account": ["payee vpa", "payee upi", "receiver vpa", "to vpa", "beneficiary vpa"],
            "amount": ["amount", "txn amount"],
            "reference_no": ["utr", "ref no", "transaction id", "txn ref id", "rrn"],
            "channel": ["channel", "payment channel"],
        },
        "dates": ["dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss"],
        "required": ["txn_time", "debit_account", "credit_account", "amount"],
    },
    # Not a fixed value: this kind had no format of its own.
    "IPDR": {
        "detect": ["ip address", "mac address", "data uploaded kb", "data downloaded kb", "destination ip"],
        "columns": {
            "caller": ["msisdn"],
            "start_time": ["start time"],
            "end_time": ["end time"],
            "ip_address": ["ip address"],
            "mac_address": ["mac address"],
            "bytes_up_kb": ["data uploaded (kb)"],
            "bytes_down_kb": ["data downloaded (kb)"],
            "destination_ip": ["destination ip"],
        },
        "dates": ["yyyy-MM-dd HH:mm:ss"],
        "required": ["caller", "start_time", "ip_address"],
    },
}
MIN_MATCHES = 2

# Canonical fields.
CANONICAL_FIELDS = [
    "caller", "callee", "start_time", "duration_s", "imei", "imsi", "cell_id", "call_type", "debit_account",
    "credit_account", "amount", "txn_time", "reference_no", "balance_after", "sender_email", "receiver_email",
    "ip_address", "mac_address",
]

# Event type of each kind, entity type of each field.
EVENT_TYPES = {"CDR": "CALL", "IPDR": "DATA_SESSION", "BANK": "TRANSFER", "UPI": "UPI_TXN", "EML": "EMAIL", "ANDROID_DUMP": "SMS"}
FIELD_TYPES = {
    "caller": "PHONE", "callee": "PHONE", "imei": "IMEI", "imsi": "IMSI", "debit_account": "BANK_ACCOUNT",
    "credit_account": "BANK_ACCOUNT", "sender_email": "EMAIL", "receiver_email": "EMAIL", "ip_address": "IP", "mac_address": "MAC",
}
TRANSFERS = ("TRANSFER", "UPI_TXN", "ATM_WITHDRAWAL")


def rules_with(overrides: dict[str, dict] | None = None) -> dict[str, dict]:
    """The rules with some settings replaced; an unknown rule or setting is an error."""
    merged = {code: dict(rule) for code, rule in RULES.items()}
    for code, change in (overrides or {}).items():
        for key, value in change.items():
            if code not in merged or key not in merged[code]:
                raise KeyError(f"{code}.{key} is not a setting of any rule")
            merged[code][key] = value
    return merged


def rules_from(path: str) -> dict[str, dict]:
    """The rules with the settings of a JSON file {rule: {setting: value}}; a missing or broken file is an error."""
    with open(path, encoding="utf-8") as f:
        changes = json.load(f)
    if not isinstance(changes, dict) or not all(isinstance(c, dict) for c in changes.values()):
        raise ValueError(f"{path} does not map rules to settings")
    return rules_with(changes)


def rules_hash(rules: dict[str, dict] | None = None) -> str:
    """SHA-256 over rules and bands as canonical JSON: names the configuration of a run."""
    body = json.dumps({"rules": rules or RULES, "bands": BANDS}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()
