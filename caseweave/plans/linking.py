"""Queries that link entities.

A value that n entities share links n * (n - 1) / 2 pairs; it is shown as n - 1 rows from its smallest entity to the
others (a star), so every link is there at any n and rows grow as the uses do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.config import CONFIDENCE
from caseweave.functions import normalize
from caseweave.operators import links, windows
from caseweave.operators.adapter import EVENTS_SQL, device_events, installed_apps, sessions, table, transfers
from caseweave.operators.checkpoints import cut
from caseweave.operators.proximity import Proximity
from caseweave.plans._plain import plain


def _identifiers(spark, sf_dir, kind: str) -> DataFrame:
    found = normalize.text_identifiers(table(spark, sf_dir, "documents")).filter(F.col("kind") == kind)
    return found.select("doc_id", "raw", F.lit(None).cast("timestamp").alias("ts"))


#: link type -> (uses, entity, attribute), least users, and DuckDB's rows (e, v) of uses
SHARED: dict[str, tuple[Callable, str, str, int, str]] = {
    "SHARED_IMEI": (device_events, "phone", "imei", 2, "SELECT phone AS e, imei AS v FROM dev"),
    "SHARED_IMSI": (device_events, "phone", "imsi", 2, "SELECT phone AS e, imsi AS v FROM dev"),
    "RECURRING_BENEFICIARY": (lambda spark, sf: transfers(spark, sf).filter("event_type <> 'ATM_WITHDRAWAL'"), "src", "dst", 3, "SELECT src AS e, dst AS v FROM tr WHERE event_type <> 'ATM_WITHDRAWAL'"),
    "SHARED_MAC": (
        lambda spark, sf: sessions(spark, sf).withColumn("net", normalize.mac(F.col("mac"))),
        "phone",
        "net",
        2,
        "SELECT src AS e, 'aa:bb:cc:00:' || lpad((dst % 100)::VARCHAR, 2, '0') || ':0f' AS v FROM ev WHERE event_type = 'LOGIN' AND dst IS NOT NULL",
    ),
    "SHARED_APK_CERT": (installed_apps, "phone", "certificate_sha256", 2, "SELECT phone AS e, sha256('cert-' || (imei % 37)) AS v FROM dev"),
    "SHARED_DEVICE": (installed_apps, "phone", "android_id", 2, "SELECT phone AS e, 'android-' || (imei % 53) AS v FROM dev"),
    "SHARED_EMAIL_DOMAIN": (
        lambda spark, sf: _identifiers(spark, sf, "EMAIL").withColumn("domain", normalize.email_domain(F.col("raw"))),
        "doc_id",
        "domain",
        2,
        r"SELECT doc_id AS e, lower(split_part(m, '@', 2)) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]')) AS m FROM documents) WHERE regexp_matches(m, '@[^@]*\.[A-Za-z]{2,}$')",
    ),
    "SHARED_IP_SUBNET": (
        lambda spark, sf: sessions(spark, sf).withColumn("net", normalize.ip_prefix(F.col("ip"))),
        "phone",
        "net",
        2,
        "SELECT src AS e, '10.' || (dst % 7) || '.' || (src % 25) || '.0/24' AS v FROM ev WHERE event_type = 'LOGIN' AND dst IS NOT NULL",
    ),
}
#: Link types between accounts, which the merged queries show.
ACCOUNTS = ["SHARED_IMEI", "SHARED_IMSI", "RECURRING_BENEFICIARY", "SHARED_MAC", "SHARED_APK_CERT", "SHARED_DEVICE", "SHARED_IP_SUBNET"]


def _classes(spark, sf_dir, kind: str) -> DataFrame:
    """Membership rows of one link type over all of its rows."""
    uses, entity, attribute, least, _ = SHARED[kind]
    return links.shared_classes(uses(spark, sf_dir), entity, attribute, kind, least=least)


def _rows(classes: DataFrame) -> DataFrame:
    return classes.select("link_type", "value", "entity", "users", "smallest", F.round("confidence", 4).alias("confidence"))


def _starred(df: DataFrame) -> DataFrame:
    return df.select("a", "b", "link_type", "value", F.round("confidence", 4).alias("confidence"), "support")


def _star_query(kind: str):
    def query(spark, sf_dir):
        return _starred(links.as_stars(_classes(spark, sf_dir, kind)))

    return query


def _class_query(kind: str):
    def query(spark, sf_dir):
        return _rows(_classes(spark, sf_dir, kind))

    return query


def shared_imei_hubs(spark, sf_dir):
    """Every handset's phones, handsets of most phones first."""
    return links.hubs(device_events(spark, sf_dir), "phone", "imei")


def all_link_classes(spark, sf_dir):
    """Every link of accounts: those that are pairs by nature, and every account's membership in every shared value.

    A membership stands beside the value's smallest account, the smallest account's own too.
    """
    pairs, classes = _pairs_and_classes(spark, sf_dir)
    pairs = pairs.withColumn("value", F.lit(None).cast("string")).select("a", "b", "link_type", "value", "confidence", "support")
    own = classes.select(F.col("smallest").alias("a"), F.col("entity").alias("b"), "link_type", "value", "confidence", F.col("users").alias("support"))
    return _starred(pairs.unionByName(own))


def surfaced_link_classes(spark, sf_dir):
    """Memberships in values that are strong enough to be shown alone."""
    return _rows(_account_classes(spark, sf_dir)).filter(F.col("confidence") >= 0.75)


def time_proximity(spark, sf_dir):
    return windows.time_proximity(transfers(spark, sf_dir), "src", "ts", 60)


def _near(spark, sf_dir) -> Proximity:
    return Proximity(transfers(spark, sf_dir), "src", "ts", 60)


def _account_classes(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, [_classes(spark, sf_dir, kind) for kind in ACCOUNTS])


def _pairs_and_classes(spark, sf_dir, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(links that are pairs by nature, classes): what all_links shows, of all rows; types of less confidence are not made.

    A pair has one row of each type as it is, so nothing has to be merged.
    """
    pairs = links.fund_flow(transfers(spark, sf_dir))
    if CONFIDENCE["TEMPORAL_PROXIMITY"] >= least:
        pairs = pairs.unionByName(links._linked(_near(spark, sf_dir).pairs().withColumnRenamed("n", "support"), "TEMPORAL_PROXIMITY"))
    return pairs, _account_classes(spark, sf_dir)


def _merged(spark, sf_dir, least: float = 0.0) -> DataFrame:
    pairs, classes = _pairs_and_classes(spark, sf_dir, least)
    return pairs.withColumn("value", F.lit(None).cast("string")).select("a", "b", "link_type", "value", "confidence", "support").unionByName(links.as_stars(classes))


def all_links(spark, sf_dir):
    return _starred(_merged(spark, sf_dir))


def links_above(spark, sf_dir):
    """The links of at least the active confidence."""
    return _starred(_merged(spark, sf_dir, 0.75).filter(F.col("confidence") >= 0.75))


def surfaced_links(spark, sf_dir):
    """What is worth showing after an officer dismissed the flows between some accounts."""
    flows = cut(links.fund_flow(transfers(spark, sf_dir)))
    dismissed = flows.filter("(a + b) % 11 = 0").select("a", "b", "link_type")
    return _starred(links.surfaced_near(flows, _near(spark, sf_dir), _account_classes(spark, sf_dir), dismissed))


def fund_flow_events(spark, sf_dir):
    return plain(links.support_events(transfers(spark, sf_dir)))


def link_rationale(spark, sf_dir):
    """Sentences for the money flows and the beneficiaries' stars."""
    stars = links.as_stars(_classes(spark, sf_dir, "RECURRING_BENEFICIARY")).select("a", "b", "link_type", "support", F.lit(None).cast("decimal(18,2)").alias("total_amount"))
    flows = links.fund_flow(transfers(spark, sf_dir)).select("a", "b", "link_type", "support", "total_amount")
    return links.rationale(flows.unionByName(stars)).select("a", "b", "link_type", "rationale").distinct()


def link_upsert(spark, sf_dir):
    t = transfers(spark, sf_dir)
    old, new = links.fund_flow(t.filter("event_id < 5000")), links.fund_flow(t.filter("event_id >= 4000"))
    return plain(links.upserted(old, new)).select("a", "b", "support", "total_amount", "first_at", "last_at")


def _compared(spark, sf_dir) -> DataFrame:
    t = transfers(spark, sf_dir)
    return links.compared(links.fund_flow(t.filter("event_type <> 'UPI_TXN'")), links.fund_flow(t.filter("event_type <> 'TRANSFER'")))


def link_accuracy(spark, sf_dir):
    return _compared(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def link_recall(spark, sf_dir):
    return links.accuracy(_compared(spark, sf_dir))


def _confidence(kind: str, users: str = "users") -> str:
    if kind == "RECURRING_BENEFICIARY":
        return f"round(least(0.95::DOUBLE, 0.8::DOUBLE + 0.02::DOUBLE * {users}), 4)"
    return "NULL::DOUBLE" if CONFIDENCE[kind] is None else f"{CONFIDENCE[kind]}::DOUBLE"


_BASE = "WITH " + EVENTS_SQL + "".join(
    f""",
u_{kind} AS (SELECT DISTINCT e, v FROM ({sql}) WHERE e IS NOT NULL AND v IS NOT NULL),
c_{kind} AS (
  SELECT '{kind}' AS link_type, v::VARCHAR AS value, e AS entity, users, smallest, {_confidence(kind)} AS confidence
  FROM u_{kind} JOIN (SELECT v, count(*) AS users, min(e) AS smallest FROM u_{kind} GROUP BY v HAVING count(*) >= {least}) USING (v))"""
    for kind, (_, _, _, least, sql) in SHARED.items()
) + """,
prox AS (
  SELECT a.src AS a, b.src AS b, count(*) AS n FROM tr a JOIN tr b ON a.dst = b.dst AND a.src < b.src AND b.ts BETWEEN a.ts - INTERVAL '60 minutes' AND a.ts + INTERVAL '60 minutes' GROUP BY a.src, b.src),
cls AS (""" + " UNION ALL ".join(f"FROM c_{k}" for k in ACCOUNTS) + """),
pairs AS (
  SELECT src AS a, dst AS b, 'FUND_FLOW' AS link_type, NULL::VARCHAR AS value, 1.0::DOUBLE AS confidence, count(*) AS support FROM tr GROUP BY src, dst
  UNION ALL SELECT a, b, 'TEMPORAL_PROXIMITY', NULL, 0.35::DOUBLE, n FROM prox),
stars AS (SELECT smallest AS a, entity AS b, link_type, value, confidence, users AS support FROM cls WHERE entity <> smallest),
f AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM tr WHERE event_type <> 'UPI_TXN'),
e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM tr WHERE event_type <> 'TRANSFER'),
cmp AS (SELECT CASE WHEN f.a IS NOT NULL AND e.a IS NOT NULL THEN 'MATCHED' WHEN e.a IS NOT NULL THEN 'MISSED' ELSE 'FALSE' END AS status FROM f FULL JOIN e ON f.a = e.a AND f.b = e.b)
"""  # fmt: skip

QUERIES = {
    f.__name__: f
    for f in (shared_imei_hubs, time_proximity, all_links, all_link_classes, surfaced_link_classes, links_above, surfaced_links, fund_flow_events, link_rationale, link_upsert, link_accuracy, link_recall)
}
SQL = {
    "shared_imei_hubs": _BASE
    + "SELECT place, v AS value, e AS entity, users FROM u_SHARED_IMEI JOIN (SELECT v, count(*) AS users, row_number() OVER (ORDER BY count(*) DESC, v) AS place FROM u_SHARED_IMEI GROUP BY v) USING (v)",
    "all_link_classes": _BASE + "FROM pairs UNION ALL SELECT smallest AS a, entity AS b, link_type, value, confidence, users AS support FROM cls",
    "surfaced_link_classes": _BASE + "SELECT * FROM cls WHERE confidence >= 0.75",
    "time_proximity": _BASE + "SELECT * FROM prox",
    "all_links": _BASE + "FROM pairs UNION ALL FROM stars",
    "links_above": _BASE + "SELECT * FROM (FROM pairs UNION ALL FROM stars) WHERE confidence >= 0.75",
    "surfaced_links": _BASE
    + """, kept AS (SELECT * FROM pairs WHERE NOT (link_type = 'FUND_FLOW' AND (a + b) % 11 = 0)),
best AS (SELECT least(a, b) AS x, greatest(a, b) AS y, max(confidence) AS best FROM kept GROUP BY ALL),
strong AS (SELECT * FROM cls WHERE confidence >= 0.75),
shown AS (
  SELECT x, y FROM best WHERE best >= 0.75
  UNION SELECT x, y FROM best JOIN strong p ON p.entity = x JOIN strong q ON q.entity = y AND p.link_type = q.link_type AND p.value = q.value WHERE best < 0.75)
SELECT k.* FROM kept k WHERE (least(a, b), greatest(a, b)) IN (SELECT (x, y) FROM shown)
UNION ALL SELECT * FROM stars WHERE confidence >= 0.75""",
    "fund_flow_events": _BASE + "SELECT src AS a, dst AS b, event_id, ts, amount::DOUBLE AS amount FROM tr",
    "link_rationale": _BASE
    + """SELECT src AS a, dst AS b, 'FUND_FLOW' AS link_type, 'Money moved directly: ' || format('{:,.2f}', sum(amount)::DOUBLE) || ' in ' || count(*) || ' transfers.' AS rationale FROM tr GROUP BY src, dst
UNION SELECT smallest, entity, link_type, 'Both paid one beneficiary, as did ' || users || ' payers in all.' FROM c_RECURRING_BENEFICIARY WHERE entity <> smallest""",
    "link_upsert": _BASE
    + """, o AS (SELECT src AS a, dst AS b, count(*) AS support, sum(amount)::DOUBLE AS total_amount, min(ts) AS first_at, max(ts) AS last_at FROM tr WHERE event_id < 5000 GROUP BY src, dst),
n AS (SELECT src AS a, dst AS b, count(*) AS support, sum(amount)::DOUBLE AS total_amount, min(ts) AS first_at, max(ts) AS last_at FROM tr WHERE event_id >= 4000 GROUP BY src, dst)
SELECT coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, coalesce(n.support, o.support) AS support, coalesce(n.total_amount, o.total_amount) AS total_amount,
       least(coalesce(o.first_at, n.first_at), coalesce(n.first_at, o.first_at)) AS first_at, coalesce(n.last_at, o.last_at) AS last_at
FROM o FULL JOIN n ON o.a = n.a AND o.b = n.b""",
    "link_accuracy": _BASE + "SELECT status, count(*) AS n FROM cmp GROUP BY 1",
    "link_recall": _BASE
    + """SELECT m AS matched, l AS missed, w AS false_links, round(m::DOUBLE / (m + l), 6) AS recall, round(m::DOUBLE / (m + w), 6) AS "precision", round(w::DOUBLE / (m + w), 6) AS false_rate
FROM (SELECT count(*) FILTER (status = 'MATCHED') AS m, count(*) FILTER (status = 'MISSED') AS l, count(*) FILTER (status = 'FALSE') AS w FROM cmp)""",
}
for _kind in SHARED:
    _name = _kind.lower()
    QUERIES |= {_name: _star_query(_kind), f"{_name}_classes": _class_query(_kind)}
    SQL[_name] = _BASE + f"SELECT smallest AS a, entity AS b, link_type, value, confidence, users AS support FROM c_{_kind} WHERE entity <> smallest"
    SQL[f"{_name}_classes"] = _BASE + f"SELECT link_type, value, entity, users, smallest, confidence FROM c_{_kind}"
