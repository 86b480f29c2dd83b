"""Twelve weighted rules as columns: points, reasons, bands and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.config import BANDS, RULES
from caseweave.operators.ranking import numbered

#: code -> (value that the rule looks at, setting that holds its threshold, sentence if it fired, sentence if not)
MEASURES = {
    "R01": ("passthrough_ratio", "threshold", "Passed on %s of what it received", "Passed on only %s of what it received"),
    "R02": ("fan_in_count", "threshold", "Received from %s different sources within the window", "Received from at most %s sources within the window"),
    "R03": ("fan_out_count", "threshold", "Sent to %s different destinations within the window", "Sent to at most %s destinations within the window"),
    "R04": ("layering_depth", "threshold", "On a chain of %s quick hops", "Longest quick chain has %s hops"),
    "R05": ("sim_switch_count", "threshold", "Its handset held %s SIMs within the window", "Its handset held %s SIMs at most within the window"),
    "R06": ("device_share_count", "threshold", "Its handset served %s numbers", "Its handset served %s numbers at most"),
    "R07": ("turnover", "min_turnover", "New account with a turnover of %s", "Not a new account of high volume; turnover %s"),
    "R08": ("has_cash_out", "threshold", "Money left through a withdrawal (%s)", "No withdrawal (%s)"),
    "R09": ("has_spoofed_header", "threshold", "Mail with a forged sender (%s)", "No forged sender (%s)"),
    "R10": ("odd_hour_txn_count", "threshold", "%s transfers at night", "%s transfers at night, too few"),
    "R11": ("has_call_then_transfer", "threshold", "An unknown caller shortly before a debit (%s)", "No unknown caller before a debit (%s)"),
    "R12": ("betweenness_centrality", "threshold", "Lies between others (betweenness %s)", "Does not lie between others (betweenness %s)"),
}


def fires(code: str, rule: dict) -> Column:
    value, setting, *_ = MEASURES[code]
    if code == "R07":
        return (F.col("account_age_days") < rule["max_age_days"]) & (F.col(value) > rule[setting])
    return F.col(value) >= rule[setting]


def scored(features: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """features with score (capped at 100), band and rules_fired."""
    rules = rules or RULES
    points = sum((F.when(fires(c, r), F.lit(r["weight"])).otherwise(F.lit(0.0)) for c, r in rules.items()), F.lit(0.0))
    fired = F.filter(F.array(*[F.when(fires(c, r), F.lit(c)) for c, r in rules.items()]), lambda x: x.isNotNull())
    out = features.withColumn("score", F.round(F.least(F.lit(100.0), points), 2))
    return out.withColumn("band", band(F.col("score"))).withColumn("rules_fired", F.array_join(fired, ","))


def band(score: Column) -> Column:
    """The first band, from the top, whose least score is reached."""
    out = F.lit(min(BANDS, key=BANDS.get))
    for name, least in sorted(BANDS.items(), key=lambda x: x[1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def reasons(features: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """Twelve rows per account, fired or not: entity, rule_code, triggered, raw_value, threshold, points, text, display_order."""
    made = []
    for k, (code, rule) in enumerate((rules or RULES).items()):
        value, setting, yes, no = MEASURES[code]
        shown = F.round(F.col(value).cast("double"), 4)
        written = F.regexp_replace(shown.cast("decimal(38,4)").cast("string"), r"\.?0+$", "")
        made.append(
            F.struct(
                F.lit(code).alias("rule_code"),
                fires(code, rule).cast("int").alias("triggered"),
                shown.alias("raw_value"),
                F.lit(float(rule[setting])).alias("threshold"),
                F.when(fires(code, rule), F.lit(rule["weight"])).otherwise(F.lit(0.0)).alias("points"),
                F.when(fires(code, rule), F.format_string(yes, written)).otherwise(F.format_string(no, written)).alias("text"),
                F.lit(k + 1).alias("display_order"),
            )
        )
    return features.select("entity", F.explode(F.array(*made)).alias("r")).select("entity", "r.*")


def top_reasons(reason_rows: DataFrame, n: int = 3) -> DataFrame:
    """The n fired reasons of most points of each account."""
    w = Window.partitionBy("entity").orderBy(F.desc("points"), "display_order")
    return reason_rows.filter("triggered = 1").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def ranked(scores: DataFrame, within_band: bool = True) -> DataFrame:
    """rank_in_case by band and score, or by score alone, then by entity."""
    order = {name: k for k, name in enumerate(sorted(BANDS, key=BANDS.get, reverse=True))}
    place = [F.coalesce(*[F.when(F.col("band") == b, F.lit(k)) for b, k in order.items()])] if within_band else []
    return numbered(scores, [*place, F.desc("score"), F.col("entity")], "rank_in_case")


def band_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("band").agg(F.count("*").alias("accounts"))


def histogram(scores: DataFrame, width: int = 10) -> DataFrame:
    """Accounts per class of `width` points; a full score is in the last class."""
    return scores.groupBy(F.least(F.floor(F.col("score") / width), F.lit(100 // width - 1)).cast("long").alias("bin")).agg(F.count("*").alias("accounts"))


def composite(features: DataFrame) -> DataFrame:
    """The alternative score: a weighted sum of six features between 0 and 100, and its class."""
    total = (
        F.col("passthrough_ratio") * 40.0 + F.col("layering_depth") * 10.0 + F.col("fan_in_count") * 1.5 + F.col("fan_out_count") * 1.5 + F.col("sim_switch_count") * 3.0 + F.col("betweenness_centrality") * 10.0
    )
    out = features.withColumn("composite", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2))
    level = F.when(F.col("composite") > 79, "CRITICAL").when(F.col("composite") > 59, "HIGH").when(F.col("composite") > 29, "MEDIUM").otherwise("LOW")
    return out.withColumn("composite_band", level)
