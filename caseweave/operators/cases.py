"""Questions about a case: dashboards, timelines, appearances, seizures, versions, the brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.parsing import ist_hour
from caseweave.operators import windows
from caseweave.operators.features import oriented
from caseweave.operators.ranking import numbered


def dashboard(files: DataFrame, transfers: DataFrame, links: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: files, rows, entities, links, top score, its band and entity."""
    top = scores.agg(F.max("score").alias("top_score"), F.min_by("entity", F.struct(-F.col("score"), "entity")).alias("top_entity"), F.min_by("band", F.struct(-F.col("score"), "entity")).alias("top_band"), F.count("*").alias("entities"))
    parts = [files.agg(F.count("*").alias("files")), transfers.agg(F.count("*").alias("rows")), links.agg(F.count("*").alias("links"))]
    for p in parts:
        top = top.join(F.broadcast(p))
    return top.select("files", "rows", "entities", "links", "top_score", "top_band", "top_entity")


def timeline(transfers: DataFrame, entity: Column | None = None, kind: str | None = None, least: float | None = None, amount_text: str | None = None, end_text: str | None = None) -> DataFrame:
    """Events of an account in order, with a number and the minutes since the one before; amount_text is part of the
    written amount, end_text of either end."""
    rows = transfers
    if entity is not None:
        rows = rows.filter((F.col("src") == entity) | (F.col("dst") == entity)).withColumn("entity", entity)
    else:
        rows = rows.withColumn("entity", F.explode(F.array("src", "dst")))
    if kind:
        rows = rows.filter(F.col("event_type") == kind)
    if least is not None:
        rows = rows.filter(F.col("amount") >= least)
    if amount_text:
        rows = rows.filter(F.col("amount").cast("string").contains(amount_text))
    if end_text:
        rows = rows.filter(F.col("src").cast("string").contains(end_text) | F.col("dst").cast("string").contains(end_text))
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 60e6
    return rows.select("entity", F.row_number().over(w).alias("place"), "event_id", "event_type", "ts", "amount", F.round(gap, 3).alias("minutes_since"))


def listed(rows: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """rows in order with their place from 1; the first `limit` of them if one is given."""
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return numbered(rows, order, "place")


def found_cases(cases: DataFrame, text: str | None = None, status: str | None = None) -> DataFrame:
    """cases (case_id, title, status) of that status with the text in id or title."""
    out = cases if status is None else cases.filter(F.col("status") == status)
    if text:
        out = out.filter(F.lower("title").contains(text.lower()) | F.lower("case_id").contains(text.lower()))
    return out


def case_by_id(cases: DataFrame, case_id: Column) -> DataFrame:
    """The case of that id, no row where there is none."""
    return cases.filter(F.col("case_id") == case_id)


def last_entries(chain: DataFrame, n: int = 5) -> DataFrame:
    """The last n audit entries of each case, the latest first: case_id, place, seq, action, entry_hash."""
    w = Window.partitionBy("case_id").orderBy(F.desc("seq"))
    return chain.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("case_id", "place", "seq", "action", "entry_hash")


def found_scores(scores: DataFrame, band: str | None = None, on_path: DataFrame | None = None, fired: str | None = None) -> DataFrame:
    """scores of a band, of accounts (node) on a path, for which a rule fired."""
    out = scores if band is None else scores.filter(F.col("band") == band)
    if on_path is not None:
        out = out.join(on_path.select(F.col("node").alias("entity")).distinct(), "entity", "left_semi")
    return out if fired is None else out.filter(F.array_contains(F.split("rules_fired", ","), fired))


def appearances(mentions: DataFrame) -> DataFrame:
    """entity, file, n"""
    return mentions.groupBy("entity", "file").agg(F.count("*").alias("n"))


def seizures(transfers: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """Accounts of at least that score by what is left in them: entity, band, residual, balance, last_ts, ifsc, advice.

    The balance is that of the account's last payment that states one (balance_after), else null.
    """
    balance = F.col("balance_after") if "balance_after" in transfers.columns else F.lit(None).cast("decimal(18,2)")
    ends = F.array(
        F.struct(F.col("dst").alias("entity"), F.col("amount").alias("x"), F.lit(None).cast("decimal(18,2)").alias("b")),
        F.struct(F.col("src").alias("entity"), (-F.col("amount")).alias("x"), balance.cast("decimal(18,2)").alias("b")),
    )
    rows = transfers.select(F.explode(ends).alias("e"), "ts", "event_id").select("e.*", "ts", "event_id")
    last = F.max_by("b", F.when(F.col("b").isNotNull(), F.struct("ts", "event_id")))
    left = rows.groupBy("entity").agg(F.sum("x").cast("double").alias("residual"), F.max("ts").alias("last_ts"), last.cast("double").alias("balance"))
    out = scores.filter(F.col("score") >= least).join(left, "entity").filter("residual > 0")
    residual = F.round("residual", 2)
    ifsc = F.concat(F.lit("HDFC0"), F.lpad((F.col("entity") % 1000).cast("string"), 6, "0"))
    advice = F.concat(F.lit("Freeze account "), F.col("entity").cast("string"), F.lit(" at "), ifsc, F.lit(": "), F.format_number(residual, 2), F.lit(" left"))
    return out.select("entity", "band", residual.alias("residual"), "balance", "last_ts", ifsc.alias("ifsc"), advice.alias("advice"))


def neighbours(links: DataFrame) -> DataFrame:
    """entity, other, link_type, confidence from both ends of each link."""
    flip = links.select(F.col("b").alias("entity"), F.col("a").alias("other"), "link_type", "confidence")
    return links.select(F.col("a").alias("entity"), F.col("b").alias("other"), "link_type", "confidence").unionByName(flip)


def neighbour_counts(links: DataFrame, classes: DataFrame) -> DataFrame:
    """entity, link_type, value, others: distinct neighbours by link type, and by value for rows of shared_classes."""
    direct = neighbours(links).groupBy("entity", "link_type").agg(F.count_distinct("other").alias("others"))
    direct = direct.select("entity", "link_type", F.lit(None).cast("string").alias("value"), "others")
    return direct.unionByName(classes.select("entity", "link_type", "value", (F.col("users") - 1).alias("others")))


def search(entities: DataFrame, text: str | None = None, entity_type: str | None = None) -> DataFrame:
    out = entities
    if entity_type:
        out = out.filter(F.col("entity_type") == entity_type)
    if text:
        out = out.filter(F.lower("normalized").contains(text.lower()) | F.lower("raw").contains(text.lower()))
    return out


def history(versions: DataFrame) -> DataFrame:
    """entity, run_no, score, change since the run before, is_current."""
    w = Window.partitionBy("entity").orderBy("run_no")
    last = versions.groupBy("case_id").agg(F.max("run_no").alias("last"))
    rows = versions.withColumn("before", F.lag("score").over(w)).join(last, "case_id")
    return rows.select("entity", "run_no", "score", F.round(F.col("score") - F.col("before"), 4).alias("change"), (F.col("run_no") == F.col("last")).alias("is_current"))


def rule_events(transfers: DataFrame, uses: DataFrame | None = None, calls: DataFrame | None = None, minutes: int = 60) -> DataFrame:
    """entity, rule_code, event_id, amount: the events that met a rule, by account.

    R01 payments within the window after a credit; R02 and R03 receipts and payments inside the first two hours of most
    counterparties; R04 the transfers of the longest chain; R05 the calls of its handset of most SIMs inside the first
    week of most of them; R06 its own calls; R08 withdrawals; R10 transfers at night; R11 the debits after an unknown
    call; R07 and R12, which look at all of an account's money, all transfers.
    """
    both = oriented(transfers)
    w = Window.partitionBy("entity").orderBy(F.unix_micros("ts")).rangeBetween(-minutes * 60_000_000, 0)
    both = both.withColumn("credits", F.count_if(F.col("incoming") == 1).over(w))
    tests = {
        "R01": (F.col("incoming") == 0) & (F.col("credits") > 0), "R07": F.lit(True), "R08": F.col("event_type") == "ATM_WITHDRAWAL",
        "R10": ist_hour(F.col("ts")) < 5, "R12": F.lit(True),
    }
    codes = F.filter(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]), lambda x: x.isNotNull())
    rows = both.select("entity", F.explode(codes).alias("rule_code"), "event_id", "amount")
    for code, key, other in (("R02", "dst", "src"), ("R03", "src", "dst")):
        peak = windows.peak_events(transfers, key, other, "ts", "2 hours")
        rows = rows.unionByName(peak.select(F.col(key).alias("entity"), F.lit(code).alias("rule_code"), "event_id", "amount"))
    chain = windows.longest_chains(transfers).join(transfers.select("event_id", "amount"), "event_id")
    rows = rows.unionByName(chain.select(F.col("account").alias("entity"), F.lit("R04").alias("rule_code"), "event_id", "amount"))
    zero = F.lit(0).cast("decimal(18,2)").alias("amount")
    if uses is not None:
        peak = windows.peak_events(uses, "imei", "imsi", "ts", "7 days")
        own = uses.select("phone", "imei").distinct().join(peak.groupBy("imei").agg(F.max("most").alias("most")), "imei")
        handset = own.groupBy("phone").agg(F.min(F.struct((-F.col("most")).alias("less"), "imei")).alias("x")).select(F.col("phone").alias("entity"), F.col("x.imei").alias("imei"))
        rows = rows.unionByName(handset.join(peak, "imei").select("entity", F.lit("R05").alias("rule_code"), "event_id", zero))
        rows = rows.unionByName(uses.select(F.col("phone").alias("entity"), F.lit("R06").alias("rule_code"), "event_id", zero))
    if calls is not None:
        rows = rows.unionByName(calls.select(F.col("victim").alias("entity"), F.lit("R11").alias("rule_code"), F.col("transfer_id").alias("event_id"), zero))
    return rows.distinct()


def mail_refs(raw: DataFrame, mails: DataFrame, owners: DataFrame) -> DataFrame:
    """entity, rule_code (R09), file, source_row, sha256: the forged mails of an account, of raw (path, value) and its
    parsed mails; owners (address, entity)."""
    ends = mails.filter("spoofed").select("path", F.explode(F.array("sender", "recipient")).alias("address")).join(owners, "address").select("path", "entity").distinct()
    digests = raw.select("path", F.sha2(F.encode("value", "utf-8"), 256).alias("sha256"))
    return ends.join(digests, "path").select("entity", F.lit("R09").alias("rule_code"), F.col("path").alias("file"), F.lit(1).cast("long").alias("source_row"), "sha256")


def evidence_refs(reasons: DataFrame, rule_rows: DataFrame, files: DataFrame, per_reason: int = 5, other_refs: DataFrame | None = None) -> DataFrame:
    """Up to so many largest of the events that met each fired rule: entity, rule_code, event_id, file, source_row, sha256.

    rule_rows as of rule_events; files (event_id, file, source_row, sha256) says where an event stands; other_refs are
    places without an event, the first of them by name are taken.
    """
    fired = reasons.filter("triggered = 1").select("entity", "rule_code")
    w = Window.partitionBy("entity", "rule_code").orderBy(F.desc("amount"), "event_id")
    few = fired.join(rule_rows, ["entity", "rule_code"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_reason).drop("r", "amount")
    out = few.join(files, "event_id").select("entity", "rule_code", "event_id", "file", "source_row", "sha256")
    if other_refs is not None:
        by_name = Window.partitionBy("entity", "rule_code").orderBy("file", "source_row")
        more = fired.join(other_refs, ["entity", "rule_code"]).withColumn("r", F.row_number().over(by_name)).filter(F.col("r") <= per_reason)
        out = out.unionByName(more.select("entity", "rule_code", F.lit(None).cast("long").alias("event_id"), "file", "source_row", "sha256"))
    return out


def unsupported(reasons: DataFrame, refs: DataFrame) -> DataFrame:
    """Fired reasons without any evidence: must be empty."""
    return reasons.filter("triggered = 1").select("entity", "rule_code").join(refs, ["entity", "rule_code"], "left_anti")


def pipeline_status(actions: DataFrame, steps: list[str]) -> DataFrame:
    """case_id, step, done, last: from the audit actions of a case."""
    named = F.explode(F.array(*map(F.lit, steps)))
    all_ = actions.select("case_id").distinct().withColumn("step", named)
    done = actions.groupBy("case_id", F.col("action").alias("step")).agg(F.max("ts").alias("last"))
    return all_.join(done, ["case_id", "step"], "left").select("case_id", "step", F.col("last").isNotNull().alias("done"), "last")


def gates(cases: DataFrame) -> DataFrame:
    """case_id, ready: integrity checked within a day, at least one suspect, no unresolved mapping of low confidence."""
    ok = (F.col("hours_since_check") < 24) & (F.col("suspects") >= 1) & (F.col("low_confidence_mappings") == 0)
    return cases.select("case_id", F.coalesce(ok, F.lit(False)).alias("ready"))


def step_actions(**steps: DataFrame) -> DataFrame:
    """case_id, action, ts: a row for each step and case of which the step left something (case_id, ts)."""
    rows = None
    for name, df in steps.items():
        one = df.groupBy("case_id").agg(F.max("ts").alias("ts")).select("case_id", F.lit(name).alias("action"), "ts")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def gate_facts(status: DataFrame, checked: DataFrame, suspects: DataFrame, mappings: DataFrame) -> DataFrame:
    """What gates() asks, from the parts themselves: status (case_id, status) of integrity, checked (case_id, hours), suspects
    (case_id, score), mappings (case_id, confidence, is_confirmed).  A compromised case counts as never checked."""
    hours = checked.join(status, "case_id", "left").select("case_id", F.when(F.col("status") != "COMPROMISED", F.col("hours")).alias("hours_since_check"))
    own = suspects.filter("score >= 30").groupBy("case_id").agg(F.count("*").alias("suspects"))
    low = mappings.groupBy("case_id").agg(F.count_if((F.col("confidence") < 0.7) & ~F.col("is_confirmed")).alias("low_confidence_mappings"))
    out = hours.join(own, "case_id", "left").join(low, "case_id", "left")
    return out.select("case_id", "hours_since_check", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("suspects", "low_confidence_mappings")])


def brief(
    scores: DataFrame, seizure_rows: DataFrame, clusters: DataFrame, case_id: str, n: int = 5, events: DataFrame | None = None, audit_heads: DataFrame | None = None,
    header: DataFrame | None = None, reasons: DataFrame | None = None, files: DataFrame | None = None,
) -> DataFrame:
    """One row of JSON with sorted keys: the n top suspects with the rules that fired, seizures, and largest clusters with their
    first members; the first ten events of the timeline; the heads of up to n audit chains and the digests of up to n files
    (name, sha256) as appendix, with how many files there are; header (case_id, title, status, one row).

    The appendix names the first files only, so that a brief stays a page at any size; the manifest has them all.
    """
    first = lambda df, order, k, *names: df.orderBy(*order).limit(k).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s"))
    leading = scores.orderBy(F.desc("score"), "entity").limit(n)
    if reasons is not None:
        fired = reasons.filter("triggered = 1").join(F.broadcast(leading.select("entity")), "entity").groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_code", "points"))), lambda x: F.struct(x["points"].alias("points"), x["rule_code"].alias("rule_code"))).alias("reasons"))
        leading = leading.join(fired, "entity", "left")
    suspect = ["band", "entity", *(["reasons"] if reasons is not None else []), "score"]
    top = first(leading, [F.desc("score"), "entity"], n, (-F.col("score")).alias("order"), *[c for c in ("entity", "band", "score", "reasons") if c in suspect])
    top = top.select(F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in suspect])).alias("suspects"))
    take = first(seizure_rows, [F.desc("residual"), "entity"], n, (-F.col("residual")).alias("order"), "entity", "residual")
    take = take.select(F.transform("s", lambda x: F.struct(x["entity"].alias("entity"), x["residual"].alias("residual"))).alias("seizures"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    large = sizes.orderBy(F.desc("members"), "component").limit(n)
    # The first members of the few largest clusters only: ranked inside them, so no list of a whole cluster is made.
    inside = clusters.join(F.broadcast(large.select("component")), "component").withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy("node"))).filter("r <= 10")
    shown = inside.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("first"))
    large = first(large.join(shown, "component"), [F.desc("members"), "component"], n, (-F.col("members")).alias("order"), "component", "members", "first")
    large = large.select(F.transform("s", lambda x: F.struct(x["component"].alias("component"), x["first"].alias("first"), x["members"].alias("members"))).alias("largest_clusters"))
    parts = sizes.agg(F.count("*").alias("clusters"))
    one, names = top, ["clusters", "largest_clusters", "seizures", "suspects"]
    more = [take, large, parts]
    if events is not None:
        lines = first(events, ["ts", "event_id"], 10, "ts", "event_id", "src", "dst")
        more.append(lines.select(F.transform("s", lambda x: F.struct(x["dst"].alias("dst"), x["event_id"].alias("event_id"), x["src"].alias("src"))).alias("timeline")))
        names.append("timeline")
    if audit_heads is not None:
        more.append(first(audit_heads, ["case_id"], n, "case_id", "head_hash").withColumnRenamed("s", "hashes"))
        names.append("hashes")
    if files is not None:
        more += [first(files, ["name"], n, "name", "sha256").withColumnRenamed("s", "files"), files.agg(F.count("*").alias("n_files"))]
        names += ["files", "n_files"]
    if header is not None:
        more.append(header.select(F.struct("status", "title").alias("header")))
        names.append("header")
    for part in more:
        one = one.join(F.broadcast(part))
    return one.select(F.to_json(F.struct(F.lit(case_id).alias("case_id"), *sorted(names))).alias("brief"))
