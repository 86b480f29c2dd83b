"""Links between entities: shared attributes, recurring beneficiaries, money flows; merging and corroboration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.config import ACTIVE_CONFIDENCE, CONFIDENCE
from caseweave.operators.checkpoints import cut
from caseweave.operators.proximity import Proximity
from caseweave.operators.ranking import numbered

LINK_COLUMNS = ["a", "b", "link_type", "confidence", "support", "total_amount", "first_at", "last_at"]


def _linked(pairs: DataFrame, link_type: str, confidence=None) -> DataFrame:
    """Link columns; what a link type does not have is null."""
    have = set(pairs.columns)
    null = {"support": "bigint", "total_amount": "decimal(18,2)", "first_at": "timestamp", "last_at": "timestamp"}
    out = pairs.withColumn("link_type", F.lit(link_type)).withColumn("confidence", F.lit(CONFIDENCE.get(link_type)) if confidence is None else confidence)
    for name, kind in null.items():
        out = out.withColumn(name, (F.col(name) if name in have else F.lit(None)).cast(kind))
    return out.select(*LINK_COLUMNS)


def shared_attribute(uses: DataFrame, entity: str, attribute: str, link_type: str, least: int = 2) -> DataFrame:
    """Unordered pairs of entities that use one attribute value, all of them: for values of few users (else shared_classes)."""
    own = uses.filter(F.col(entity).isNotNull() & F.col(attribute).isNotNull()).groupBy(F.col(entity).alias("e"), F.col(attribute).alias("v"))
    own = own.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    size = own.groupBy("v").agg(F.count("*").alias("users")).filter(F.col("users") >= least)
    own = own.join(size, "v")
    other = own.select("v", F.col("e").alias("b"), F.col("first_at").alias("f2"), F.col("last_at").alias("l2"))
    pairs = own.join(other, "v").filter(F.col("e") < F.col("b"))
    pairs = pairs.groupBy(F.col("e").alias("a"), "b").agg(
        F.max("users").alias("support"), F.min(F.least("first_at", "f2")).alias("first_at"), F.max(F.greatest("last_at", "l2")).alias("last_at"), F.max("v").alias("v")
    )
    if link_type == "RECURRING_BENEFICIARY":
        return _linked(pairs, link_type, F.least(F.lit(0.95), F.lit(CONFIDENCE[link_type]) + F.lit(0.02) * F.col("support")))
    return _linked(pairs, link_type)


def busiest(uses: DataFrame, entity: str, attribute: str, n: int | None = None) -> DataFrame:
    """place, value, users of all values by how many entities share them, or of the first n."""
    own = uses.select(F.col(entity).alias("entity"), F.col(attribute).alias("value")).dropna().distinct()
    users, order = own.groupBy("value").agg(F.count("*").alias("users")), [F.desc("users"), F.col("value")]
    if n is not None:
        users = users.orderBy(*order).limit(n)
    return numbered(users, order, "place").select("place", "value", "users")


def hubs(uses: DataFrame, entity: str, attribute: str) -> DataFrame:
    """place, value, entity, users: every entity of every value, a row each, values by how many entities share them."""
    own = uses.select(F.col(entity).alias("entity"), F.col(attribute).alias("value")).dropna().distinct()
    return own.join(busiest(uses, entity, attribute), "value").select("place", "value", "entity", "users")


def shared_classes(uses: DataFrame, entity: str, attribute: str, link_type: str, least: int = 2) -> DataFrame:
    """One row per value and entity that uses it: link_type, value, entity, users, smallest, confidence, first_at, last_at.

    Two entities are linked if they share a value: every pair of users, in rows that grow as
    the uses do and not as the square of a value's users.
    """
    own = uses.filter(F.col(entity).isNotNull() & F.col(attribute).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(attribute).alias("value"))
    own = own.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    size = own.groupBy("value").agg(F.count("*").alias("users"), F.min("entity").alias("smallest")).filter(F.col("users") >= least)
    confidence = F.lit(CONFIDENCE[link_type]).cast("double")
    if link_type == "RECURRING_BENEFICIARY":
        confidence = F.least(F.lit(0.95), confidence + F.lit(0.02) * F.col("users"))
    found = own.join(size, "value").withColumn("confidence", confidence).withColumn("link_type", F.lit(link_type))
    return found.select("link_type", F.col("value").cast("string").alias("value"), "entity", "users", "smallest", "confidence", "first_at", "last_at")


#: Members of an entity's classes up to which its neighbours are listed; beyond, they are bits.
LISTED = 64


def class_neighbours(classes: DataFrame) -> DataFrame:
    """entity, link_type, n, others: how many links an entity has through its values (n, by value), and to how many
    different entities, of rows of shared_classes.

    Exact and without pairs: an entity of one value has its other users; one whose values have few members in all lists
    them; the rest OR the bitmaps of their values, once for all entities of equal values, and count the bits.
    """
    own = F.transform(F.array_sort(F.collect_list(F.struct("value", "users"))), lambda x: x["value"])
    per = cut(classes.groupBy("entity", "link_type").agg(own.alias("values"), F.sum(F.col("users") - 1).alias("n"), F.sum("users").alias("members")))
    one = per.filter(F.size("values") == 1).select("entity", "link_type", "n", F.col("n").alias("others"))
    few = per.filter((F.size("values") > 1) & (F.col("members") <= LISTED))
    member = classes.select("link_type", "value", F.col("entity").alias("other"))
    listed = few.select("entity", "link_type", "n", F.explode("values").alias("value")).join(member, ["link_type", "value"]).filter("other <> entity")
    listed = listed.groupBy("entity", "link_type", "n").agg(F.count_distinct("other").alias("others"))
    # Entities of equal values have equal neighbours, themselves included: one bitmap for all of them.
    many = per.filter((F.size("values") > 1) & (F.col("members") > LISTED))
    sets = many.select("link_type", "values").distinct().select("link_type", "values", F.explode("values").alias("value"))
    numbers = numbered(classes.select("entity").distinct(), [F.col("entity")], "no").withColumnRenamed("entity", "other")
    used = member.join(sets.select("link_type", "value").distinct(), ["link_type", "value"], "left_semi").join(numbers, "other")
    bits = used.groupBy("link_type", "value", F.bitmap_bucket_number("no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits"))
    union = sets.join(bits, ["link_type", "value"]).groupBy("link_type", "values", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    sizes = union.groupBy("link_type", "values").agg((F.sum(F.bitmap_count("bits")) - 1).alias("others"))
    rest = many.join(sizes, ["link_type", "values"]).select("entity", "link_type", "n", "others")
    return one.unionByName(listed).unionByName(rest)


def as_stars(classes: DataFrame) -> DataFrame:
    """Rows of shared_classes as links a, b, link_type, value, confidence, support from each value's smallest entity to its others."""
    return classes.filter(F.col("entity") != F.col("smallest")).select(F.col("smallest").alias("a"), F.col("entity").alias("b"), "link_type", "value", "confidence", F.col("users").alias("support"))


def surfaced_classes(links: DataFrame, classes: DataFrame, dismissed: DataFrame | None = None, threshold: float = ACTIVE_CONFIDENCE) -> DataFrame:
    """What surfaced() shows of links and strong classes: a weak link stays beside a strong one, or where its ends share a strong class.

    A dismissed pair (a, b, link_type) of a class corroborates nothing; the class itself stays.
    """
    strong = classes.filter(F.col("confidence") >= threshold)
    if dismissed is not None:
        links = links.join(dismissed, ["a", "b", "link_type"], "left_anti")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    ends = links.groupBy(*pair).agg(F.max("confidence").alias("best"))
    of = lambda end: strong.select(F.col("entity").alias(end), "link_type", "value")
    shared = ends.filter(F.col("best") < threshold).join(of("a"), "a").join(of("b"), ["b", "link_type", "value"]).select("a", "b", "link_type").distinct()
    if dismissed is not None:
        shared = shared.join(dismissed.select(*pair, "link_type").distinct(), ["a", "b", "link_type"], "left_anti")
    shown = ends.filter(F.col("best") >= threshold).select("a", "b").unionByName(shared.select("a", "b").distinct())
    shown = shown.select(F.col("a").alias("x"), F.col("b").alias("y"))
    kept = links.join(shown, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_semi")
    kept = kept.select("a", "b", "link_type", F.lit(None).cast("string").alias("value"), "confidence", "support")
    return kept.unionByName(as_stars(strong))


def surfaced_near(flows: DataFrame, near: Proximity, classes: DataFrame, dismissed: DataFrame | None = None, threshold: float = ACTIVE_CONFIDENCE) -> DataFrame:
    """surfaced_classes() of flows together with the links of near, which are chosen where they are found and never joined.

    dismissed are flows.
    """
    strong = cut(classes.filter(F.col("confidence") >= threshold))
    names = numbered(strong.select("link_type", "value").distinct(), [F.col("link_type"), F.col("value")], "class")
    kept = flows if dismissed is None else flows.join(dismissed, ["a", "b", "link_type"], "left_anti")
    if CONFIDENCE["TEMPORAL_PROXIMITY"] >= threshold:
        shown = near.pairs()
    else:
        shown = near.chosen(strong.join(names, ["link_type", "value"]).select("entity", "class"), kept.filter(F.col("confidence") >= threshold).select("a", "b"))
    weak = _linked(shown.withColumnRenamed("n", "support"), "TEMPORAL_PROXIMITY").select("a", "b", "link_type", F.lit(None).cast("string").alias("value"), "confidence", "support")
    return surfaced_classes(flows, strong, dismissed, threshold).unionByName(weak)


def support_events(transfers: DataFrame) -> DataFrame:
    """a, b, event_id, ts, amount: the transfers behind each link of fund_flow, a row each."""
    return transfers.select(F.col("src").alias("a"), F.col("dst").alias("b"), "event_id", "ts", "amount")


def accuracy(statuses: DataFrame) -> DataFrame:
    """One row of compared(): matched, missed, false_links, recall, precision, false_rate."""
    one = statuses.agg(*[F.count_if(F.col("status") == x).alias(n) for n, x in (("matched", "MATCHED"), ("missed", "MISSED"), ("false_links", "FALSE"))])
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    m, lost, wrong = F.col("matched"), F.col("missed"), F.col("false_links")
    return one.select("matched", "missed", "false_links", share(m, m + lost).alias("recall"), share(m, m + wrong).alias("precision"), share(wrong, m + wrong).alias("false_rate"))


def fund_flow(transfers: DataFrame) -> DataFrame:
    """Directed: source, destination, number of transfers, total, first and last time."""
    pairs = transfers.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(
        F.count("*").alias("support"), F.sum("amount").cast("decimal(18,2)").alias("total_amount"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )
    return _linked(pairs, "FUND_FLOW")


def merged(links: DataFrame) -> DataFrame:
    """One link per (a, b, type): the highest confidence, then the most support, then the earliest."""
    best = F.max_by(F.struct(*LINK_COLUMNS[3:]), F.struct("confidence", F.coalesce("support", F.lit(-1)), -F.unix_micros("first_at")))
    return links.groupBy("a", "b", "link_type").agg(best.alias("x")).select("a", "b", "link_type", "x.*")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of `new` replace those of `old` with the same (a, b, type); first_at stays the earliest."""
    both = old.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1)))
    last = F.max_by(F.struct("confidence", "support", "total_amount", "last_at"), "load")
    out = both.groupBy("a", "b", "link_type").agg(last.alias("x"), F.min("first_at").alias("first_at"))
    return out.select("a", "b", "link_type", "x.confidence", "x.support", "x.total_amount", "first_at", "x.last_at")


def surfaced(links: DataFrame, dismissed: DataFrame | None = None, threshold: float = ACTIVE_CONFIDENCE) -> DataFrame:
    """Links worth showing: strong ones, and weak ones beside a strong one of the same pair in either direction."""
    if dismissed is not None:
        links = links.join(dismissed, ["a", "b", "link_type"], "left_anti")
    pair = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b"))
    return links.withColumn("best", F.max("confidence").over(pair)).filter(F.col("best") >= threshold).drop("best")


def compared(found: DataFrame, expected: DataFrame) -> DataFrame:
    """a, b, link_type, status MATCHED, MISSED or FALSE over unordered pairs."""
    norm = lambda df, flag: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "link_type", F.lit(True).alias(flag)).distinct()
    both = norm(found, "f").join(norm(expected, "e"), ["a", "b", "link_type"], "full_outer")
    status = F.when(F.col("f") & F.col("e"), "MATCHED").when(F.col("e"), "MISSED").otherwise("FALSE")
    return both.select("a", "b", "link_type", status.alias("status"))


def rationale(links: DataFrame) -> DataFrame:
    """links with a sentence for each."""
    n = F.col("support").cast("string")
    text = (
        F.when(F.col("link_type") == "FUND_FLOW", F.concat(F.lit("Money moved directly: "), F.format_number(F.col("total_amount").cast("double"), 2), F.lit(" in "), n, F.lit(" transfers.")))
        .when(F.col("link_type") == "RECURRING_BENEFICIARY", F.concat(F.lit("Both paid one beneficiary, as did "), n, F.lit(" payers in all.")))
        .when(F.col("link_type") == "TEMPORAL_PROXIMITY", F.concat(F.lit("Paid one account within an hour of each other, times: "), n, F.lit(".")))
        .otherwise(F.concat(F.lit("Both used one "), F.lower(F.regexp_replace("link_type", "^SHARED_", "")), F.lit("; users: "), n, F.lit(".")))
    )
    return links.withColumn("rationale", text)
