"""Rules over time: fan-in and fan-out, pass-through, layering chains, SIM switches, calls before debits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.operators.proximity import Proximity
from caseweave.operators.trails import chain_ends, timed


#: Microseconds of a stretch of time that one task sums up for a key: a day, or the interval if that is longer.
STRETCH = 86_400_000_000


def _presences(events: DataFrame, key: str, other: str, ts: str, interval: str) -> DataFrame:
    """key, at, n: how many different `other` values a key has in the interval up to each time at which that changes.

    A value is present from an event until the interval after its last one is over.  Presences that run into each
    other are one; their beginnings and ends are summed in time, so the work grows with the events of a key and not with
    its square.
    """
    width = _seconds(interval) * 1_000_000
    t = F.unix_micros(F.col(ts))
    own = Window.partitionBy(key, other).orderBy("t")
    rows = events.filter(F.col(key).isNotNull() & F.col(other).isNotNull()).select(key, other, t.alias("t"))
    begins = F.coalesce(F.col("t") - F.lag("t").over(own) > width, F.lit(True))
    ends = F.coalesce(F.lead("t").over(own) - F.col("t") > width, F.lit(True))
    rows = rows.select(key, "t", begins.alias("begins"), ends.alias("ends"))
    marks = F.array(F.when(F.col("begins"), F.struct(F.col("t").alias("at"), F.lit(1).alias("by"))), F.when(F.col("ends"), F.struct((F.col("t") + width + 1).alias("at"), F.lit(-1).alias("by"))))
    moves = rows.select(key, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).groupBy(key, "m.at").agg(F.sum("m.by").alias("by"))
    # Sums run inside a stretch of time and begin with what the stretches before leave: a key of any size is many tasks.
    moves = moves.withColumn("stretch", F.floor(F.col("at") / max(width, STRETCH)))
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = moves.groupBy(key, "stretch").agg(F.sum("by").alias("by")).select(key, "stretch", F.coalesce(F.sum("by").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(key, "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.withColumn("n", F.sum("by").over(inside)).join(base, [key, "stretch"]).select(key, "at", (F.col("n") + F.col("base")).alias("n"))


def distinct_in_window(events: DataFrame, key: str, other: str, ts: str, interval: str) -> DataFrame:
    """Most different `other` values of a key in any trailing interval: key, most."""
    return _presences(events, key, other, ts, interval).groupBy(key).agg(F.max("n").cast("long").alias("most"))


def peak_events(events: DataFrame, key: str, other: str, ts: str, interval: str) -> DataFrame:
    """The rows of events inside the first interval in which their key has most different `other` values, with most."""
    width = _seconds(interval) * 1_000_000
    top = _presences(events, key, other, ts, interval).groupBy(key).agg(F.max(F.struct("n", (-F.col("at")).alias("before"))).alias("x"))
    top = top.select(F.col(key).alias("__key"), F.col("x.n").cast("long").alias("most"), (-F.col("x.before")).alias("__at"))
    both = events.join(top, F.col(key) == F.col("__key")).filter(F.unix_micros(F.col(ts)).between(F.col("__at") - width, F.col("__at")) & F.col(other).isNotNull())
    return both.drop("__key", "__at")


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def windowed_pass_through(transfers: DataFrame, minutes: int = 60) -> DataFrame:
    """account, credited, forwarded, ratio: for each credit, the debits within the window after it, no more than the
    credit itself; summed over the account's credits."""
    credit = transfers.select(F.col("dst").alias("account"), F.col("event_id").alias("credit_id"), F.col("amount").alias("credit"), F.col("ts").alias("t0"))
    debit = transfers.select(F.col("src").alias("account"), F.col("amount").alias("debit"), F.col("ts").alias("t1"))
    # A window per account and stretch of time instead of a range join: rows grow with the events, not with credit-debit
    # pairs, and a busy account is many tasks.  A debit also stands in the stretch before its own, for that one's credits.
    width = minutes * 60 * 1_000_000
    stretch = F.floor(F.unix_micros("t") / width)
    both = credit.select("account", "credit_id", "credit", F.lit(0).cast("decimal(18,2)").alias("debit"), F.col("t0").alias("t")).withColumn("stretch", stretch).unionByName(
        debit.select("account", F.lit(None).cast("long").alias("credit_id"), F.lit(0).cast("decimal(18,2)").alias("credit"), "debit", F.col("t1").alias("t")).withColumn(
            "stretch", F.explode(F.array(stretch, stretch - 1))
        )
    )
    w = Window.partitionBy("account", "stretch").orderBy(F.unix_micros("t")).rangeBetween(0, width)
    after = both.withColumn("out", F.sum("debit").over(w)).filter("credit_id is not null")
    sums = after.groupBy("account").agg(F.sum("credit").alias("credited"), F.sum(F.least("credit", "out")).alias("forwarded"))
    return sums.withColumn("ratio", F.round(F.col("forwarded").cast("double") / F.col("credited").cast("double"), 4))


def layering_chains(transfers: DataFrame, minutes: int = 30, max_hops: int = 6) -> DataFrame:
    """account, depth: most hops of a chain that leaves the account, each hop later than the one before and all
    within the window after the first.

    For each transfer and number of hops only the earliest end is kept (see trails.chain_ends): rows stay as many as
    the transfers, and an account is split by time.
    """
    width = minutes * 60_000_000
    found = chain_ends(timed(transfers, width), width, max_hops)
    depth = F.coalesce(*[F.when(F.col(f"k{k}").isNotNull(), F.lit(k)) for k in range(max_hops, 0, -1)])
    return found.groupBy(F.col("src").alias("account")).agg(F.max(depth).cast("long").alias("depth"))


def longest_chains(transfers: DataFrame, minutes: int = 30, max_hops: int = 6) -> DataFrame:
    """account, event_id: the transfers of one longest chain of each account, the one that begins and then ends first."""
    width = minutes * 60_000_000
    found = chain_ends(timed(transfers, width), width, max_hops)
    best = F.coalesce(*[F.when(F.col(f"k{k}").isNotNull(), F.struct(F.lit(-k).alias("k"), "t", F.col(f"k{k}.end").alias("end"), F.col(f"k{k}.ids").alias("ids"))) for k in range(max_hops, 0, -1)])
    return found.groupBy(F.col("src").alias("account")).agg(F.min(best).alias("x")).select("account", F.explode("x.ids").alias("event_id"))


def call_then_transfer(calls: DataFrame, transfers: DataFrame, owners: DataFrame, minutes: int = 15) -> DataFrame:
    """victim, call_id, transfer_id: a call from a number never in contact before, at most so long before a debit.

    owners (phone, account) states which phone belongs to which account; the caller is unknown if no earlier call
    joined the two numbers in either direction.
    """
    named = calls.select(F.col("event_id").alias("call_id"), F.col("src").alias("caller"), F.col("dst").alias("callee"), F.col("ts").alias("call_ts"))
    pair = [F.least("caller", "callee").alias("x"), F.greatest("caller", "callee").alias("y")]
    first = named.groupBy(*pair).agg(F.min("call_ts").alias("first_ts"))
    fresh = named.select("*", *pair).join(first, ["x", "y"]).filter("call_ts = first_ts")
    debit = transfers.select(F.col("event_id").alias("transfer_id"), F.col("src").alias("account"), F.col("ts").alias("debit_ts"))
    inbound = fresh.join(owners.select(F.col("phone").alias("callee"), "account"), "callee")
    # Buckets of the window's width turn the range into an equi-join on account and bucket.
    width = minutes * 60
    inbound = inbound.withColumn("bucket", F.explode(F.array(*[F.floor(F.unix_seconds("call_ts") / width) + k for k in (0, 1)])))
    debit = debit.withColumn("bucket", F.floor(F.unix_seconds("debit_ts") / width))
    gap = F.unix_micros("debit_ts") - F.unix_micros("call_ts")
    hit = inbound.join(debit, ["account", "bucket"]).filter((gap >= 0) & (gap < width * 1_000_000))
    return hit.select(F.col("account").alias("victim"), "call_id", "transfer_id")


#: Payers of one counterparty and time bucket that one block of a join holds.
BLOCK = 1_000


def time_proximity(events: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Unordered pairs of keys with events of one counterparty at most so far apart: a, b, n (pairs of events)."""
    return Proximity(events, key, ts, minutes, BLOCK).pairs()
