"""Money trails in time, counted and ranked without a row a trail.

A trail is a path of transfers from a source to a target, each later than the one before, all within a window after
the first, through no account twice.  Three steps:

* chain_ends gives each transfer, for each number of hops, the earliest time at which a walk that begins with it can be
  at a target: a label-setting programme backwards in time, one running minimum an account and time bucket a hop.
* Prefixes grow forward over transfers that can still arrive in time.  Prefixes are one state if they have the same
  source, first time, end, arrival, and accounts that could be entered again; the state holds how many they are and the
  best of them.  Accounts that no later transfer enters within the window are forgotten, so that unlike prefixes meet.
* The last hop is not made: for each state and target it is counted, and its largest amount found, by places in the
  sorted times of the transfers between the two.

Counting paths that visit nothing twice cannot be polynomial in general; what grows here is the number of states, not
the number of trails.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.operators.checkpoints import cut

STATE = ["source", "t0", "end", "t", "seen"]


def _next(queries: DataFrame, account: str, values: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """queries (account, t, bucket, ...) with the least value, as `name`, of later values (at, t, bucket, value) of the
    account, those of its bucket and the next; buckets split an account of any number of transfers."""
    asked = queries.withColumns({"__a": F.col(account), "__b": F.col("bucket"), "__v": F.lit(None).cast(dict(values.dtypes)[value]), "__q": F.lit(True)})
    given = values.select(F.col(at).alias("__a"), F.explode(F.array("bucket", F.col("bucket") - 1)).alias("__b"), "t", F.col(value).alias("__v"), F.lit(False).alias("__q"))
    later = Window.partitionBy("__a", "__b").orderBy(-F.col("t")).rangeBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(given, allowMissingColumns=True).withColumn(name, F.min("__v").over(later))
    return both.filter("__q").drop("__a", "__b", "__v", "__q")


def timed(transfers: DataFrame, width: int) -> DataFrame:
    """event_id, src, dst, amount (hundredths), t (microseconds), bucket (of that width) of transfers between two accounts.

    Whole numbers, as equal sums must be equal whatever they are added up from.
    """
    t, amount = F.unix_micros("ts"), F.round(F.col("amount") * 100).cast("long")
    return transfers.filter("src <> dst").select("event_id", "src", "dst", amount.alias("amount"), t.alias("t"), F.floor(t / width).alias("bucket"))


def chain_ends(hops: DataFrame, width: int, max_hops: int, targets: DataFrame | None = None) -> DataFrame:
    """hops (as of timed) with k1, k2, ...: struct(end, ids) of the earliest end at a target (any account without
    targets) of a walk of so many hops that begins with the transfer, null beyond the width; ids are its transfers."""
    own = F.struct(F.col("t").alias("end"), F.array("event_id").alias("ids"))
    if targets is None:
        found = hops.withColumn("k1", own)
    else:
        goal = targets.select(F.col("node").alias("dst"), F.lit(True).alias("__goal")).distinct()
        found = hops.join(goal, "dst", "left").withColumn("k1", F.when(F.col("__goal"), own)).drop("__goal")
    found = cut(found)
    for k in range(2, max_hops + 1):
        before = found.filter(F.col(f"k{k - 1}").isNotNull()).select("src", "t", "bucket", f"k{k - 1}")
        found = _next(found, "dst", before, "src", f"k{k - 1}", "__best")
        best = F.struct(F.col("__best.end").alias("end"), F.concat(F.array("event_id"), "__best.ids").alias("ids"))
        found = cut(found.withColumn(f"k{k}", F.when(F.col("__best.end") <= F.col("t") + width, best)).drop("__best"))
        if found.filter(F.col(f"k{k}").isNotNull()).isEmpty():
            return reduce(lambda df, j: df.withColumn(f"k{j}", F.col(f"k{k}")), range(k + 1, max_hops + 1), found)
    return found


@dataclass
class Trails:
    """levels[h - 1]: states after h hops; moves[h - 1]: how states of h hops become those of h + 1; ends: a row a state
    and target, with the trails that end so; direct: trails of one hop. Their totals are in hundredths."""

    levels: list[DataFrame]
    moves: list[DataFrame]
    ends: DataFrame
    direct: DataFrame

    def pairs(self) -> DataFrame:
        """source, target, hops, total, minutes, path, n_paths: the trail of fewest hops, then the most money, then the
        first path as text, then the fewest minutes, and how many trails there are."""
        rows = self.ends.select("source", "target", "hops", "total", "minutes", "path", (F.col("n") * F.col("count")).alias("m"))
        rows = rows.unionByName(self.direct.select("source", "target", "hops", "total", "minutes", "path", F.col("n").alias("m")))
        order = F.struct("hops", -F.col("total"), "path", "minutes")
        best = rows.groupBy("source", "target").agg(F.min_by(F.struct("hops", "total", "minutes", "path"), order).alias("p"), F.sum("m").alias("n_paths"))
        return best.select("source", "target", "p.hops", (F.col("p.total") / 100).alias("total"), "p.minutes", "p.path", "n_paths")

    def through(self) -> DataFrame:
        """node, n_paths: how many trails pass through an account between their ends."""
        after = self.ends.groupBy("hops", *STATE).agg(F.sum("count").alias("more"))
        found, below = None, None
        for h in range(len(self.levels), 0, -1):
            own = after.filter(F.col("hops") == h + 1).select(*STATE, "more")
            if below is not None:
                child = below.select(*[F.col(c).alias(f"c_{c}") for c in STATE], "more")
                own = own.unionByName(self.moves[h - 1].join(child, [f"c_{c}" for c in STATE]).select(*STATE, (F.col("m") * F.col("more")).alias("more")))
            below = cut(own.groupBy(*STATE).agg(F.sum("more").alias("more")))
            part = self.levels[h - 1].join(below, STATE).select(F.col("end").alias("node"), (F.col("n") * F.col("more")).alias("n_paths"))
            found = part if found is None else found.unionByName(part)
        return found.groupBy("node").agg(F.sum("n_paths").alias("n_paths"))

    def share(self) -> DataFrame:
        """node, n_paths, share of all trails that pass through it between their ends."""
        total = self.ends.select((F.col("n") * F.col("count")).alias("m")).unionByName(self.direct.select(F.col("n").alias("m"))).agg(F.sum("m").alias("all"))
        return self.through().join(F.broadcast(total)).select("node", "n_paths", F.round(F.col("n_paths") / F.col("all"), 4).alias("share"))

    def nodes(self) -> DataFrame:
        """node: every account on a trail, ends included."""
        ends = self.pairs().select(F.explode(F.array("source", "target")).alias("node"))
        return self.through().select("node").unionByName(ends).distinct()


#: Rows of states and last transfers that one call looks at, about; an account's time bucket is never split.
GROUP_ROWS = 50_000


def _last_hops(width: int, keys: list[str]):
    """States and last transfers of some accounts and time buckets -> a row a state and target."""

    def run(_, states: pd.DataFrame, hops: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "n", "total", "path", "hops", "target", "count", "arrival"]
        hops = hops.sort_values(["src", "bucket", "dst", "t", "event_id"], kind="stable", ignore_index=True)
        hops["pair"] = hops.groupby(["src", "bucket", "dst"], sort=False).ngroup()
        pairs = hops.drop_duplicates("pair")[["src", "bucket", "dst", "pair"]].rename(columns={"src": "end", "dst": "target"})
        rows = states.merge(pairs, on=["end", "bucket"])
        rows = rows[[not len(s) or x not in s for s, x in zip(rows["seen"], rows["target"], strict=True)]]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        # Times inside their bucket, after the pair's number: one sorted array for all pairs.
        inside = lambda t, of: of["pair"] * (width + 2) + (t - of["bucket"] * width).clip(-1, width) + 1
        at = inside(hops["t"], hops).to_numpy()
        first, last = np.searchsorted(at, inside(rows["t"], rows), "right"), np.searchsorted(at, inside(rows["t0"] + width, rows), "right")
        keep = last > first
        rows, first, last = rows[keep].copy(), first[keep], last[keep]
        # Places of the largest of runs of 1, 2, 4, ... amounts, the first of equal ones; two runs cover any range.
        amount, size = hops["amount"].to_numpy(), np.frexp((last - first).astype(float))[1] - 1
        largest, best = np.arange(len(amount)), np.zeros(len(rows), np.int64)
        for k in range(int(size.max(initial=0)) + 1):
            own = size == k
            one, two = largest[first[own]], largest[last[own] - (1 << k)]
            best[own] = np.where(amount[two] > amount[one], two, one)
            one, two = largest[: -(1 << k)], largest[1 << k :]
            largest = np.where(amount[two] > amount[one], two, one)
        rows["count"], rows["total"], rows["arrival"] = last - first, rows["total"] + amount[best], hops["t"].to_numpy()[best]
        return rows[columns]

    return run


def trails(transfers: DataFrame, sources: DataFrame, targets: DataFrame, minutes: float, max_hops: int = 6) -> Trails:
    """Trails from sources (node) to targets (node) of transfers (event_id, src, dst, amount, ts)."""
    width = int(minutes * 60_000_000)
    ks = [f"k{k}" for k in range(1, max_hops + 1)]
    hops = chain_ends(timed(transfers, width), width, max_hops, targets).filter(F.coalesce(*ks).isNotNull())
    hops = _next(hops, "dst", hops.select("dst", "t", "bucket", F.col("t").alias("u")), "dst", "u", "again")
    hops = cut(_next(hops, "src", hops.select("dst", "t", "bucket", F.col("t").alias("u")), "dst", "u", "back"))
    last = hops.filter("k1 is not null").select("event_id", "src", "dst", "amount", "t", "bucket")
    n_last = last.count()
    onward = cut(hops.filter(F.coalesce(*ks[1:]).isNotNull())) if max_hops > 1 else hops.limit(0)
    text = lambda c: F.col(c).cast("string")

    def grouped(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("total")).alias("cost"), "path")).alias("b")
        return rows.groupBy(*STATE).agg(F.sum("n").alias("n"), best).select(*STATE, "n", (-F.col("b.cost")).alias("total"), F.col("b.path").alias("path"))

    def kept(*accounts) -> F.Column:
        """Those of (account, next time that it is entered) that can be entered again within the window."""
        return F.filter(F.array(*[F.when(at <= F.col("t0") + width, F.col(a)) for a, at in accounts]), lambda x: x.isNotNull())

    first = hops.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi").withColumn("t0", F.col("t"))
    path = F.concat(text("src"), F.lit(">"), text("dst"))
    none = F.lit(0.0)
    direct = first.filter("k1 is not null").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).alias("hops"), "amount", path.alias("path"))
    direct = cut(direct.groupBy("source", "target", "hops", "path").agg(F.max("amount").alias("total"), F.count("*").alias("n")).withColumn("minutes", none))
    seen = F.array_sort(kept(("src", F.col("back")), ("dst", F.col("again"))))
    start = first.select(F.col("src").alias("source"), "t0", F.col("dst").alias("end"), "t", seen.alias("seen"), F.lit(1).cast("long").alias("n"), F.col("amount").alias("total"), path.alias("path"))
    levels, moves, ends = [cut(grouped(start))], [], []
    kind = dict(hops.dtypes)["src"]
    shape = f"source {kind}, t0 long, end {kind}, t long, seen array<{kind}>, n long, total long, path string, hops int, target {kind}, count long, arrival long"
    for h in range(1, max_hops):
        level = levels[-1]
        near = F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1))
        asked = level.withColumn("hops", F.lit(h + 1)).withColumn("bucket", near).filter(F.col("bucket") <= F.floor((F.col("t0") + width) / width))
        asked = asked.join(last.select(F.col("src").alias("end"), "bucket").distinct(), ["end", "bucket"], "left_semi")
        groups = 1 + (level.count() + n_last) // GROUP_ROWS
        dealt = lambda df, account: df.groupBy(F.pmod(F.xxhash64(account, "bucket"), F.lit(groups)).alias("group"))
        ends.append(dealt(asked, "end").cogroup(dealt(last, "src")).applyInPandas(_last_hops(width, STATE), shape))
        if h + 1 == max_hops:
            break
        step = onward.select(F.col("src").alias("end"), "bucket", F.col("dst").alias("to"), F.col("t").alias("t1"), F.col("amount").alias("a"), "again", *ks[1 : max_hops - h])
        in_time = F.coalesce(F.least(*[F.col(f"{k}.end") for k in ks[1 : max_hops - h]]) if max_hops - h > 2 else F.col(f"{ks[1]}.end"), F.lit(None))
        grown = level.withColumn("bucket", near).join(step, ["end", "bucket"])
        until = F.col("t0") + width
        grown = grown.filter((F.col("t1") > F.col("t")) & (F.col("t1") <= until) & (in_time <= until) & ~F.array_contains("seen", F.col("to")))
        more = F.array_sort(F.concat("seen", kept(("to", F.col("again")))))
        grown = cut(grown.withColumn("c_seen", more).withColumn("c_path", F.concat("path", F.lit(">"), text("to"))).drop("bucket", "again", *ks[1 : max_hops - h]))
        child = [F.col("source").alias("c_source"), F.col("t0").alias("c_t0"), F.col("to").alias("c_end"), F.col("t1").alias("c_t"), "c_seen"]
        moves.append(cut(grown.select(*STATE, *child).groupBy(*STATE, *[f"c_{c}" for c in STATE]).agg(F.count("*").alias("m"))))
        made = grown.select("source", "t0", F.col("to").alias("end"), F.col("t1").alias("t"), F.col("c_seen").alias("seen"), "n", (F.col("total") + F.col("a")).alias("total"), F.col("c_path").alias("path"))
        level = cut(grouped(made))
        if level.isEmpty():
            moves.pop()
            break
        levels.append(level)
    if not ends:
        empty = transfers.sparkSession.createDataFrame([], shape)
        ends = [empty]
    all_ends = reduce(DataFrame.unionByName, ends)
    minutes_ = F.round((F.col("arrival") - F.col("t0")) / 60e6, 2)
    all_ends = all_ends.withColumns({"minutes": minutes_, "path": F.concat("path", F.lit(">"), text("target"))})
    return Trails(levels, moves, cut(all_ends), direct)
