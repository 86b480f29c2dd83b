"""Graph jobs over an edge table (src, dst, ...): degrees, patterns, paths, ranks, components, betweenness.

Loops are bounded, stop on an empty frontier and cut their lineage with checkpoint() every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.operators.checkpoints import cut as _cut
from caseweave.operators.ranking import numbered


def build(entities: DataFrame, links: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): links of any type, and transfers of which both ends are nodes."""
    nodes = entities.select("entity").distinct()
    inside = transfers.join(nodes.withColumnRenamed("entity", "src"), "src", "left_semi").join(nodes.withColumnRenamed("entity", "dst"), "dst", "left_semi")
    own = inside.select("src", "dst", F.lit("TRANSFER").alias("edge_type"), "amount", "ts", "event_id")
    null = {"amount": "decimal(18,2)", "ts": "timestamp", "event_id": "bigint"}
    linked = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("link_type").alias("edge_type"), *[F.lit(None).cast(k).alias(n) for n, k in null.items()])
    return nodes, own.unionByName(linked)


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, counting parallel edges."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))
    both = edges.select(F.explode(ends).alias("e")).select("e.*")
    return both.groupBy("node").agg(F.count_if(F.col("o") == 0).alias("in_degree"), F.count_if(F.col("o") == 1).alias("out_degree"))


def patterns(edges: DataFrame, least: int = 8) -> DataFrame:
    """node, is_fan_in, is_fan_out, is_pass_through."""
    d = degrees(edges)
    return d.select("node", (F.col("in_degree") >= least).alias("is_fan_in"), (F.col("out_degree") >= least).alias("is_fan_out"), ((F.col("in_degree") > 0) & (F.col("out_degree") > 0)).alias("is_pass_through"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, rank; parallel edges weigh their number, dangling mass is spread evenly; stops below tolerance a node."""
    w = edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("total"))
    share = _cut(w.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = _cut(degrees(edges).select("node", (F.col("out_degree") == 0).alias("dangling")))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = rank.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = share.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        new = _cut(rank.withColumnRenamed("rank", "old").join(got, "node", "left").select("node", "dangling", "old", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new.drop("old")
        if change < n * tolerance:
            break
    return rank.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), by minimum labels with pointer jumping."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = _cut(both)
    label = _cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = new.select(F.col("node").alias("c"), F.col("c").alias("next"))
        new = _cut(new.join(jump, "c", "left").select("node", "old", F.coalesce("next", "c").alias("component")))
        if new.filter("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 6, directed: bool = True, timed: bool = False, minutes: float | None = None) -> DataFrame:
    """source, target, hops, path, total, minutes of every simple path from sources (node) to targets (node).

    With `timed` each hop is later than the one before, and with `minutes` at most so long after the first; then every
    transfer is a hop of its own, and trails of equal nodes count one by one.
    """
    hops = edges.select("src", "dst", F.col("amount").cast("double").alias("amount"), F.unix_micros("ts").alias("t"))
    if not directed:
        hops = hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "amount", "t"))
    if not timed:
        hops = hops.groupBy("src", "dst").agg(F.sum("amount").alias("amount"), F.min("t").alias("t"))
    step = hops.select(F.col("src").alias("end"), F.col("dst").alias("to"), F.col("amount").alias("a"), F.col("t").alias("t1"))
    front = sources.select(F.col("node").alias("source"), F.col("node").alias("end"), F.array("node").alias("path"), F.lit(0.0).alias("total"), F.lit(None).cast("long").alias("t0"), F.lit(None).cast("long").alias("t"))
    goal = targets.select(F.col("node").alias("end"))
    found = None
    for hop in range(1, max_hops + 1):
        later = F.col("t").isNull() | (F.col("t1") > F.col("t")) if timed else F.lit(True)
        if minutes is not None:
            later = later & (F.col("t0").isNull() | (F.col("t1") - F.col("t0") <= minutes * 60e6))
        front = front.join(step, "end").filter(later & ~F.array_contains("path", F.col("to")))
        front = front.select("source", F.col("to").alias("end"), F.concat("path", F.array("to")).alias("path"), (F.col("total") + F.col("a")).alias("total"), F.coalesce("t0", "t1").alias("t0"), F.col("t1").alias("t"))
        if hop > 2:
            front = _cut(front)
            if front.isEmpty():
                break
        hit = front.join(goal, "end", "left_semi").select("source", F.col("end").alias("target"), F.lit(hop).alias("hops"), "path", F.round("total", 2).alias("total"), F.round((F.col("t") - F.col("t0")) / 60e6, 2).alias("minutes"))
        found = hit if found is None else found.unionByName(hit)
    return found


def best_paths(path_rows: DataFrame) -> DataFrame:
    """The path of fewest hops, then the most money, of each source and target."""
    order = F.struct("hops", -F.col("total"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
    return path_rows.groupBy("source", "target").agg(F.min_by(F.struct("hops", "total", "minutes", "path"), order).alias("p"), F.count("*").alias("n_paths")).select("source", "target", "p.*", "n_paths")


def path_share(path_rows: DataFrame) -> DataFrame:
    """node, n_paths, share of all paths that pass through it between their ends."""
    total = path_rows.agg(F.count("*").alias("all"))
    inner = path_rows.filter("hops > 1").select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("node"))
    return inner.groupBy("node").agg(F.count("*").alias("n_paths")).join(F.broadcast(total)).select("node", "n_paths", F.round(F.col("n_paths") / F.col("all"), 4).alias("share"))


def timed_cycles(edges: DataFrame, minutes: float, max_length: int = 6) -> DataFrame:
    """length, cycle, n of the simple cycles in which money goes round: each transfer later than the one before, all
    within the time after the first; n counts the rounds of one cycle, which is written from its first payer.

    Both halves of a cycle are walks of at most half its length, so only such walks are made and written: those from a
    start to a middle account are joined with later ones back.  A walk begins only with a transfer of which both ends
    can be on a cycle: the payer is paid and the payee pays on within the time.
    """
    width = int(minutes * 60_000_000)
    hops = edges.filter("src <> dst").select("src", "dst", F.unix_micros("ts").alias("t")).withColumn("bucket", F.floor(F.col("t") / width))
    touched = lambda account, side: hops.select(F.col(account).alias(side), F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket")).distinct()
    hops = _cut(hops.join(touched("dst", "src"), ["src", "bucket"], "left_semi").join(touched("src", "dst"), ["dst", "bucket"], "left_semi"))
    step = hops.select(F.col("src").alias("z"), "bucket", F.col("dst").alias("to"), F.col("t").alias("t2"))
    kind = dict(hops.dtypes)["src"]
    halves = [hops.select(F.col("src").alias("a"), F.col("dst").alias("z"), F.array().cast(f"array<{kind}>").alias("inner"), F.col("t").alias("t0"), "t")]
    next_two = lambda t: F.explode(F.array(F.floor(F.col(t) / width), F.floor(F.col(t) / width) + 1))
    for _ in range(2, (max_length + 1) // 2 + 1):
        grown = halves[-1].withColumn("bucket", next_two("t")).join(step, ["z", "bucket"])
        grown = grown.filter((F.col("t2") > F.col("t")) & (F.col("t2") <= F.col("t0") + width) & (F.col("to") != F.col("a")) & ~F.array_contains("inner", F.col("to")))
        halves.append(_cut(grown.select("a", F.col("to").alias("z"), F.concat("inner", F.array("z")).alias("inner"), "t0", F.col("t2").alias("t"))))
    found = None
    for length in range(2, max_length + 1):
        there = halves[(length + 1) // 2 - 1].withColumn("bucket", next_two("t0"))
        back = halves[length // 2 - 1].select(F.col("z").alias("a"), F.col("a").alias("z"), F.col("inner").alias("inner2"), F.col("t0").alias("u0"), F.col("t").alias("u"), F.floor(F.col("t0") / width).alias("bucket"))
        round_ = there.join(back, ["a", "z", "bucket"]).filter((F.col("u0") > F.col("t")) & (F.col("u") <= F.col("t0") + width) & ~F.arrays_overlap("inner", "inner2"))
        hit = round_.select(F.lit(length).alias("length"), F.concat(F.array("a"), "inner", F.array("z"), "inner2").alias("cycle"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("length", "cycle").agg(F.count("*").alias("n"))


def caption(path_rows: DataFrame) -> DataFrame:
    """path_rows with a caption: hops, money and minutes."""
    text = F.format_string("%d hops, %s, %s minutes", F.col("hops").cast("int"), F.format_number("total", 2), F.format_number("minutes", 1))
    return path_rows.withColumn("caption", text)


def central(metrics: DataFrame, share: float = 0.05) -> DataFrame:
    """node, betweenness, is_central: whether it is among the highest share (those equal to the last one included).

    The bound is the interpolated percentile, from the places of the two values around it in the ranked table.
    """
    ranked = numbered(metrics, [F.col("betweenness"), F.col("node")], "place")
    at = (F.col("n") - 1) * F.lit(1 - share) + 1
    near = ranked.join(F.broadcast(metrics.agg(F.count("*").alias("n")))).filter((F.col("place") >= F.floor(at)) & (F.col("place") <= F.ceil(at)))
    bound = near.agg(F.sum(F.when(F.floor(at) == F.ceil(at), F.col("betweenness")).otherwise(F.col("betweenness") * (1 - F.abs(F.col("place") - at)))).alias("bound"))
    return metrics.join(F.broadcast(bound)).select("node", "betweenness", ((F.col("betweenness") >= F.col("bound")) & (F.col("betweenness") > 0)).alias("is_central"))


def _from_smallest(hops: DataFrame, rounds: int) -> list[DataFrame]:
    """By length: walks (a, z, inner) over hops (src, dst) through no node twice, of which all other nodes are larger than the first."""
    step = hops.select(F.col("src").alias("z"), F.col("dst").alias("to"))
    kind = dict(hops.dtypes)["src"]
    walks = [hops.filter("dst > src").select(F.col("src").alias("a"), F.col("dst").alias("z"), F.array().cast(f"array<{kind}>").alias("inner"))]
    for _ in range(2, rounds + 1):
        grown = walks[-1].join(step, "z").filter((F.col("to") > F.col("a")) & ~F.array_contains("inner", F.col("to")) & (F.col("to") != F.col("z")))
        walks.append(_cut(grown.select("a", F.col("to").alias("z"), F.concat("inner", F.array("z")).alias("inner"))))
    return walks


def cycles(edges: DataFrame, max_length: int = 6) -> DataFrame:
    """length, cycle of every simple cycle up to a length, once each, written from its smallest node.

    Walks of half a cycle's length from the smallest node meet those against the edges' direction at the middle node.
    """
    hops = _cut(edges.select("src", "dst").filter("src <> dst").distinct())
    there = _from_smallest(hops, (max_length + 1) // 2)
    back = _from_smallest(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_length // 2)
    found = None
    for length in range(2, max_length + 1):
        other = back[length // 2 - 1].select("a", "z", F.col("inner").alias("inner2"))
        round_ = there[(length + 1) // 2 - 1].join(other, ["a", "z"]).filter(~F.arrays_overlap("inner", "inner2"))
        hit = round_.select(F.lit(length).alias("length"), F.concat(F.array("a"), "inner", F.array("z"), F.reverse("inner2")).alias("cycle"))
        found = hit if found is None else found.unionByName(hit)
    return found


def reach(edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """node, depth: levels that a breadth-first search from it reaches, at most max_depth.

    Sixty-four searches go at once: a row (block, at, bits) says which of a block's sources have come to a node, and a
    level is one join with the edges and one OR; so the state is a 64th of all pairs of nodes.
    """
    hops = _cut(edges.select("src", "dst").filter("src <> dst").distinct())
    no = F.col("no") - 1
    sources = numbered(hops.select(F.col("src").alias("node")).distinct(), [F.col("node")], "no")
    sources = _cut(sources.select("node", F.floor(no / 64).alias("block"), F.expr("shiftleft(1L, cast((no - 1) % 64 as int))").alias("bit")))
    front = sources.select("block", F.col("node").alias("at"), F.col("bit").alias("bits"))
    seen, levels = front, None
    for level in range(1, max_depth + 1):
        got = front.join(hops, F.col("at") == F.col("src")).groupBy("block", F.col("dst").alias("at")).agg(F.bit_or("bits").alias("got"))
        old = seen.withColumnRenamed("bits", "old")
        new = got.join(old, ["block", "at"], "left").select("block", "at", F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits"))
        front = _cut(new.filter("bits <> 0"))
        if front.isEmpty():
            break
        own = front.groupBy("block").agg(F.bit_or("bits").alias("bits")).withColumn("level", F.lit(level))
        levels = own if levels is None else levels.unionByName(own)
        if level < max_depth:
            seen = _cut(seen.unionByName(front).groupBy("block", "at").agg(F.bit_or("bits").alias("bits")))
    if levels is None:
        return sources.select("node", F.lit(0).alias("depth")).limit(0)
    return sources.join(levels, "block").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("node").agg(F.max("level").alias("depth"))


def neighbourhood(edges: DataFrame, centre: DataFrame, hops: int = 2) -> DataFrame:
    """Edges among the nodes within so many hops, in either direction, of the centre (node)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = centre.select("node").distinct()
    for _ in range(hops):
        near = near.unionByName(both.join(near.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))).distinct()
    return induced(edges, near)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def central_pivots(n: int) -> int | None:
    """All nodes of a graph of up to 5,000, else 500."""
    return None if n <= 5000 else 500


#: Nodes that are paid, and edges among them, up to which these are sent to every task (16 bytes an edge).
DENSE_NODES, DENSE_EDGES = 5_000, 1_000_000


def _dependencies(inner: DataFrame, paid: DataFrame, hops: DataFrame, pivots: DataFrame) -> DataFrame:
    """node, delta: what the shortest paths from the pivots of each task lay on each node.

    Paths lead on through nodes that are paid alone, so only those and the edges among them are sent; a pivot brings
    its own edges, and there may be any number of pivots that nobody pays.
    """
    names = paid.orderBy("node").toArrow()["node"].combine_chunks()
    pairs = inner.toArrow()
    src, dst = (pc.index_in(pairs[c], value_set=names).to_numpy().astype(np.int64) for c in ("src", "dst"))
    share = hops.sparkSession.sparkContext.broadcast((src, dst))
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = share.value
        total = np.zeros(n)
        for batch in batches:
            starts = pc.fill_null(pc.index_in(batch.column(0), value_set=names), -1).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            first, ends = pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())
            for s, end, size in zip(starts, ends, np.diff(ends, prepend=0), strict=True):
                depth, sigma, delta, steps = np.full(n, -1), np.zeros(n), np.zeros(n), []
                depth[first[end - size : end]], sigma[first[end - size : end]] = 1, 1.0
                if s >= 0:
                    depth[s] = 0
                while True:
                    own = np.flatnonzero(depth[src] == len(steps) + 1)
                    own = own[depth[dst[own]] < 0]
                    if not len(own):
                        break
                    depth[dst[own]] = len(steps) + 2
                    sigma += np.bincount(dst[own], sigma[src[own]], n)
                    steps.append(own)
                for own in reversed(steps):
                    a, b = src[own], dst[own]
                    delta += np.bincount(a, sigma[a] / sigma[b] * (1 + delta[b]), n)
                total += delta
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(total[at])], ["node", "delta"])

    tasks = max(1, min(256, pivots.count() // 64))
    own = hops.join(pivots.select(F.col("node").alias("src")), "src", "left_semi").groupBy("src").agg(F.collect_list("dst").alias("to"))
    return own.repartition(tasks).mapInArrow(run, f"node {dict(paid.dtypes)['node']}, delta double")


def betweenness(edges: DataFrame, pivots: int | str | None = None, seed: int = 42, dense: bool | None = None) -> DataFrame:
    """node, betweenness: normalised, directed, from all nodes or from `pivots` of them chosen by a seeded hash; with
    "auto" from all of a graph of up to 5,000 nodes, else from 500.

    Level-synchronous: state is (pivot, node, distance, number of shortest paths); dependencies flow back level by
    level, until no new node is met.  Where the nodes that are paid and the edges among them are few enough, those are
    sent to the tasks, which deal the pivots among them; `dense` says so instead of the size.
    """
    hops = _cut(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = _cut(hops.select(F.col("src").alias("node")).unionByName(hops.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    pivots = central_pivots(n) if pivots == "auto" else pivots
    start = nodes if pivots is None or pivots >= n else nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(pivots)
    k = n if pivots is None else min(n, pivots)
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    paid = hops.select(F.col("dst").alias("node")).distinct()
    if dense is None and (dense := paid.count() <= DENSE_NODES):
        inner = _cut(hops.join(F.broadcast(paid.withColumnRenamed("node", "src")), "src", "left_semi").select("src", "dst"))
        dense = inner.count() <= DENSE_EDGES
    elif dense:
        inner = hops.join(paid.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
    if dense:
        deltas = _dependencies(inner, paid, hops, start)
        return nodes.join(deltas.groupBy("node").agg(F.sum("delta").alias("d")), "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))
    levels = [_cut(start.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("pivot", "node")
    while True:
        new = levels[-1].join(hops, F.col("node") == F.col("src")).groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = _cut(new.join(seen, ["pivot", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("pivot", "node"))
        if len(levels) % 16 == 0:
            seen = _cut(seen)
    found, after = None, None
    for level in reversed(levels[1:]):
        own = level.withColumn("delta", F.lit(0.0)) if after is None else level.join(after, ["pivot", "node"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        own = _cut(own)
        found = own.select("node", "delta") if found is None else found.unionByName(own.select("node", "delta"))
        if levels.index(level) % 16 == 0:
            found = _cut(found.groupBy("node").agg(F.sum("delta").alias("delta")))
        before = levels[levels.index(level) - 1]
        back = own.withColumnRenamed("node", "dst").join(hops, "dst").select("pivot", F.col("src").alias("node"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        back = before.join(back, ["pivot", "node"]).groupBy("pivot", "node").agg(F.sum(F.col("sigma") * F.col("share")).alias("delta"))
        after = back
    if found is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    return nodes.join(found.groupBy("node").agg(F.sum("delta").alias("d")), "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def roles(nodes: DataFrame, cash_out: DataFrame, mules: DataFrame, victims: DataFrame) -> DataFrame:
    """entity, role: cash-out before mule before victim before intermediary."""
    tag = lambda df, name: df.select("entity", F.lit(True).alias(name)).distinct()
    all_ = nodes.join(tag(cash_out, "c"), "entity", "left").join(tag(mules, "m"), "entity", "left").join(tag(victims, "v"), "entity", "left")
    return all_.select("entity", F.when(F.col("c"), "CASHOUT").when(F.col("m"), "MULE").when(F.col("v"), "VICTIM").otherwise("INTERMEDIARY").alias("role"))


def top_subgraph(edges: DataFrame, scores: DataFrame, n: int = 50) -> DataFrame:
    """Edges among the n accounts of the highest scores."""
    return induced(edges, scores.orderBy(F.desc("score"), "entity").limit(n).select(F.col("entity").alias("node")))


def snapshot(edges: DataFrame, run_id: str) -> DataFrame:
    """One row: run_id, node_count, edge_count, betweenness_k (how many pivots a snapshot of that size takes)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.count_distinct("node").alias("node_count"))
    both = nodes.join(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))
    k = F.when(F.col("node_count") <= 5000, F.col("node_count")).otherwise(F.lit(500).cast("long"))
    return both.select(F.lit(run_id).alias("run_id"), "node_count", "edge_count", k.alias("betweenness_k"))


def current(versions: DataFrame, keys: list[str], run: str = "run_no") -> DataFrame:
    """Rows of the latest run of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(run))
    return versions.withColumn("__r", F.rank().over(w)).filter("__r = 1").drop("__r")
