"""Isolation forest over the feature frame, and what it may change: the order within a band, never the band."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.config import BANDS
from caseweave.functions.parsing import finite
from caseweave.operators.checkpoints import shipped
from caseweave.operators.ranking import numbered

FEATURES = [
    "passthrough_ratio", "fan_in_count", "fan_out_count", "layering_depth", "sim_switch_count", "device_share_count", "account_age_days", "turnover",
    "odd_hour_txn_count", "betweenness_centrality", "in_count", "out_count", "unique_counterparties",
]
TREES, SAMPLE, LEAST_ROWS = 100, 256, 30


def _usual(n: int) -> float:
    """Mean depth of an unsuccessful search among n: what is left below a leaf of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (column, cut, left, right, depth); a leaf has column -1 and its expected depth."""
    nodes: list[tuple] = []
    todo = [(x, 0, None)]
    while todo:
        rows, depth, parent = todo.pop()
        me = len(nodes)
        if parent is not None:
            at, side = parent
            nodes[at] = (*nodes[at][:2], *((me, nodes[at][3]) if side == 0 else (nodes[at][2], me)), nodes[at][4])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes.append((-1, 0.0, -1, -1, depth + _usual(len(rows))))
            continue
        column = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, column].min(), rows[:, column].max()))
        nodes.append((column, cut, -1, -1, float(depth)))
        low = rows[:, column] < cut
        todo += [(rows[~low], depth + 1, (me, 1)), (rows[low], depth + 1, (me, 0))]
    return nodes


def isolation_scores(frame: DataFrame, columns: list[str] | None = None, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """entity, anomaly_score in (0, 1), anomaly_raw (score - 0.5), is_anomaly, anomaly_rank (1 is the most anomalous).

    Each tree is grown on the rows of the smallest hashes of (seed, tree, entity), so results do not depend on how
    rows are partitioned; the trees, of fixed size, are broadcast.  Under 30 rows all scores are null.
    """
    columns = columns or FEATURES
    spark = shipped(frame.sparkSession)
    tidy = [finite(F.col(c).cast("double")).alias(c) for c in columns]
    rows = frame.select("entity", *tidy)
    n = rows.count()
    if n < LEAST_ROWS:
        return rows.select("entity", *[F.lit(None).cast(k).alias(c) for c, k in (("anomaly_score", "double"), ("anomaly_raw", "double"), ("is_anomaly", "boolean"), ("anomaly_rank", "bigint"))])
    # A hash threshold with room to spare leaves each tree a few hundred rows before they are ordered.
    keep = min(1.0, (4 * sample + 100) / n)
    bound = int(keep * 2**31)
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64(F.lit(seed), "tree", "entity"))
    drawn = drawn.filter(F.pmod(F.shiftright("h", 20), F.lit(2**31)) <= bound)
    w = Window.partitionBy("tree").orderBy("h", "entity")
    drawn = drawn.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= sample)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = part.sort_values(["h", "entity"])[columns].to_numpy(float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(2, len(x)))))
        return pd.DataFrame([(tree, k, *node) for k, node in enumerate(nodes)], columns=["tree", "k", "feature", "cut", "low", "high", "depth"])

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, k int, feature int, cut double, low int, high int, depth double").toPandas()
    forest = spark.sparkContext.broadcast([g.sort_values("k").drop(columns=["tree", "k"]).to_numpy() for _, g in grown.groupby("tree")])
    usual = _usual(min(sample, n))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[columns].to_numpy(float)
            total = np.zeros(len(x))
            for nodes in forest.value:
                at = np.zeros(len(x), int)
                while (inner := nodes[at, 0] >= 0).any():
                    here = nodes[at[inner]]
                    low = x[inner, here[:, 0].astype(int)] < here[:, 1]
                    at[inner] = np.where(low, here[:, 2], here[:, 3]).astype(int)
                total += nodes[at, 4]
            yield pd.DataFrame({"entity": part["entity"], "anomaly_score": 2.0 ** (-total / len(forest.value) / usual)})

    kind = dict(rows.dtypes)["entity"]
    scored = rows.mapInPandas(score, f"entity {kind}, anomaly_score double")
    scored = numbered(scored, [F.desc("anomaly_score"), F.col("entity")], "anomaly_rank").withColumn("anomaly_rank", F.col("anomaly_rank").cast("long"))
    return scored.select("entity", "anomaly_score", (F.col("anomaly_score") - 0.5).alias("anomaly_raw"), (F.col("anomaly_score") > 0.5).alias("is_anomaly"), "anomaly_rank")


def reranked(scores: DataFrame, anomalies: DataFrame) -> DataFrame:
    """rank_in_case by band, then anomaly rank, then score; bands stay; without anomaly scores, by band and score."""
    place = F.coalesce(*[F.when(F.col("band") == b, F.lit(k)) for k, b in enumerate(sorted(BANDS, key=BANDS.get, reverse=True))])
    both = scores.join(anomalies.select("entity", "anomaly_score", "anomaly_rank"), "entity", "left")
    return numbered(both, [place, F.col("anomaly_rank").asc_nulls_last(), F.desc("score"), F.col("entity")], "rank_in_case")


def evaluation(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of flags (id, flag) against labels (id, label)."""
    both = predicted.join(truth, "id")
    one = both.agg(F.count_if((F.col("flag") == 1) & (F.col("label") == 1)).alias("tp"), F.count_if((F.col("flag") == 1) & (F.col("label") == 0)).alias("fp"), F.count_if((F.col("flag") == 0) & (F.col("label") == 1)).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
