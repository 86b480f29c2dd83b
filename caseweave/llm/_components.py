"""Connected components by alternating large-star and small-star rounds, each a pair of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shared_dir


def _is_stars(e: DataFrame) -> bool:
    """Whether each node points at one root and no root points on."""
    many = e.groupBy("u").count().filter("count > 1").limit(1)
    onward = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u").limit(1)
    return many.select("u").unionByName(onward).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, root), root the smallest node reachable; nodes without links are left out.

    Minimums are aggregated before each shuffle and joined back, so a node with very many links is no group in one
    task; every round is checkpointed, so an executor's loss costs one round.
    """
    shared_dir(links.sparkSession)
    low, high = F.least("u", "v"), F.greatest("u", "v")
    e = links.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct().checkpoint()
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        rest = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = own.unionByName(rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct().checkpoint()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
