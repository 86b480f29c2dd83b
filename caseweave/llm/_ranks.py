"""Places of rows in order, without one task for a whole table or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written


def placed(rows: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """rows with __place (from 0, in this order inside the group) and __n (the group's rows).

    Rows are sorted into ranges of group and order and written once; a row's place in its range is moved on by the
    sizes of its group's ranges before.  Order should end with a key: rows that tie in everything take any places.
    """
    group = group or []
    keys = [*map(F.col, group), *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = written(spread.withColumn("__at", F.monotonically_increasing_id()), "placed")
    marked = marked.withColumn("__range", F.shiftright("__at", 33))
    runs = marked.groupBy("__range", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__size"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")
    runs = runs.select("__range", *group, base.alias("__base"), F.sum("__size").over(Window.partitionBy(*group)).alias("__n"))
    return marked.join(runs, ["__range", *group]).withColumn("__place", F.col("__at") + F.col("__base")).drop("__range", "__at", "__base")
