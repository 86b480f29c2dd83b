"""Numbers over a whole table in order, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.operators.checkpoints import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1, 2, ... in the order of these columns, which must end with a key.

    Rows are sorted into ranges, numbered inside their range and moved on by the sizes of the ranges before.
    """
    rows = cut(df.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return own.join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__own")).drop("__range", "__base", "__own")
