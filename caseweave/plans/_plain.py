"""What registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare by value."""
    return df.select(*[F.col(n).cast("double").alias(n) if k.startswith("decimal") else F.col(n) for n, k in df.dtypes])
