"""Mixing sources to target weights.

Tokens are aggregated per source, a repetition rate follows for each source, and every document is emitted
floor(rate) times plus once more with probability equal to the fraction, drawn from a seeded hash of its id.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source (null is a source, ordered last): source_size, target, rate.

    The targets share `share` of all tokens by weight; none is above `cap` times its source's size, and what a
    capped source leaves goes to the others by weight.  That fixed point is min(cap * size, level * weight) with one
    common level, which prefix sums over the sources give without iteration.  A source of size 0 has target 0.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    place = Window.orderBy(F.col(source).isNull(), F.col(source))
    n = len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % n + 1)))
    # Sources fill up in the order of cap * size / weight; before the k-th, all earlier ones are at their caps.
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col(source).isNull(), F.col(source))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") * F.lit(share) - F.col("capped") * F.lit(cap)) / F.col("w_left"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("source_size") * F.lit(cap))
    )
    level = F.min(F.when(F.col("open"), F.struct("capped", "level"))).over(everything)["level"]
    target = F.least(F.col("source_size") * F.lit(cap), F.coalesce(level * F.col("w"), F.col("source_size") * F.lit(cap)))
    return per.withColumn("target", target).select(
        source, "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")
    )


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate), and one more where the seeded hash of the id falls under the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies.

    A null text has size 0; a null source is a source of its own; repeated rows each count and draw alike; an empty
    table gives an empty plan.  Columns of docs other than the three are not read.
    """
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    targets = source_targets(sized, "source", "size", **how).withColumnRenamed("source", "of")
    return sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", copies(F.col("doc_id"), F.col("rate"), seed).alias("copies")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """The rows of docs, each repeated as planned; its columns stay as they are, whatever their names.

    Null texts have size 0, a null source is a source of its own, a null id draws like one id, and an empty table stays
    empty.
    """
    sized = written(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    targets = source_targets(sized, "source", "size", **how).select(F.col("source").alias("__of"), F.col("rate").alias("__rate"))
    n = copies(docs[doc_id], targets["__rate"], seed)
    turn = next(c for k in range(len(docs.columns) + 1) if (c := f"turn{k}") not in docs.columns)
    times = F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))).alias(turn)
    return docs.join(targets, docs[source].eqNullSafe(targets["__of"])).select(*[docs[c] for c in docs.columns], times).drop(turn)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, coalesce(sum(source_size) OVER f, 0)::BIGINT AS capped,
         (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::BIGINT AS w_left, (sum(source_size) OVER ())::BIGINT AS total
  FROM per
  WINDOW f AS (ORDER BY source_size::DOUBLE / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total * 1.5::DOUBLE - capped * 2.0::DOUBLE) / w_left AS level FROM filled),
one AS (SELECT arg_min(level, capped) AS level FROM levels WHERE level * w <= source_size * 2.0::DOUBLE),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(one.level * w, source_size * 2.0::DOUBLE)) AS target
  FROM levels, one),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE
                                        < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
