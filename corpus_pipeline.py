"""Corpus preparation: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; every result is written as
Parquet and read again, so a lost executor never costs more than the running stage.

All stages but the last return the columns that they were given, further ones included; null and empty texts, null ids,
repeated rows, very long texts and empty tables pass through as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import lines, minhash, mixing, packing, toxicity
from caseweave.llm._store import written

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; labels are used for training only.

    Null and empty texts stay, and rows of a null id are judged by their text; without labels of both classes nothing goes.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text.

    No document goes: one of template lines only stays with an empty text; a null text stays null.
    """
    cut = lines.deduplicate(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id.

    Texts without words and rows of a null id stay; rows of one id stay or go together.
    """
    return minhash.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to bring the sources to their target weights.

    A null source is a source, the last; documents without words draw their copies like the others of their source.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity scores, verified shingle sets and best-fit packing are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
