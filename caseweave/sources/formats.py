"""Formats of evidence files, read from plug-in files at run time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a plug-in states: headers that tell the kind, aliases by field, date patterns, fields that a file must have.
PARTS = {"detect": list, "columns": dict, "dates": list, "required": list}


def save(formats: dict[str, dict], spark: SparkSession, path: str) -> None:
    """A JSON file for each format."""
    rows = [(kind, json.dumps({"kind": kind} | {k: f[k] for k in PARTS})) for kind, f in formats.items()]
    spark.createDataFrame(rows, "kind string, value string").repartition(len(rows), "kind").write.partitionBy("kind").text(path)


def load(spark: SparkSession, path: str, base: dict[str, dict] | None = None) -> dict[str, dict]:
    """The formats under a path, each file one JSON object with kind and PARTS; they replace those of base with their kind.

    A file that is no such object, or a kind that two files state, is an error.
    """
    found: dict[str, dict] = {}
    texts: DataFrame = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    for row in texts.filter("trim(value) <> ''").orderBy("path").collect():  # a few small files
        one = json.loads(row["value"])
        if not isinstance(one, dict) or not isinstance(one.get("kind"), str) or any(not isinstance(one.get(k), t) for k, t in PARTS.items()):
            raise ValueError(f"{row['path']} is no format: kind and {', '.join(PARTS)} are needed")
        if one["kind"] in found:
            raise ValueError(f"two formats of kind {one['kind']}")
        found[one["kind"]] = {k: one[k] for k in PARTS}
    return (base or {}) | found
