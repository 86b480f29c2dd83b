"""A keyed table in versions: a merge rewrites only the buckets that its rows fall into.

A key belongs to the bucket of its hash.  A version is a manifest, a small JSON file that names each bucket's folder; a
merge writes new folders for the buckets it touches and then a manifest that takes the others over.  Manifests are
created, never overwritten: of two merges that began at one version the later to finish fails and may begin anew.
Readers keep the version that they opened.  Creation is atomic on HDFS and local disks; an object store needs a
committer of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, rising."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("-")[1].split(".")[0]) for n in names if n.startswith("version-"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/version-{version:08d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, p = _fs(spark, f"{path}/version-{version:08d}.json")
    out = fs.create(p, False)  # fails if another merge has made this version
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()


def _rows(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last."""
    from pyspark.sql.types import StructType

    manifest = _manifest(spark, path, versions(spark, path)[-1] if version is None else version)
    return _rows(spark, path, sorted(set(manifest["buckets"].values())), StructType.fromJson(manifest["schema"]))


def merge(new: DataFrame, path: str, keys: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> int:
    """Merge new rows into the table under path; combine(old, new) makes the rows of the touched buckets.  The new version's number.

    The first merge fixes the number of buckets and the schema, that of combine's result.
    """
    spark = new.sparkSession
    had = versions(spark, path)
    old = _manifest(spark, path, had[-1]) if had else {"buckets": {}, "n": buckets}
    n = old["n"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # at most n numbers
    before = _rows(spark, path, [old["buckets"][str(b)] for b in touched if str(b) in old["buckets"]], new.schema)
    rows = combine(before, new).withColumn("__bucket", bucket)
    load = f"load-{uuid.uuid4().hex}"
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{load}")
    schema = rows.drop("__bucket").schema
    made = {str(b): f"{load}/__bucket={b}" for b in touched}
    version = had[-1] + 1 if had else 1
    _commit(spark, path, version, {"n": n, "schema": json.loads(schema.json()), "buckets": old["buckets"] | made})
    return version
