"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch, where the session leaves Spark's default: texts of any length stand in them.
BATCH = 2000


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this package shipped to its Python workers as by --py-files, and smaller Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_caseweave_shipped", None) is None:
        top = Path(__file__).resolve().parents[2]
        path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "caseweave.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((top / "caseweave").rglob("*.py")):
                z.write(f, f.relative_to(top))
        sc.addPyFile(path)
        sc._caseweave_shipped = path
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the setting is absent (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="caseweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/caseweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table written once: lineage ends there, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def fs_of(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(df: DataFrame) -> None:
    """Delete the files under a table made by written(), once nothing reads it any more."""
    for path in {f.rsplit("/caseweave/", 1)[0] + "/caseweave/" + f.rsplit("/caseweave/", 1)[1].split("/")[0] for f in df.inputFiles() if "/caseweave/" in f}:
        fs, p = fs_of(df.sparkSession, path)
        fs.delete(p, True)
