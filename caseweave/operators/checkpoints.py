"""Lineage is cut in the folder that the session names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="caseweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once and read back: a lost executor costs a reread, plans of loops stay short, nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/caseweave/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(df: DataFrame) -> bool:
    """Whether the files that df reads are still there."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return False


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its Python workers as by --py-files; for tasks that call its functions."""
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
