"""Derived tables in a shared folder: they cut the lineage of iterations and are made once per session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT = None


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one of our own only where that is unset and Spark
    runs in one process."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if _LOCAL_ROOT is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL_ROOT = "file://" + tempfile.mkdtemp(prefix="lectorium-tables-")
    return _LOCAL_ROOT


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Changes when the files below the paths do."""
    out = []
    for path in paths:
        p, fs = _path(spark, path)
        out.append((path, fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()))
    return tuple(out)
