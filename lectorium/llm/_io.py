"""Tables, shared scratch folders and shipping of this package to executors."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT = None
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None


#: Bytes of an Arrow batch between Spark and Python. Batches by rows alone grow with the texts.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks import it by name, and bound
    the bytes of the session's Arrow batches."""
    sc = spark.sparkContext
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_lectorium_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        path = os.path.join(tempfile.mkdtemp(prefix="lectorium-ship-"), "lectorium_pkg.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
    sc._lectorium_shipped = True


def trim() -> None:
    """Give freed memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def frugal(task):
    """Make a generator that runs in a Python worker give back what it has freed when it ends. Workers live on
    for other tasks, and the allocators of C and of Arrow would keep it for themselves."""

    @functools.wraps(task)
    def wrapped(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            trim()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table, so that others, whatever their names, reach no operator."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one of our own only where that is unset."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if _LOCAL_ROOT is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL_ROOT = "file://" + tempfile.mkdtemp(prefix="lectorium-")
    return _LOCAL_ROOT


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root, removed when the application ends."""
    path = f"{shared_root(spark)}/lectorium/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more. Call it where a large
    intermediate result has been written and its plan is done; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of saved frames that nothing reads any more."""
    for df in frames:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
