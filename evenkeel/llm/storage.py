"""Written intermediate tables in the folder that the whole cluster shares.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir`` (read from the session). Only in local mode, as in unit
tests, a folder of this process is made where that setting is absent; on a cluster that is an error, because executors
would not see each other's files.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker is sent at a time; a longer row is sent alone.
SENT = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared scratch folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("evenkeel.scratch.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="evenkeel-")
            spark.conf.set("evenkeel.scratch.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/evenkeel/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark itself reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "file:///", found)


def written(df: DataFrame, name: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Write ``df`` once and read it back: a restart point that survives lost executors. ``by``: columns of folders."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, through the file system they are in."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are finished; they otherwise stay until the driver collects garbage."""
    for _ in range(2):  # the first lets go of plans, the second of what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def bounded(spark: SparkSession) -> None:
    """Send workers ``SENT`` bytes of rows at a time, unless the session says less.

    Spark counts rows only (10,000). A batch is held several times over, outside the executor's heap and in each worker,
    and long texts would set the size of both. The setting stays, as frames are run when they are written.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > SENT:
        spark.conf.set(name, str(SENT))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` in a worker that gives freed memory back when the task's rows end: workers stay beside later tasks."""

    @wraps(run)
    def then_free(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # not glibc
            pass

    return then_free
