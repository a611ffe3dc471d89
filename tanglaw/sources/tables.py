"""Access to the parquet tables of one data directory, and intermediate tables shared by all executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """Read ``<data_dir>/<name>.parquet`` (a file or a folder), only the named columns if any are given."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a laptop) a temporary folder of this machine is used, which is
    sound only because driver and executors are then one process.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        place = os.path.join(tempfile.gettempdir(), f"tanglaw-{os.getpid()}")
    return place.rstrip("/")


#: Folders of intermediate tables that this process wrote and that still stand.
_written: list[str] = []


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` as a parquet table into the shared folder, with a folder for each value of ``by``, and read it back.

    It cuts the lineage, survives the loss of executors, and lets several consumers share one computation
    without holding blocks in executor memory. ``release`` deletes the tables; the end of the process does too.
    """
    spark = df.sparkSession
    path = scratch(f"{shared_dir(spark)}/tanglaw/{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(path: str) -> str:
    """``path``, noted as one that ``release`` deletes."""
    if not _written:
        atexit.register(release)
    _written.append(path)
    return path


def release() -> None:
    """Delete the intermediate tables written so far. Results that are not yet read or stored can't be read afterwards."""
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:  # stopped: what is on this machine can still go
        while _written:
            path = _written.pop().removeprefix("file://").removeprefix("file:")
            if path.startswith("/"):
                shutil.rmtree(path, ignore_errors=True)
        return
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, least: int = 0) -> DataFrame:
    """Repartition ``df`` when its scan has fewer partitions than the cluster has task slots.

    A table of one file with one row group can't be split by the scan; per-document Python work on it would
    run in a single task.
    """
    want = max(least, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
