"""Shared-folder tables and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A written table of at most this many rows, and where their width varies of so many bytes, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a new local folder for a local master, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="weft-shared-"))
            held = context._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: Python code that runs there imports it by name."""
    context = spark.sparkContext
    if not getattr(context, "_weft_shipped", False):
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="weft-ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        context._weft_shipped = True


def table(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, and has a known size."""
    path = f"{shared_folder(df.sparkSession)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, folder: str | None = None) -> int:
    """Deletes the tables that this library left in the shared folder, once no result is in use; returns how many."""
    jvm = spark._jvm.org.apache.hadoop.fs
    pattern = jvm.Path(f"{folder or shared_folder(spark)}/weft-*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.globStatus(pattern) or []]
    return sum(system.delete(p, True) for p in found)


def if_small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """df marked for broadcast when its counted rows, and bytes where they are given, are within the bounds, else left to Spark's shuffled joins."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def ranked(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with a 0-based rank by the order columns: range partitions are sorted, counted, and offset by the counts before them, so no task holds all rows."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = table(parts, "ranked")
    counts = parts.groupBy("_p").agg(F.count("*").alias("c"), F.min("_m").alias("first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select("_p", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("_offset"))
    return parts.join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_m") + F.col("_offset")).drop("_p", "_m", "_offset")
