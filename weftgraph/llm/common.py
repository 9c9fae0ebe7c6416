"""Shared plumbing of the training-data operators: session limits, scratch tables, hot-key joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import BROADCAST_ROWS, ship, table
from weftgraph.session import shared_folder as scratch

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Bounds of one Arrow batch handed to Python: rows and bytes, whichever is reached first.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that very long texts cannot fill a Python worker's memory, and ships this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ship(spark)


def spread(scan: DataFrame) -> DataFrame:
    """A file scan dealt over all cores if its files make fewer partitions than there are cores; larger inputs stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/weft-{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a written table for broadcast if its counted rows are within the bound; else Spark's own join is used."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def hash_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 32 bits of md5(seed:key); SQL engines without Spark's hashes can repeat it."""
    hexa = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(hexa, 16, 10).cast("bigint") / F.lit(4294967296.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with their groups' row. Groups of over 1 / 1000 of the rows, at most 1000, go by broadcast.

    groups is a written table with one row per key combination; nulls match nulls. A hot key so never meets in one task.
    """

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
        on = F.lit(True)
        for c in keys:
            on = on & left[c].eqNullSafe(right[f"_{c}"])
        return left.join(right, on, how).drop(*[f"_{c}" for c in keys])

    if groups.count() <= BROADCAST_ROWS:
        return joined(rows, F.broadcast(groups), "inner")
    hot = F.col(size) * 1000 > total
    many, few = groups.filter(hot), groups.filter(~hot)
    cold = joined(rows, F.broadcast(many.select(*keys)), "left_anti")
    return joined(rows, F.broadcast(many), "inner").unionByName(joined(cold, few, "inner"))
