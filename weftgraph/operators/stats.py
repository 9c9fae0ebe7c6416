"""Aggregates over blocks and edges: metadata indexes, degrees, workspace and storage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import if_small, ranked, table

SECONDS_FRESH = 3600


def metadata_index(blocks: DataFrame, name: str) -> DataFrame:
    """(value, id): the inverted index of a metadata field in flat form, distinct and without unbounded lists."""
    value = F.get_json_object("metadata_json", f"$.{name}")
    return blocks.select(value.alias("value"), "id").filter("value IS NOT NULL").distinct()


def distinct_values(blocks: DataFrame, name: str) -> DataFrame:
    return metadata_index(blocks, name).select("value").distinct()


def index_statistics(blocks: DataFrame, name: str) -> DataFrame:
    """(unique_values, total_blocks, max_per_value, selectivity, is_selective) of the field's index."""
    per = metadata_index(blocks, name).groupBy("value").agg(F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("unique_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("max_per_value"))
    share = F.when(F.col("total_blocks") == 0, F.lit(1.0)).otherwise(F.col("unique_values") / F.col("total_blocks"))
    return out.withColumn("selectivity", share).withColumn("is_selective", (F.col("selectivity") < 0.5) & (F.col("max_per_value") < F.floor(F.col("total_blocks") / 2)))


def degrees(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, out_degree, in_degree) over distinct edges, in one aggregation; edges that are known to be distinct are read once and not shuffled."""
    e = edges if distinct else edges.distinct()
    end = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = e.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def workspace_statistics(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(codebase, block_count, edge_count, estimated_bytes): edges count for their source's workspace."""
    owner = blocks.select("id", F.get_json_object("metadata_json", "$.codebase").alias("codebase")).filter("codebase IS NOT NULL")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("e"))
    per = owner.join(out, "id", "left").groupBy("codebase").agg(F.count("*").alias("block_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))
    return per.withColumn("estimated_bytes", F.col("block_count") * 2048 + F.col("edge_count") * 64)


def sync_status(last_sync: Column, now: int) -> Column:
    """never synced, synced (within the hour) or sync needed."""
    return F.when(last_sync == 0, "never synced").when(F.lit(now) - last_sync <= SECONDS_FRESH, "synced").otherwise("sync needed")


def memory_pressure(used: Column, limit: Column) -> Column:
    share = used / limit
    return F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low")


def storage_statistics(blocks: DataFrame, live: DataFrame, edges: DataFrame) -> DataFrame:
    """(versions, live_blocks, edges, content_bytes): a row of totals, the bytes being those of live content."""
    size = F.octet_length("content").cast("bigint")
    parts = [
        blocks.select(F.lit(1).alias("v"), F.lit(0).alias("l"), F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("b")),
        live.select(F.lit(0).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("e"), F.coalesce(size, F.lit(0)).alias("b")),
        edges.select(F.lit(0).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("e"), F.lit(0).cast("bigint").alias("b")),
    ]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("v", "versions"), ("l", "live_blocks"), ("e", "edges"), ("b", "content_bytes"))])


def latency_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Per group with a value: n, mean, median, p95, p99, min, max, population standard deviation. Null values do not count.

    Percentiles are exact, interpolated between the two nearest ranks: rows are ranked by ranges, so a group of any size is
    dealt over many tasks, and of each group only the rows at the ranks asked for meet.
    """
    v = F.col(value)
    rows = ranked(samples.select(F.col(group).alias("_g"), v.cast("double").alias("_v")).filter("_v IS NOT NULL"), "_g", "_v")
    groups = rows.groupBy("_g").agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.stddev_pop("_v").alias("std"), F.min("rank").alias("_first"))
    groups = table(groups, "groups")
    sides = if_small(groups.select(F.col("_g").alias("_h"), "n", "_first"), groups.count())
    at = F.col("rank") - F.col("_first")
    near = rows.join(sides, F.col("_g").eqNullSafe(F.col("_h")))
    places = {name: (F.col("n") - 1) * share for name, share in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))}
    wanted = F.lit(False)
    for p in places.values():
        wanted = wanted | (at == F.floor(p)) | (at == F.ceil(p))
    ends = [F.max(F.when(at == end(p), F.col("_v"))).alias(f"{name}_{k}") for name, p in places.items() for k, end in ((0, F.floor), (1, F.ceil))]
    picked = near.filter(wanted).groupBy("_h").agg(*ends)
    out = groups.join(picked, F.col("_g").eqNullSafe(F.col("_h")))
    between = [(F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * (p - F.floor(p))).alias(name) for name, p in places.items()]
    return out.select(F.col("_g").alias(group), "n", "mean", *between, "min", "max", "std")
