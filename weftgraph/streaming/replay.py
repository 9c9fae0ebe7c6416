"""Replay of a change log as a stream.

A log is a folder of Parquet files of LOG rows (kind put, delete or edge). Each micro-batch is validated and written
to a folder named by its number, replacing what a failed try left, so a batch counts once however often it is tried. The
tables under the target are then read as any others: versions resolve on read, and edges come back with the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph import model
from weftgraph.operators import store

LOG = "kind string, id string, sequence bigint, source_uri string, metadata_json string, content string, deletion_ts_us bigint, dst string, edge_type string"
_PARTS = {"put": ("blocks", model.BLOCKS), "delete": ("tombstones", model.TOMBSTONES), "edge": ("edges", model.EDGES)}


def _columns(kind: str, schema: str) -> list[Column]:
    source = {"src": "id"} if kind == "edge" else {}
    return [F.col(source.get(name, name)).cast(form).alias(name) for name, form in (x.split() for x in schema.split(", "))]


def apply(batch: DataFrame, number: int, target: str) -> None:
    """Writes one micro-batch; edges of unknown type and self-loops are left out."""
    held = batch.persist()
    try:
        for kind, (name, schema) in _PARTS.items():
            rows = held.filter(F.col("kind") == kind).select(*_columns(kind, schema))
            if kind == "edge":
                rows = rows.filter(F.col("edge_type").isin(*model.EDGE_TYPES) & (F.col("src") != F.col("dst")))
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
    finally:
        held.unpersist()


def replay(spark: SparkSession, log: str, target: str, checkpoint: str, files_per_batch: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream; by default it takes what there is and ends."""
    changes = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    writer = changes.writeStream.foreachBatch(lambda df, n: apply(df, n, target)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def tables(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live blocks, tombstones, live edges) of what has been replayed."""
    blocks, gone, edges = (spark.read.schema(schema).parquet(f"{target}/{name}") for name, schema in _PARTS.values())
    live = store.current(blocks, gone)
    return live, gone, store.live_edges(edges, live)


def activity(changes: DataFrame, at: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) of a stream of changes by event time: watermarked windows, so state is dropped once a window has closed."""
    return changes.withWatermark(at, late).groupBy(F.window(at, window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
