"""Versioned storage: resolution of versions and deletions, lookups, writes, compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.session import if_small, ranked, table

GRACE_SECONDS = 6 * 3600
BATCH_LIMIT, MANY_LIMIT = 100, 1000
POLICIES = ("skip_older", "overwrite", "fail")


def current(blocks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The live version of each id: highest sequence over versions and deletions; a deletion there hides the block.

    The newest sequence is a hash aggregation over narrow rows; other columns are fetched for the winners, if they are
    asked for, by a join on the id that both sides are dealt by. Of equal sequences a block wins over a deletion. A sequence names one write, so
    blocks that repeat an id and sequence are copies, of which one stays.
    """
    code = F.col("sequence") * 2
    both = blocks.select("id", (code + 1).alias("_top")).unionByName(tombstones.select("id", code.alias("_top")))
    newest = both.groupBy("id").agg(F.max("_top").alias("_top")).filter("_top % 2 = 1")
    # The comparison is no join key, so that the rows stay dealt by id for the last step.
    found = blocks.join(newest, "id").filter(F.col("sequence") * 2 + 1 - F.col("_top") == 0)
    return found.select(*blocks.columns).dropDuplicates(["id"])


def find(blocks: DataFrame, ident: str) -> DataFrame:
    return blocks.filter(F.col("id") == ident)


def find_many(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Blocks of the ids in input order (column ord); repeats repeat, missing ids are left out. 1 to 1000 ids."""
    if not ids:
        raise ValueError("EmptyQuery")
    if len(ids) > MANY_LIMIT:
        raise ValueError("TooManyResults")
    wanted = blocks.sparkSession.createDataFrame(list(enumerate(ids)), "ord long, id string")
    return blocks.join(F.broadcast(wanted), "id").select("ord", *blocks.columns)


def exists(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(id, present) for each distinct id, at most 1000."""
    if len(ids) > MANY_LIMIT:
        raise ValueError("TooManyResults")
    wanted = blocks.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    hits = blocks.join(F.broadcast(wanted), "id", "left_semi").select("id").distinct().withColumn("present", F.lit(True))
    return wanted.join(hits, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))


def count_existing(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    return find_many(blocks, ids).agg(F.count("*").alias("n"))


def outgoing(edges: DataFrame, ident: str) -> DataFrame:
    return edges.filter(F.col("src") == ident)


def incoming(edges: DataFrame, ident: str) -> DataFrame:
    return edges.filter(F.col("dst") == ident)


def live_edges(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct edges whose both ends are live now. The live ids are found once and written."""
    ids = table(live.select("id"), "live")
    n = ids.count()
    ends = [if_small(ids.withColumnRenamed("id", c), n) for c in ("src", "dst")]
    return edges.select("src", "dst", "edge_type").join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst", "edge_type").distinct()


def next_sequence(blocks: DataFrame, tombstones: DataFrame) -> DataFrame:
    both = blocks.select("sequence").unionByName(tombstones.select("sequence"))
    return both.agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).cast("bigint").alias("next_sequence"))


def put_blocks(log: DataFrame, tombstones: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with the valid new blocks under fresh increasing sequences, rejected with errors). The caller's sequences are not used.

    Sequences follow the new blocks' ``ord`` column: distributed ranks from per-range counts, not one global window.
    """
    start = next_sequence(log, tombstones).first()[0]
    checked = new.withColumn("sequence", F.lit(1).cast("bigint")).withColumn("errors", model.block_errors())
    good = ranked(checked.filter(F.size("errors") == 0), "ord").withColumn("sequence", F.col("rank") + F.lit(start))
    return log.unionByName(good.select(*log.columns)), checked.filter(F.size("errors") > 0).select("id", "errors")


def delete(tombstones: DataFrame, log: DataFrame, ids: Sequence[str], now_us: int) -> DataFrame:
    """Tombstones with one more per id at the next sequences; ids need not exist."""
    start = next_sequence(log, tombstones).first()[0]
    rows = [(i, start + k, now_us) for k, i in enumerate(ids)]
    return tombstones.unionByName(tombstones.sparkSession.createDataFrame(rows, model.TOMBSTONES))


def put_edges(edges: DataFrame, new: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge set with the valid new edges, rejected with errors)."""
    checked = model.edge_errors(new, live)
    good = checked.filter(F.size("errors") == 0).select("src", "dst", "edge_type")
    return edges.unionByName(good).dropDuplicates(["src", "dst", "edge_type"]), checked.filter(F.size("errors") > 0)


def remove_edge(edges: DataFrame, src: str, dst: str, edge_type: str) -> DataFrame:
    return edges.filter(~((F.col("src") == src) & (F.col("dst") == dst) & (F.col("edge_type") == edge_type)))


def batch_upsert(live: DataFrame, batch: DataFrame, policy: str = "skip_older", workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(written rows, statistics row) of a batch (columns of blocks and ord) of at most 100.

    Within the batch the highest sequence of an id is kept, then the last submitted. Against live blocks, ``skip_older``
    keeps what is newer there, ``overwrite`` writes always, ``fail`` is an error on any conflict.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    submitted = batch.count()
    if submitted > BATCH_LIMIT:
        raise ValueError("BatchTooLarge")
    if workspace is not None and not batch.filter(~F.get_json_object("metadata_json", "$.codebase").eqNullSafe(F.lit(workspace))).isEmpty():
        raise ValueError("WorkspaceViolation")
    last = Window.partitionBy("id").orderBy(F.desc("sequence"), F.desc("ord"))
    kept = batch.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    state = kept.join(live.select("id", F.col("sequence").alias("_held")), "id", "left")
    older = F.col("_held").isNotNull() & (F.col("sequence") <= F.col("_held"))
    if policy == "fail" and not state.filter(F.col("_held").isNotNull()).isEmpty():
        raise ValueError("VersionConflict")
    state = state.withColumn("_skip", older if policy == "skip_older" else F.lit(False))
    counts = state.agg(F.count("*").alias("kept"), F.count_if("_skip").alias("conflicts"))
    stats = counts.select(
        F.lit(submitted).cast("bigint").alias("submitted"), (F.lit(submitted) - F.col("kept")).cast("bigint").alias("duplicates"), "conflicts",
        (F.col("kept") - F.col("conflicts")).alias("written"),
        (F.expr(f"({submitted} - kept + conflicts) * 100 div {max(1, submitted)}")).cast("bigint").alias("dedup_percent"),
        (F.lit(100.0) if not submitted else (F.col("kept") - F.col("conflicts")) * 100.0 / submitted).alias("success_percent"),
    )
    return state.filter(~F.col("_skip")).select(*live.columns), stats


def shadowed(blocks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Versions under a deletion: some tombstone of the id has a strictly higher sequence."""
    top = tombstones.groupBy("id").agg(F.max("sequence").alias("_gone"))
    return blocks.join(top, "id").filter(F.col("_gone") > F.col("sequence")).select(*blocks.columns)


def expired(now_us: int, grace_seconds: int = GRACE_SECONDS) -> Column:
    """Whether a tombstone may be collected."""
    return F.lit(now_us) > F.col("deletion_ts_us") + grace_seconds * 1_000_000


def compact(blocks: DataFrame, tombstones: DataFrame, edges: DataFrame, now_us: int, grace_seconds: int = GRACE_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(newest live blocks, newest unexpired tombstone per id, distinct edges with both ends among those blocks)."""
    live = current(blocks, tombstones)
    kept = tombstones.groupBy("id").agg(F.max(F.struct("sequence", "deletion_ts_us")).alias("v")).select("id", "v.sequence", "v.deletion_ts_us").filter(~expired(now_us, grace_seconds))
    return live, kept, live_edges(edges, live)


def write_sorted(blocks: DataFrame, path: str, partitions: int | None = None, rows_per_file: int = 65_535) -> None:
    """Blocks as Parquet sorted by id within files, so that row-group statistics prune point lookups."""
    dealt = blocks.repartitionByRange(partitions, "id") if partitions else blocks.repartitionByRange("id")
    dealt.sortWithinPartitions("id").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("parquet.bloom.filter.enabled#id", "true").parquet(path)


def block_info(blocks: DataFrame) -> DataFrame:
    """(id, uri, preview, metadata_size): 256 bytes of URI and content at most, cut by bytes."""
    cut = lambda c: F.substring(F.col(c).cast("binary"), 1, 256).cast("string")
    return blocks.select("id", cut("source_uri").alias("uri"), cut("content").alias("preview"), F.octet_length("metadata_json").cast("bigint").alias("metadata_size"))
