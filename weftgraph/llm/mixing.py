"""Mixing sources to target weights by repetition rates.

Method: tokens are summed per source in one map-side-combined aggregation; a capped proportional share turns
them into a target and so a repetition rate per source; each document is then emitted floor(rate) times plus one
hash-seeded Bernoulli copy whose probability is the fraction. No document is ever split, so no shuffle touches text.

Defined results: a null text or one without words has size 0 and takes 0 words (it is still emitted by the rate of
its source); a null source is a source of its own, last in the order; repeated rows are separate documents that
draw the same number; a very long text is counted whole and taken whole; sources whose caps tie by weight are ordered
by their names; an empty table gives an empty result; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hash_unit, join_groups, table, word_count

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_REPEAT = 2
SEED = "mix"


def rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> with target and rate.

    Targets share ``percent`` % of all sizes by weight, none above ``repeat`` times its source's size; what is cut
    off is shared anew. That fixed point is min(cap, weight * level): with sources ordered by cap / weight the
    capped ones are a prefix, so running sums give the level without iteration. Everything up to the last division
    is in integers, hence exact. The input has one row per source, so its windows hold the catalogue of sources only.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(x).cast("bigint") for x in weights])
    df = (
        sizes.withColumn("_place", F.row_number().over(place))
        .withColumn("_w", F.element_at(w, ((F.col("_place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * repeat)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_weight", F.sum("_w").over(every))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    )
    # A source is capped iff its cap is under its share of what the sources before it leave: 100 cap W < w (p T - 100 C).
    left = F.col("_total") * percent - F.col("_cap_before") * 100
    open_ = (F.col("_cap").cast("decimal(38,0)") * 100 * (F.col("_weight") - F.col("_w_before"))) >= (F.col("_w").cast("decimal(38,0)") * left)
    df = df.withColumn("_open", open_)
    # The level is set by the first open source: all from there on are open.
    first = F.min(F.when(F.col("_open"), F.struct("_ratio", "_place", left.alias("left"), (F.col("_weight") - F.col("_w_before")).alias("weight")))).over(every)
    level = df.withColumn("_level", first)
    share = (F.col("_w") * F.col("_level.left")).cast("double") / (F.col("_level.weight") * 100).cast("double")
    return level.select(
        "source", "source_size",
        F.when(F.col("_open"), share).otherwise(F.col("_cap").cast("double")).alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def with_copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """docs -> (_doc struct of all its columns, size, source_size, target, copies)."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    sized = held.select("_doc", F.col(f"_doc.`{source}`").cast("string").alias("_source"), word_count(F.col(f"_doc.`{text}`")).alias("size"))
    sums = table(sized.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumnRenamed("_source", "source"), "mix-sizes")
    rate = rates(sums).withColumnRenamed("source", "_source")
    if sums.count() <= BROADCAST_ROWS:
        rate = F.broadcast(rate.withColumnRenamed("_source", "_of"))
        joined = sized.join(rate, F.col("_source").eqNullSafe(F.col("_of")), "left")
    else:
        joined = join_groups(sized, table(rate, "mix-rates"), ["_source"], "source_size", sums.agg(F.sum("source_size")).first()[0])
    whole = F.floor("rate")
    more = F.when(hash_unit(seed, F.col(f"_doc.`{key}`")) < F.col("rate") - whole, 1).otherwise(0)
    return joined.select("_doc", "size", "source_size", "target", (whole + more).cast("bigint").alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken."""
    taken = with_copies(docs, **kw).filter("copies > 0")
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_doc.*")
