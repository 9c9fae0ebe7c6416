"""Context queries: anchors, expansion rules, and the induced subgraph."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import search
from weftgraph.operators.filters import in_workspace
from weftgraph.operators.traversal import DIRECTIONS, steps
from weftgraph.session import if_small, table

MAX_ANCHORS, MAX_RULES, ANCHOR_BLOCKS, MAX_EDGE_TYPES = 4, 2, 16, 8


@dataclass(frozen=True)
class Anchor:
    """kind: block_id, entity_name (with unit kind) or file_path."""

    kind: str
    value: str
    unit: str = "function"
    workspace: str | None = None

    def find(self, blocks: DataFrame, workspace: str) -> DataFrame:
        if self.workspace not in (None, workspace):
            raise ValueError("WorkspaceMismatch")
        if self.kind == "block_id":
            return blocks.filter((F.col("id") == self.value) & in_workspace(workspace))
        if self.kind == "entity_name":
            return search.by_name(blocks, workspace, self.unit, self.value)
        if self.kind == "file_path":
            return search.by_path(blocks, workspace, self.value)
        raise ValueError(f"unknown anchor {self.kind!r}")


@dataclass(frozen=True)
class Rule:
    direction: str = "outgoing"
    edge_types: tuple[str, ...] = ()
    max_depth: int = 3
    #: None is without a bound.
    max_nodes: int | None = 100

    def check(self) -> None:
        bounded = self.max_nodes is None or 1 <= self.max_nodes <= 10_000
        if self.direction not in DIRECTIONS or len(self.edge_types) > MAX_EDGE_TYPES or not 1 <= self.max_depth <= 32 or not bounded:
            raise ValueError("InvalidRule")


@dataclass(frozen=True)
class ContextQuery:
    workspace: str
    anchors: tuple[Anchor, ...]
    rules: tuple[Rule, ...] = field(default_factory=tuple)
    #: None is without a bound.
    max_total_nodes: int | None = 1000
    #: Wall-clock bound, held against before each phase and round; none unless it is given, as one Spark job takes longer than the usual 100 ms.
    timeout_ms: int | None = None

    def check(self) -> None:
        if not self.workspace or not 1 <= len(self.anchors) <= MAX_ANCHORS or len(self.rules) > MAX_RULES:
            raise ValueError("InvalidQuery")
        for rule in self.rules:
            rule.check()
        if self.max_total_nodes is None:
            return
        if not 1 <= self.max_total_nodes <= 100_000 or any(r.max_nodes is None for r in self.rules) or sum(r.max_nodes for r in self.rules) > 2 * self.max_total_nodes:
            raise ValueError("InvalidQuery")

    def cost(self) -> dict[str, int | bool | None]:
        """A query without a bound on its nodes has no kilobytes, and exceeds the limits."""
        micros = 10 * len(self.anchors) + 5 * len(self.rules) * max((r.max_depth for r in self.rules), default=0)
        kilobytes = None if self.max_total_nodes is None else 2 * self.max_total_nodes
        return {"micros": micros, "kilobytes": kilobytes, "exceeds_limits": micros > 1_000_000 or kilobytes is None or kilobytes > 100_000}


@dataclass
class ContextStatistics:
    """What the context queries of one caller took, in microseconds."""

    queries_executed: int = 0
    total_execution_time_us: int = 0
    last_query_time_us: int = 0

    @property
    def average_query_time_us(self) -> int:
        return self.total_execution_time_us // self.queries_executed if self.queries_executed else 0

    def record(self, seconds: float) -> None:
        self.last_query_time_us = int(seconds * 1e6)
        self.queries_executed += 1
        self.total_execution_time_us += self.last_query_time_us

    def reset(self) -> None:
        self.queries_executed = self.total_execution_time_us = self.last_query_time_us = 0


def neighbours(edges: DataFrame, ident: str, incoming: bool = False) -> DataFrame:
    """(id): the distinct nodes one edge away, along the edges or against them."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    return edges.filter(F.col(near) == ident).select(F.col(far).alias("id")).distinct()


def utilization(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """(node_count, edge_count, node_percent, edge_percent) of a context graph against its bounds."""
    counts = nodes.agg(F.count("*").alias("node_count")).join(edges.agg(F.count("*").alias("edge_count")))
    return counts.select("node_count", "edge_count", F.expr(f"node_count * 100 div {max_nodes}").alias("node_percent"), F.expr(f"edge_count * 100 div {max_edges}").alias("edge_percent"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, missing): edges with an end that is no node; missing is source or target, the source first. Empty for a valid graph."""
    ids = nodes.select("id").distinct()
    found = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    missing = F.when(F.col("_s").isNull(), "source").when(F.col("_d").isNull(), "target")
    return found.select("src", "dst", "edge_type", missing.alias("missing")).filter("missing IS NOT NULL")


def _first(nodes: DataFrame, limit: int | None) -> DataFrame:
    return nodes if limit is None else nodes.orderBy("depth", "id").limit(limit)


def run(query: ContextQuery, blocks: DataFrame, edges: DataFrame, statistics: ContextStatistics | None = None, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with depth, edges among them, metrics row).

    Each rule starts anew from the anchors and walks only nodes of the workspace over its edge types. A rule keeps its
    first max_nodes by (depth, id), and the result the first max_total_nodes; where a bound is None, all of them.
    """
    query.check()
    began = clock()

    def in_time() -> None:
        if query.timeout_ms is not None and (clock() - began) * 1000 > query.timeout_ms:
            raise TimeoutError("QueryTimeout")

    found = None
    for anchor in query.anchors:
        in_time()
        hit = anchor.find(blocks, query.workspace).select("id").limit(ANCHOR_BLOCKS + 1)
        if hit.count() > ANCHOR_BLOCKS:
            raise ValueError("TooManyAnchorBlocks")
        found = hit if found is None else found.unionByName(hit)
    anchors = table(found.distinct(), "anchors")
    inside = table(blocks.filter(in_workspace(query.workspace)).select("id"), "inside")
    inside = if_small(inside, inside.count())
    nodes = anchors.withColumn("depth", F.lit(0))
    for rule in query.rules:
        move = steps(edges, rule.direction, F.col("edge_type").isin(*rule.edge_types) if rule.edge_types else None)
        seen = front = anchors.withColumn("depth", F.lit(0))
        n = reached = anchors.count()
        for d in range(1, rule.max_depth + 1):
            in_time()
            if not n or rule.max_nodes is not None and reached >= rule.max_nodes:
                break
            new = move.join(if_small(front.select(F.col("id").alias("a")), n), "a").select(F.col("b").alias("id")).distinct()
            new = new.join(inside, "id", "left_semi").join(if_small(seen.select("id"), reached), "id", "left_anti")
            front = table(new.withColumn("depth", F.lit(d)), "frontier")
            n = front.count()
            reached += n
            seen = seen.unionByName(front)
        nodes = nodes.unionByName(_first(seen, rule.max_nodes))
    in_time()
    nodes = table(_first(nodes.groupBy("id").agg(F.min("depth").alias("depth")), query.max_total_nodes), "context")
    ids = nodes.select("id")
    induced = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "edge_type").distinct()
    metrics = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.count_if(F.col("depth") == 0).alias("anchors"))
    in_time()
    if statistics is not None:
        statistics.record(clock() - began)
    return nodes, induced, metrics
