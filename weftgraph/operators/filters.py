"""Filters: conditions and their trees as Spark columns, paging, statistics, edge-type and workspace filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text

DEFAULT_RESULTS, MAX_RESULTS = 1000, 10_000


class Operator(IntEnum):
    equal, not_equal, greater, greater_equal, less, less_equal, contains, starts_with, ends_with = range(9)


class Logic(IntEnum):
    and_, or_, not_ = range(3)


class Target(IntEnum):
    content, source_uri, metadata_field, sequence, content_length = range(5)


def decode(kind: type[IntEnum], value: int) -> IntEnum:
    try:
        return kind(value)
    except ValueError:
        raise ValueError("InvalidFilter") from None


@dataclass(frozen=True)
class Condition:
    """One comparison; ``textual`` reads metadata by scanning its text in place of parsing it."""

    target: Target
    operator: Operator
    value: str
    field: str | None = None
    textual: bool = False

    def operand(self) -> Column:
        t = self.target
        if t is Target.metadata_field:
            if not self.field:
                raise ValueError("InvalidFilter")
            return (text.textual_field if self.textual else text.json_field)(F.col("metadata_json"), self.field)
        if t is Target.content_length:
            return F.coalesce(F.octet_length("content"), F.lit(0)).cast("string")
        return F.coalesce(F.col(t.name).cast("string"), F.lit(""))

    def column(self) -> Column:
        left, op = self.operand(), self.operator
        if op is Operator.contains:
            return left.contains(self.value)
        if op is Operator.starts_with:
            return left.startswith(self.value)
        if op is Operator.ends_with:
            return left.endswith(self.value)
        order = text.compare(left, self.value)
        return {
            Operator.equal: order == 0, Operator.not_equal: order != 0, Operator.greater: order > 0,
            Operator.greater_equal: order >= 0, Operator.less: order < 0, Operator.less_equal: order <= 0,
        }[op]


@dataclass(frozen=True)
class Tree:
    """A logical node; a missing right side leaves the left one's result."""

    logic: Logic
    left: Condition | Tree
    right: Condition | Tree | None = None

    def column(self) -> Column:
        left = self.left.column()
        if self.logic is Logic.not_:
            return ~left
        if self.right is None:
            return left
        return left & self.right.column() if self.logic is Logic.and_ else left | self.right.column()


def content_contains(value: str) -> Condition:
    return Condition(Target.content, Operator.contains, value)


def source_uri(value: str, operator: Operator = Operator.equal) -> Condition:
    return Condition(Target.source_uri, operator, value)


def metadata_field(field: str, value: str, operator: Operator = Operator.equal) -> Condition:
    return Condition(Target.metadata_field, operator, value, field)


def select(blocks: DataFrame, where: Condition | Tree, limit: int | None = DEFAULT_RESULTS, offset: int = 0) -> DataFrame:
    """Matching blocks in id order, one page of them; limit None is all of them, without an order."""
    found = blocks.filter(where.column())
    if limit is None:
        return found
    if limit < 1:
        raise ValueError("EmptyQuery")
    if limit > MAX_RESULTS:
        raise ValueError("ResultsLimitExceeded")
    return found.orderBy("id").offset(offset).limit(limit)


def statistics(blocks: DataFrame, where: Condition | Tree, limit: int = DEFAULT_RESULTS, offset: int = 0) -> DataFrame:
    """(scanned, matches, returned, has_more) over the whole input."""
    out = blocks.agg(F.count("*").alias("scanned"), F.count_if(where.column()).alias("matches"))
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("matches") - offset)).cast("bigint")
    return out.select("scanned", "matches", returned.alias("returned"), (F.col("matches") > offset + limit).alias("has_more"))


def edge_types(kind: str = "all", types: Sequence[str] = ()) -> Column:
    """all, only, include or exclude. Including nothing matches nothing; excluding nothing matches everything."""
    if kind == "all":
        return F.lit(True)
    if kind == "only" and len(types) != 1:
        raise ValueError("only takes one type")
    if kind in ("only", "include"):
        return F.col("edge_type").isin(*types) if types else F.lit(False)
    if kind == "exclude":
        return ~F.col("edge_type").isin(*types) if types else F.lit(True)
    raise ValueError(f"unknown edge filter {kind!r}")


def in_workspace(name: str) -> Column:
    """Whether the block's JSON codebase is the workspace; metadata that is no JSON or lacks it does not match."""
    return F.coalesce(F.get_json_object("metadata_json", "$.codebase") == name, F.lit(False))
