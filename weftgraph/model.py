"""The data model: blocks, edges, tombstones, workspaces; identifiers, edge types and write-time rules."""

from __future__ import annotations

import json
import re
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "id string, sequence bigint, source_uri string, metadata_json string, content string"
EDGES = "src string, dst string, edge_type string"
TOMBSTONES = "id string, sequence bigint, deletion_ts_us bigint"
WORKSPACES = "name string, path string, linked_ts bigint, last_sync_ts bigint, block_count bigint, edge_count bigint"

MAX_METADATA, MAX_URI, MAX_CONTENT = 10 << 20, 1 << 20, 100 << 20


class EdgeType(IntEnum):
    imports = 1
    defined_in = 2
    references = 3
    contains = 4
    extends = 5
    implements = 6
    calls = 7
    depends_on = 8
    method_of = 9
    calls_method = 10
    calls_function = 11

    @classmethod
    def decode(cls, value: int | str) -> EdgeType:
        """From the number or the name; anything else is a ValueError."""
        try:
            return cls[value] if isinstance(value, str) else cls(value)
        except (KeyError, ValueError):
            raise ValueError(f"invalid edge type: {value!r}") from None


EDGE_TYPES = tuple(t.name for t in EdgeType)


def block_id(value: int) -> str:
    """The identifier of a small number: 16 bytes, low 8 little-endian, as 32 lower-case hexadecimal digits."""
    return value.to_bytes(8, "little").hex() + "0" * 16


def check_id(value: str) -> str:
    if not re.fullmatch(r"[0-9a-f]{32}", value):
        raise ValueError("an identifier has 32 lower-case hexadecimal digits")
    if value == "0" * 32:
        raise ValueError("the zero identifier is invalid")
    return value


def derived_id(*parts: Column) -> Column:
    """A stable identifier: ingesting the same unit again gives the same block."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def block_errors() -> Column:
    """Names of the write rules that a block breaks, as an array; empty for a valid block."""
    rule = lambda name, bad: F.when(bad, F.lit(name))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return F.array_compact(F.array(
        rule("id", F.col("id").isNull() | (F.col("id") == "0" * 32) | (F.col("id") == "")),
        rule("sequence", F.col("sequence").isNull() | (F.col("sequence") <= 0)),
        rule("uri_empty", size("source_uri") == 0),
        rule("uri_size", size("source_uri") >= MAX_URI),
        rule("metadata_size", size("metadata_json") >= MAX_METADATA),
        rule("metadata_json", F.try_parse_json("metadata_json").isNull()),
        rule("content_empty", size("content") == 0),
        rule("content_size", size("content") >= MAX_CONTENT),
    ))


def edge_errors(edges: DataFrame, live: DataFrame) -> DataFrame:
    """edges with an array of broken rules: unknown type, self-loop, missing or deleted ends."""
    ids = live.select("id").distinct()
    return (
        edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left")
        .join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        .select("src", "dst", "edge_type", F.array_compact(F.array(
            F.when(~F.coalesce(F.col("edge_type").isin(*EDGE_TYPES), F.lit(False)), F.lit("type")),
            F.when(F.col("src").eqNullSafe(F.col("dst")), F.lit("self_loop")),
            F.when(F.col("_s").isNull(), F.lit("source_missing")),
            F.when(F.col("_d").isNull(), F.lit("target_missing")),
        )).alias("errors"))
    )


def parse_metadata(text: str) -> dict:
    """Metadata as a dict; text that is no JSON object is an empty one."""
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}
