"""Lookups by name, path and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_THRESHOLD, DEFAULT_RESULTS, MAX_RESULTS = 0.7, 100, 500
_KINDS = {"struct": "type", "constant": "const", "variable": "var"}


def by_name(blocks: DataFrame, workspace: str, kind: str, name: str) -> DataFrame:
    """Blocks whose unit has the name: what follows the last ':' of unit_id, or for Container.member the last two parts."""
    field = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    unit = field("unit_id")
    parts = F.split(unit, ":")
    last = F.element_at(parts, -1)
    found = blocks.filter((field("codebase") == workspace) & (field("unit_type") == _KINDS.get(kind, kind)) & unit.contains(":"))
    if "." in name:
        container, _, member = name.partition(".")
        nested = F.when(F.size(parts) >= 3, (F.try_element_at(parts, F.lit(-2)) == container) & (last == member)).otherwise(False)
        return found.filter(nested | (last == name))
    return found.filter((last == name) | (F.substring_index(last, ".", -1) == name) & last.contains("."))


def by_path(blocks: DataFrame, workspace: str, path: str) -> DataFrame:
    field = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    return blocks.filter((field("codebase") == workspace) & (field("file_path") == path))


def keywords(blocks: DataFrame, query: str, threshold: float = DEFAULT_THRESHOLD, limit: int | None = DEFAULT_RESULTS) -> DataFrame:
    """Blocks with the share (32-bit) of the query's words found in their content, best first, ties by id.

    Words are what single blanks separate: an empty one is always found and a repeated one counts again.
    """
    if limit is not None and not 1 <= limit <= MAX_RESULTS:
        raise ValueError("EmptyQuery" if limit < 1 else "TooManyResults")
    words = query.split(" ")
    hits = sum((F.coalesce(F.contains("content", F.lit(w)), F.lit(False)).cast("int") for w in words), F.lit(0))
    likeness = (hits.cast("float") / F.lit(float(len(words))).cast("float")).cast("float")
    found = blocks.select(*blocks.columns, likeness.alias("similarity")).filter(F.col("similarity") >= F.lit(threshold).cast("float"))
    return found if limit is None else found.orderBy(F.desc("similarity"), "id").limit(limit)


def structured(query: str) -> dict[str, str]:
    """workspace:X type:Y name:Z -> its parts; the type defaults to function and the name to the whole text."""
    out = {"workspace": "", "type": "function", "name": query}
    for part in query.split(" "):
        key, colon, value = part.partition(":")
        if colon and key in out:
            out[key] = value
    return out
