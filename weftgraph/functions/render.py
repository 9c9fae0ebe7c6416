"""Renderings of results: text, JSON and CSV lines, and text for language models.

Row renderings are columns, so results of any size are written by Spark; ``page`` puts a bounded page of results into
one string for a terminal.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weftgraph.session import ranked

FORMATS = ("text", "json", "csv")
PREVIEW, PAGE = 80, 1000
BEGIN, END = "--- BEGIN CONTEXT BLOCK ---", "--- END CONTEXT BLOCK ---"


def model_text(blocks: DataFrame, similarity: str | None = None) -> DataFrame:
    """(ord, text): each block as text for a language model, numbered by descending similarity and id.

    The numbering is by ranges, so results of any size are numbered without meeting in one task.
    """
    order = [*([F.desc(similarity)] if similarity else []), F.col("id")]
    head = F.format_string("Block %d (ID: %s, Similarity: %.3f):", "ord", "id", F.col(similarity).cast("double")) if similarity else F.format_string("Block %d (ID: %s):", "ord", "id")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    text = F.concat_ws("\n", F.lit(BEGIN), head, line("Source", "source_uri"), line("Sequence", "sequence"), line("Metadata", "metadata_json"), line("Content", "content"), F.lit(END))
    return ranked(blocks, *order).withColumn("ord", (F.col("rank") + 1).cast("int")).select("ord", text.alias("text"))


def for_model(blocks: DataFrame, similarity: str | None = None) -> str:
    rows = model_text(blocks, similarity).orderBy("ord").limit(PAGE).collect()
    head = f"Found {len(rows)} semantically similar blocks:" if similarity else f"Retrieved {len(rows)} blocks:"
    return "\n\n".join([head, *(r.text for r in rows)]) + "\n\n"


def json_lines(info: DataFrame) -> DataFrame:
    """(line): each row of (id, uri, preview, metadata_size) or any other columns as one JSON object."""
    return info.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in info.columns]), {"ignoreNullFields": "false"}).alias("line"))


def csv_field(value: Column) -> Column:
    """Quoted, with quotes doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(info: DataFrame, plain: Sequence[str] = ("id", "metadata_size")) -> DataFrame:
    """(line): strings quoted, ``plain`` columns bare; the header is ``','.join(info.columns)``."""
    return info.select(F.concat_ws(",", *[F.col(c).cast("string") if c in plain else csv_field(F.col(c)) for c in info.columns]).alias("line"))


def _quoted(value) -> str:
    return '"' + str("" if value is None else value).replace('"', '""') + '"'


def found(rows: list[Row], form: str = "text", metadata: bool = False) -> str:
    """A page of lookup results (id, uri, preview, metadata_size)."""
    if form == "json":
        return json.dumps({"results": [r.asDict() for r in rows]}, ensure_ascii=False) + "\n"
    if form == "csv":
        return "".join(["id,uri,preview,metadata_size\n", *(f"{r.id},{_quoted(r.uri)},{_quoted(r.preview)},{r.metadata_size}\n" for r in rows)])
    if not rows:
        return "No results found.\n"
    out = [f"Found {len(rows)} result{'' if len(rows) == 1 else 's'}:\n"]
    for k, r in enumerate(rows, 1):
        out += ["", f"[{k}] {r.uri}", f"    ID: {r.id}"]
        if r.preview:
            out.append(f"    Preview: {r.preview[:PREVIEW]}" + "..." * (len(r.preview) > PREVIEW))
        if metadata and r.metadata_size:
            out.append(f"    Metadata: {r.metadata_size} bytes")
    return "\n".join(out).replace("\n\n\n", "\n\n") + "\n"


def related(rows: list[Row], relation: str, form: str = "text") -> str:
    """A page of related blocks (id, uri): callers, callees, references, imports or exports."""
    if form == "json":
        return json.dumps({"direction": relation, "results": [{"id": r.id, "uri": r.uri} for r in rows]}, ensure_ascii=False) + "\n"
    if form == "csv":
        return "".join(["id,uri,direction\n", *(f"{r.id},{_quoted(r.uri)},{_quoted(relation)}\n" for r in rows)])
    if not rows:
        return f"No {relation} found.\n"
    arrow = "←" if relation in ("callers", "exports") else "→"
    return f"Found {len(rows)} {relation}:\n\n" + "".join(f"  {arrow} {r.uri}\n" for r in rows)


def operation(success: bool, message: str, form: str = "text") -> str:
    if form == "json":
        return json.dumps({"success": success, "message": message}, ensure_ascii=False) + "\n"
    if form == "csv":
        return f"success,message\n{str(success).lower()},{_quoted(message)}\n"
    return f"{'✓' if success else '✗'} {message}\n"


def status(values: dict[str, int], workspaces: list[Row], form: str = "text") -> str:
    """Totals, and in text the workspaces (name, sync_status, last_sync, size) below them."""
    if form == "json":
        return json.dumps(values) + "\n"
    if form == "csv":
        return "metric,value\n" + "".join(f"{k},{v}\n" for k, v in values.items())
    out = ["Status", f"├─ Workspaces: {len(workspaces)} linked", *(f"├─ {k}: {v}" for k, v in values.items())]
    icons = {"synced": "✓", "sync needed": "⚠", "never synced": "⚠"}
    out += [f"  {icons.get(w.sync_status, '✗')} {w.name:<15} {w.sync_status} {w.last_sync:<8} ({w.size})" for w in workspaces] or ["No workspaces linked."]
    return "\n".join(out) + "\n"
