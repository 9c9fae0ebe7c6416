"""Ingestion of source folders: files -> units -> blocks and resolved edges.

Files are read by Spark's binaryFile source, so any file system that Spark knows will do; each file is scanned alone in
an Arrow map; symbols are resolved by two equi-joins on (workspace, name), against one row per symbol.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.session import ship
from weftgraph.sources import zig_units

#: File endings that are taken when no pattern is given (fixed values).
EXTENSIONS = (".zig", ".c", ".cpp", ".h", ".hpp", ".rs", ".go", ".py", ".js", ".ts")
MAX_FILE_BYTES = 10 << 20
CONTENT_TYPES = {".md": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".zig": "text/zig"}
UNIT_KINDS = ("function", "type", "const", "var", "import", "test", "document")

UNITS = "path string, unit string, kind string, parent string, line_start int, line_end int, content string, edges array<struct<edge_type:string,target:string,caller_container:string>>"


def included(name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a file is taken: no exclusion is part of its name, and an inclusion is, or '**/*' + ending matches."""
    wanted = F.lit(False)
    for p in include:
        wanted = wanted | name.contains(p)
        if p.startswith("**/*"):
            wanted = wanted | name.endswith(p[4:])
    if not include:
        for ending in EXTENSIONS:
            wanted = wanted | name.endswith(ending)
    for p in exclude:
        wanted = wanted & ~name.contains(p)
    return wanted


def files(spark: SparkSession, folder: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content): files under folder, paths relative to it; hidden and version-control folders are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    tail = F.substring_index(F.col("path"), full, -1)
    kept = found.select(tail.alias("path"), "length", "content").filter((F.col("length") <= max_bytes) & ~F.col("path").rlike(r"(^|/)\.[^/]"))
    return kept.filter(included(F.col("path"), include, exclude)).select("path", F.col("content").cast("string").alias("content"))


def text_blocks(texts: DataFrame, workspace: str) -> DataFrame:
    """Each file (path, content) as one document block whose URI spans lines 1 to newlines + 1."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    kind = F.lit("text/plain")
    for ending, name in CONTENT_TYPES.items():
        kind = F.when(F.col("path").endswith(ending), name).otherwise(kind)
    unit = F.concat("path", F.lit(":document"))
    meta = F.to_json(F.struct(F.lit("document").alias("unit_type"), unit.alias("unit_id"), F.lit(workspace).alias("codebase"), kind.alias("content_type"), F.col("path").alias("file_path")))
    return texts.select(
        model.derived_id(F.lit(workspace), unit, F.lit(1)).alias("id"), F.lit(1).cast("bigint").alias("sequence"),
        F.format_string("file://%s#L1-%d", "path", lines).alias("source_uri"), meta.alias("metadata_json"), "content",
    )


def units(sources: DataFrame, functions: bool = True, types: bool = True, tests: bool = True, variables: bool = True, imports: bool = True) -> DataFrame:
    """Units of Zig files (path, content); other files give none. The switches leave kinds out."""
    ship(sources.sparkSession)
    kept = {k for k, on in (("function", functions), ("type", types), ("test", tests), ("const", variables), ("var", variables), ("import", imports)) if on}
    edge = pa.list_(pa.struct([("edge_type", pa.string()), ("target", pa.string()), ("caller_container", pa.string())]))
    names = [x.split()[0] for x in UNITS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), edge]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for u in zig_units.units(content or ""):
                    if u.kind in kept:
                        edges = [{"edge_type": t, "target": x, "caller_container": more.get("caller_container")} for t, x, more in u.edges]
                        rows.append((path, u.name, u.kind, u.parent, u.line_start, u.line_end, u.content, edges))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return sources.filter(F.col("path").endswith(".zig")).select("path", "content").mapInArrow(scan, UNITS)


def unit_key(workspace: str) -> Column:
    """A unit's block id: stable over repeated ingestion."""
    return model.derived_id(F.lit(workspace), F.concat_ws(":", "path", "unit"), F.col("line_start"))


def unit_blocks(found: DataFrame, workspace: str) -> DataFrame:
    meta = F.to_json(F.struct(F.col("kind").alias("unit_type"), F.concat_ws(":", "path", "unit").alias("unit_id"), F.lit(workspace).alias("codebase"), F.col("path").alias("file_path")))
    return found.select(
        unit_key(workspace).alias("id"), F.lit(1).cast("bigint").alias("sequence"),
        F.format_string("file://%s#L%d-%d", "path", "line_start", "line_end").alias("source_uri"), meta.alias("metadata_json"), "content",
    )


def resolve(found: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """(edges between units, references that name nothing here: src, edge_type, target).

    A target is its exact unit name, else the one in the caller's container; of units with one name the last by (path,
    line) counts. Edges from a unit to itself are left out, as the store takes none.
    """
    symbols = found.filter("kind <> 'test'").groupBy(F.col("unit").alias("name")).agg(F.max_by(unit_key(workspace), F.struct("path", "line_start", F.when(F.col("kind") == "import", 0).otherwise(1))).alias("dst"))
    raw = found.select(unit_key(workspace).alias("src"), "parent", F.explode("edges").alias("e")).select("src", "parent", "e.edge_type", "e.target").distinct()
    exact = symbols.select(F.col("name").alias("target"), F.col("dst").alias("_exact"))
    own = symbols.select(F.col("name").alias("_own_name"), F.col("dst").alias("_own"))
    joined = raw.withColumn("_own_name", F.concat_ws(".", "parent", "target")).join(exact, "target", "left").join(own, "_own_name", "left").withColumn("dst", F.coalesce("_exact", "_own"))
    edges = joined.filter("dst IS NOT NULL AND dst <> src").select("src", "dst", "edge_type").distinct()
    return edges, joined.filter("dst IS NULL").select("src", "edge_type", "target")
