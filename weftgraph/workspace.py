"""A database of linked code folders: catalog, ingestion, lookups, relations, status.

State is Parquet under one root folder. Blocks, tombstones and edges are append-only logs, one folder per change, written
whole and named in the catalog only afterwards; so a change that fails halfway is never read, and a repeated one writes
another folder. The catalog is one small snapshot per change; the highest number counts.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.cache import ResultCache
from weftgraph.functions import fmt
from weftgraph.operators import search, stats, store, traversal
from weftgraph.operators.filters import in_workspace
from weftgraph.session import table
from weftgraph.sources import ingest

FORBIDDEN = r'[/\\:*?"<>|]'
FIND_RESULTS, SHOW_DEPTH, TRACE_DEPTH = 10, 3, 10
RELATIONS = {"callers": "incoming", "callees": "outgoing", "references": "bidirectional", "imports": "outgoing", "exports": "incoming"}
_CATALOG = "name string, path string, linked_ts bigint, last_sync_ts bigint, block_count bigint, edge_count bigint"
_LOG = "kind string, folder string"


class WorkspaceError(ValueError):
    """InvalidCodebasePath, InvalidCodebaseName, CodebaseAlreadyLinked, CodebaseNotFound, NotInitialized."""


@dataclass
class QueryStatistics:
    """Counts and time by kind of query."""

    counts: dict[str, int]
    total_us: int = 0

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    @property
    def average_us(self) -> int:
        return self.total_us // self.total if self.total else 0

    @property
    def per_second(self) -> float:
        return self.total * 1e6 / self.total_us if self.total_us else 0.0


class Database:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.cache, self.statistics, self.closed = ResultCache(), QueryStatistics({}), False
        self._held: dict[tuple, DataFrame] = {}

    # State.
    def _snapshots(self) -> list[int]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        where = jvm.Path(f"{self.root}/catalog")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        names = (s.getPath() for s in system.listStatus(where))
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and system.exists(jvm.Path(p, "log/_SUCCESS")))

    @property
    def version(self) -> int:
        return max(self._snapshots(), default=0)

    def _read(self, version: int, part: str, schema: str) -> list[Row]:
        return self.spark.read.schema(schema).parquet(f"{self.root}/catalog/{version}/{part}").collect() if version else []

    def _commit(self, spaces: Iterable[tuple], added: Iterable[tuple[str, str]] = ()) -> None:
        """A new snapshot: the workspaces, and the log with the folders that were added."""
        v = self.version
        log = [tuple(r) for r in self._read(v, "log", _LOG)] + list(added)
        for part, rows, schema in (("workspaces", list(spaces), _CATALOG), ("log", log, _LOG)):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/catalog/{v + 1}/{part}")

    def _append(self, kind: str, df: DataFrame) -> tuple[str, str]:
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return kind, folder

    def _log(self, kind: str, schema: str) -> DataFrame:
        if self.closed:
            raise WorkspaceError("NotInitialized")
        v = self.version
        if (v, kind) not in self._held:
            folders = [f"{self.root}/{r.folder}" for r in self._read(v, "log", _LOG) if r.kind == kind]
            self._held = {k: x for k, x in self._held.items() if k[0] == v}
            self._held[v, kind] = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return self._held[v, kind]

    def versions(self) -> DataFrame:
        return self._log("blocks", model.BLOCKS)

    def tombstones(self) -> DataFrame:
        return self._log("tombstones", model.TOMBSTONES)

    def blocks(self) -> DataFrame:
        return store.current(self.versions(), self.tombstones())

    def edges(self) -> DataFrame:
        return store.live_edges(self._log("edges", model.EDGES), self.blocks())

    def close(self) -> None:
        self.closed = True

    # Writes.
    def put_blocks(self, new: DataFrame) -> DataFrame:
        """Appends valid blocks (with an ``ord`` column) under fresh sequences; returns the rejected ones with their errors."""
        start = store.next_sequence(self.versions(), self.tombstones()).first()[0]
        checked = table(new.withColumn("sequence", F.lit(1).cast("bigint")).withColumn("errors", model.block_errors()), "put")
        good = store.ranked(checked.filter(F.size("errors") == 0), "ord").withColumn("sequence", F.col("rank") + F.lit(start))
        self._commit(self._rows(), [self._append("blocks", good.selectExpr(*(c.split()[0] for c in model.BLOCKS.split(", "))))])
        return checked.filter(F.size("errors") > 0).select("id", "errors")

    def put_edges(self, new: DataFrame) -> DataFrame:
        """Appends valid edges between live blocks; returns the rejected ones with their errors."""
        checked = table(model.edge_errors(new, self.blocks()), "put")
        self._commit(self._rows(), [self._append("edges", checked.filter(F.size("errors") == 0).select("src", "dst", "edge_type"))])
        return checked.filter(F.size("errors") > 0)

    def delete(self, ids: list[str]) -> None:
        none = self.spark.createDataFrame([], model.TOMBSTONES)
        start = store.next_sequence(self.versions(), self.tombstones()).first()[0]
        rows = [(i, start + k, int(self.clock() * 1e6)) for k, i in enumerate(ids)]
        self._commit(self._rows(), [self._append("tombstones", none.unionByName(self.spark.createDataFrame(rows, model.TOMBSTONES)))])

    def compact(self, grace_seconds: int = store.GRACE_SECONDS) -> None:
        """Rewrites the logs as newest live blocks, unexpired tombstones and edges among the blocks; old folders stay on disk."""
        parts = store.compact(self.versions(), self.tombstones(), self._log("edges", model.EDGES), int(self.clock() * 1e6), grace_seconds)
        log = [self._append(kind, df) for kind, df in zip(("blocks", "tombstones", "edges"), parts, strict=True)]
        v = self.version
        for part, rows, schema in (("workspaces", self._rows(), _CATALOG), ("log", log, _LOG)):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/catalog/{v + 1}/{part}")

    # Catalog.
    def _rows(self) -> list[tuple]:
        return [tuple(r) for r in self._read(self.version, "workspaces", _CATALOG)]

    def workspaces(self) -> list[Row]:
        return sorted(self._read(self.version, "workspaces", _CATALOG), key=lambda r: r.name)

    def info(self, name: str) -> Row | None:
        return next((r for r in self.workspaces() if r.name == name), None)

    def is_linked(self, name: str) -> bool:
        return self.info(name) is not None

    def link(self, path: str, name: str | None = None) -> Row:
        """Links a folder under a name (the folder's own by default) and ingests it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not path or not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            raise WorkspaceError("InvalidCodebasePath")
        name = path.rstrip("/").rpartition("/")[2] if name is None else name
        if not name or re.search(FORBIDDEN, name):
            raise WorkspaceError("InvalidCodebaseName")
        if self.is_linked(name):
            raise WorkspaceError("CodebaseAlreadyLinked")
        return self._ingest(name, path, int(self.clock()))

    def sync(self, name: str | None = None) -> list[Row]:
        """Ingests a workspace (or all) again: changed units get new versions, units that are gone get tombstones."""
        if name is None:
            return [self._ingest(r.name, r.path, r.linked_ts) for r in self.workspaces()]
        held = self.info(name)
        if held is None:
            raise WorkspaceError("CodebaseNotFound")
        return [self._ingest(name, held.path, held.linked_ts)]

    def unlink(self, name: str) -> None:
        """Takes the workspace out of the catalog; its blocks stay."""
        if not self.is_linked(name):
            raise WorkspaceError("CodebaseNotFound")
        self._commit(r for r in self._rows() if r[0] != name)

    def clear(self) -> None:
        self._commit([])

    def _ingest(self, name: str, path: str, linked: int) -> Row:
        sources = ingest.files(self.spark, path)
        units = table(ingest.units(sources), "units")
        made = table(ingest.unit_blocks(units, name).filter(F.octet_length("content") > 0).dropDuplicates(["id"]), "made")
        held = table(self.blocks().filter(in_workspace(name)), "held")
        changed = made.join(held.select("id", "content", "metadata_json", "source_uri"), ["id", "content", "metadata_json", "source_uri"], "left_anti")
        gone = held.select("id").join(made.select("id"), "id", "left_anti")
        start = store.next_sequence(self.versions(), self.tombstones()).first()[0]
        fresh = store.ranked(changed.drop("sequence"), "id").withColumn("sequence", F.col("rank") + F.lit(start)).select("id", "sequence", "source_uri", "metadata_json", "content")
        fresh = table(fresh, "fresh")
        after = start + fresh.count()
        dead = store.ranked(gone, "id").select("id", (F.col("rank") + F.lit(after)).alias("sequence"), F.lit(int(self.clock() * 1e6)).cast("bigint").alias("deletion_ts_us"))
        found = table(ingest.resolve(units, name)[0], "edges")
        now, blocks, edges = int(self.clock()), made.count(), found.count()
        row = (name, path, linked, now, blocks, edges)
        self._commit([*(r for r in self._rows() if r[0] != name), row], [self._append("blocks", fresh), self._append("tombstones", dead), self._append("edges", found)])
        return self.info(name)

    # Queries.
    def _timed(self, kind: str, key: tuple, make: Callable[[], object]):
        began = time.perf_counter_ns()
        try:
            return self.cache.get(self.version, (kind, *key), make)
        finally:
            self.statistics.counts[kind] = self.statistics.counts.get(kind, 0) + 1
            self.statistics.total_us += (time.perf_counter_ns() - began) // 1000

    def find(self, query: str, limit: int = FIND_RESULTS) -> list[Row]:
        """Blocks by 'workspace:X type:Y name:Z' as (id, uri, preview, metadata_size) rows; an empty workspace is any."""
        if not 1 <= limit <= 1000:
            raise ValueError("InvalidMaxResults")
        q = search.structured(query)
        return self._timed("find", (query, limit), lambda: store.block_info(self._named(q["workspace"], q["type"], q["name"])).orderBy("id").limit(limit).collect())

    def _named(self, workspace: str, kind: str, name: str) -> DataFrame:
        live = self.blocks()
        if workspace:
            return search.by_name(live, workspace, kind, name)
        spaces = [r.name for r in self.workspaces()]
        found = [search.by_name(live, w, kind, name) for w in spaces]
        out = live.limit(0)
        for df in found:
            out = out.unionByName(df)
        return out

    def _target(self, name: str, workspace: str) -> str | None:
        """The id of the unit to start from: functions first, then types, then the rest."""
        if re.fullmatch(r"[0-9a-f]{32}", name):
            return name
        for kind in ("function", "type", "const", "var", "import"):
            hit = self._named(workspace, kind, name).select("id").orderBy("id").first()
            if hit:
                return hit.id
        return None

    def show(self, relation: str, target: str, workspace: str = "", depth: int = SHOW_DEPTH, limit: int = 1000) -> list[Row]:
        """(id, uri, depth) of what is related to a unit, itself left out."""
        if relation not in RELATIONS:
            raise ValueError(f"unknown relation {relation!r}")
        keep = F.col("edge_type") == "imports" if relation in ("imports", "exports") else None

        def run() -> list[Row]:
            start = self._target(target, workspace)
            if start is None:
                return []
            live = table(self.blocks(), "live")
            found = traversal.bfs(self.edges(), start, RELATIONS[relation], depth, keep=keep).filter("depth > 0")
            if workspace:
                found = traversal.in_ws(found, live, workspace)
            named = found.join(live.select("id", F.col("source_uri").alias("uri")), "id")
            return named.select("id", "uri", "depth").orderBy("depth", "id").limit(limit).collect()

        return self._timed("show", (relation, target, workspace, depth, limit), run)

    def trace(self, source: str, target: str, workspace: str = "", depth: int = TRACE_DEPTH, limit: int = traversal.MAX_PATHS) -> list[list[str]]:
        """Shortest paths of source URIs from one unit to another, one for each unit that calls the target on the way."""

        def run() -> list[list[str]]:
            ends = self._target(source, workspace), self._target(target, workspace)
            if None in ends:
                return []
            paths = [r.path for r in traversal.paths_between(self.edges(), *ends, depth, limit).orderBy("hops", "path").collect()]
            wanted = sorted({x for p in paths for x in p})
            uris = {r.id: r.source_uri for r in self.blocks().filter(F.col("id").isin(wanted)).select("id", "source_uri").collect()} if wanted else {}
            return [[uris.get(x, x) for x in p] for p in paths]

        return self._timed("trace", (source, target, workspace, depth, limit), run)

    def status(self) -> tuple[dict[str, int], list[Row]]:
        """Totals, and (name, path, sync_status, last_sync, size, block_count, edge_count) of each workspace."""
        totals = stats.storage_statistics(self.versions(), self.blocks(), self.edges()).first().asDict()
        now = int(self.clock())
        rows = self.spark.createDataFrame([tuple(r) for r in self.workspaces()], _CATALOG)
        size = fmt.format_bytes(F.col("block_count") * 2048 + F.col("edge_count") * 64)
        return totals, rows.select("name", "path", stats.sync_status(F.col("last_sync_ts"), now).alias("sync_status"), fmt.format_time_ago(F.lit(now) - F.col("last_sync_ts")).alias("last_sync"), size.alias("size"), "block_count", "edge_count").orderBy("name").collect()
