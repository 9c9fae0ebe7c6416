"""Command line: ``python -m weftgraph.cli --root FOLDER VERB ...``"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from weftgraph.functions import render
from weftgraph.workspace import FIND_RESULTS, RELATIONS, SHOW_DEPTH, TRACE_DEPTH, Database, WorkspaceError

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph", description="Graph queries over linked code folders.")
    top.add_argument("--root", default="weftgraph-data", help="folder of the database")
    top.add_argument("--format", choices=render.FORMATS, default="text")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("version", "ping", "status"):
        verbs.add_parser(name)
    find = verbs.add_parser("find", help="units by type and name")
    find.add_argument("--type", default="function", choices=["function", "struct", "type", "variable", "constant", "import", "test"])
    find.add_argument("--name", required=True)
    find.add_argument("--workspace", default="")
    find.add_argument("--max-results", type=int, default=FIND_RESULTS)
    find.add_argument("--show-metadata", action="store_true")
    show = verbs.add_parser("show", help="units related to one")
    show.add_argument("--relation", required=True, choices=[*RELATIONS])
    show.add_argument("--target", required=True)
    show.add_argument("--workspace", default="")
    show.add_argument("--max-depth", type=int, default=SHOW_DEPTH)
    trace = verbs.add_parser("trace", help="all that calls a unit or is called by it, or the paths between two")
    trace.add_argument("--direction", choices=["callers", "callees"], default="callees")
    trace.add_argument("--target", required=True)
    trace.add_argument("--from", dest="source")
    trace.add_argument("--workspace", default="")
    trace.add_argument("--max-depth", type=int, default=TRACE_DEPTH)
    link = verbs.add_parser("link", help="ingest a folder")
    link.add_argument("--path", required=True)
    link.add_argument("--name")
    for name in ("unlink", "sync"):
        verb = verbs.add_parser(name)
        verb.add_argument("--name", required=name == "unlink")
        if name == "sync":
            verb.add_argument("--all", action="store_true")
    return top


def run(db: Database, argv: Sequence[str]) -> tuple[int, str]:
    """(exit code, output) of one command."""
    a = parser().parse_args(argv)
    form = a.format
    try:
        if a.verb == "version":
            return 0, f"{VERSION}\n"
        if a.verb == "ping":
            return 0, render.operation(True, f"{db.spark.range(1).count()} session answers", form)
        if a.verb == "status":
            return 0, render.status(*db.status(), form)
        if a.verb == "find":
            query = f"type:{a.type} name:{a.name}" + (f" workspace:{a.workspace}" if a.workspace else "")
            return 0, render.found(db.find(query, a.max_results), form, a.show_metadata)
        if a.verb == "show":
            return 0, render.related(db.show(a.relation, a.target, a.workspace, a.max_depth), a.relation, form)
        if a.verb == "trace" and a.source:
            paths = db.trace(a.source, a.target, a.workspace, a.max_depth)
            return 0, "".join(" → ".join(p) + "\n" for p in paths) or render.related([], "paths", form)
        if a.verb == "trace":
            return 0, render.related(db.show(a.direction, a.target, a.workspace, a.max_depth), a.direction, form)
        if a.verb == "link":
            row = db.link(a.path, a.name)
            return 0, render.operation(True, f"Linked {row.name}: {row.block_count} blocks, {row.edge_count} edges", form)
        if a.verb == "unlink":
            db.unlink(a.name)
            return 0, render.operation(True, f"Unlinked {a.name}", form)
        rows = db.sync(None if a.all else a.name)
        return 0, "".join(render.operation(True, f"Synced {r.name}: {r.block_count} blocks, {r.edge_count} edges", form) for r in rows)
    except (WorkspaceError, ValueError) as e:
        return 1, render.operation(False, str(e), form)


def main(argv: Sequence[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    root = parser().parse_args(argv).root
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    code, text = run(Database(spark, root), argv)
    sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
