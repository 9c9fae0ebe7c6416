"""Ingestion, the catalog, formats, the cache, the command line and the replayed stream."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph import cli, model
from weftgraph.cache import ResultCache
from weftgraph.functions import fmt, render
from weftgraph.session import sweep
from weftgraph.sources import ingest, zig_units
from weftgraph.streaming import replay
from weftgraph.workspace import Database, WorkspaceError

MAIN = """const std = @import("std");
const utils = @import("utils.zig");
pub fn main() !void {
    helper_function();
    utils.utility_function();
    std.debug.print("hi", .{});
}
fn helper_function() void {
    const x = calculate_value(3);
    _ = x;
}
fn calculate_value(n: u32) u32 {
    return if (n > 1) calculate_value(n - 1) else n;
}
"""
UTILS = """pub fn utility_function() void {
    _ = add_numbers(1, 2);
}
fn add_numbers(a: i32, b: i32) i32 {
    return a + b;
}
fn private_helper() void {}
"""
STRUCTS = """pub const StorageEngine = struct {
    const Self = @This();
    name: []const u8 = "{",
    pub fn init(path: []const u8) !StorageEngine {
        return StorageEngine{ .name = path };
    }
    pub fn startup(self: *StorageEngine) error{ Bad, Worse }!void {
        self.deinit();
    }
    pub fn deinit(self: *StorageEngine) void {
        _ = self; // not a call: fake(
    }
};
const Kind = union(enum) { one: u8, two };
fn Wrap(comptime T: type) type {
    return struct {
        fn inner(x: T) T {
            return x;
        }
    };
}
var counter: u64 = 0;
test "storage" {
    _ = try StorageEngine.init("x");
}
"""


@pytest.fixture
def project(tmp_path):
    folder = tmp_path / "project"
    (folder / "src").mkdir(parents=True)
    (folder / ".git").mkdir()
    for name, text in (("src/main.zig", MAIN), ("src/utils.zig", UTILS), ("src/storage.zig", STRUCTS), ("build.zig", "pub fn build() void {}\n"), ("notes.md", "# notes\n"), (".git/x.zig", "fn hidden() void {}\n"), ("tool.py", "def f(): pass\n")):
        (folder / name).write_text(text)
    return folder


def test_scanner():
    found = {(u.kind, u.name): u for u in zig_units.units(STRUCTS)}
    assert set(found) == {("type", "StorageEngine"), ("const", "Self"), ("function", "StorageEngine.init"), ("function", "StorageEngine.startup"), ("function", "StorageEngine.deinit"),
                          ("type", "Kind"), ("function", "Wrap"), ("function", "inner"), ("var", "counter"), ("test", "test_22")}
    startup = found["function", "StorageEngine.startup"]
    assert (startup.line_start, startup.line_end, startup.parent) == (7, 9, "StorageEngine")
    assert startup.edges == [("method_of", "StorageEngine", {}), ("calls_method", "deinit", {"caller_container": "StorageEngine"})]
    assert found["function", "inner"].parent is None and found["type", "StorageEngine"].content.startswith("pub const StorageEngine = struct {")
    calls = {u.name: [(t, x) for t, x, _ in u.edges] for u in zig_units.units(MAIN) if u.kind == "function"}
    assert calls == {"main": [("calls", "helper_function"), ("calls_method", "utility_function"), ("calls_method", "print")], "helper_function": [("calls", "calculate_value")], "calculate_value": [("calls", "calculate_value")]}
    assert [u.kind for u in zig_units.units(MAIN)][:2] == ["import", "import"]


@pytest.mark.parametrize("broken", ["", "fn", "fn f(", "const x = struct {", "}}}}", 'test "a" {', '"open', "fn f() void { g(", "const a = ", "pub", "struct {", "\\\\line", "var x: u8"])
def test_scanner_takes_broken_source(broken):
    for u in zig_units.units(broken):
        assert u.line_start <= u.line_end


def test_inclusion(spark):
    names = spark.createDataFrame([("a.zig",), ("b.md",), ("src/c.py",), ("vendor/d.zig",)], "name string")
    got = lambda *a: sorted(r.name for r in names.filter(ingest.included(F.col("name"), *a)).collect())
    assert got() == ["a.zig", "src/c.py", "vendor/d.zig"]
    assert got(["**/*.md"]) == ["b.md"] and got(["src/"]) == ["src/c.py"] and got([], ["vendor"]) == ["a.zig", "src/c.py"]


def test_files_and_text_blocks(spark, project):
    found = ingest.files(spark, str(project))
    assert sorted(r.path for r in found.collect()) == ["build.zig", "src/main.zig", "src/storage.zig", "src/utils.zig", "tool.py"]
    assert ingest.files(spark, str(project), max_bytes=len(UTILS)).count() == 3
    row = ingest.text_blocks(ingest.files(spark, str(project), ["**/*.md"]), "w").first()
    assert row.source_uri == "file://notes.md#L1-2"
    assert json.loads(row.metadata_json) == {"unit_type": "document", "unit_id": "notes.md:document", "codebase": "w", "content_type": "text/markdown", "file_path": "notes.md"}
    assert {r.kind for r in ingest.units(found, tests=False, variables=False).select("kind").distinct().collect()} == {"function", "type", "import"}


def test_life_of_a_workspace(spark, project, tmp_path):
    now = [10_000.0]
    db = Database(spark, str(tmp_path / "db"), clock=lambda: now[0])
    assert db.workspaces() == [] and db.find("name:main") == []
    linked = db.link(str(project), "w")
    assert linked.block_count == db.blocks().count() and db.is_linked("w")
    for path, name, error in ((str(project), "w", "CodebaseAlreadyLinked"), (str(project), "a/b", "InvalidCodebaseName"), (str(tmp_path / "none"), None, "InvalidCodebasePath")):
        with pytest.raises(WorkspaceError, match=error):
            db.link(path, name)
    assert [r.uri for r in db.find("workspace:w type:function name:main")] == ["file://src/main.zig#L3-7"]
    assert [r.uri for r in db.find("type:struct name:StorageEngine")] == ["file://src/storage.zig#L1-13"]
    assert [r.uri for r in db.find("workspace:w name:StorageEngine.startup")] == [r.uri for r in db.find("name:startup")] != []
    uris = lambda *a, **kw: [r.uri.partition("#")[0].rpartition("/")[2] + ":" + str(r.depth) for r in db.show(*a, **kw)]
    assert sorted(uris("callees", "main", "w", 1)) == ["main.zig:1", "utils.zig:1"]
    assert sorted(uris("callees", "main", "w", 3)) == ["main.zig:1", "main.zig:2", "utils.zig:1", "utils.zig:2"]
    assert sorted(uris("callers", "calculate_value", depth=5)) == ["main.zig:1", "main.zig:2"]
    assert db.show("callers", "nobody") == []
    assert [[u.rpartition("#")[2] for u in p] for p in db.trace("main", "calculate_value")] == [["L3-7", "L8-11", "L12-14"]]
    assert db.statistics.counts["find"] >= 5 and db.cache.statistics.misses > 0

    # A change of one file, a new unit, and a unit that is gone.
    before = {r.id: r.sequence for r in db.blocks().collect()}
    (project / "src/utils.zig").write_text(UTILS.replace("fn private_helper() void {}\n", "fn fresh() void {}\n").replace("a + b", "b + a"))
    now[0] += 7200
    assert db.status()[1][0].sync_status == "sync needed"
    db.sync("w")
    after = {r.id: r.sequence for r in db.blocks().collect()}
    assert len(before.keys() - after.keys()) == 1 and len(after.keys() - before.keys()) == 1
    assert sum(after[k] != before[k] for k in before.keys() & after.keys()) == 1
    assert db.find("name:private_helper") == [] and len(db.find("name:fresh")) == 1
    totals, rows = db.status()
    assert rows[0].sync_status == "synced" and rows[0].last_sync == "0s ago" and totals["live_blocks"] == len(after)

    # Direct writes, deletion with its edges, compaction.
    new = spark.createDataFrame([("n1", 0, "u", "{}", "c", 0), ("n2", 0, "u", "{}", "c", 1), ("n3", 0, "u", "{", "c", 2)], model.BLOCKS + ", ord long")
    assert [r.id for r in db.put_blocks(new).collect()] == ["n3"]
    db.put_edges(spark.createDataFrame([("n1", "n2", "calls"), ("n1", "gone", "calls")], model.EDGES))
    assert db.edges().filter("src = 'n1'").count() == 1
    db.delete(["n2"])
    assert db.edges().filter("src = 'n1'").count() == 0 and db.blocks().filter("id LIKE 'n%'").count() == 1
    state = sorted(tuple(r) for r in db.blocks().collect())
    db.compact(grace_seconds=0)
    assert sorted(tuple(r) for r in db.blocks().collect()) == state and db.versions().count() == len(state)
    db.unlink("w")
    with pytest.raises(WorkspaceError, match="CodebaseNotFound"):
        db.sync("w")
    with pytest.raises(WorkspaceError, match="CodebaseNotFound"):
        db.unlink("w")
    db.close()
    with pytest.raises(WorkspaceError, match="NotInitialized"):
        db.blocks()


def test_command_line(spark, project, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    run = lambda *a: cli.run(db, [*a])
    assert run("version") == (0, f"{cli.VERSION}\n") and run("ping")[0] == 0
    code, text = run("link", "--path", str(project))
    assert code == 0 and text.startswith("✓ Linked project: ")
    assert run("link", "--path", str(project)) == (1, "✗ CodebaseAlreadyLinked\n")
    assert "src/main.zig" in run("find", "--name", "main", "--show-metadata")[1]
    assert json.loads(run("--format", "json", "find", "--name", "nobody")[1]) == {"results": []}
    assert run("--format", "csv", "show", "--relation", "callees", "--target", "helper_function")[1].splitlines()[0] == "id,uri,direction"
    assert "No callers found." in run("show", "--relation", "callers", "--target", "main")[1]
    assert "→" in run("trace", "--from", "main", "--target", "calculate_value")[1]
    assert json.loads(run("--format", "json", "status")[1])["live_blocks"] > 5
    assert run("find", "--type", "constant", "--name", "x")[1].startswith("Found 1 result:")
    assert run("sync", "--all")[0] == 0 and run("unlink", "--name", "project")[0] == 0 and run("unlink", "--name", "project")[0] == 1


@pytest.mark.parametrize("kind, value, want", [
    ("bytes", 1023, "1023 B"), ("bytes", 1536, "1.5 KB"), ("bytes", 2 << 20, "2.0 MB"), ("bytes", 5 << 40, "5120.0 GB"),
    ("time_ago", -1, "in future"), ("time_ago", 30, "30s ago"), ("time_ago", 300, "5m ago"), ("time_ago", 7200, "2h ago"), ("time_ago", 4500, "1h 15m ago"), ("time_ago", 200_000, "2d ago"),
    ("uptime", 45, "45s"), ("uptime", 60, "1m"), ("uptime", 200, "3m 20s"), ("uptime", 3600, "1h"), ("uptime", 7500, "2h 5m"), ("uptime", 86_400, "1d"), ("uptime", 100_800, "1d 4h"),
])
def test_formats(spark, kind, value, want):
    assert spark.range(1).select(getattr(fmt, f"format_{kind}")(F.lit(value))).first()[0] == want


def test_renderings(spark):
    b = spark.createDataFrame([("b", 2, "u", "{}", 'say "hi"', 0.25), ("a", 1, "u", "{}", "x", 0.5)], model.BLOCKS + ", score double")
    text = render.for_model(b, "score")
    assert text.startswith("Found 2 semantically similar blocks:\n\n--- BEGIN CONTEXT BLOCK ---\nBlock 1 (ID: a, Similarity: 0.500):\nSource: u\nSequence: 1\n")
    assert "Block 2 (ID: b):" in render.for_model(b)
    assert [r.line for r in render.csv_lines(b.select("id", "content")).collect()] == ['b,"say ""hi"""', 'a,"x"']
    assert json.loads(render.json_lines(b.select("id", "content")).first().line) == {"id": "b", "content": 'say "hi"'}
    assert render.found([]) == "No results found.\n" and render.operation(False, "no", "csv") == 'success,message\nfalse,"no"\n'


def test_sweep(spark, tmp_path):
    for name in ("weft-a-1", "weft-b-2", "other"):
        spark.range(3).write.parquet(str(tmp_path / name))
    assert sweep(spark, str(tmp_path)) == 2 and [p.name for p in tmp_path.iterdir()] == ["other"]
    assert sweep(spark, str(tmp_path)) == 0


def test_cache():
    now = [0.0]
    cache, made = ResultCache(limit=4, ttl=10, clock=lambda: now[0]), []
    get = lambda v, k: cache.get(v, k, lambda: made.append(k) or k)
    assert [get(1, "a"), get(1, "a"), get(2, "a")] == ["a"] * 3 and made == ["a", "a"]
    now[0] = 11
    get(2, "a")
    assert len(made) == 3 and cache.statistics.expired == 1
    for k in "bcde":
        get(2, k)
    assert list(cache.held) == ["c", "d", "e"] and cache.statistics.evictions == 2
    assert cache.statistics.needs_tuning and not ResultCache().statistics.is_effective


def test_replay(spark, tmp_path):
    def write(n, rows):
        spark.createDataFrame(rows, replay.LOG).coalesce(1).write.parquet(str(tmp_path / f"log/{n}"))

    put = lambda i, s, c: ("put", i, s, "u", "{}", c, None, None, None)
    edge = lambda a, b, t: ("edge", a, None, None, None, None, None, b, t)
    run = lambda: replay.replay(spark, str(tmp_path / "log/*"), str(tmp_path / "t"), str(tmp_path / "c"), 1).awaitTermination(120)
    write(0, [put("a", 1, "x"), put("b", 2, "y"), edge("a", "b", "calls"), edge("a", "a", "calls"), edge("a", "b", "likes")])
    write(1, [put("a", 3, "z"), ("delete", "b", 4, None, None, None, 0, None, None)])
    run()
    live, gone, edges = replay.tables(spark, str(tmp_path / "t"))
    assert [(r.id, r.content) for r in live.collect()] == [("a", "z")] and gone.count() == 1 and edges.count() == 0
    write(2, [put("b", 5, "w")])
    run()
    live, _, edges = replay.tables(spark, str(tmp_path / "t"))
    assert live.count() == 2 and [tuple(r) for r in edges.collect()] == [("a", "b", "calls")]
    # A batch that is tried again replaces itself.
    replay.apply(spark.createDataFrame([put("q", 9, "q")], replay.LOG), 77, str(tmp_path / "t"))
    replay.apply(spark.createDataFrame([put("q", 9, "q")], replay.LOG), 77, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/blocks")).filter("id = 'q'").count() == 1
