"""Versions, deletions, batches, compaction, validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.operators import context, stats, store
from weftgraph.session import ranked

GONE = model.TOMBSTONES


def blocks(spark, *rows):
    return spark.createDataFrame([(i, s, f"uri://{i}", '{"codebase": "w"}', c) for i, s, c in rows], model.BLOCKS)


def gone(spark, *rows):
    return spark.createDataFrame([(i, s, t) for i, s, t in rows], GONE)


def test_newest_version_counts_and_deletions_hide(spark):
    b = blocks(spark, ("a", 1, "old"), ("a", 3, "new"), ("b", 2, "x"), ("c", 5, "y"))
    live = store.current(b, gone(spark, ("b", 4, 0), ("c", 4, 0), ("z", 9, 0)))
    assert sorted((r.id, r.content) for r in live.collect()) == [("a", "new"), ("c", "y")]
    assert live.columns == b.columns


def test_versions_resolve_on_narrow_rows(spark, tmp_path):
    """Content that is not asked for is neither read nor shuffled, and the newest sequence is a hash aggregation."""
    blocks(spark, ("a", 1, "old"), ("a", 3, "new"), ("b", 2, "x")).write.parquet(str(tmp_path / "b"))
    held = spark.read.parquet(str(tmp_path / "b"))
    plan = store.current(held, gone(spark, ("b", 4, 0))).select("id", "sequence")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "HashAggregate" in plan
    # A copy of a version is no version of its own, and a deletion of the same sequence does not hide it.
    twice = blocks(spark, ("a", 3, "new"), ("a", 3, "new"), ("a", 1, "old"))
    assert [(r.id, r.content) for r in store.current(twice, gone(spark, ("a", 3, 0))).collect()] == [("a", "new")]
    assert store.current(twice.limit(0), gone(spark, ("a", 3, 0))).count() == 0


def test_shadowing_is_strict(spark):
    b = blocks(spark, ("a", 5, "x"))
    assert [store.shadowed(b, gone(spark, ("a", s, 0))).count() for s in (4, 5, 6)] == [0, 0, 1]


def test_lookups(spark):
    b = blocks(spark, ("a", 1, "x"), ("b", 2, "y"))
    assert [(r.ord, r.id) for r in store.find_many(b, ["b", "q", "a", "b"]).orderBy("ord").collect()] == [(0, "b"), (2, "a"), (3, "b")]
    assert store.count_existing(b, ["b", "q", "b"]).first().n == 2
    assert {r.id: r.present for r in store.exists(b, ["a", "q"]).collect()} == {"a": True, "q": False}
    with pytest.raises(ValueError, match="EmptyQuery"):
        store.find_many(b, [])
    with pytest.raises(ValueError, match="TooManyResults"):
        store.find_many(b, ["x"] * 1001)


def test_put_assigns_sequences_and_rejects(spark):
    new = spark.createDataFrame([("n1", 77, "u", "{}", "c", 1), ("n2", 99, "u", "{}", "c", 0), ("", 1, "u", "{}", "c", 2), ("n3", 1, "u", "{bad", "c", 3), ("n4", 1, "", "{}", "", 4)], model.BLOCKS + ", ord long")
    log, bad = store.put_blocks(blocks(spark, ("a", 4, "x")), gone(spark, ("b", 6, 0)), new)
    assert {r.id: r.sequence for r in log.collect()} == {"a": 4, "n2": 7, "n1": 8}
    assert {r.id: r.errors for r in bad.collect()} == {"": ["id"], "n3": ["metadata_json"], "n4": ["uri_empty", "content_empty"]}


def test_delete_and_edges(spark):
    b = blocks(spark, ("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"))
    t = store.delete(gone(spark), b, ["c", "nobody"], 1_000)
    assert {r.id: r.sequence for r in t.collect()} == {"c": 4, "nobody": 5}
    live = store.current(b, t)
    new = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("a", "a", "calls"), ("a", "c", "calls"), ("a", "b", "likes")], model.EDGES)
    edges, bad = store.put_edges(spark.createDataFrame([], model.EDGES), new, live)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "calls")]
    assert sorted(tuple(r.errors) for r in bad.collect()) == [("self_loop",), ("target_missing",), ("type",)]
    assert store.remove_edge(edges, "a", "b", "calls").count() == 0
    three = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "imports"), ("b", "a", "calls")], model.EDGES)
    assert sorted(map(tuple, store.remove_edge(three, "a", "b", "calls").collect())) == [("a", "b", "imports"), ("b", "a", "calls")]
    assert store.remove_edge(three, "a", "c", "calls").count() == 3
    assert [r.next_sequence for r in store.next_sequence(b, t).collect()] == [6]


@pytest.mark.parametrize("policy, written", [("skip_older", {"a": 9, "n": 1}), ("overwrite", {"a": 9, "b": 1, "n": 1})])
def test_batches(spark, policy, written):
    live = blocks(spark, ("a", 5, "x"), ("b", 5, "y"))
    batch = spark.createDataFrame([("a", 9, "u", '{"codebase": "w"}', "p", 0), ("a", 8, "u", '{"codebase": "w"}', "q", 1), ("b", 1, "u", '{"codebase": "w"}', "r", 2), ("n", 1, "u", '{"codebase": "w"}', "s", 3)], model.BLOCKS + ", ord long")
    rows, figures = store.batch_upsert(live, batch, policy, "w")
    assert {r.id: r.sequence for r in rows.collect()} == written
    f = figures.first()
    skipped = policy == "skip_older"
    assert (f.submitted, f.duplicates, f.conflicts, f.written) == (4, 1, int(skipped), 3 - skipped)
    assert f.dedup_percent == (50 if skipped else 25)
    with pytest.raises(ValueError, match="VersionConflict"):
        store.batch_upsert(live, batch, "fail")
    with pytest.raises(ValueError, match="WorkspaceViolation"):
        store.batch_upsert(live, batch, workspace="other")
    empty = store.batch_upsert(live, batch.limit(0))[1].first()
    assert (empty.submitted, empty.success_percent) == (0, 100.0)


def test_compaction(spark):
    b = blocks(spark, ("a", 1, "old"), ("a", 2, "new"), ("b", 3, "x"))
    t = gone(spark, ("b", 4, 0), ("z", 9, 10**15))
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "a2", "calls")], model.EDGES)
    live, kept, left = store.compact(b, t, edges, now_us=10**12)
    assert [r.content for r in live.collect()] == ["new"]
    assert [r.id for r in kept.collect()] == ["z"]
    assert left.count() == 0


def test_sorted_files_prune(spark, tmp_path):
    b = blocks(spark, *((f"{k:04}", k + 1, "c") for k in range(500)))
    store.write_sorted(b, str(tmp_path / "b"), partitions=4)
    back = spark.read.parquet(str(tmp_path / "b"))
    plan = store.find(back, "0007")._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 500 and "PushedFilters: [IsNotNull(id), EqualTo(id,0007)]" in plan


def test_identifiers():
    assert model.block_id(1) == "01" + "0" * 30 and model.check_id(model.block_id(258)) == "0201" + "0" * 28
    for bad in ("0" * 32, "A" * 32, "ab"):
        with pytest.raises(ValueError):
            model.check_id(bad)
    assert model.parse_metadata("[1]") == {} and model.parse_metadata('{"a": 1}') == {"a": 1} and model.parse_metadata("{") == {}


def test_context(spark):
    b = spark.createDataFrame([(i, 1, "u", f'{{"codebase": "{w}", "unit_type": "function", "unit_id": "f:{i}"}}', "c") for i, w in (("a", "w"), ("b", "w"), ("c", "w"), ("x", "v"))], model.BLOCKS)
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "imports"), ("a", "x", "calls"), ("x", "c", "calls")], model.EDGES)
    query = context.ContextQuery("w", (context.Anchor("entity_name", "a"),), (context.Rule(max_depth=2),))
    nodes, edges, figures = context.run(query, b, e)
    assert {r.id: r.depth for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("a", "b"), ("b", "c")]
    assert figures.first().asDict() == {"nodes": 3, "max_depth": 2, "anchors": 1}
    typed = context.run(context.ContextQuery("w", (context.Anchor("block_id", "a"),), (context.Rule(edge_types=("calls",)),)), b, e)[0]
    assert {r.id for r in typed.collect()} == {"a", "b"}
    assert query.cost() == {"micros": 20, "kilobytes": 2000, "exceeds_limits": False}
    for bad in (context.ContextQuery("w", ()), context.ContextQuery("w", (context.Anchor("block_id", "a"),), (context.Rule(max_depth=40),)),
                context.ContextQuery("w", (context.Anchor("block_id", "a"),), (context.Rule(max_nodes=300),), 100), context.ContextQuery("w", (context.Anchor("block_id", "a", workspace="v"),))):
        with pytest.raises(ValueError):
            context.run(bad, b, e)


def test_context_graph(spark):
    b = spark.createDataFrame([(i, 1, "u", f'{{"codebase": "w", "unit_type": "function", "unit_id": "f:{i}"}}', "c") for i in "abcd"], model.BLOCKS)
    e = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "imports"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "z", "calls"), ("z", "d", "calls")], model.EDGES)
    query = context.ContextQuery("w", (context.Anchor("entity_name", "a"),), (context.Rule(max_depth=3),))
    held = context.ContextStatistics()
    ticks = iter(range(100))
    nodes, edges, _ = context.run(query, b, e, held, clock=lambda: next(ticks) * 0.5)
    assert held.queries_executed == 1 and held.total_execution_time_us == held.last_query_time_us == held.average_query_time_us > 0
    held.record(0.25)
    assert held.average_query_time_us == held.total_execution_time_us // 2 and held.last_query_time_us == 250_000
    held.reset()
    assert (held.queries_executed, held.average_query_time_us) == (0, 0)
    assert [r.id for r in context.neighbours(edges, "a").collect()] == ["b"] and [r.id for r in context.neighbours(edges, "a", incoming=True).collect()] == ["c"]
    assert context.utilization(nodes, edges, 10, 8).first().asDict() == {"node_count": 3, "edge_count": 4, "node_percent": 30, "edge_percent": 50}
    assert context.dangling(nodes, edges).count() == 0
    assert sorted((r.src, r.missing) for r in context.dangling(b.select("id"), e).collect()) == [("d", "target"), ("z", "source")]
    slow = context.ContextQuery("w", query.anchors, query.rules, timeout_ms=100)
    ticks = iter(range(100))
    with pytest.raises(TimeoutError, match="QueryTimeout"):
        context.run(slow, b, e, clock=lambda: next(ticks) * 0.06)
    assert context.run(slow, b, e, clock=lambda: 0.0)[0].count() == 3


def test_latency_percentiles(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=1001).tolist(), "b": [1.5], None: rng.integers(0, 5, 200).astype(float).tolist()}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("c", None)]
    got = {r.g: r for r in stats.latency_summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        r = got[g]
        assert [r.n, r.min, r.max] == [len(vs), min(vs), max(vs)]
        assert [r.median, r.p95, r.p99, r.mean, r["std"]] == pytest.approx([*np.percentile(vs, [50, 95, 99]), np.mean(vs), np.std(vs)])


def test_ranks(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(500)], "a int, b int")
    got = sorted((r["rank"], -r.a, r.b) for r in ranked(df, F.desc("a"), "b").collect())
    assert [x[0] for x in got] == list(range(500)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_statistics(spark):
    b = blocks(spark, ("a", 1, "xx"), ("b", 2, "é"))
    e = spark.createDataFrame([("a", "b", "calls")], model.EDGES)
    assert stats.index_statistics(b, "codebase").first().asDict() == {"unique_values": 1, "total_blocks": 2, "max_per_value": 2, "selectivity": 0.5, "is_selective": False}
    assert stats.index_statistics(b.limit(0), "codebase").first().selectivity == 1.0
    assert stats.storage_statistics(b, b, e).first().asDict() == {"versions": 2, "live_blocks": 2, "edges": 1, "content_bytes": 4}
    row = stats.workspace_statistics(b, e).first()
    assert (row.codebase, row.block_count, row.edge_count, row.estimated_bytes) == ("w", 2, 1, 2 * 2048 + 64)
    got = spark.sql("SELECT 0L AS a, 100L AS b, 9000L AS c").select(*[stats.sync_status(F.col(c), 10_000) for c in "abc"]).first()
    assert list(got) == ["never synced", "sync needed", "synced"]
    share = spark.sql("SELECT 1 AS a, 5 AS b, 8 AS c").select(*[stats.memory_pressure(F.col(c), F.lit(10)) for c in "abc"]).first()
    assert list(share) == ["low", "medium", "high"]
