"""Queries over tables that are larger than bounds which once cut them, against their SQL."""

import random
import shutil

import pytest

duckdb = pytest.importorskip("duckdb")

from oracle import assert_same, connect  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_traversal import closure, graph, model_dfs  # noqa: E402

from weftgraph import model  # noqa: E402
from weftgraph.operators import context, stats, traversal  # noqa: E402
from weftgraph.plans import oracles, queries  # noqa: E402
from weftgraph.sources import tables  # noqa: E402

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def grown(sf, tmp_path_factory):
    """The small tables with so many customers, of whom the first 10,500 are of nation 2."""

    def make(customers: int) -> str:
        folder = tmp_path_factory.mktemp("grown")
        shutil.copytree(sf, folder, dirs_exist_ok=True, copy_function=shutil.copyfile)
        duckdb.sql(f"""COPY (SELECT k::BIGINT AS c_custkey, 'Customer#' || k AS c_name, (CASE WHEN k < 10500 THEN 2 ELSE k % 25 END)::INTEGER AS c_nationkey, 1.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment
          FROM range({customers}) AS r(k)) TO '{folder}/customer.parquet' (FORMAT parquet)""")
        return str(folder)

    return make


@pytest.mark.parametrize("name", ["context_nodes", "context_utilization", "context_dangling"])
def test_context_holds_all_it_reaches(spark, grown, name):
    folder = grown(10_500)
    assert_same(queries.queries()[name](spark, folder), connect(folder), SQL[name])


def test_context_without_bounds(spark):
    b = spark.range(10_200).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(1).cast("bigint").alias("sequence"), F.lit("u").alias("source_uri"), F.lit('{"codebase": "w"}').alias("metadata_json"), F.lit("c").alias("content"))
    e = b.filter("id <> 'n0'").select(F.lit("n0").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("edge_type"))
    anchors = (context.Anchor("block_id", "n0"),)
    nodes, edges, figures = context.run(context.ContextQuery("w", anchors, (context.Rule(max_nodes=None),), None), b, e)
    assert nodes.count() == 10_200 and edges.count() == 10_199 and figures.first().nodes == 10_200
    assert context.run(context.ContextQuery("w", anchors, (context.Rule(max_nodes=50),), None), b, e)[0].count() == 50
    assert context.ContextQuery("w", anchors, (), None).cost() == {"micros": 10, "kilobytes": None, "exceeds_limits": True}
    with pytest.raises(ValueError, match="InvalidQuery"):
        context.run(context.ContextQuery("w", anchors, (context.Rule(max_nodes=None),), 100), b, e)
    assert set(b.columns) == {f.split()[0] for f in model.BLOCKS.split(", ")}


@pytest.mark.parametrize("graph", ["trade", "parts"])
def test_large_graphs_are_built_in_bounded_tasks(spark, sf, graph, monkeypatch):
    """The plans of their own give the edges of the SQL, none twice, and no task of theirs gets more rows than it should, whatever Spark's partition number."""
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    found = tables.view(spark, sf, graph)
    assert found.rdd.getNumPartitions() >= 6000 // 200
    ours, sql = (sorted(map(tuple, x)) for x in (found.collect(), connect(sf).sql(tables.oracle(tables.GRAPHS[graph])).fetchall()))
    assert ours == sql


def test_degrees_of_known_distinct_edges(spark, sf):
    """They are read once, and only their ends are shuffled."""
    e = tables.view(spark, sf, "trade").limit(500)
    assert sorted(stats.degrees(e, distinct=True).collect()) == sorted(stats.degrees(e.unionByName(e)).collect())
    e = spark.createDataFrame([("a", "b", "calls")], model.EDGES)
    assert stats.degrees(e, distinct=True)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_depth_first_tree_is_whole(spark, grown):
    folder = grown(10_500)
    assert_same(queries.queries()["dfs_tree"](spark, folder), connect(folder), SQL["dfs_tree"])


@pytest.mark.parametrize("seed", range(2))
def test_depth_first_order_of_all(spark, seed, monkeypatch):
    """Trees, with names that are beginnings of each other, and graphs, whose moves are held whole or fetched in groups."""
    rng = random.Random(seed)
    names = ["", "a", "aa", "ab", "b", "z", "zz", "é", "￿", "\U0001f600", "\U0010ffff", "\U0010ffffa", *map(str, range(20))]
    rng.shuffle(names)
    tree = [(names[rng.randrange(k)], names[k]) for k in range(1, len(names))]
    mixed = [(rng.choice(names), rng.choice(names)) for _ in range(70)]
    for pairs, start in ((tree, names[0]), (mixed, mixed[0][0]), ([*tree, (names[3], names[0])], names[0])):
        e = graph(spark, pairs)
        for depth, limit, held in ((3, None, 200_000), (4, 9, 0)):
            monkeypatch.setattr(traversal, "BROADCAST_ROWS", held)
            got = traversal.dfs(e, start, depth=depth, limit=limit).orderBy("ord").collect()
            assert [r.ord for r in got] == list(range(len(got))) and all(len(r.path) == r.depth + 1 and r.path[-1] == r.id for r in got)
            assert [(r.id, r.depth) for r in got] == model_dfs(pairs, start, depth, limit or 1 << 30)


def test_depth_first_is_not_cut_at_the_largest_limit(spark):
    pairs = [("hub", f"n{k}") for k in range(10_300)] + [("n7", "n8")]
    got = traversal.dfs(graph(spark, pairs), "hub", depth=2, limit=None)
    assert got.count() == 10_301


def test_ingest_files_reads_all_texts(spark, grown):
    """More texts in one task than one file may hold, and those of nations."""
    folder = grown(110_000)
    found = queries.queries()["ingest_files"](spark, folder)
    assert found.filter("kind = 'n.zig'").count() == 25
    assert_same(found, connect(folder), SQL["ingest_files"])


def test_edges_ahead(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("d", "e"), ("y", "z")]
    e = graph(spark, pairs + pairs[:2])
    assert sorted((r.src, r.dst) for r in traversal.ahead(e, "a").collect()) == sorted(p for p in pairs if p[0] not in "xy")
    assert traversal.ahead(e, "nowhere").count() == 0
    for name in ("breadth_first", "depth_first", "bidirectional", "topological", "strongly_connected"):
        near, whole = ([r.id for r in traversal.traverse(x, "a", name, depth=3).orderBy("id").collect()] for x in (traversal.ahead(e, "a"), e))
        assert near == whole


@pytest.mark.parametrize(("held", "nodes", "edges"), [(0, 20, 32), (10, 30, 300)])
def test_strong_components_beyond_the_driver(spark, held, nodes, edges, monkeypatch):
    """Sparse graphs by colouring, dense ones by their thin parts first."""
    monkeypatch.setattr(traversal, "BROADCAST_ROWS", held)
    rng = random.Random(edges)
    pairs = [(str(rng.randrange(nodes)), str(rng.randrange(nodes))) for _ in range(edges)]
    every, reach = closure(pairs)
    want = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in every}
    assert {r.id: r.component for r in traversal.strongly_connected(graph(spark, pairs)).collect()} == want


def test_strong_components_move_a_dense_graph_few_times(spark, monkeypatch):
    """What is written of the moves is the moves themselves and thin parts of them, not the moves of every round."""
    monkeypatch.setattr(traversal, "BROADCAST_ROWS", 100)
    rows = []

    def counted(df, name="step", f=traversal.table):
        out = f(df, name)
        rows.append(out.count() if name == "moves" else 0)
        return out

    monkeypatch.setattr(traversal, "table", counted)
    rng = random.Random(4)
    pairs = list({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(2500)) if a != b})
    found = traversal.strongly_connected(graph(spark, pairs))
    assert found.select("component").distinct().count() == 1 and found.count() == 60
    assert sum(rows) < 2 * len(pairs)


def test_components_on_the_driver():
    rng = random.Random(9)
    for n in (3, 8, 20):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]
        every, reach = closure(pairs)
        least = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in every}
        assert dict(traversal._tarjan(pairs)) == {a: r for a, r in least.items() if a != r}
    assert traversal._tarjan([(k, (k + 1) % 5000) for k in range(5000)])[0][1] == 0
