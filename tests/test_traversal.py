"""Traversals against golden facts and against sequential models on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.operators import traversal as t

EDGES = "src string, dst string, edge_type string"


def graph(spark, pairs, kind="calls"):
    return spark.createDataFrame([(str(a), str(b), kind) for a, b in pairs], EDGES)


def ids(df):
    return sorted((r.id, r.depth) for r in df.collect())


def model_bfs(pairs, start, depth):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if seen[x] < depth:
            for a, b in pairs:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    queue.append(b)
    return sorted(seen.items())


def test_chain(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert t.bfs(e, "a", depth=3).count() == 4
    assert t.bfs(e, "a", depth=4).count() == 5
    assert ids(t.bfs(e, "e", "incoming", 1)) == [("d", 1), ("e", 0)]
    assert t.summary(t.bfs(e, "a", depth=3)).first().asDict() == {"blocks_traversed": 4, "max_depth_reached": 3}


def test_two_cycle_and_hub(spark):
    e = graph(spark, [("10", "20"), ("20", "10")])
    assert t.bfs(e, "10", depth=10).count() == 2
    assert t.bfs_walks(e, "10", depth=10).count() == 2
    hub = graph(spark, [("1", str(k)) for k in range(100, 300)])
    assert t.bfs(hub, "1", depth=2).count() == 201
    assert [r.id for r in t.bfs(hub, "1", depth=2, limit=3).orderBy("depth", "id").collect()] == ["1", "100", "101"]


def test_walks_differ_from_distinct_nodes(spark):
    diamond = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert sorted(r.id for r in t.bfs_walks(diamond, "a", depth=3).collect()) == ["a", "b", "c", "d", "d"]
    assert t.bfs(diamond, "a", depth=3).count() == 4
    inner = graph(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    walks = t.bfs_walks(inner, "a", depth=4).orderBy("depth").collect()
    assert [r.id for r in walks] == ["a", "b", "c", "b", "c"]


def test_nodes_without_blocks_are_not_expanded(spark):
    e = graph(spark, [("a", "b"), ("b", "c")])
    live = spark.createDataFrame([("a",), ("c",)], "id string")
    assert ids(t.bfs(e, "a", depth=5, blocks=live)) == [("a", 0)]
    assert t.dfs(e, "b", blocks=live).count() == 0


def test_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = sorted({(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(16)})
        pairs = [p for p in pairs if p[0] != p[1]]
        e, start = graph(spark, pairs), pairs[0][0]
        assert ids(t.bfs(e, start, depth=3)) == model_bfs(pairs, start, 3)
        assert ids(t.astar(e, start, depth=4)) == model_bfs(pairs, start, 4)
        assert ids(t.bidirectional(e, start, depth=5)) == model_bfs(pairs, start, 2)
        both = sorted({*pairs, *((b, a) for a, b in pairs)})
        assert ids(t.bfs(e, start, "bidirectional", 2)) == model_bfs(both, start, 2)
        far = dict(model_bfs(pairs, start, 20))
        for end in sorted(far)[:2]:
            hops = [r.hops for r in t.meet(e, start, end, 8).collect()]
            assert hops in ([far[end]], [None], []) and (far[end] == 0 or hops == [far[end]])


def model_dfs(pairs, start, depth, limit):
    near = {}
    for a, b in sorted(set(pairs)):
        near.setdefault(a, []).append(b)
    out, seen, stack = [], set(), [(start, 0)]
    while stack and len(out) < limit:
        x, d = stack.pop()
        if x in seen:
            continue
        seen.add(x)
        out.append((x, d))
        if d < depth:
            stack += [(b, d + 1) for b in near.get(x, []) if b not in seen]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_depth_first_order(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(90)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = [(r.id, r.depth) for r in t.dfs(graph(spark, pairs), pairs[0][0], depth=4, limit=12).orderBy("ord").collect()]
    assert got == model_dfs(pairs, pairs[0][0], 4, 12)


def closure(pairs):
    nodes = sorted({x for p in pairs for x in p})
    reach = {a: {b for x, b in pairs if x == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    return nodes, reach


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = [p for p in {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(20)} if p[0] != p[1]]
    nodes, reach = closure(pairs)
    want = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in nodes}
    assert {r.id: r.component for r in t.strongly_connected(graph(spark, pairs)).collect()} == want
    assert t.strongly_connected(graph(spark, [("x", "y")]).limit(0)).count() == 0


def test_strong_components_of_a_long_chain(spark, monkeypatch):
    """Chains take rounds in proportion to the logarithm of their length, not to it."""
    made = []
    monkeypatch.setattr(t, "table", lambda df, name="step", f=t.table: made.append(name) or f(df, name))
    pairs = [(f"n{k:03}", f"n{k + 1:03}") for k in range(79)] + [("n050", "n040")]
    got = {r.id: r.component for r in t.strongly_connected(graph(spark, pairs)).collect()}
    assert got == {f"n{k:03}": "n040" if 40 <= k <= 50 else f"n{k:03}" for k in range(80)}
    assert made.count("labels") < 60


def test_topological(spark):
    dag = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    order = [r.id for r in t.topological(dag, "a").orderBy("level", "id").collect()]
    assert order[0] == "a" and order[-1] == "d" and set(order[1:3]) == {"b", "c"}
    cycle = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert t.topological(cycle, "a").count() == 0
    assert t.has_cycle(cycle, "a").first().has_cycle and not t.has_cycle(dag, "a").first().has_cycle


def test_paths(spark):
    e = graph(spark, [("1", "2")])
    assert [r.path for r in t.paths_between(e, "1", "2", 5).collect()] == [["1", "2"]]
    assert [r.path for r in t.paths_between(e, "2", "2", 5).collect()] == [["2"]]
    assert t.paths_between(e, "2", "1", 5).count() == 0
    diamond = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")])
    assert [r.path for r in t.paths_between(diamond, "a", "d", 3).collect()] == [["a", "d"], ["a", "b", "d"], ["a", "c", "d"]]
    assert t.paths_between(diamond, "a", "d", 1).count() == 1


def test_reachability_and_hops(spark):
    e = graph(spark, [("a", "b"), ("b", "a"), ("b", "c")], "imports")
    assert t.can_reach(e, "a", "c", "imports").first().reachable
    assert not t.can_reach(e, "a", "c", "calls").first().reachable
    assert sorted(r.id for r in t.k_hop(e, "a", 2).collect()) == ["a", "b", "c"]
    assert sorted(r.id for r in t.k_hop(e, "a", 1).collect()) == ["b"]
    cost = t.cheapest(e, "a", lambda: F.lit(2.5))
    assert {r.id: r.cost for r in cost.collect()} == {"a": 0.0, "b": 2.5, "c": 5.0}


def test_arguments(spark):
    e = graph(spark, [("a", "b")])
    for bad in ({"direction": "sideways"}, {"depth": 0}, {"depth": 101}, {"limit": 0}, {"limit": 10_001}):
        with pytest.raises(ValueError):
            t.bfs(e, "a", **bad)
    with pytest.raises(ValueError):
        t.traverse(e, "a", "random")
    assert t.traverse(e, "a", "strongly_connected").count() == 1
    assert model.EdgeType.decode("calls") == model.EdgeType.decode(7)
    with pytest.raises(ValueError):
        model.EdgeType.decode(12)


def test_rounds_do_not_shuffle_edges(spark, tmp_path):
    """What a round reads of the edges is a scan and a broadcast join with the frontier; only what is reached is dealt."""
    graph(spark, [(k, k + 1) for k in range(50)]).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    for direction in t.DIRECTIONS:
        move = t.steps(e, direction)
        assert "Exchange" not in move._jdf.queryExecution().executedPlan().toString()
        front = spark.createDataFrame([("1",)], "a string")
        plan = move.join(F.broadcast(front), "a").select("b").distinct()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_repeated_edges_change_nothing(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(40)]
    once, often = graph(spark, dict.fromkeys(pairs)), graph(spark, pairs * 3).unionByName(graph(spark, pairs, "imports"))
    for run in (
        lambda e: t.bfs(e, "0", depth=2), lambda e: t.bfs_walks(e, "0", depth=2), lambda e: t.k_hop(e, "0", 2), lambda e: t.topological(e, "0", 2),
        lambda e: t.paths_between(e, "0", "5", 2), lambda e: t.dfs(e, "0", depth=2), lambda e: t.cheapest(e, "0", lambda: F.lit(1.0), depth=2),
    ):
        assert sorted(map(repr, run(once).collect())) == sorted(map(repr, run(often).collect()))


def test_exact_depth_boundary_and_hub(spark):
    """A hub with very many neighbours, and a chain cut at each depth."""
    hub = graph(spark, [("hub", f"n{k}") for k in range(3000)] + [("n7", "last")])
    found = t.bfs(hub, "hub", depth=2)
    assert found.count() == 3002 and found.filter("depth = 2").collect()[0].id == "last"
    chain = graph(spark, [(f"{k:02}", f"{k + 1:02}") for k in range(5)])
    for depth in (1, 4, 5, 8):
        assert t.bfs(chain, "00", depth=depth).count() == min(depth, 5) + 1


def test_component_of_one_node(spark):
    rng = random.Random(21)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(60)}
    reach = {x: {int(i) for i, _ in model_bfs([(str(a), str(b)) for a, b in pairs], str(x), 99)} for x in range(25)}
    for x in (0, 7):
        want = {y for y in reach[x] if x in reach[y]}
        assert {int(r.id) for r in t.component_of(graph(spark, pairs), str(x)).collect()} == want
    ring = graph(spark, [(k, (k + 1) % 9) for k in range(9)])
    assert t.component_of(ring, "5").count() == 9


def test_paths_of_one_hop_more(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("c", "z"), ("a", "z")])
    assert sorted(r.hops for r in t.paths_between(e, "a", "z", 2).collect()) == [1]
    assert sorted(r.hops for r in t.paths_between(e, "a", "z", 2, over=True).collect()) == [1, 3]


def test_long_paths_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound on bytes the same join is shuffled, with the same paths."""
    from weftgraph import session

    e = graph(spark, [(f"{'n' * 50}{k}", f"{'n' * 50}{k + 1}") for k in range(6)])
    ends = "n" * 50 + "0", "n" * 50 + "6"
    want = t.paths_between(e, *ends, 8).collect()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    assert t.paths_between(e, *ends, 8).collect() == want and want[0].hops == 6
