"""Filters, name lookups and keyword search on the documented small cases."""

import pytest

from weftgraph.operators import filters as f
from weftgraph.operators import search
from weftgraph.operators.filters import Condition, Logic, Operator, Target, Tree

BLOCKS = "id string, sequence bigint, source_uri string, metadata_json string, content string"


def one(spark, condition, sequence=42, uri="numeric.zig", meta="{}", content="x"):
    df = spark.createDataFrame([("a", sequence, uri, meta, content)], BLOCKS)
    return f.select(df, condition, None).count() == 1


@pytest.mark.parametrize("condition, block, want", [
    (f.content_contains("hello"), {"content": "pub fn hello() void {}"}, True),
    (f.content_contains("goodbye"), {"content": "pub fn hello() void {}"}, False),
    (f.content_contains(""), {}, True),
    (f.metadata_field("language", "zig"), {"meta": '{"language": "zig", "complexity": "low"}'}, True),
    (f.metadata_field("language", "rust"), {"meta": '{"language": "zig"}'}, False),
    (Condition(Target.sequence, Operator.greater, "1"), {"sequence": 1}, False),
    (Condition(Target.sequence, Operator.greater, "1"), {"sequence": 2}, True),
    (Condition(Target.sequence, Operator.less_equal, "1"), {"sequence": 1}, True),
    (Condition(Target.sequence, Operator.not_equal, "1"), {"sequence": 2}, True),
    (Condition(Target.sequence, Operator.equal, "42.0"), {}, True),
    (Condition(Target.sequence, Operator.less, "100"), {}, True),
    (f.source_uri("a", Operator.greater), {}, True),
    (f.source_uri("100", Operator.greater), {}, True),
    (Condition(Target.content_length, Operator.greater, "10"), {"content": "short"}, False),
    (Condition(Target.content_length, Operator.equal, "5"), {"content": "short"}, True),
    (Condition(Target.content_length, Operator.equal, "2"), {"content": "é"}, True),
    (f.metadata_field("incomplete", "x"), {"meta": '{"incomplete":'}, False),
    (f.metadata_field("level", "info"), {"meta": '{"config": {"debug": "true"}, "level": "info"}'}, True),
    (Condition(Target.metadata_field, Operator.equal, "69}", "k", textual=True), {"meta": '{"k": 69}'}, True),
    (f.metadata_field("k", "69"), {"meta": '{"k": 69}'}, True),
    (Condition(Target.metadata_field, Operator.equal, "", "k", textual=True), {"meta": '{"k" : 5}'}, True),
    (Condition(Target.content, Operator.starts_with, "x"), {}, True),
    (Condition(Target.content, Operator.ends_with, "y"), {}, False),
    (f.content_contains("x"), {"content": None}, False),
    (Tree(Logic.not_, f.content_contains("x")), {"content": None}, True),
    (Tree(Logic.and_, f.content_contains("x")), {}, True),
    (Tree(Logic.or_, f.content_contains("q"), f.content_contains("x")), {}, True),
    (Tree(Logic.and_, f.content_contains("q"), f.content_contains("x")), {}, False),
])
def test_condition(spark, condition, block, want):
    assert one(spark, condition, **block) is want


def test_limits_and_decoding(spark):
    df = spark.createDataFrame([(f"{k:02}", k, "", "{}", "c") for k in range(1, 8)], BLOCKS)
    where = f.content_contains("c")
    assert [r.id for r in f.select(df, where, 3, 2).collect()] == ["03", "04", "05"]
    assert f.statistics(df, where, 3, 2).first().asDict() == {"scanned": 7, "matches": 7, "returned": 3, "has_more": True}
    for limit in (0, 20_000):
        with pytest.raises(ValueError):
            f.select(df, where, limit)
    with pytest.raises(ValueError):
        f.decode(Operator, 99)
    with pytest.raises(ValueError):
        Condition(Target.metadata_field, Operator.equal, "x").column()


def test_edge_types(spark):
    df = spark.createDataFrame([("calls",), ("imports",)], "edge_type string")
    count = lambda *a: df.filter(f.edge_types(*a)).count()
    assert [count(), count("only", ["calls"]), count("include", []), count("exclude", []), count("include", ["calls", "imports"]), count("exclude", ["calls"])] == [2, 1, 0, 2, 2, 1]


UNITS = [
    ("src/simple.zig:init", "w"), ("src/storage.zig:StorageEngine:init", "w"), ("src/query.zig:QueryEngine:init", "w"),
    ("src/nested.zig:OuterStruct:InnerStruct:process", "w"), ("src/e.zig:Engine:init", "codebase_a"), ("src/e.zig:Engine:init", "codebase_b"), ("src/d.zig:Dot.run", "w"), ("plain", "w"),
]


def units(spark):
    rows = [(str(k), 1, "", f'{{"unit_type": "function", "unit_id": "{u}", "codebase": "{w}"}}', "") for k, (u, w) in enumerate(UNITS)]
    return spark.createDataFrame([*rows, ("9", 1, "", '{"broken', "")], BLOCKS)


@pytest.mark.parametrize("workspace, name, want", [
    ("w", "init", ["0", "1", "2"]), ("w", "StorageEngine.init", ["1"]), ("w", "InnerStruct.process", ["3"]), ("w", "OuterStruct.process", []),
    ("codebase_a", "Engine.init", ["4"]), ("codebase_b", "init", ["5"]), ("w", "Dot.run", ["6"]), ("w", "run", ["6"]), ("w", "plain", []), ("none", "init", []),
])
def test_names(spark, workspace, name, want):
    assert sorted(r.id for r in search.by_name(units(spark), workspace, "function", name).collect()) == want


def test_keywords(spark):
    df = spark.createDataFrame([("a", 1, "", "", "red green"), ("b", 1, "", "", "red"), ("c", 1, "", "", None)], BLOCKS)
    got = [(r.id, round(r.similarity, 3)) for r in search.keywords(df, "red green", 0.5).collect()]
    assert got == [("a", 1.0), ("b", 0.5)]
    assert [r.id for r in search.keywords(df, " ".join(["red"] * 7 + ["no"] * 3), 0.7).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        search.keywords(df, "x", limit=501)


def test_structured_query():
    assert search.structured("workspace:w type:struct name:Engine") == {"workspace": "w", "type": "struct", "name": "Engine"}
    assert search.structured("just words") == {"workspace": "", "type": "function", "name": "just words"}
