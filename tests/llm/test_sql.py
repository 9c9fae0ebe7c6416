"""The queries that SQL expresses, against DuckDB; on the odd rows too."""

import duckdb
import pytest
from oracle import assert_same, connect

import corpus_pipeline
from weftgraph.llm import chat, common, mixing, oracles, quality_rules, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, name, size):
    sf = f"/root/testdata/{size}"
    assert_same(queries.queries()[name](spark, sf), connect(sf), SQL[name])


def test_names():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.queries())
    assert numbers == list(range(1, 11)) and set(SQL) < set(queries.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def odd_connection(odd, name):
    con = duckdb.connect()
    con.register("_t", odd.toArrow())
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM _t")
    return con


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, odd, tmp_path, empty):
    docs = odd.limit(0) if empty else odd
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = odd_connection(docs, "documents")
    for name in ("op7_mixing", "op8_quality_rules"):
        assert_same(queries.queries()[name](spark, str(tmp_path)), con, SQL[name])


def test_quality_rules_are_native(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    # Filtering by the verdict evaluates nothing twice.
    cleaned = quality_rules.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert cleaned.count("sort_array(") == plan.count("sort_array(")


def test_cleaning(spark, odd, none):
    good = "\n".join(f"The {a} {b} was {c} by the {d}{k} before the {e}." for k, (a, b, c, d, e) in enumerate(zip(*(w.split() for w in ("old new red low tall wide calm dark", "mill barn road gate lamp well hill door", "seen sold lost made held kept left moved", "man girl king team crew host boss firm", "rain snow wind storm night dawn noon dusk")), strict=True)))
    rows = [(1, f"{good}\nHome | About | Contact | Help\nClick here to subscribe.\n{good.splitlines()[0]}\nno end", 5), (2, "short", 5), (3, "Home | About | News | Help\n" * 40 + good, 5)]
    got = {r.doc_id: r for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert set(got) == {1} and got[1].text == good and got[1].n_chars == len(good)
    left = quality_rules.clean(odd)
    assert left.columns == odd.columns and quality_rules.clean(none).count() == 0


def test_mixing_nears_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_mixing(spark, sf).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    per = {}
    for r in rows:
        per.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in per.items():
        assert target <= 2 * size + 1e-6 and abs(sum(taken) - target) <= 0.25 * target
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(common.word_count(mixed.text).alias("n")).agg({"n": "sum"}).first()[0]
    assert words == sum(r.taken for r in rows)


def test_mixing_many_sources(spark, sf, monkeypatch):
    """Beyond the broadcast bound, hot sources are broadcast and the rest shuffled, with the same result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = "_doc.doc_id", "size", "target", "copies"
    want = sorted(map(repr, mixing.with_copies(docs).select(*columns).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixing.with_copies(docs).select(*columns).collect())) == want


def test_rates(spark):
    """Weights 3, 1, 2 repeat in source order, null last; capped sources pass their excess on."""
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 50), ("d", 0)], "source string, source_size long")
    got = {r.source: (r.target, r.rate) for r in mixing.rates(sizes).collect()}
    assert got["a"] == (200.0, 2.0) and got["d"] == (0.0, 0.0) and got[None] == (100.0, 2.0)
    rest = 1.5 * 2150 - 200 - 100
    assert got["b"][0] == pytest.approx(rest / 3) and got["c"][0] == pytest.approx(2 * rest / 3)


def test_odd_conversations(spark, tmp_path):
    rows = [(None, 1, "user", "hi there my dear old friend"), (1, None, "user", "> hi there my dear old friend\nyes"), (1, 0, None, None), (1, 1, "user", ""), (1, 2, "assistant", "> > deep one that is long enough\n> hi there my dear old friend\nanswer"), (1, 2, "assistant", "> > deep one that is long enough\n> hi there my dear old friend\nanswer"),
            (2, 0, "user", "hi there my dear old friend"), (2, 1, "user", "deep one that is long enough"), (2, 2, "user", "Bob wrote:\n> deep one that is long enough\n>> hi there my dear old friend\nI agree"), (3, 0, "user", "> never said\n" + "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, c string, m string")
    for part, folder in ((df, "a"), (df.limit(0), "b")):
        part.write.parquet(str(tmp_path / folder / "conversations.parquet"))
        assert_same(queries.op9_chat_quotes(spark, str(tmp_path / folder)), odd_connection(part, "conversations"), SQL["op9_chat_quotes"])
    got = {(r.conv_id, r.turn): r for r in chat.linked(df).collect()}
    assert got[2, 2].reply_text == "I agree" and (got[2, 2].reply_conv, got[2, 2].reply_turn, got[2, 2].quote_levels) == (2, 1, 2)
    assert (got[1, 2].reply_conv, got[1, 2].reply_turn, got[1, 2].n_linked) == (2, 0, 2)
    assert got[3, 0].n_linked == 0 and got[3, 0].reply_turn is None
