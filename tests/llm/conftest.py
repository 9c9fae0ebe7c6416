from __future__ import annotations

import pytest

from weftgraph.llm import common

#: Columns whose names the operators use for their own.
CLASHES = ("id", "t", "k", "h", "size", "band", "score", "copies", "target", "_doc", "_t", "_w", "_k", "lang_pred", "kept", "rep", "class_id", "hub", "comp", "bucket", "guest", "rate", "_source", "n", "l", "count")
LONG = " ".join(f"word{i % 977} stone{i % 31}" for i in range(60_000)) + "."


@pytest.fixture(scope="session", autouse=True)
def tuned(spark):
    common.tune(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows and keys, and clashing columns."""
    rows = [
        (None, None, None, None), (None, "no key at all here", "en", "s1"), (1, None, "en", "s1"), (2, "", "en", None), (3, " \n\t ", None, "s1"), (4, LONG, "en", "s1"), (5, LONG, "en", "s2"),
        (6, "one two three", "en", "s1"), (6, "one two three", "en", "s1"), (7, "one two three", "de", "s2"), (7, "four five six seven eight nine", "de", "s2"), (8, "12345 67890 !!", "en", "s1"), (9, "größer 漢字 \U0001f600 é", "de", "s1"),
    ]
    rows = [(k, t, l, s, len(t or "")) for k, t, l, s in rows]
    df = spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    return common.table(df, "odd")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
