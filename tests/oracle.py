"""Comparison of a query with its DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def assert_same(df, con, sql: str) -> None:
    found = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    assert {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema} == dict(zip(found.columns, map(str, found.types), strict=True))
    at = [found.columns.index(c) for c in names]
    ours = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert ours == theirs, (sorted((ours - theirs).elements())[:4], sorted((theirs - ours).elements())[:4])
