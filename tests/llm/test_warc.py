import gzip
import hashlib
from base64 import b32encode
from pathlib import Path

import duckdb
import pytest

from weftgraph.llm import oracles, queries, warc

SCHEMA = "page_id long, url string, html string, file string, length string, first string, d string, id string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


ROWS = [
    (5, "http://www.Example.com:80/a?b#c", "<p>same</p>"), (3, "https://example.com/a?b", "<p>same</p>"), (9, "http://b.example.org/x y", "ünï"), (1, None, None), (2, "", ""), (7, "not a url \r\n at all", "<p>same</p>"),
    (None, "http://null.example/", "<p>same</p>"), (11, "http://long.example/", "z" * 3_000_000), (12, "http://[bad", "q"), (13, "http://b.example.org/x y", "WARC/1.1\r\n\r\nnested"), (13, "http://b.example.org/x y", "WARC/1.1\r\n\r\nnested"),
]


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path)
    records = warc.read(spark, path, bodies=True).collect()
    assert len(records) == len(ROWS)
    first = {}
    for k, _, body in ROWS:
        if k is not None:
            first[body or ""] = min(first.get(body or "", k), k)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in records)
    want = sorted(
        (str(k), "response" if k == first[b or ""] else "revisit", None if k == first[b or ""] else first[b or ""], len((b or "").encode()), b32encode(hashlib.sha1((b or "").encode()).digest()).decode())
        for k, _, b in ROWS)
    assert got == want
    bodies = {r.page_id: bytes(r.body).decode() for r in records if r.record_type == "response"}
    assert bodies == {k: b or "" for k, _, b in ROWS if k is not None and k == first[b or ""]}


def test_files_are_plain_gzip(spark, tmp_path):
    """Any gzip reader sees the records, and each offset and length is a member of its own."""
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path)
    count = 0
    for file in Path(path).glob("part-*"):
        raw = file.read_bytes()
        whole = gzip.decompress(raw)
        parts = b"".join(record for _, _, record in warc.members(raw))
        assert whole == parts
        for offset, length, record in warc.members(raw):
            assert gzip.decompress(raw[offset : offset + length]) == record and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            count += 1
    assert count == len(ROWS)


def test_large_members_end_in_the_separator():
    import os

    big = os.urandom(17 << 20)
    made = warc.member(1, "http://x/", big, "D", None)
    assert made[-1] == 0 and [warc.parse(r)[1] for _, _, r in warc.members(made)] == [big]


@pytest.mark.parametrize("url, key", [
    ("http://www.Example.com:80/a?b#c", "com,example)/a?b"), ("https://example.com:8443", "com,example:8443)/"), ("http://a.b.co.uk/x y", "uk,co,b,a)/x%20y"), (None, ")/"), ("http://[bad", "http://[bad"),
])
def test_reversed_host_keys(url, key):
    assert warc.surt(url) == key


def test_index_finds_every_capture(spark, monkeypatch):
    rows = [(k, f"http://h{k % 7}.example.com/p{k % 40}", f"<p>{k % 13}</p>") for k in range(300)] + [(1000 + k, "http://hot.example.com/", f"hot {k}") for k in range(200)]
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "FILE_RECORDS", 50)
    path, directory = warc.archive(pages(spark, rows))
    listed = directory.orderBy("first", "file", "offset").collect()
    assert sum(r.lines for r in listed) == len(rows) and max(r.lines for r in listed) <= 16 and [r["first"] for r in listed] == sorted(r["first"] for r in listed)
    index = warc.Directory([(r["first"], r.file, r.offset, r.length) for r in listed])
    held = {}
    for k, url, _ in rows:
        held.setdefault(url, set()).add(k)
    for url in [*list(held)[:12], "http://hot.example.com/"]:
        found = index.lookup(url)
        assert {k for k, _, _ in found} == held[url]
        for k, kind, record in found:
            headers, body = warc.parse(record)
            assert headers["warc-record-id"] == f"<urn:page:{k}>" and headers["warc-type"] == kind
            assert body.decode() == (next(b for i, _, b in rows if i == k) if kind == "response" else "")
    for url in ("http://hot.example.com/", "http://h3.example.com/p3", "http://none.example.com/"):
        assert sorted(warc.lookup_in(directory, url), key=repr) == sorted(index.lookup(url), key=repr)
    assert index.lookup("http://none.example.com/") == [] and index.lookup("http://aaa.zzz/") == [] and warc.Directory([]).lookup("http://x/") == []
    # A key that another one begins with.
    assert index.lookup("http://h1.example.com/p") == []
    # One hot key's captures lie in many blocks, yet each page's key needs two at most.
    assert len(index.blocks(warc.capture_key("http://hot.example.com/", 0), warc.capture_key("http://hot.example.com/", 9999))) > 10
    assert max(len(index.blocks(k, k)) for k in (warc.capture_key(u, i) for i, u, _ in rows)) <= 2
    some = pages(spark, rows[40:90] + [(77, "http://elsewhere.example/", "")])
    assert sorted(r.page_id for r in warc.fetch(some, directory).collect()) == list(range(40, 90))


@pytest.mark.parametrize("gap, stretch", [(0, 100), (1 << 20, 1 << 30)])
def test_fetch_equals_the_survey(spark, monkeypatch, gap, stretch):
    """Every record comes back once through the index, repeated rows and null ids too, however ranges are cut."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "GAP_BYTES", gap)
    monkeypatch.setattr(warc, "STRETCH_BYTES", stretch)
    rows = ROWS + [(50, "http://many.example/", "same again")] * 20 + [(None, None, "x")] * 4 + [(50, "http://many.example/#part", "other")]
    path, directory = warc.archive(pages(spark, rows))
    survey, found = (sorted(map(tuple, x.collect()), key=repr) for x in (warc.read(spark, path, bodies=True), warc.fetch(pages(spark, rows), directory, bodies=True)))
    assert len(found) == len(rows) and found == survey


def test_directory_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "MAX_BLOCKS", 10)
    rows = [(k, f"http://h{k % 9}.example/{k}", "x") for k in range(400)]
    _, directory = warc.archive(pages(spark, rows))
    assert directory.count() <= 10 + int(spark.conf.get("spark.sql.shuffle.partitions")) and warc.fetch(pages(spark, rows), directory).count() == 400


def test_no_read_but_through_the_index(spark):
    """The result's plan scans pages, and neither archives nor blocks."""
    _, directory = warc.archive(pages(spark, ROWS))
    plan = warc.fetch(pages(spark, ROWS), directory)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "weft-warc" not in plan and "weft-cdx" not in plan


def test_query_against_sql(spark, tmp_path):
    """Revisits of a hot payload, an empty one and one that only null ids hold."""
    rows = [(k, f"http://h{k % 5}.example/{k}", ["<p>hot</p>", f"<p>{k}</p>", "", None, f"pair {k // 8}"][k % 5 if k % 3 else 0]) for k in range(600)]
    rows += [(None, "http://null.example/", "only null ids"), (None, "http://null.example/b", "only null ids"), (None, None, "<p>hot</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in queries.op1_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({oracles.oracle_sql()['op1_warc']})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[3] == "revisit" for r in got) > 300


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    warc.write(pages(spark, [(k, "http://x/", f"{k:04}" * 1000) for k in range(60)]).coalesce(1), str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*"))) == 6


def test_empty_table(spark):
    path, directory = warc.archive(pages(spark, ROWS).limit(0))
    assert warc.read(spark, path).count() == 0 and directory.count() == 0 and warc.fetch(pages(spark, ROWS), directory).count() == 0
