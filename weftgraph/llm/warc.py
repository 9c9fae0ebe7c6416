"""WARC archives with a two-level capture index.

Method: pages become WARC/1.1 records, one gzip member each, appended by Spark's own text writer, so its commit protocol
covers lost and repeated tasks. Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that with the
smallest page id is a response and the others are revisits of it, without a payload. The archives are surveyed once, as
a stream of members, for the place of each record. The capture index sorts these captures by key (reversed host and path
of the URL, then the page id), cuts them into blocks, compresses each block, and keeps a sparse directory: the first key
of each block with its file, offset and length. Blocks have ``BLOCK_LINES`` captures, more where the directory would
pass ``MAX_BLOCKS`` entries, so the directory is always small enough to broadcast.

Records are read back through the index. ``fetch`` looks up every page of a table: a binary search of the directory
gives the blocks that can hold its key; keys meet at their block, which is range-read once; the captures found go by file
and stretch of file to tasks that range-read the records, neighbours together. ``Directory.lookup`` does the same for
one URL; ``lookup_in`` does so with a stored directory, by filters that prune its sorted Parquet files.

A text line ends in a separator, and gzip members must follow each other without a gap; a member's last byte is the
high byte of its length modulo 2 ** 32, which is 0 below 16 MiB, so that byte is cut and written back as the separator.
Larger members are followed by an empty one, which ends in 0. No task holds more of a file than one record, or ``READ_BYTES``.

Defined results: a null payload is empty; a null URL is recorded as an empty target; records that repeat a page id and
URL are written each, and found each; rows with a null page id never name a group unless all of it is null; empty tables give
empty archives and an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch_path, table

MIN_REVISIT_BYTES = 0
BLOCK_LINES, MAX_BLOCKS, TASK_BLOCKS = 512, 100_000, 64
#: Sizes of one archive file to aim at: records, and payload bytes by their mean.
FILE_RECORDS, FILE_BYTES = 5000, 96 << 20
#: Records at most so far apart are read together, up to so many bytes; a task takes such a stretch of a file.
GAP_BYTES, READ_BYTES, STRETCH_BYTES = 64 << 10, 8 << 20, 32 << 20
DATE = "2024-01-01T00:00:00Z"
#: A payload digest held by more than this share of the records is joined by broadcast: at most 1 / share of them.
HOT_SHARE = 0.001
_MEMBER_TAIL = zlib.compressobj(wbits=31).flush()


def base32_of_hex(hexa: str) -> str:
    return base64.b32encode(bytes.fromhex(hexa)).decode()


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.Example.com:80/a?b#c -> com,example)/a?b. A URL and its record's header have the same."""
    url = _clean(url or "").strip()
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower().removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
        key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        key = url.lower()
    return re.sub(r"\s", "%20", key)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The reversed-host key and, behind a tab, the page id in digits that sort as numbers do, a null first."""
    return f"{surt(url)}\t" + ("" if page_id is None else f"{page_id + (1 << 63):016x}")


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]", "%0A", value)


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The gzip member of one record."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = coder.compress("\r\n".join([*head, "", ""]).encode()) + coder.compress(payload) + coder.compress(b"\r\n\r\n") + coder.flush()
    return made if made[-1] == 0 else made + _MEMBER_TAIL


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers.get("content-length", 0))]


def members(source: bytes | BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed record) of each record's member, as they stream by; empty members belong to the record before."""
    file = io.BytesIO(source) if isinstance(source, bytes) else source
    at, held, data = 0, None, file.read(1 << 20)
    while data:
        reader, out, low = zlib.decompressobj(31), [], at
        while data and not reader.eof:
            out.append(reader.decompress(data))
            at += len(data) - len(reader.unused_data)
            data = reader.unused_data or file.read(1 << 20)
        record = b"".join(out)
        if not record and held:
            held = held[0], at - held[0], held[2]
            continue
        if held:
            yield held
        held = low, at - low, record
    if held:
        yield held


def verdicts(pages: DataFrame, key: str, payload: str) -> tuple[DataFrame, float]:
    """(page_id, digest, first) of the rows that revisit, their payload's smallest page id being another; mean payload bytes."""
    raw = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.sha1(raw).alias("d"), F.octet_length(raw).alias("n"))
    rows = table(rows.distinct(), "digests")
    mean = rows.agg(F.avg("n")).first()[0] or 1.0
    rows = rows.filter(F.col("n") >= MIN_REVISIT_BYTES)
    groups = table(rows.groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1"), "payloads")
    hot = F.col("c") > HOT_SHARE * rows.count()
    many, few = groups.filter(hot), groups.filter(~hot)
    cold = rows.join(F.broadcast(many.select("d")), "d", "left_anti")
    out = rows.join(F.broadcast(many), "d").unionByName(cold.join(few, "d"))
    return out.filter("id IS NULL OR id <> first").filter("first IS NOT NULL").select("id", "d", "first"), mean


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes the archives as gzip WARC files under path, of at most FILE_RECORDS records and about FILE_BYTES."""
    again, mean = verdicts(pages, key, payload)
    again = table(again, "revisits")
    n = again.count()
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("d", F.sha1("body")).alias("p")
    again = (F.broadcast(again) if n <= BROADCAST_ROWS else again).alias("r")
    joined = rows.join(again, F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.d") == F.col("r.d")), "left").select("p.id", "p.url", "p.body", "p.d", "r.first")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [member(i, u, b, base32_of_hex(d), f)[:-1] for i, u, b, d, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    records = joined.mapInArrow(compose, "value binary").select(F.col("value").cast("string").alias("value"))
    most = max(1, min(FILE_RECORDS, int(FILE_BYTES / max(1.0, mean))))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)


def opened(file: str) -> BinaryIO:
    """A file that can be read by ranges, by whichever file system its address names."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", file)))
    return system.open_input_file(name)


def range_read(file: str, offset: int, length: int) -> bytes:
    with opened(file) as f:
        f.seek(offset)
        return f.read(length)


_RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, file string, offset bigint, length bigint"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _row(file: str, offset: int, length: int, record: bytes, bodies: bool) -> list:
    """A record's row. A response's digest and length come from its payload as read; a revisit's from its headers, as it has none."""
    h, body = parse(record)
    ident, url, kind = _number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type")
    if kind == "revisit":
        row = [ident, url, kind, _number(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha1:"), int(h.get("x-payload-length", 0))]
    else:
        row = [ident, url, kind, None, base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)]
    return [*row, file, offset, length] + [body] * bodies


def _rows(records: Iterator[tuple[str, int, int, bytes]], bodies: bool) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1000 rows, and of about READ_BYTES of bodies."""
    kinds = _KINDS + [pa.binary()] * bodies
    names = [x.split()[0] for x in _RECORD.split(", ")] + ["body"] * bodies

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    out, size = [], 0
    for file, offset, length, record in records:
        out.append(_row(file, offset, length, record, bodies))
        size += len(record) * bodies
        if len(out) == 1000 or size > READ_BYTES:
            yield batch()
            out, size = [], 0
    yield batch()


def read(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """A survey of the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes, file, offset, length.

    Files are listed by Spark and streamed member by member.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[str, int, int, bytes]]:
            for batch in batches:
                for name in batch.column("path").to_pylist():
                    with opened(name) as file:
                        for offset, length, record in members(file):
                            yield name, offset, length, record

        yield from _rows(records(), bodies)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(take, _RECORD + ", body binary" * bodies)


def _number(urn: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def build_index(captures: DataFrame, path: str) -> DataFrame:
    """captures: (url, page_id, record_type, file, offset, length), a written table. Writes the compressed blocks under path and
    returns the directory: (first, file, offset, length, lines, bytes), a row per block; bytes are those of its records.

    Keys are dealt by range, sorted, and cut into blocks as they stream; a block is one gzip member, ended as records are.
    """
    spark = captures.sparkSession
    most = max(BLOCK_LINES, -(-captures.count() // MAX_BLOCKS))
    key = F.pandas_udf(lambda urls, ids: _keys(urls, ids), "string")
    lines = captures.select(key("url", F.col("page_id").cast("string")).alias("k"), "record_type", "file", "offset", "length")
    ordered = lines.repartitionByRange("k", "file", "offset").sortWithinPartitions("k", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def block() -> pa.RecordBatch:
            made = _packed("\n".join(held).encode())
            return pa.RecordBatch.from_arrays([pa.array([made[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append("\t".join("" if x is None else str(x) for x in row))
                if len(held) == most:
                    yield block()
                    held = []
        if held:
            yield block()

    ordered.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as file:
                    out = [(_first(b), name, o, n, b.count(b"\n") + 1, sum(int(x.rpartition(b"\t")[2]) for x in b.split(b"\n"))) for o, n, b in members(file)]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["first", "file", "offset", "length", "lines", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(survey, "first string, file string, offset bigint, length bigint, lines bigint, bytes bigint").orderBy("first", "file", "offset")


def _keys(urls, ids):
    import pandas as pd

    return pd.Series([capture_key(u, None if i is None else int(i)) for u, i in zip(urls, ids, strict=True)], dtype=object)


def _first(block: bytes) -> str:
    return "\t".join(block.split(b"\n", 1)[0].decode().split("\t")[:2])


def _lines(file: BinaryIO, offset: int, length: int) -> Iterator[tuple[str, str, str, int, int]]:
    """(key, record type, file, offset, length) of each capture of a block."""
    file.seek(offset)
    for line in zlib.decompressobj(31).decompress(file.read(length)).decode().split("\n"):
        key, ident, kind, name, at, size = line.split("\t")
        yield f"{key}\t{ident}", kind, name, int(at), int(size)


def _packed(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = coder.compress(data) + coder.flush()
    return made if made[-1] == 0 else made + _MEMBER_TAIL


def _captures(blocks: list[tuple[str, int, int]], key: str) -> list[tuple[int | None, str, bytes]]:
    """(page id, record type, record) of the URL key's captures in the blocks (file, offset, length), by range reads."""
    found = []
    for file, offset, length in blocks:
        with opened(file) as f:
            for k, kind, name, at, size in _lines(f, offset, length):
                url, _, ident = k.partition("\t")
                if url == key:
                    found.append((int(ident, 16) - (1 << 63) if ident else None, kind, next(members(range_read(name, at, size)))[2]))
    return found


class Directory:
    """The sparse directory of an index in memory: (first key, file, offset, length), one entry per block."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.rows = sorted(rows)
        self.firsts = [r[0] for r in self.rows]

    def blocks(self, low: str, high: str) -> range:
        """Numbers of the blocks that can hold keys from low to high: captures of one key may begin in the block before the first that starts with it."""
        return range(max(0, bisect.bisect_left(self.firsts, low) - 1), bisect.bisect_right(self.firsts, high))

    def lookup(self, url: str) -> list[tuple[int | None, str, bytes]]:
        """(page id, record type, record) of each capture of the URL: directory, then block, then record, by range reads."""
        key = surt(url)
        return _captures([self.rows[i][1:] for i in self.blocks(f"{key}\t", f"{key}\tg")], key)


def lookup_in(directory: DataFrame, url: str) -> list[tuple[int | None, str, bytes]]:
    """As Directory.lookup, over a written directory: only the blocks that can hold the URL reach the driver."""
    key = surt(url)
    low, high = f"{key}\t", f"{key}\tg"
    before = directory.filter(F.col("first") < low).orderBy(F.desc("first"), F.desc("file"), F.desc("offset")).limit(1)
    rows = before.unionByName(directory.filter((F.col("first") >= low) & (F.col("first") < high))).select("file", "offset", "length").collect()
    return _captures([tuple(r) for r in rows], key)


def fetch(pages: DataFrame, directory: DataFrame, key: str = "page_id", url: str = "url", bodies: bool = False) -> DataFrame:
    """The records of every (page id, URL) in pages, by way of the index; a capture is returned once, however often pages name it. Rows are as ``read`` gives them."""
    spark = pages.sparkSession
    # MAX_BLOCKS entries at most, and one for each range partition.
    entries = directory.select("first", "file", "offset", "length", "bytes").collect()
    held = spark.sparkContext.broadcast(Directory([tuple(r)[:4] for r in entries]))
    # Narrow rows stand for much reading: Spark would put all of them into a few tasks.
    cores = spark.sparkContext.defaultParallelism
    shares, stretches = max(cores, len(entries) // TASK_BLOCKS), max(cores, sum(r.bytes for r in entries) // STRETCH_BYTES)
    asked = pages.select(F.col(f"`{key}`").cast("bigint").alias("i"), F.col(f"`{url}`").cast("string").alias("u")).distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, keys = [], []
            for i, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = capture_key(u, i)
                there = held.value.blocks(k, k)
                block += there
                keys += [k] * len(there)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(keys, pa.string())], names=["block", "k"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines = None, {}
        for batch in batches:
            out = []
            for number, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    _, file, offset, length = held.value.rows[number]
                    now, lines = number, {}
                    with opened(file) as f:
                        for found, _, *place in _lines(f, offset, length):
                            lines.setdefault(found, []).append(place)
                # URLs that differ by what a key leaves out ask for the same captures.
                out += lines.pop(k, ())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(_together((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))), bodies)

    places = asked.mapInArrow(search, "block int, k string").repartition(shares, "block").sortWithinPartitions("block", "k").mapInArrow(take, "file string, offset bigint, length bigint")
    near = places.repartition(stretches, "file", (F.col("offset") / STRETCH_BYTES).cast("bigint")).sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(gather, _RECORD + ", body binary" * bodies)


def _together(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, offset, length, record) of sorted places; those close to each other come by one range read."""
    run: list[tuple[int, int]] = []
    name, file = None, None

    def load() -> Iterator[tuple[str, int, int, bytes]]:
        if run:
            low = run[0][0]
            file.seek(low)
            data = memoryview(file.read(run[-1][0] + run[-1][1] - low))
            for offset, length in run:
                yield name, offset, length, next(members(bytes(data[offset - low : offset - low + length])))[2]

    for f, offset, length in places:
        if run and (f != name or offset > run[-1][0] + run[-1][1] + GAP_BYTES or offset + length > run[0][0] + READ_BYTES):
            yield from load()
            run = []
        if f != name:
            if file:
                file.close()
            name, file = f, opened(f)
        run.append((offset, length))
    yield from load()
    if file:
        file.close()


def archive(pages: DataFrame) -> tuple[str, DataFrame]:
    """Writes pages to archives in the shared folder and indexes them: (folder of the archives, stored directory)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    captures = table(read(spark, path).select("url", "page_id", "record_type", "file", "offset", "length"), "captures")
    return path, table(build_index(captures, scratch_path(spark, "cdx")), "directory")
