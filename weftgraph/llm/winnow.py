"""Document fingerprints by winnowing.

Method: every run of ``GRAM`` code points has a rolling 40-bit hash, read off one running polynomial. In each window of
``WINDOW`` successive hashes the minimum is selected, the rightmost of equals; a position selected by several windows
counts once. Any passage of at least GRAM + WINDOW - 1 equal code points therefore shares a selected hash, and the
positions kept with the hashes say where. A text of fewer than GRAM code points has one hash, of all of them; one of
fewer hashes than a window has one window.

The likeness of two fingerprints is the Jaccard coefficient of their sets of hashes; two empty ones are alike (1).

``with_next`` gives each document the one after it in descending key order. Keys are cut into ranges of about
``BUCKET_ROWS`` at approximate quantiles; each range also receives the first document of the next one, is sorted,
and is streamed. Text is shuffled once; what reaches the driver is one key per range, at most ``MAX_BUCKETS``.

Defined results: a null text counts as empty and has the fingerprint of an empty list; equal texts have equal
fingerprints; of equal keys the smaller text comes first; null keys come last; the only document is its own
successor; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

GRAM, WINDOW = 16, 16
BUCKET_ROWS, MAX_BUCKETS = 500, 20_000
CHUNK_CHARS = 600_000
_BASE = 0xA24BAED4963EE407
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = 24  # bits of a key for the position; texts are cut into calls far below 2 ** 24 code points


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) selected in each text. window: a power of two."""
    points, offsets = arrays.code_points(texts)
    n = len(points)
    if n >= 1 << _PLACE:
        if len(texts) > 1:
            half = len(texts) // 2
            return fingerprints(texts[:half], gram, window) + fingerprints(texts[half:], gram, window)
        return [_long(texts[0], gram, window)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mixed(points.astype(np.uint64)) * arrays.powers(_BASE, n), dtype=np.uint64)))
    size = np.diff(offsets)
    # Grams start at every code point of a text but its last gram - 1; a short text has one.
    length = np.minimum(size, gram)
    count = np.where(size > 0, size - length + 1, 0)
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(of)) - first[of] + offsets[of] if len(of) else np.zeros(0, np.int64)
    hashes = arrays.mixed((total[start + length[of]] - total[start]) * arrays.powers(_BACK, n + 1)[start]) >> np.uint64(_PLACE)
    index = np.arange(len(of), dtype=np.uint64)
    key = (hashes << np.uint64(_PLACE)) | (np.uint64((1 << _PLACE) - 1) - index)
    low, width = key, 1
    while width < window and len(low) > width:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    windows = np.maximum(count - window + 1, 0)
    at = np.flatnonzero(of[: len(low)] == of[window - 1 :]) if len(of) >= window else np.zeros(0, np.int64)
    picked = low[at]
    few = np.flatnonzero((count > 0) & (windows == 0))
    if len(few):
        picked = np.concatenate((picked, [key[first[i] : first[i] + count[i]].min() for i in few]))
    place = np.unique(((1 << _PLACE) - 1) - (picked & np.uint64((1 << _PLACE) - 1)).astype(np.int64))
    edge = np.searchsorted(place, np.append(first, len(of)))
    return [(hashes[p], p - f) for p, f in ((place[edge[i] : edge[i + 1]], first[i]) for i in range(len(texts)))]


def _long(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over overlapping pieces, for a single text beyond the position bits."""
    step, over = 1 << 22, gram + window - 2
    hashes, places = [], []
    for low in range(0, max(1, len(text) - over), step):
        h, p = fingerprints([text[low : low + step + over]], gram, window)[0]
        hashes.append(h)
        places.append(p + low)
    place, index = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[index], place


def digest(mark: tuple[np.ndarray, np.ndarray]) -> str:
    return hashlib.blake2b(mark[0].astype("<u8").tobytes() + mark[1].astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, guest, id, t) in streaming order: each row's successor is the next row; guests have none themselves."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets + 1000)).first()[0]
    edges = np.unique(np.array([x for x in cuts or [] if x is not None], np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        got = len(edges) - np.searchsorted(edges, ids.fillna(0).astype("int64"), "left")
        return pd.Series(np.where(ids.isna(), len(edges) + 1, got).astype("int32"))

    # The first key of each range, at most one per cut: a bounded list.
    firsts = sorted((r.b, r.id) for r in rows.select("id", bucket("id").alias("b")).groupBy("b").agg(F.max("id").alias("id")).collect())
    follow = {firsts[(i + 1) % len(firsts)][1]: firsts[i][0] for i in range(len(firsts))} if firsts else {}
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame([(k, b) for k, b in follow.items()], "head_id bigint, bucket int"))
    guests = rows.join(heads, rows.id.eqNullSafe(heads.head_id)).groupBy("bucket", "id").agg(F.min("t").alias("t")).select("bucket", F.lit(1).alias("guest"), "id", "t")
    own = rows.select(bucket("id").alias("bucket"), F.lit(0).alias("guest"), "id", "t")
    return own.unionByName(guests).repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), "t")


def edited(text: str, after: str) -> str:
    """The last third of the text's code points, rounded down, replaced by the first as many (or all) of the next text."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text", outputs: bool = False) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); ``outputs`` adds hashes and positions."""
    kind = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    kind = pa.schema([*kind, ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))]) if outputs else kind

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (id, text, next text is the next row's). The last row is only a successor."""
        texts = [r[3] for r in rows]
        follows = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        other = [edited(texts[i], texts[i + 1]) for i in follows]
        marks = fingerprints(texts)
        own = [np.unique(h) for h, _ in marks]
        out = []
        for i, e, m in zip(follows, other, fingerprints(other), strict=True):
            row = [rows[i][2], len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(marks[i]), digest(m), likeness(own[i], np.unique(m[0])), likeness(own[i], own[i + 1])]
            out.append(row + [marks[i][0].tolist(), marks[i][1].tolist()] * outputs)
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "id", "t")), strict=True):
                held.append(row)
                size += len(row[3])
                if size > CHUNK_CHARS and len(held) > 1:
                    yield judged(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield judged(held)

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema += ", hashes array<bigint>, positions array<bigint>" * outputs
    return with_next(docs, key, text).mapInArrow(run, schema).withColumnRenamed("id", key)
