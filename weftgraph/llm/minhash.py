"""Near-duplicate detection with ProbMinHash: signatures, banding, exact verification, components.

Method: a text's elements are its lower-cased five-word shingles, weighted by how often they occur (a text of one to
four words has one element, all of its words). Each element is a Poisson process whose rate is its weight; each
arrival falls on one of ``REGISTERS`` registers, which keeps the element that arrives first. Arrivals later than a
horizon cannot win a register that is already taken, so generation stops there; texts with a register still empty go
on to a wider one. Two texts agree on a register with their probability Jaccard likeness. Registers are banded,
texts that share a band are candidates, and a link needs an exact likeness of at least ``THRESHOLD`` over the whole
texts. A text's class is its connected component over links and equal word sequences, named by its smallest key.

How groups stay small: equal word sequences collapse to one representative by a map-side-combined aggregation
before anything else. In a bucket, members are compared with a hub (the member whose bands are the most shared), not
with each other; components are then taken. In buckets that still hold several components, the members outside the
hub's are dealt into blocks of about ``BLOCK`` texts and ``BLOCK_WORDS`` words; each block's shingles are held in memory while the bucket's members,
in slices of about ``SLICE`` that are tasks of their own, are streamed past them, and only links that join two components leave the task. So no link between different texts of a
bucket is lost, no pairs are written out, and a group of near copies costs a comparison each for all that are near
its hub. Star verification deals each hub's members into salted groups of ``GROUP``. Shingles are compared by 48 bits of their hashes, so "exact" means up to a collision inside a pair of texts.

Defined results: a text without a word (or null), and a row with a null key, is a class of its own; rows that repeat
a key share a class with each other if their words are equal, and otherwise the key gets the smaller class; an empty
table gives an empty result; other columns are not read. Words that differ in case only are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import BROADCAST_ROWS, table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 21, 6
REGISTERS = BANDS * ROWS
GROUP, BLOCK, BLOCK_WORDS, SLICE = 256, 256, 2_000_000, 512
CHUNK_BYTES = 1_500_000


def signatures(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) winning elements. of, shingle, weight: distinct weighted elements in text order."""
    total = np.bincount(of, weights=weight, minlength=n)
    best, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    width = registers * (np.log(registers) + 3.0)
    live, start = np.arange(len(of)), None
    while len(live):
        horizon = width / np.maximum(total, 1e-300)
        best[np.repeat(np.isin(np.arange(n), of[live]), registers)] = np.inf
        at, when, j = live, np.zeros(len(live)), 0
        while len(at):
            draw = arrays.mixed(shingle[at] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(2 * j + 1))
            when = when - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight[at]
            inside = when <= horizon[of[at]]
            at, when = at[inside], when[inside]
            place = arrays.mixed(shingle[at] ^ np.uint64(0x5851F42D4C957F2D * (j + 1) % (1 << 64))) % np.uint64(registers)
            cell = of[at] * registers + place.astype(np.int64)
            np.minimum.at(best, cell, when)
            won = best[cell] == when
            winner[cell[won]] = shingle[at[won]]
            j += 1
        empty = np.isinf(best).reshape(n, registers).any(axis=1)
        live = live[empty[of[live]]]
        width *= 3
    return winner.reshape(n, registers)


def bands(winners: np.ndarray, count: int = BANDS) -> np.ndarray:
    """(n, count) 64-bit band keys; the band's number is part of its key."""
    n, m = winners.shape
    parts = winners.reshape(n, count, m // count)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (n, count)).copy()
    for j in range(m // count):
        out = arrays.mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two (sorted shingles, weights): the sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # For j with a larger a / b than i, a_j / a_i is the maximum; else b_j / b_i.
    up = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))[np.searchsorted(ratio, ratio, "right")]
    down = np.cumsum(y)[np.searchsorted(ratio, ratio, "right") - 1]
    return float((1 / ((only_a + up) / x + (only_b + down) / y)).sum())


def _elements(texts: pa.Array) -> tuple:
    data, offsets = arrays.text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    start, end, of = arrays.words(data, offsets)
    hashes = arrays.word_hashes(data, start, end)
    return hashes, of, arrays.weighted(*arrays.runs(hashes, of, len(texts), SHINGLE))


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about CHUNK_BYTES: bounds the working memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    low = size = 0
    for i, x in enumerate(sizes):
        if i > low and size + x > CHUNK_BYTES:
            yield batch.slice(low, i - low)
            low, size = i, 0
        size += int(x)
    if batch.num_rows > low:
        yield batch.slice(low)


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h1, h2, n, bands): word sequence hashes, number of words, band keys (empty without a word)."""

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "t"):
                n = batch.num_rows
                hashes, of, (where, shingle, weight) = _elements(batch.column("t"))
                h1, h2 = arrays.sequence_hashes(hashes, of, n)
                count = np.bincount(of, minlength=n)
                keys = bands(signatures(where, shingle, weight, n))
                full = count > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(count.astype(np.int64)), lists], names=["id", "h1", "h2", "n", "bands"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n bigint, bands array<bigint>")


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """pairs (a, hub) -> those whose exact likeness reaches the threshold. docs: one row for each key in pairs, or equal rows."""
    sizes = table(pairs.groupBy("hub").agg(F.count("*").alias("c")).filter(F.col("c") > GROUP), "hubs")
    dealt = pairs.join(_if_small(sizes, sizes.count()), "hub", "left").select(
        "a", "hub", F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("c") / GROUP), F.lit(1)).cast("bigint")).alias("salt")
    )
    routes = table(
        dealt.select(F.col("a").alias("id"), "hub", "salt", F.lit(1).alias("part")).unionByName(dealt.select(F.col("hub").alias("id"), "hub", "salt", F.lit(0).alias("part")).distinct()),
        "routes",
    )
    n = routes.count()
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).filter("id IS NOT NULL")
    sent = texts.join(_if_small(routes, n), "id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "part", "id")

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for whole in batches:
            for batch in _slices(whole, "t"):
                _, _, (where, shingle, weight) = _elements(batch.column("t"))
                edge = np.searchsorted(where, np.arange(batch.num_rows + 1))
                out = []
                for i, (ident, h, salt, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "hub", "salt", "part")), strict=True)):
                    mine = shingle[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]
                    if part == 0:
                        hub, own = (h, salt), mine
                    elif hub == (h, salt) and likeness(mine, own) >= threshold:
                        out.append((ident, h))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "hub"])

    return sent.select("id", "hub", "salt", "part", "t").mapInArrow(run, "a bigint, hub bigint")


def block_links(held: DataFrame, docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """held: (band, a, comp, main, words) of the open buckets -> (a, hub) links that join components, found in blocks."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("words") / BLOCK_WORDS))
    held = table(held, "open")
    blocks = held.filter("comp <> main").groupBy("band").agg(parts.cast("int").alias("blocks"))
    slices = held.groupBy("band").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    blocks = table(blocks.join(slices, "band"), "blocks")
    dealt = held.join(_if_small(blocks, blocks.count()), "band")
    inside = dealt.filter("comp <> main").select(F.col("a").alias("id"), "band", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("part"), "comp")
    past = dealt.select(F.col("a").alias("id"), "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("a", F.lit(1)), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("part"), "comp")
    routes = table(inside.unionByName(past), "routes")
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).filter("id IS NOT NULL")
    sent = texts.join(_if_small(routes, routes.count()), "id").repartition("band", "block", "slice").sortWithinPartitions("band", "block", "slice", "part", "id")

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, merged = None, [], {}
        index: tuple | None = None

        def root(x: int) -> int:
            while merged.get(x, x) != x:
                x = merged[x]
            return x

        for whole in batches:
            for batch in _slices(whole, "t"):
                _, _, (where, shingle, weight) = _elements(batch.column("t"))
                edge = np.searchsorted(where, np.arange(batch.num_rows + 1))
                out = []
                for i, (ident, band, number, cut, part, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "band", "block", "slice", "part", "comp")), strict=True)):
                    mine = shingle[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]
                    if at != (band, number, cut):
                        at, block, merged, index = (band, number, cut), [], {}, None
                    if part == 0:
                        block.append((ident, comp, mine))
                        continue
                    if index is None:
                        every = np.concatenate([b[2][0] for b in block])
                        order = np.argsort(every, kind="stable")
                        share = np.concatenate([b[2][1] / b[2][1].sum() for b in block])[order]
                        index = every[order], np.repeat(np.arange(len(block)), [len(b[2][0]) for b in block])[order], share
                    # Common mass bounds the likeness from above, so only pairs that reach the threshold need it exactly.
                    low, high = np.searchsorted(index[0], mine[0], "left"), np.searchsorted(index[0], mine[0], "right")
                    count = high - low
                    hit = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
                    mass = np.bincount(index[1][hit], np.minimum(index[2][hit], np.repeat(mine[1] / mine[1].sum(), count)), len(block))
                    for j in np.flatnonzero(mass >= threshold - 1e-9):
                        other, its, theirs = block[j]
                        x, y = root(comp), root(its)
                        if x != y and likeness(mine, theirs) >= threshold:
                            merged[max(x, y)] = min(x, y)
                            out.append((ident, other))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "hub"])

    return sent.select("id", "band", "block", "slice", "part", "comp", "t").mapInArrow(run, "a bigint, hub bigint")


def components(edges: DataFrame, a: str = "a", b: str = "hub") -> DataFrame:
    """(id, comp) of every end of an edge: the smallest id that it reaches.

    Minimum labels pass along edges, then jump to their own label's label; rounds are logarithmic for stars and
    chains alike. Each round is written to the shared folder.
    """
    both = table(edges.selectExpr(f"{a} AS x", f"{b} AS y").unionByName(edges.selectExpr(f"{b} AS x", f"{a} AS y")).distinct(), "edges")
    label = table(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "id"), "labels")
    while True:
        n = label.count()
        near = both.join(_if_small(label.withColumnRenamed("id", "y"), n), "y").groupBy("x").agg(F.min("comp").alias("near"))
        step = label.join(_if_small(near, n), label.id == near.x, "left").select("id", "comp", F.least("comp", "near").alias("next"))
        step = table(step, "step")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        moved = table(step.join(_if_small(jump, n), "next", "left").select("id", F.col("comp").alias("was"), F.least("next", "far").alias("comp")), "labels")
        label = moved.select("id", "comp")
        if moved.filter("was <> comp").isEmpty():
            return label


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id) of every row of docs."""
    signed = table(sign(docs, key, text), "signed")
    known = signed.filter("id IS NOT NULL AND n > 0")
    reps = table(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n").alias("words")), "reps")
    all_bands = reps.select("rep", "words", F.explode(F.array_distinct("bands")).alias("band"))
    shared = all_bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    member = table(all_bands.join(shared, "band"), "members")
    central = member.groupBy("rep").agg(F.sum("size").alias("weight"))
    member = table(member.drop("size").join(central, "rep"), "members")
    best = F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub")
    hubs = member.groupBy("band").agg(best, F.count("*").alias("size"))
    of_band = table(member.join(hubs, "band").select("band", F.col("rep").alias("a"), "hub", "size", "words"), "stars")
    pairs = of_band.filter("a <> hub").groupBy(F.least("a", "hub").alias("u"), F.greatest("a", "hub").alias("v")).agg(F.max("hub").alias("hub"))
    pairs = table(pairs.select(F.expr("u + v - hub").alias("a"), "hub"), "pairs")
    links = table(verify(pairs, docs, key, text).distinct(), "links")
    label = components(links)
    n = label.count()
    comp = _if_small(label, n)
    held = of_band.filter("size > 2").join(comp, F.col("a") == F.col("id"), "left").select("band", "a", "hub", "words", F.coalesce("comp", "a").alias("comp"))
    open_ = table(held.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("a") == F.col("hub"), F.col("comp"))).alias("main")).filter("low < high"), "open")
    n = open_.count()
    if n:
        held = held.join(_if_small(open_.select("band", "main"), n), "band")
        more = table(block_links(held, docs, key, text).distinct(), "links")
        if not more.isEmpty():
            label = components(links.unionByName(more))
    named = reps.join(label, reps.rep == label.id, "left").select("h1", "h2", F.coalesce("comp", "rep").alias("class_id"))
    joined = signed.withColumn("_in", F.expr("id IS NOT NULL AND n > 0")).alias("s").join(
        named.alias("c"), (F.col("s.h1") == F.col("c.h1")) & (F.col("s.h2") == F.col("c.h2")) & F.col("s._in"), "left")
    return joined.select("s.id", F.coalesce("class_id", "id").alias("class_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, kept): kept is true for the document that names its class, and for rows with a null key."""
    return classes(docs, key, text).select(F.col("id").alias(key), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class; of rows that repeat a kept key, one stays."""
    verdict = table(classes(docs, key, text).filter("id IS NOT NULL").groupBy("id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")), "verdicts")
    gone, twice = verdict.filter("class_id <> id").select("id"), verdict.filter("class_id = id AND n > 1").select("id")
    mark = docs.withColumn("__weft_id", F.col(f"`{key}`").cast("bigint"))
    for drop in (gone, twice):
        drop = table(drop, "drop")
        mark = mark.join(_if_small(drop.withColumnRenamed("id", "__weft_id"), drop.count()), "__weft_id", "left_anti")
    once = docs.join(_if_small(twice, twice.count()), F.col(f"`{key}`").cast("bigint") == twice.id, "left_semi").dropDuplicates([key])
    return mark.select(*[f"`{c}`" for c in docs.columns]).unionByName(once)
