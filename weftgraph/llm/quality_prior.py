"""Quality by hierarchical empirical Bayes over documents, hosts and paths.

Method: a logistic classifier on shape features of the whole text gives each document's evidence. Grouped aggregation
sums the evidence per path and per host. Rates are Beta-distributed around their parent's: a host's posterior shrinks
to the global rate and a path's to its host's, each by a concentration fitted to the spread between groups (method of
moments), so sparse sites lean on their prior. A document's score adds to its own evidence the log odds of its path's
posterior against the global rate; its own share is left out of both sums, so no evidence counts twice.

The classifier is fitted on at most about ``TRAIN_TEXTS`` labelled documents of each class, drawn by a hash; rates and
concentrations cover all documents. Groups are summed map-side first; hot hosts join by a bounded broadcast.

Defined results: null and empty texts have the features of no words; null hosts and paths are groups of their own;
labels that are null or neither 0 nor 1 are not learned from, and a key with both counts as low quality; without both
classes the evidence is 0 throughout; repeated rows are scored alike and count each; rows with equal features tie at
one score; very long texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, minhash
from .common import hash_unit, join_groups, table

TRAIN_TEXTS, RIDGE = 3000, 1e-3
FEATURES = ("symbols", "capitals", "digits", "bars", "shouts", "repeated shingles", "repeated lines", "word length", "word length spread", "size")
LIMIT = 12.0


def features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES) of whole texts, without a loop over characters."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    data, offsets = arrays.text_bytes(texts)
    start, end, of = arrays.words(data, offsets)
    count = np.bincount(of, minlength=n)
    size = np.maximum(1, np.bincount(of, end - start, minlength=n))
    kinds = []
    for chars in (b"#*$%&<>=@^~{}[]", bytes(range(65, 91)), bytes(range(48, 58)), b"|", b"!?"):
        total = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(chars, np.uint8)))))
        kinds.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    hashes = arrays.word_hashes(data, start, end)
    made, where = arrays.runs(hashes, of, n, 3)
    whose, _, times = arrays.weighted(made, where)
    total = np.bincount(whose, times, minlength=n)
    repeated = (total - np.bincount(whose, minlength=n)) / np.maximum(1, total)
    lines = pc.split_pattern(texts, "\n")
    flat, parent = lines.flatten(), np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    ldata, loffsets = arrays.text_bytes(flat)
    full = np.diff(loffsets) > 0
    code = arrays.mixed(arrays.word_hashes(ldata, loffsets[:-1][full], loffsets[1:][full]) ^ arrays.mixed(parent[full].astype(np.uint64)))
    _, first = np.unique(code, return_index=True)
    line_count = np.bincount(parent[full], minlength=n)
    again = (line_count - np.bincount(parent[full][first], minlength=n)) / np.maximum(1, line_count)
    mean = np.bincount(of, end - start, minlength=n) / np.maximum(1, count)
    spread = np.sqrt(np.maximum(0, np.bincount(of, (end - start) ** 2.0, minlength=n) / np.maximum(1, count) - mean**2))
    return np.stack([np.minimum(1, np.sqrt(k)) for k in kinds] + [repeated, again, np.log1p(mean), np.log1p(spread), np.log1p(count)], axis=1)


def _map(rows: DataFrame, schema: str, make) -> DataFrame:
    """rows with a text column t -> the other columns and what make(texts) adds (a list of Arrow arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in minhash._slices(whole, "t"):
                rest = [c for c in batch.schema.names if c != "t"]
                added = make(batch.column("t"))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [a for _, a in added], names=rest + [k for k, _ in added])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "t")
    return rows.mapInArrow(run, f"{kept}, {schema}")


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton steps."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], RIDGE * len(x)), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights) of the evidence model."""
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    marked = table(marked, "quality-labels")
    count = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(TRAIN_TEXTS / max(1, count.get(1, 0)))).otherwise(F.lit(TRAIN_TEXTS / max(1, count.get(0, 0))))
    drawn = marked.filter(hash_unit("quality", F.col("k")) < share)  # about TRAIN_TEXTS rows of each class: safe to broadcast
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(drawn), "k").select("k", "y", "t")
    got = _map(rows, "f array<double>", lambda t: [("f", pa.array(features(t).tolist(), pa.list_(pa.float64())))]).collect()
    got = sorted((r.k, r.y, tuple(r.f)) for r in got)
    x, y = np.array([r[2] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float)
    if len(set(y)) < 2:
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return centre, scale, logistic((x - centre) / scale, y)


def _concentration(groups: DataFrame, total: str, n: str, mean: Column) -> float:
    """Method-of-moments concentration of rates total / n about their means: large where groups differ no more than by chance."""
    rate = F.col(total) / F.col(n)
    row = groups.filter(F.col(n) > 1).agg(
        F.sum(F.col(n) * (rate - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(F.col(n) * mean * (1 - mean)).alias("scale")
    ).first()
    if not row.scale:
        return 1.0
    excess = max(0.0, (row.between - row.chance)) / row.scale  # = 1 / (concentration + 1)
    return float(min(1e6, max(1.0, 1 / excess - 1 if excess > 1e-6 else 1e6)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, evidence, host_rate, path_rate, score, predicted)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> list[tuple[str, pa.Array]]:
        centre, scale, w = held.value
        return [("evidence", pa.array(np.clip((features(texts) - centre) / scale @ w[:-1] + w[-1], -LIMIT, LIMIT)))]

    rows = docs.select(F.col(f"`{key}`").alias("k"), host.cast("string").alias("h"), path.cast("string").alias("p"), F.col(f"`{text}`").alias("t"))
    rows = table(_map(rows, "evidence double", judge).withColumn("own", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    total = rows.agg(F.count("*").alias("n"), F.sum("own").alias("s")).first()
    if not total.n:
        mean = 0.5
    else:
        mean = min(1 - 1e-6, max(1e-6, total.s / total.n))
    paths = table(rows.groupBy("h", "p").agg(F.count("*").alias("pn"), F.sum("own").alias("ps")), "paths")
    hosts = table(paths.groupBy("h").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs")), "hosts")
    to_global = _concentration(hosts, "hs", "hn", F.lit(mean))
    both = table(join_groups(paths, hosts, ["h"], "hn", total.n), "sites")
    hosts_rate = (F.col("hs") + to_global * mean) / (F.col("hn") + to_global)
    to_host = _concentration(both, "ps", "pn", hosts_rate)
    df = join_groups(rows, both, ["h", "p"], "pn", total.n)
    # Leave-one-out: the document's own evidence is taken out of its host's and path's sums.
    host_rate = (F.col("hs") - F.col("own") + to_global * mean) / (F.col("hn") - 1 + to_global)
    path_rate = (F.col("ps") - F.col("own") + to_host * F.col("host_rate")) / (F.col("pn") - 1 + to_host)
    df = df.withColumn("host_rate", host_rate).withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(mean / (1 - mean)))
    df = df.withColumn("score", 1 / (1 + F.exp(-odds)))
    return df.select(F.col("k").alias(key), "evidence", "host_rate", "path_rate", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
