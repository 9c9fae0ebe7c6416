"""Language identification with hyperdimensional profiles.

Method: each letter owns a random vector of +1 and -1 drawn from its code point alone. The vector of a letter
n-gram binds (multiplies) its letters' vectors, permuted (rolled) by their place; a text's profile bundles (adds)
its n-grams' vectors. A language's prototype bundles the unit profiles of its training texts. A text gets the language
whose prototype has the largest cosine with its profile; the score is the softmax of the cosines.

Runs of other characters count as one blank; every letter of the whole text is read. Training takes at most about
``TRAIN_PER_LANGUAGE`` texts of each language, by a hash of their key, and all of them where there are fewer: that
bound, and one prototype per language, are all that the driver holds. Scoring is one map without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null language are never
learned from; repeated rows are scored alike; with no training rows at all every text is ``und``; ties between
languages go to the first by name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import hash_unit, small, table

DIMENSIONS = 1024
GRAM = 3
TRAIN_PER_LANGUAGE = 1500
SHARPNESS = 20.0
UNKNOWN = "und"
CHUNK_CHARS = 400_000
CHUNK_GRAMS = 4096

_alpha: list[np.ndarray] = []
_letters: dict[int, np.ndarray] = {}


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _alpha[0][points]


def letter(point: int) -> np.ndarray:
    """The letter's own vector; point 0 is the blank."""
    if point not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        draw = np.random.Generator(np.random.Philox(key=point)).integers(0, 2, DIMENSIONS)
        _letters[point] = (draw * 2 - 1).astype(np.float32)
    return _letters[point]


def profiles(texts: list[str]) -> np.ndarray:
    """The bundled n-gram vectors of each text, (texts, DIMENSIONS)."""
    points, offsets = arrays.code_points([t.lower() for t in texts])
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    points = np.where(_is_letter(points), points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (of[1:] != of[:-1])
    points, of = points[keep], of[keep]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(points) < GRAM:
        return out
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    dense = rank[points]
    last = len(dense) - GRAM + 1
    grams = np.zeros(last, np.int64)
    for j in range(GRAM):
        grams = grams * len(alphabet) + dense[j : j + last]
    at = of[:last] == of[GRAM - 1 :]
    grams, of = grams[at], of[:last][at]
    if len(alphabet) ** GRAM <= 4_000_000:
        there = np.zeros(len(alphabet) ** GRAM, bool)
        there[grams] = True
        known = np.flatnonzero(there)
        number = np.zeros(len(there), np.int64)
        number[known] = np.arange(len(known))
        grams = number[grams]
    else:
        known, grams = np.unique(grams, return_inverse=True)
    own = np.stack([letter(int(p)) for p in alphabet])
    rolled = [np.roll(own, GRAM - 1 - j, axis=1) for j in range(GRAM)]
    for low in range(0, len(known), CHUNK_GRAMS):
        part, rest = known[low : low + CHUNK_GRAMS], known[low : low + CHUNK_GRAMS]
        bound = np.ones((len(part), DIMENSIONS), np.float32)
        for j in reversed(range(GRAM)):
            bound *= rolled[j][rest % len(alphabet)]
            rest = rest // len(alphabet)
        inside = (grams >= low) & (grams < low + len(part))
        counts = np.bincount(of[inside] * len(part) + grams[inside] - low, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
    return out


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes."""
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    counts = small(table(rows.groupBy("l").count(), "languages"))
    sample = rows.join(counts, "l").filter(hash_unit("language", F.col("k")) * F.col("count") < per_language)

    @arrays.tidy
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column("t").to_pylist(), batch.column("l").to_pylist()
            at = 0
            for run in _chunks(texts):
                unit = _unit(profiles(run)).astype(np.float64)
                for name in set(names[at : at + len(run)]):
                    mine = unit[[x == name for x in names[at : at + len(run)]]].sum(axis=0)
                    sums[name] = sums.get(name, 0) + mine
                at += len(run)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["l", "v"])

    parts = sample.select("k", "l", "t").repartition(12, "k").sortWithinPartitions("k", "t").mapInArrow(bundle, "l string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for row in sorted(parts, key=lambda r: (r.l, r.v)):
        total[row.l] = total.get(row.l, 0) + np.array(row.v)
    names = sorted(total)
    return names, _unit(np.array([total[x] for x in names], np.float64).reshape(len(names), DIMENSIONS)).astype(np.float32)


def compare(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    found, scores = [], []
    for run in _chunks([t or "" for t in texts]):
        has = np.array([any(map(str.isalpha, t)) for t in run], bool)
        cos = _unit(profiles([" " + t + " " for t in run])) @ prototypes.T if names else np.zeros((len(run), 0), np.float32)
        if not names:
            found += [UNKNOWN] * len(run)
            scores += [0.0] * len(run)
            continue
        best = cos.argmax(axis=1)
        power = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)).astype(np.float64))
        share = 1 / power.sum(axis=1)
        found += [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        scores += np.where(has, share, 0.0).tolist()
    return found, scores


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """docs -> (_doc struct of all its columns, lang_pred, score)."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("_t"))
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = compare(batch.column("_t").to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["_doc", "lang_pred", "score"])

    return held.mapInArrow(run, f"_doc {held.schema['_doc'].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
