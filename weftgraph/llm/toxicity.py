"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Method: the gap-weighted subsequence kernel of order ``ORDER`` (decay ``DECAY`` per spanned character), normalised and
raised to ``POWER``, compares a landmark, behind a mark for the token's edge, with the landmark's own characters in a whole
token, in windows from each of them on. Other characters, however many, widen gaps: each costs one decay, and a piece's own
kernel has ``OWN_GAPS`` of that, so that letters put between the landmark's own lower the likeness a little. Likenesses of
at most ``LEAST`` count as none; windows that lack so many of the landmark's characters that Cauchy's and Schwarz's bound is no more are left
out. Punctuation inside a token is passed over and also taken for an edge, the better counting, and a run of
single-character tokens also counts as one token. The likenesses go through the Nyström map of the landmarks' own kernel matrix into a linear machine with
squared hinge loss; tokens above 0 are hits. A text is judged by its ``TOP`` highest distinct tokens, its number of
distinct hits and the share of its words that are hits, through a logistic link: one word that is like an insult by
chance weighs less than several, and less in a long text.

Training: labels are of texts, so sentences' tokens are labelled by multiple instances: all of a clean text's are clean,
of a toxic text's the highest-scoring are toxic, for ``ROUNDS`` rounds. Landmarks are word beginnings (or words) that
tell toxic training texts from clean ones beyond chance (``CHANCE`` over all candidates), taken greedily by the toxic
texts that they cover. Toxic texts are also learned with their insults disguised: a character inserted, left out, or put
in another's place. The driver holds about ``TRAIN_CLEAN`` and ``TRAIN_TOXIC`` labelled texts of either class, drawn by a
hash and whole, however long; the link allows for the classes' shares among all labels given. Scoring is one map over whole texts.

Defined results: a null or empty text gets the score of a text without hits; rows with a null key or label, and labels
without a text, are not learned from; a key with both labels counts as toxic; without toxic training texts every score is 0; repeated rows
are scored alike and learned from each; of landmarks that cover equally many texts the longer, then the later by code points is taken;
very long texts and tokens are read to their end; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, minhash
from .common import hash_unit, table

ORDER, DECAY, POWER = 3, 0.7, 2
SHORTEST, LEAST_BYTES, LONGEST, LANDMARKS = 3, 4, 16, 96
LEAST_TEXTS, PURITY, CHANCE = 3, 0.8, 0.01
TRAIN_CLEAN, TRAIN_TOXIC, ROUNDS, RIDGE = 5000, 1500, 3, 0.003
INSERTED, TOP = 3, 3
#: Stands before a token's first character; texts hold none, as punctuation is passed over.
EDGE = b"^"
PUNCTUATION = ord(".")
LEAST, OWN_GAPS = 0.55, 0.9
#: Hashes a window's characters and gaps.
_ODD = np.random.default_rng(5).integers(1 << 63, 1 << 64, 64, np.uint64) | np.uint64(1)


@dataclass
class Model:
    landmarks: list[bytes]
    own: np.ndarray
    weights: np.ndarray
    bias: float
    link: np.ndarray


def kernels(tokens: np.ndarray, marks: np.ndarray, order: int = ORDER, decay: float = DECAY, token_gaps: np.ndarray | None = None, mark_gaps: np.ndarray | None = None) -> np.ndarray:
    """Gap-weighted subsequence kernel of row pairs. tokens, marks: zero-padded matrices; a zero matches nothing. Gaps: how many characters were left out before each one."""
    n, width = tokens.shape
    m = marks.shape[1]
    wide = [1.0] * width if token_gaps is None else list(decay**token_gaps.T)
    high = [1.0] * m if mark_gaps is None else list(decay**mark_gaps.T)
    # before[j]: K' of the previous order between the token so far and the landmark's first j characters.
    before = [[np.ones(n)] * (m + 1)] * (width + 1)
    total = np.zeros(n)
    square = decay * decay
    same = [[(tokens[:, i] == marks[:, j]) & (tokens[:, i] != 0) for j in range(m)] for i in range(width)]
    for k in range(order):
        last = k == order - 1
        now = [[np.zeros(n)] * (m + 1)]
        for i in range(width):
            row, run = [np.zeros(n)], np.zeros(n)
            for j in range(m):
                hit = np.where(same[i][j], before[i][j] * (wide[i] * high[j]) if k else 1.0, 0.0)
                if last:
                    total += square * hit
                else:
                    run = decay * high[j] * run + square * hit
                    row.append(decay * wide[i] * now[i][j + 1] + run)
            now.append(row)
        before = now
    return total


def padded(pieces: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)


def _points(landmarks: list[bytes]) -> np.ndarray:
    """The landmarks' characters, a zero-padded row each."""
    names = [x.decode() for x in landmarks]
    width = max(map(len, names))
    return np.frombuffer("".join(x.ljust(width, "\0") for x in names).encode("utf-32-le"), np.uint32).reshape(len(names), width)


@functools.lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=4)
def _alphabets(landmarks: tuple[bytes, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each landmark its characters, its distinct ones, and the most that the normalised kernel can be with text that has only some of them.

    The bound is Cauchy's and Schwarz's: subsequences with a character that the text lacks add nothing."""
    out = []
    for row in _points(list(landmarks)):
        mark = row[row != 0]
        letters = np.unique(mark)
        has = (np.arange(1 << len(letters))[:, None] >> np.searchsorted(letters, mark)) & 1
        some = np.where(has, mark, 0)
        own = kernels(some, some)
        out.append((mark, letters, np.sqrt(own / own[-1])))
    return out


def _windows(bit: np.ndarray, at: np.ndarray, of: np.ndarray, size: int, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the letters in each window, from every letter on, that could be like the landmark; and which of them are in it. bit, at, of: the landmark's own letters in tokens, wherever they stand."""
    n = len(at)
    close = np.searchsorted(of, of, "right")
    have, reach, done = bit.copy(), 1, np.zeros(n, bool)
    # The larger windows leave room for more of the landmark's own letters: some, or one in each place.
    for most in sorted({size, size + INSERTED, 2 * size - 1}):
        for reach in range(reach, min(most, n)):
            have[: n - reach] |= np.where(close[: n - reach] > np.arange(reach, n), bit[reach:], 0)
        reach = most
        got = np.flatnonzero(~done & (bound[have] > LEAST))
        done |= np.arange(n) + most >= close
        for low in range(0, len(got), 100_000):
            part = got[low : low + 100_000]
            where = part[:, None] + np.arange(most)
            yield np.minimum(where, n - 1), where < close[part][:, None]


def _least_own(piece: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """A lower bound of each piece's own kernel: its neighbouring characters' subsequences, each with itself."""
    out = np.zeros(len(piece))
    for i in range(piece.shape[1] - ORDER + 1):
        span = ORDER + gaps[:, i + 1 : i + ORDER].sum(axis=1)
        out += np.where(piece[:, i + ORDER - 1] != 0, DECAY ** (2 * span), 0.0)
    return out


def likenesses(data: np.ndarray, start: np.ndarray, size: np.ndarray, landmarks: list[bytes], own: np.ndarray) -> np.ndarray:
    """(tokens, landmarks) likeness of tokens that are spans of data. The landmarks begin with the edge mark."""
    out = np.zeros((len(start), len(landmarks)))
    if not len(start) or not landmarks:
        return out
    # All tokens as characters, each behind a space.
    ends = np.cumsum(size + 1)
    inner = np.arange(ends[-1]) - np.repeat(ends - size - 1, size + 1)
    flat = np.where(inner > 0, data[np.maximum(np.repeat(start, size + 1) + inner - 1, 0)], 32).astype(np.uint8)
    text = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = text == 32
    of = np.cumsum(first) - 1
    word = _alnum()[text]
    odd = np.zeros(len(start), bool)
    odd[of[~word & ~first]] = True
    # Punctuation is passed over; beside that, it is an edge.
    views = [(np.where(first, EDGE[0], text)[word | first], of[word | first])]
    if odd.any():
        views.append((np.where(word, text, EDGE[0])[odd[of]], of[odd[of]]))
    for letter, token in views:
        for k, (mark, letters, bound) in enumerate(_alphabets(tuple(landmarks))):
            bit = np.zeros(len(letter), np.int64)
            for i, x in enumerate(letters):
                bit[letter == x] = 1 << i
            at = np.flatnonzero(bit)
            if not len(at):
                continue
            gap = np.diff(at, prepend=at[0] - 1) - 1
            for where, inside in _windows(bit[at], at, token[at], len(mark), bound):
                piece, gaps = np.where(inside, letter[at[where]], 0).astype(np.uint64), np.where(inside, gap[where], 0).astype(np.uint64)
                # Many windows are alike; each kind is compared once.
                _, kind, inverse = np.unique((piece * _ODD[: piece.shape[1]] + gaps * _ODD[-piece.shape[1] :]).sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)
                piece, gaps = piece[kind], gaps[kind]
                # A letter that is not the landmark's widens a gap, by less in the piece's own kernel.
                raw = kernels(piece, np.broadcast_to(mark, (len(piece), len(mark))), token_gaps=gaps)
                value = np.zeros(len(piece))
                able = np.flatnonzero(raw > LEAST * np.sqrt(_least_own(piece, gaps * OWN_GAPS) * own[k]))
                if len(able):
                    piece, gaps = piece[able], gaps[able] * OWN_GAPS
                    value[able] = raw[able] / np.sqrt(kernels(piece, piece, token_gaps=gaps, mark_gaps=gaps) * own[k])
                value = np.where(value > LEAST, np.minimum(1.0, value), 0.0) ** POWER
                np.maximum.at(out[:, k], token[at[where[:, 0]]], value[inverse])
    return out


_DROP = np.zeros(256, bool)
_DROP[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True


class Plain:
    """Hashes of the tokens that were found to be like no landmark, so that they need no second look. Bounded; only speed depends on it."""

    MOST = 1_000_000

    def __init__(self):
        self.held = np.zeros(0, np.uint64)

    def lacks(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.held, hashes)
        return (at == len(self.held)) | (self.held[np.minimum(at, len(self.held) - 1)] != hashes) if len(self.held) else np.ones(len(hashes), bool)

    def add(self, hashes: np.ndarray) -> None:
        self.held = np.sort(np.concatenate((self.held, hashes)) if len(self.held) + len(hashes) <= self.MOST else hashes)


def tokens(texts: pa.Array, landmarks: list[bytes], own: np.ndarray, plain: Plain | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct token of a text that is like any landmark: text number, likenesses, occurrences; and each text's words."""
    data, offsets = arrays.text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    # Of punctuation, one character stays for each place inside a token.
    place = np.flatnonzero(np.diff(np.concatenate(([False], _DROP[data], [False])).astype(np.int8)))
    low, high = place[::2], place[1::2]
    inner = (low > 0) & (high < len(data))
    low, high = low[inner], high[inner]
    inner = ~arrays._SPACE[data[low - 1]] & ~arrays._SPACE[data[high]] & (np.searchsorted(offsets, low - 1, "right") == np.searchsorted(offsets, high, "right"))
    keep = ~_DROP[data]
    keep[low[inner]] = True
    data = data.copy()
    data[low[inner]] = PUNCTUATION
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    data = data[keep]
    start, end, of = arrays.words(data, offsets)
    count = np.bincount(of, minlength=len(texts))
    if not len(start) or not landmarks:
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks))), np.zeros(0, np.int64), count
    single = end - start <= 1 + (data[start] >= 0xC0)
    if len(single) > 3 and (single[3:] & single[2:-1] & single[1:-2] & single[:-3]).any():
        # A run ends with its text.
        run = np.concatenate(([-1], np.where(single, of, -1), [-1]))
        edge = np.flatnonzero(np.diff(run))
        spans = [(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if single[a] and b - a >= 4]
        spelled = [b"".join(data[start[i] : end[i]].tobytes() for i in range(a, b)) for a, b in spans]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        first = len(data) + 1 + np.cumsum(size + 1) - size - 1
        of = np.concatenate((of, [of[a] for a, _ in spans])).astype(np.int64)
        data = np.concatenate((data, np.frombuffer(b" " + b" ".join(spelled), np.uint8)))
        start, end = np.concatenate((start, first)), np.concatenate((end, first + size))
    kind, first, inverse = np.unique(arrays.word_hashes(data, start, end), return_index=True, return_inverse=True)
    plain = plain or Plain()
    new = np.flatnonzero(plain.lacks(kind))
    like = np.zeros((len(kind), len(landmarks)))
    like[new] = likenesses(data, start[first[new]], (end - start)[first[new]], landmarks, own)
    plain.add(kind[new[~like[new].any(axis=1)]])
    hit = np.flatnonzero(like.any(axis=1)[inverse])
    pair, times = np.unique((of[hit] << 32) | inverse[hit], return_counts=True)
    return pair >> 32, like[pair & 0xFFFFFFFF], times, count


def _all_tokens(texts: list[str], landmarks: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``tokens``, a part of the texts at a time."""
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts, low = [], 0
    for part in minhash._slices(rows, "t"):
        of, *rest = tokens(part.column("t"), landmarks, own)
        parts.append((of + low, *rest))
        low += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def evidence(of: np.ndarray, margin: np.ndarray, times: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, TOP + 2): the highest margins of distinct tokens, how many are hits, and hits by the words of the text."""
    n = len(count)
    out = np.zeros((n, TOP + 2))
    hit = np.flatnonzero(margin > 0)
    of, margin, times = of[hit], margin[hit], times[hit]
    order = np.lexsort((-margin, of))
    of, margin, times = of[order], margin[order], times[order]
    distinct = np.bincount(of, minlength=n)
    place = np.arange(len(of)) - (np.cumsum(distinct) - distinct)[of]
    best = place < TOP
    out[of[best], place[best]] = np.minimum(margin[best], 1.0)
    out[:, TOP] = np.log1p(distinct)
    out[:, TOP + 1] = np.log((np.bincount(of, times, minlength=n) + 0.2) / (count + 20)) + 5
    return out


def _beginnings(text: str) -> set[str]:
    return {w[:k] for w in set(re.findall(r"\w{%d,}" % SHORTEST, text.lower())) for k in range(SHORTEST, min(len(w), LONGEST) + 1) if len(w[:k].encode()) >= LEAST_BYTES}


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[bytes]:
    """Word beginnings that cover the toxic texts and few clean ones, more clearly than the best of as many chance draws would."""
    bad, good = Counter(), Counter()
    for i in np.flatnonzero(toxic):
        bad.update(_beginnings(texts[i]))
    for i in np.flatnonzero(~toxic):
        good.update(w for w in _beginnings(texts[i]) if bad[w] >= LEAST_TEXTS)
    base = toxic.mean()
    odds = (1 - base) / base
    need = np.log(len(bad) / CHANCE)

    def able(w: str) -> bool:
        c, g = bad[w], good[w]
        if c < LEAST_TEXTS or c * odds < PURITY * (c * odds + g):
            return False
        p = c / (c + g)
        # Chernoff's bound on drawing so many toxic texts among c + g.
        return c * np.log(p / base) + (g * np.log((1 - p) / (1 - base)) if g else 0.0) >= need

    where: dict[str, set[int]] = {w: set() for w in bad if able(w)}
    for i in np.flatnonzero(toxic):
        for w in _beginnings(texts[i]) & where.keys():
            where[w].add(int(i))
    chosen = []
    while where and len(chosen) < LANDMARKS:
        best = max(where, key=lambda w: (len(where[w]), len(w), w))
        if len(where[best]) < LEAST_TEXTS:
            break
        # A longer beginning that covers nearly the same texts is the sharper landmark.
        best = max((w for w in where if w.startswith(best) and len(where[w]) >= 0.85 * len(where[best])), key=lambda w: (len(w), len(where[w]), w))
        chosen.append(best)
        same = where[best]
        where = {w: v for w, v in where.items() if not (w.startswith(best) or best.startswith(w) and len(v - same) < LEAST_TEXTS)}
    return [EDGE + w.encode() for w in chosen]


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes weighed evenly, by Newton steps."""
    z = np.hstack((x, np.ones((len(x), 1))))
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.diag(np.append(np.full(x.shape[1], RIDGE), 1e-6))
    for _ in range(50):
        active = y * (z @ w) < 1
        a = z[active] * c[active, None]
        new = np.linalg.solve(ridge + a.T @ z[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _disguised(text: str, landmarks: list[str], rng: np.random.Generator) -> str:
    """The text with one character of each word that begins like a landmark doubled by another, left out, or masked."""

    def put(m: re.Match) -> str:
        w = m[0]
        if not any(w.lower().startswith(x) for x in landmarks):
            return w
        way, i = rng.integers(3), int(rng.integers(1, min(len(w), SHORTEST + 2)))
        mark = str(rng.choice(list(".-*aeoxqz")))
        return w[:i] + (mark if way == 0 else "*" if way == 1 else "") + w[i + (way > 0) :]

    return re.sub(r"\w{%d,}" % SHORTEST, put, text)


def distinct(texts: list[str]) -> list[int]:
    """Numbers of the texts that are no near copy of an earlier one, so that groups of copies count once."""
    seen, kept = set(), []
    for low in range(0, len(texts), 256):
        part = pa.array(texts[low : low + 256])
        _, _, (of, shingle, weight) = minhash._elements(part)
        keys = minhash.bands(minhash.signatures(of, shingle, weight, len(part)), minhash.REGISTERS // 2)
        for i, row in enumerate(keys.tolist()):
            if seen.isdisjoint(row):
                kept.append(low + i)
            seen.update(row)
    return kept


def fit(texts: list[str], labels: list[int], shift: float = 0.0) -> Model:
    """shift: what a text's log odds of being toxic are among all labels beyond those in the sample."""
    kept = distinct(texts)
    texts, toxic = [texts[i] for i in kept], np.array([labels[i] for i in kept], bool)
    landmarks = choose_landmarks(texts, toxic) if toxic.any() and not toxic.all() else []
    if not landmarks:
        return Model([], np.ones(0), np.zeros(0), -1.0, np.append(np.zeros(TOP + 2), -50.0))
    marks = _points(landmarks)
    own = kernels(marks, marks)
    n = len(landmarks)
    a, b = np.divmod(np.arange(n * n), n)
    gram = np.minimum(1.0, (kernels(marks[a], marks[b]) / np.sqrt(own[a] * own[b])).reshape(n, n)) ** POWER
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    useful = values > 1e-6
    nystrom = vectors[:, useful] / np.sqrt(values[useful])
    rng = np.random.default_rng(7)
    names = [x[len(EDGE) :].decode() for x in landmarks]
    more = [_disguised(t, names, rng) for t, y in zip(texts, toxic, strict=True) if y]
    of, like, times, count = _all_tokens(texts + more, landmarks, own)
    truth = np.concatenate((toxic, np.ones(len(more), bool)))
    total = len(truth)
    margin = like.max(axis=1) if len(like) else np.zeros(0)
    weights, bias = np.zeros(n), -1.0
    blank = max(1, total // 10)
    for k in range(ROUNDS):
        top = np.full(total, -np.inf)
        np.maximum.at(top, of, margin)
        witness = margin >= np.minimum(top[of], np.inf if k == 0 else 0.0) - 1e-9
        use = ~truth[of] | witness
        x = np.vstack((like[use] @ nystrom, np.zeros((blank, nystrom.shape[1]))))
        y = np.concatenate((np.where(truth[of[use]], 1.0, -1.0), -np.ones(blank)))
        w, bias = _machine(x, y)
        weights = nystrom @ w
        margin = like @ weights + bias
    # Disguised copies would make toxic texts look more common than they are.
    link = _logistic(evidence(of, margin, times, count)[: len(texts)], toxic)
    link[-1] += shift
    return Model(landmarks, own, weights, bias, link)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (offset last) of a logistic link with Platt's smoothed targets."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    z, w = np.hstack((x, np.ones((len(x), 1)))), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], 0.1), 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - target) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_batch(texts: pa.Array, model: Model, plain: Plain | None = None) -> np.ndarray:
    of, like, times, count = tokens(texts, model.landmarks, model.own, plain)
    x = evidence(of, like @ model.weights + model.bias, times, count)
    return 1 / (1 + np.exp(-np.clip(x @ model.link[:-1] + model.link[-1], -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded, hash-drawn sample of the labelled texts."""
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    marked = table(marked, "toxic-labels")
    count = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = {y: min(1.0, most / max(1, count.get(y, 0))) for y, most in ((0, TRAIN_CLEAN), (1, TRAIN_TOXIC))}
    share = F.when(F.col("y") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    drawn = marked.filter(hash_unit("toxic", F.col("k")) < share)  # about TRAIN_CLEAN + TRAIN_TOXIC rows: safe to broadcast
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL")
    sample = sorted(rows.join(F.broadcast(drawn), "k").select("k", "t", "y").collect())
    return fit([r.t for r in sample], [r.y for r in sample], float(np.log(shares[0] / shares[1])))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Plain()
        for whole in batches:
            for batch in minhash._slices(whole, "t"):
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(score_batch(batch.column("t"), held.value, plain))], names=["k", "score"])

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, score double")
    return out.select(F.col("k").alias(key), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
