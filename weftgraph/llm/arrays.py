"""Vectorised text primitives over Arrow batches: words, hashes, shingles. No Python loop runs over words or characters."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes whose hashes are summed at once: working memory takes some 50 times as many.
HASH_BYTES = 1 << 16


#: What modules keep in a worker between tasks: module name -> a function that drops it.
caches: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what other modules keep dropped before it and free memory given back after it: workers outlive their stage."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in caches.items():
            if name != run.__module__:
                drop()
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            give_back()

    return tidied


def give_back() -> None:
    """Returns free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept and grown within a task."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; nulls count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the n + 1 offsets."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a text's edge ends a word."""
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], full[:-1])) & ~edge[:-1]
    after = np.concatenate((full[1:], [False])) & ~edge[1:]
    start, end = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running polynomial over all bytes, ``HASH_BYTES`` of them at a time. start and end ascend."""
    first, last, back = (np.zeros(len(start), np.uint64) for _ in range(3))
    carry = np.uint64(0)
    for low in range(0, max(len(data), 1), HASH_BYTES):
        part = _BYTE[data[low : low + HASH_BYTES]]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = carry
        part *= powers(_BASE, len(part))
        part *= np.uint64(pow(_BASE, low, 1 << 64))
        np.cumsum(part, out=total[1:])
        total[1:] += carry
        carry = total[-1]
        # A word's edge between two blocks is in both, with equal values.
        i, j = np.searchsorted(start, low), np.searchsorted(start, low + len(part), "right")
        at = start[i:j] - low
        first[i:j], back[i:j] = total[at], powers(_BACK, len(part) + 1)[at] * np.uint64(pow(_BACK, low, 1 << 64))
        i, j = np.searchsorted(end, low), np.searchsorted(end, low + len(part), "right")
        last[i:j] = total[end[i:j] - low]
    last -= first
    last *= back
    last += (end - start).astype(np.uint64)
    return mixed(last)


def runs(hashes: np.ndarray, of: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their text numbers; a text of 1 to k - 1 words has one shingle, of all of them."""
    count = np.bincount(of, minlength=n)
    if len(hashes) >= k:
        at = np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :])
        made = np.zeros(len(at), np.uint64)
        for j in range(k):
            made = made * _ODD + hashes[at + j]
        where = of[at]
    else:
        made, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = count[short] > j
            whole[there] = whole[there] * _ODD + hashes[first[short][there] + j]
        made, where = np.concatenate((made, whole + np.uint64(1))), np.concatenate((where, short))
    return mixed(made), where


def weighted(made: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, 48-bit shingle) pairs in order, with their counts: text numbers, shingles, weights. At most 65,536 texts."""
    key = np.sort((where.astype(np.uint64) << np.uint64(48)) | (made >> np.uint64(16)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), np.diff(np.append(first, len(where)))


def sequence_hashes(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence; together they stand for the sequence."""
    count = np.bincount(of, minlength=n)
    at = np.arange(len(of)) - (np.cumsum(count) - count)[of] if len(of) else np.zeros(0, np.int64)
    top = int(count.max(initial=0))
    out = []
    for base, salt in ((0xA0761D6478BD642F, 0), (0xE7037ED1A0B428DB, 77)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + np.uint64(salt)) * powers(base, top)[at], dtype=np.uint64)))
        ends = np.cumsum(count)
        out.append(mixed(total[ends] - total[ends - count] + count.astype(np.uint64)))
    return out[0], out[1]
