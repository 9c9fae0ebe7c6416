"""Plain versions of the operators, for small inputs: loops, dictionaries, exact arithmetic."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from weftgraph.llm import language

SPACE = " \t\n\x0b\f\r"


def words(text: str | None) -> list[str]:
    return [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]


def shingles(text: str | None, k: int = 5) -> Counter:
    """Weighted k-word shingles; a shorter text has one."""
    w = words((text or "").lower())
    return Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def likeness(a: Counter, b: Counter) -> Fraction:
    """Probability Jaccard from its definition."""
    total = Fraction(0)
    for i in a.keys() & b.keys():
        total += 1 / sum(max(Fraction(a[j], a[i]), Fraction(b[j], b[i])) for j in a.keys() | b.keys())
    return total


def fast_likeness(a: Counter, b: Counter) -> float:
    names = list(a.keys() | b.keys())
    x, y = np.array([a[n] for n in names], float), np.array([b[n] for n in names], float)
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))


def classes(texts: dict[int, str | None], threshold: float = 0.8) -> dict[int, int]:
    """Smallest key of each connected component, over every pair that shares a shingle."""
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sh = {k: shingles(t) for k, t in texts.items()}
    holders = defaultdict(list)
    for k, s in sh.items():
        for x in s:
            holders[x].append(k)
    seen = set()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if min(sum(sh[a].values()), sum(sh[b].values())) >= 0.5 * max(sum(sh[a].values()), sum(sh[b].values())) or sh[a].keys() == sh[b].keys():
                        if fast_likeness(sh[a], sh[b]) >= threshold - 1e-12:
                            x, y = find(a), find(b)
                            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def profile(text: str) -> np.ndarray:
    """Hyperdimensional profile by one loop over n-grams."""
    out, n = np.zeros(language.DIMENSIONS), language.GRAM
    kept = []
    for c in text.lower():
        p = ord(c) if c.isalpha() else 0
        if p or not kept or kept[-1]:
            kept.append(p)
    for gram, count in Counter(tuple(kept[i : i + n]) for i in range(len(kept) - n + 1)).items():
        bound = np.ones(language.DIMENSIONS)
        for j, p in enumerate(gram):
            bound *= np.roll(language.letter(p), n - 1 - j)
        out += count * bound
    return out


def rolling_minima(values: list[int], window: int) -> list[int]:
    """Positions picked by windows: the rightmost minimum of each."""
    if not values:
        return []
    spans = [(i, i + window) for i in range(len(values) - window + 1)] or [(0, len(values))]
    return sorted({max(i for i in range(a, b) if values[i] == min(values[a:b])) for a, b in spans})


def kernel(s: str, t: str, order: int, decay: float) -> float:
    """Gap-weighted subsequence kernel by enumeration of index tuples."""
    from itertools import combinations

    def spans(x):
        out = defaultdict(float)
        for at in combinations(range(len(x)), order):
            out["".join(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def gapped_kernel(a: list[tuple[str, float]], b: list[tuple[str, float]], order: int, decay: float) -> float:
    """The gap-weighted subsequence kernel by enumeration. a, b: (character, place) lists."""
    spans: dict[str, list[list[float]]] = defaultdict(lambda: [[], []])
    for side, s in enumerate((a, b)):
        for at in itertools.combinations(range(len(s)), order):
            spans["".join(s[i][0] for i in at)][side].append(s[at[-1]][1] - s[at[0]][1] + 1)
    return sum(decay ** (x + y) for one, two in spans.values() for x in one for y in two)


def toxic_tokens(text: str | None) -> tuple[Counter, int]:
    """Tokens as toxicity compares them, with their occurrences; and the text's words."""
    drop = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    inner = "".join(c for c in drop if c not in "\\]^-[")
    mark = re.compile(rf"[{re.escape(inner)}\\\]\[^-]+")
    found = [mark.sub(".", w.strip(drop)) for w in words((text or "").lower())]
    found = [w for w in found if w]
    out = Counter(found)
    single = [len(w.encode()) <= 1 + (w.encode()[0] >= 0xC0) for w in found]
    for yes, run in itertools.groupby(range(len(found)), lambda i: single[i]):
        run = list(run)
        if yes and len(run) >= 4:
            out["".join(found[i] for i in run)] += 1
    return out, len(found)


def toxic_likeness(token: str, landmark: str, t) -> float:
    """Of a token to a landmark that begins with the edge mark: the best window of the landmark's own letters, in either view."""
    views = ["^" + "".join(c for c in token if c.isalnum())]
    if not all(c.isalnum() for c in token):
        views.append("^" + "".join(c if c.isalnum() else "^" for c in token))
    m, best = len(landmark), 0.0
    whole = [(c, i) for i, c in enumerate(landmark)]
    own = gapped_kernel(whole, whole, t.ORDER, t.DECAY)
    for view in views:
        at = [i for i, c in enumerate(view) if c in landmark]
        for low in range(len(at)):
            for size in {m, m + t.INSERTED, 2 * m - 1}:
                part = at[low : low + size]
                if len(part) < t.ORDER:
                    continue
                piece = [(view[i], float(i)) for i in part]
                tight = [(view[i], sum(1 + (part[k] - part[k - 1] - 1) * t.OWN_GAPS for k in range(1, n + 1))) for n, i in enumerate(part)]
                self = gapped_kernel(tight, tight, t.ORDER, t.DECAY)
                value = gapped_kernel(piece, whole, t.ORDER, t.DECAY) / np.sqrt(self * own) if self else 0.0
                if value > t.LEAST:
                    best = max(best, min(1.0, value) ** t.POWER)
    return best


def toxic_score(text: str | None, model, t, memo: dict) -> float:
    """A text's score under a fitted model."""
    counts, n = toxic_tokens(text)
    hits = []
    for token, times in counts.items():
        if token not in memo:
            like = [toxic_likeness(token, x.decode(), t) for x in model.landmarks]
            memo[token] = float(np.dot(like, model.weights) + model.bias) if any(like) else -1.0
        if memo[token] > 0:
            hits.append((memo[token], times))
    top = sorted((min(m, 1.0) for m, _ in hits), reverse=True)[: t.TOP]
    x = [*top, *[0.0] * (t.TOP - len(top)), np.log1p(len(hits)), np.log((sum(k for _, k in hits) + 0.2) / (n + 20)) + 5]
    return float(1 / (1 + np.exp(-(np.dot(x, model.link[:-1]) + model.link[-1]))))
