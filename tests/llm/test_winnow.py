import hashlib
import random

import brute
import numpy as np

from weftgraph.llm import arrays, winnow


def gram_hashes(text, gram):
    """Hash of each gram from the same polynomial, computed gram by gram."""
    points = [ord(c) for c in text]
    if not points:
        return []
    length, out = min(gram, len(points)), []
    for i in range(len(points) - length + 1):
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for j, p in enumerate(points[i : i + length]):
                total += arrays.mixed(np.array([p], np.uint64))[0] * arrays.powers(winnow._BASE, j + 1)[j]
        out.append(int(arrays.mixed(np.array([total], np.uint64))[0] >> np.uint64(winnow._PLACE)))
    return out


def test_selection_against_plain_windows():
    rng = random.Random(1)
    texts = ["", "a", "short text", "x" * 80, "".join(rng.choice("ab") for _ in range(300)), "größer 漢字 \U0001f600 " * 9, "".join(rng.choice("abcdefg ") for _ in range(500))]
    for (hashes, places), text in zip(winnow.fingerprints(texts, 8, 4), texts, strict=True):
        plain = gram_hashes(text, 8)
        assert places.tolist() == brute.rolling_minima(plain, 4)
        assert hashes.tolist() == [plain[i] for i in places]


def test_guarantee():
    """Any shared run of GRAM + WINDOW - 1 code points shares a selected hash, at matching places."""
    rng = random.Random(2)
    need = winnow.GRAM + winnow.WINDOW - 1
    for _ in range(50):
        shared = "".join(rng.choice("abcdefghij ") for _ in range(need))
        a, b = ("".join(rng.choice("klmnopqrst ") for _ in range(rng.randrange(80))) for _ in range(2))
        (ha, pa), (hb, pb) = winnow.fingerprints([a + shared + b, b + shared + a])
        common = set(ha.tolist()) & set(hb.tolist())
        assert common
        assert any(p - len(a) == q - len(b) for p, h in zip(pa, ha, strict=True) for q, g in zip(pb, hb, strict=True) if h == g)


def test_long_texts_are_cut_alike():
    text = "".join(random.Random(3).choices("abcdefgh ", k=30_000))
    whole, parts = winnow.fingerprints([text])[0], winnow._long(text, winnow.GRAM, winnow.WINDOW)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def expected(rows):
    """rows (id, text) -> by (id, n_chars): edited digest and likenesses, from the definition."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        (h, _), (e, _), (n, _) = winnow.fingerprints([t, edited, after])
        jaccard = lambda a, b: 1.0 if not len(a) and not len(b) else len({*a.tolist()} & {*b.tolist()}) / len({*a.tolist()} | {*b.tolist()})
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(h, e), 9), round(jaccard(h, n), 9)))
    return sorted(out, key=repr)


def test_query_against_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    rows = winnow.compare(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=repr) == want
    marks = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert marks.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_ranges_meet(spark, monkeypatch):
    """Many small ranges: each one's last row has the next one's first as successor."""
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 7)
    rows = [(k * 3 % 101, f"text number {k} " * (k % 5)) for k in range(101)]
    got = winnow.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == expected(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = winnow.compare(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == expected(rows)
    assert winnow.compare(none).count() == 0
    alone = winnow.compare(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    full = winnow.compare(odd, outputs=True).filter("doc_id = 9").first()
    assert len(full.hashes) == len(full.positions) > 0
