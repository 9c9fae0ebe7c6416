import random
import tracemalloc
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import arrays, common, minhash


def signed(texts):
    _, _, (of, shingle, weight) = minhash._elements(pa.array(texts))
    return minhash.signatures(of, shingle, weight, len(texts), 2048)


def elements(text):
    _, _, (_, shingle, weight) = minhash._elements(pa.array([text]))
    return shingle, weight


def variant(rng, base, share):
    return [f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


def test_likeness_is_probability_jaccard():
    rng = random.Random(3)
    for _ in range(20):
        a = [rng.choice("abcd") for _ in range(rng.randrange(5, 40))]
        b = variant(rng, a, 0.05) + [rng.choice("abcd") for _ in range(rng.randrange(5))]
        a, b = " ".join(a), " ".join(b)
        want = float(brute.likeness(brute.shingles(a), brute.shingles(b)))
        assert minhash.likeness(elements(a), elements(b)) == pytest.approx(want, abs=1e-9)
    assert brute.likeness(brute.shingles("a b c d e"), brute.shingles("a b c d e")) == Fraction(1)


def test_registers_agree_with_likeness():
    rng = random.Random(4)
    base = [f"w{rng.randrange(60)}" for _ in range(300)]
    texts = [" ".join(base), " ".join(variant(rng, base, 0.01)), " ".join(variant(rng, base, 0.05)), " ".join(base * 2)]
    marks = signed(texts)
    for i in (1, 2, 3):
        want = brute.fast_likeness(brute.shingles(texts[0]), brute.shingles(texts[i]))
        assert np.mean(marks[0] == marks[i]) == pytest.approx(want, abs=0.05)
    assert (marks != 0).all()


def test_scaled_weights_give_equal_signatures():
    of, shingle, weight = np.array([0, 0, 1, 1]), np.array([5, 9, 5, 9], np.uint64), np.array([1, 2, 10, 20])
    assert (lambda m: (m[0] == m[1]).all())(minhash.signatures(of, shingle, weight, 2))


def test_classes_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute.classes({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == want and len(set(got.values())) < len(got)


def test_groups_of_copies_and_chains(spark):
    """A large group of exact copies, one of near copies, and texts that share all bands with neither."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 700):
        other = list(base)
        other[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(other)))
    rows += [(1000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(150))) for k in range(50)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(700)) and all(got[1000 + k] == 1000 + k for k in range(50))


@pytest.mark.parametrize("words, cut", [(2_000_000, 1024), (1500, 1024), (1500, 5)])
def test_open_buckets_lose_no_link(spark, monkeypatch, words, cut):
    """Texts of one bucket that are like each other but not like its hub."""
    monkeypatch.setattr(minhash, "BLOCK_WORDS", words)
    monkeypatch.setattr(minhash, "SLICE", cut)
    rng = random.Random(2)
    texts = {}
    for g in range(6):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(120)]
        for k in range(12):
            other = list(base)
            other[rng.randrange(120)] = f"y{g}{k}"
            texts[100 * g + k] = " ".join(other)
    held = spark.createDataFrame([(7, k, k, 0, 120) for k in texts], "band long, a long, comp long, main long, words long")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = [(r.a, r.hub) for r in minhash.block_links(held, docs, "doc_id", "text").collect()]
    root = {k: k for k in texts}
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    want = brute.classes(texts)
    assert {k: v for k, v in root.items() if want[k] >= 100} == {k: v for k, v in want.items() if v >= 100}


def test_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.class_id, r.kept))
    assert got[None] == {(None, True)} and got[1] == {(1, True)} and got[2] == {(2, True)} and got[3] == {(3, True)}
    assert got[4] == {(4, True)} and got[5] == {(4, False)} and got[6] == {(6, True)} and (6, False) in got[7] and got[9] == {(9, True)}
    assert minhash.near_duplicates(none).count() == 0
    left = minhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.filter("doc_id IS NOT NULL").select("doc_id").collect()) == [1, 2, 3, 4, 6, 8, 9]
    assert left.filter("doc_id IS NULL").count() == 2 and minhash.deduplicated(none).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, hub long")
    assert {r.id: r.comp for r in minhash.components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert minhash.components(edges.limit(0)).count() == 0


def test_words_match_plain_split():
    texts = ["a  b\tc\x0bd\fe\r\nf", "", " x ", "é ü zz", "漢字 かな"]
    data, offsets = arrays.text_bytes(pa.array(texts))
    start, end, of = arrays.words(data, offsets)
    got = [[] for _ in texts]
    for s, e, o in zip(start, end, of, strict=True):
        got[o].append(data[s:e].tobytes().decode())
    assert got == [brute.words(t) for t in texts]
    hashes = arrays.word_hashes(data, start, end)
    by_word = {}
    for s, e, h in zip(start, end, hashes, strict=True):
        assert by_word.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_nothing_depends_on_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a = {tuple(r) for r in minhash.near_duplicates(docs).collect()}
    b = {tuple(r) for r in minhash.near_duplicates(docs.repartition(7, F.rand(1))).collect()}
    assert a == b and common.scratch(spark)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_word_hashes_do_not_depend_on_blocks(monkeypatch, block):
    """Words within, across and over several blocks, and empty ones, against a plain polynomial."""
    monkeypatch.setattr(arrays, "HASH_BYTES", block)
    texts = ["ab abc  x", "", "y" * 300, "é 漢字 " * 40, ""]
    data, offsets = arrays.text_bytes(pa.array(texts))
    start, end, _ = arrays.words(data, offsets)
    for low, high in ((start, end), (offsets[:-1], offsets[1:])):
        plain = [(sum(int(arrays._BYTE[b]) * pow(arrays._BASE, i, 1 << 64) for i, b in enumerate(data[s:e])) + int(e - s)) % (1 << 64) for s, e in zip(low, high, strict=True)]
        assert (arrays.word_hashes(data, low, high) == arrays.mixed(np.array(plain, np.uint64))).all()
    assert not len(arrays.word_hashes(data[:0], start[:0], end[:0]))


def test_long_texts_are_hashed_in_little_memory():
    """A text's hashing takes memory for its words, not some 50 times its bytes."""
    data, offsets = arrays.text_bytes(pa.array(["consectetur incididunt " * 350_000]))
    start, end, _ = arrays.words(data, offsets)
    arrays._powers.clear()
    tracemalloc.start()
    arrays.word_hashes(data, start, end)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * len(data)
