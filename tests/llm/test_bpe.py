import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from weftgraph.llm import arrays, bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_query_against_library(spark, sf, reference):
    rows = {r.doc_id: r for r in queries.op10_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, r = reference.encode_ordinary(d.text or ""), rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((d.text or "").encode()))


def coded(coder, pieces):
    """The queries' ids and decoded bytes of distinct pieces, in order."""
    got = {r["piece"]: ([int(x) for x in r["ids"].split()], r["n"], r["decoded"]) for r in coder.code_pieces(pa.array(pieces, pa.large_string())).to_pylist()}
    return [got[x] for x in pieces]


def test_texts_of_one_coder(ranks, reference):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdeéß漢 <|", k=rng.randrange(1, 120))) for _ in range(300)] + ["", "a" * 400, "<|endoftext|>", "\x00\x01", "ﬀ", " " * 90, "́" * 20, ""]
    coder = bpe.Coder(ranks, PATTERN)
    for text, (ids, n, decoded) in zip(texts, coder.texts(texts), strict=True):
        want = reference.encode_ordinary(text)
        assert [int(x) for x in bytes(ids).split()] == want and n == len(want) and decoded == text.encode()


@pytest.mark.parametrize("rows", [1, 400, bpe.SQL_ROWS])
def test_both_forms_of_the_query(ranks, reference, monkeypatch, rows):
    """Few rows a query end the first form early; the second does the rest."""
    monkeypatch.setattr(bpe, "SQL_ROWS", rows)
    rng = random.Random(rows)
    pieces = list({"".join(rng.choices("abcdeéß漢", k=rng.randrange(1, 90))) for _ in range(150)} | {"".join(rng.choices(["the", "and", "tion", "ing"], k=rng.randrange(1, 30))) for _ in range(150)} | {"a" * k for k in range(1, 40)})
    for x, (ids, n, decoded) in zip(pieces, coded(bpe.Coder(ranks, PATTERN), pieces), strict=True):
        assert ids == reference._encode_single_piece(x.encode()) and n == len(ids) and decoded == x.encode()


@pytest.mark.parametrize("letters, size", [("a", 100_000), ("ab", 100_000), (["the", "tion", "qu"], 25_000), ("abcdefghijklmnopqrstuvwxyz", 8000)])
def test_long_pieces(ranks, reference, letters, size):
    piece = "".join(random.Random(3).choices(letters, k=size))
    ids, _, decoded = coded(bpe.Coder(ranks, PATTERN), [piece])[0]
    assert ids == reference._encode_single_piece(piece.encode()) and decoded == piece.encode()


def test_other_vocabularies():
    """Over 65,536 tokens, ranks in no order of growth: merged tokens make pairs of lower rank."""
    rng = random.Random(11)
    tokens = {"".join(rng.choices("abc", k=k)).encode() for k in (2, 3, 4, 5) for _ in range(60)}
    tokens |= {b"".join(rng.choices([b"x", b"yz", b"q"], k=rng.randrange(2, 16))) for _ in range(160_000)}
    order = [bytes([b]) for b in range(256)] + rng.sample(sorted(tokens), len(tokens))
    ranks = {t: i for i, t in enumerate(order)}
    assert len(ranks) > 66_000
    library = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = list({"".join(rng.choices("abcxyzq", k=rng.randrange(1, 60))) for _ in range(400)} | {"abc" * 40, "yzx" * 50})
    for rows in (bpe.SQL_ROWS, 1):
        bpe.SQL_ROWS, was = rows, bpe.SQL_ROWS
        try:
            got = coded(bpe.Coder(ranks, PATTERN), pieces)
        finally:
            bpe.SQL_ROWS = was
        assert [ids for ids, _, _ in got] == [library._encode_single_piece(x.encode()) for x in pieces]


def test_whole_pieces_are_their_own_token(reference):
    """A token that no merges reach is still found, as in the library."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b" abc": 257}
    library = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "abc abc abcd abc"
    (ids, n, decoded), = bpe.Coder(ranks, PATTERN).texts([text])
    assert [int(x) for x in bytes(ids).split()] == library.encode_ordinary(text) and n == len(library.encode_ordinary(text)) and decoded == text.encode()


@pytest.mark.parametrize("bound", [0, 5, 40])
def test_small_memo(ranks, reference, monkeypatch, bound):
    """The memo's bound never changes a result."""
    monkeypatch.setattr(bpe, "MEMO_PIECES", bound)
    monkeypatch.setattr(bpe, "RUN_CHARS", 40)
    monkeypatch.setattr(bpe, "SQL_BYTES", 20)
    texts = [f"alphax betaq {k} gammaz deltaw{k % 3}" for k in range(30)]
    coder = bpe.Coder(ranks, PATTERN)
    assert [[int(x) for x in bytes(ids).split()] for ids, _, _ in coder.texts(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert coder.known.num_rows < coder.own.num_rows + bound + 60


def test_equal_hashes_are_told_apart(ranks, reference, monkeypatch):
    """Hashes only propose a piece; with very few of them results stay right."""
    few = bpe._hashes
    monkeypatch.setattr(bpe, "_hashes", lambda pieces: few(pieces) % np.uint64(7))
    monkeypatch.setattr(bpe, "RUN_CHARS", 60)
    texts = [f"alphax betaq {k} gammaz deltaw{k % 3} Zürich" for k in range(12)] + ["", "a"]
    got = [[int(x) for x in bytes(ids).split()] for ids, _, _ in bpe.Coder(ranks, PATTERN).texts(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_coders_are_known_by_content(ranks):
    less = dict(ranks)
    less[b" zq"], less[b" zx"] = len(ranks), len(ranks) + 1
    more = dict(ranks)
    more[b" zx"], more[b" zq"] = len(ranks), len(ranks) + 1
    assert len({bpe.digest(x) for x in (ranks, less, more)}) == 3


def test_other_operators_drop_the_coder(ranks):
    bpe._coder("n", ranks, PATTERN)

    def own(batches):
        yield from batches

    own.__module__ = bpe.__name__
    assert list(arrays.tidy(own)(iter([1]))) == [1] and len(bpe._coders) == 1
    own.__module__ = "another"
    assert list(arrays.tidy(own)(iter([1]))) == [1] and not bpe._coders
    assert bpe._coder("n", ranks, PATTERN) is bpe._coder("n", ranks, PATTERN)


def test_odd_rows(odd, none, reference):
    rows = bpe.encode(odd, PATH, PATTERN, outputs=True).collect()
    want = sorted((repr(r.doc_id), sha((r.text or "").encode()), len(reference.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert sorted((repr(r.doc_id), r.decoded_sha256, r.n_tokens) for r in rows) == want
    assert all(reference.decode(r.ids) == r.decoded for r in rows)
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert all(r.n_tokens == 0 and r.ids_sha256 == sha(b"") and r.ids == [] for r in empty)
    assert bpe.encode(none, PATH, PATTERN).count() == 0
