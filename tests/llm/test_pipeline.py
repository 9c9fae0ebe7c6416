"""The corpus pipeline against plain versions of its stages, each on its own input."""

import hashlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import connect

import corpus_pipeline as cp
from weftgraph.llm import bpe, common, language, mixing, oracles


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input of each stage and the last one's result."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append(docs)
        docs = common.table(stage(spark, docs, sf), f"test-{name}")
    return [*out, docs]


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_language_stage(steps):
    before, after = steps[0], steps[1]
    names, prototypes = language.learn(before)
    want = Counter()
    for r in before.collect():
        if any(map(str.isalpha, r.text or "")):
            p = brute.profile(f" {r.text} ")
            cos = prototypes @ (p / np.linalg.norm(p))
            if 1 / np.exp(language.SHARPNESS * (cos - cos.max())).sum() >= cp.MIN_LANGUAGE_SCORE:
                want[(r.doc_id, r.text, names[int(cos.argmax())], r.source, r.n_chars)] += 1
    assert after.columns == before.columns and rows(after) == want


def test_quality_stage(steps):
    con = connect("/nowhere")
    con.register("_t", steps[1].toArrow())
    con.execute("CREATE TABLE documents AS SELECT * FROM _t")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({oracles.oracle_sql()['op8_quality_rules']}) WHERE kept").fetchall()}
    after = steps[2].collect()
    assert steps[2].columns == steps[1].columns and {r.doc_id for r in after} == kept
    before = {r.doc_id: r.text for r in steps[1].collect()}
    assert all(set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) and r.n_chars == len(r.text) for r in after)


def test_duplicate_stage(steps):
    want = brute.classes({r.doc_id: r.text for r in steps[2].collect()})
    assert steps[3].columns == steps[2].columns
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({*want.values()})
    assert rows(steps[3]) <= rows(steps[2])


def test_mixing_stage(steps):
    before = steps[3].collect()
    size = {r.doc_id: len(brute.words(r.text)) for r in before}
    per = Counter()
    for r in before:
        per[r.source] += size[r.doc_id]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = {}, 1.5 * sum(per.values()), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * per[s]}
        for s in over or open_:
            target[s] = 2.0 * per[s] if over else weight[s] * level
        rest -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    want = Counter()
    for r in before:
        rate = target[r.source] / per[r.source] if per[r.source] else 0
        draw = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        if n := int(rate) + (draw < rate - int(rate)):
            want[tuple(r)] += n
    assert steps[4].columns == steps[3].columns and rows(steps[4]) == want


def test_coding_stage(steps):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in steps[4].collect():
        ids = library.encode_ordinary(r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert rows(steps[5]) == want


def test_run(spark, sf, steps):
    assert rows(cp.run(spark, sf)) == rows(steps[5])


def test_odd_documents(spark, odd, tmp_path):
    for folder, docs in (("a", odd), ("b", odd.limit(0))):
        docs.write.parquet(str(tmp_path / folder / "documents.parquet"))
        out = cp.run(spark, str(tmp_path / folder))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if folder == "b":
            assert out.count() == 0
        held = docs
        for _, stage in cp.STAGES[:-1]:
            held = common.table(stage(spark, held, str(tmp_path / folder)), "odd-stage")
            assert held.columns == docs.columns
