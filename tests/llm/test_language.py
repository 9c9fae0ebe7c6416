import brute
import numpy as np
import pytest

from weftgraph.llm import language, queries


def test_profiles_against_plain_loop():
    texts = ["", "a", "Straße und Wald, 12 Bäume", "hello  --  hello world", "漢字かな", " x "]
    got = language.profiles(texts)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, brute.profile(text), atol=1e-3)


def test_letters_are_nearly_orthogonal():
    a, b = language.letter(ord("a")), language.letter(ord("b"))
    assert abs(a @ b) / language.DIMENSIONS < 0.15 and set(np.unique(a)) == {-1.0, 1.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op2_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id]]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows)
    assert len(rows) > 150 and right / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_query_predicts_as_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    assert len(rows) == docs.count()
    names, prototypes = language.learn(docs.filter(~language.held_out(docs.doc_id)))
    for r in docs.collect()[:60]:
        p = brute.profile(f" {r.text or ''} ")
        if not any(map(str.isalpha, r.text or "")):
            assert (rows[r.doc_id].lang_pred, rows[r.doc_id].score) == ("und", 0.0)
            continue
        cos = prototypes @ (p / np.linalg.norm(p))
        assert rows[r.doc_id].lang_pred == names[int(cos.argmax())]
        assert rows[r.doc_id].score == pytest.approx(1 / np.exp(language.SHARPNESS * (cos - cos.max())).sum(), abs=1e-3)


def test_odd_rows(odd, none):
    model = language.learn(odd)
    assert model[0] == ["de", "en"]
    rows = language.identify(odd, *model).select("_doc.*", "_doc", "score").collect() if False else language.identify(odd, *model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not any(map(str.isalpha, r._doc.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model[0] and 0 < r.score <= 1
    assert language.identify(none, *model).count() == 0
    empty = language.learn(none)
    assert empty[0] == [] and {r.lang_pred for r in language.identify(odd, *empty).collect()} == {"und"}
