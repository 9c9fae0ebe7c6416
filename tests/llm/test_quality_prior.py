import brute
import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import quality_prior, queries


def test_features_of_small_texts():
    texts = ["", "Hello world!", "a a a a a a", "line\nline\nother", "100% #1 | x", None]
    got = quality_prior.features(pa.array(texts))
    at = {n: i for i, n in enumerate(quality_prior.FEATURES)}
    assert got.shape == (6, len(at)) and np.isfinite(got).all() and (got[0] == 0).all() and (got[5] == 0).all()
    assert got[1, at["capitals"]] == pytest.approx(np.sqrt(1 / 11)) and got[1, at["shouts"]] == pytest.approx(np.sqrt(1 / 11))
    assert got[2, at["repeated shingles"]] == pytest.approx(0.75) and got[3, at["repeated lines"]] == pytest.approx(1 / 3)
    assert [round(float(np.expm1(r[at["size"]]))) for r in got] == [len(brute.words(t)) for t in texts]


def plain_scores(rows, evidence):
    """The hierarchical posteriors, leave-one-out, in plain Python. rows: (host, path)."""
    own = [1 / (1 + np.exp(-e)) for e in evidence]
    mean = min(1 - 1e-6, max(1e-6, sum(own) / len(own)))
    hosts, paths = {}, {}
    for (h, p), q in zip(rows, own, strict=True):
        for table, key in ((hosts, h), (paths, (h, p))):
            n, s = table.get(key, (0, 0.0))
            table[key] = n + 1, s + q

    def concentration(groups):
        groups = [(n, s, m) for n, s, m in groups if n > 1]
        scale = sum(n * m * (1 - m) for n, _, m in groups)
        if not scale:
            return 1.0
        excess = max(0.0, sum(n * (s / n - m) ** 2 for n, s, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / scale
        return min(1e6, max(1.0, 1 / excess - 1 if excess > 1e-6 else 1e6))

    a = concentration([(n, s, mean) for n, s in hosts.values()])
    rate = {h: (s + a * mean) / (n + a) for h, (n, s) in hosts.items()}
    b = concentration([(n, s, rate[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for (h, p), q, e in zip(rows, own, evidence, strict=True):
        (hn, hs), (pn, ps) = hosts[h], paths[h, p]
        host = (hs - q + a * mean) / (hn - 1 + a)
        path = min(1 - 1e-6, max(1e-6, (ps - q + b * host) / (pn - 1 + b)))
        out.append(1 / (1 + np.exp(-(e + np.log(path / (1 - path)) - np.log(mean / (1 - mean))))))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_scores_against_plain_version(spark, sf, limit, monkeypatch):
    """With the groups broadcast, and with only the hot ones broadcast."""
    from weftgraph.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_quality_prior(spark, sf).collect()
    assert len(rows) == len(docs)
    want = plain_scores([(docs[r.doc_id].source, docs[r.doc_id].lang) for r in rows], [r.evidence for r in rows])
    assert [r.score for r in rows] == pytest.approx(want, abs=1e-7)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op6_quality_prior(spark, sf)
    from weftgraph.llm import toxicity

    rows = [(r.predicted, truth[r.doc_id]) for r in out.filter(toxicity.held_out(out.doc_id)).collect() if truth.get(r.doc_id) is not None]
    assert len(rows) > 300 and sum(p == y for p, y in rows) / len(rows) >= 0.9


def test_sparse_sites_lean_on_the_prior(spark):
    good, bad = "A calm and clear sentence about the river and the mill. " * 8, "$$$ ### BUY | NOW | !!! 99% " * 8
    docs = spark.createDataFrame([(k, good if k % 10 else bad, "many", "p") for k in range(100)] + [(200, bad, "few", "p"), (201, good, "few", "p")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(100)], "doc_id long, quality int")
    model = quality_prior.learn(docs, labels)
    got = {r.doc_id: r for r in quality_prior.score(docs, model, docs.host, docs.path).collect()}
    assert got[0].predicted == 0 and got[1].predicted == 1 and got[200].predicted == 0 and got[201].predicted == 1
    assert abs(got[200].host_rate - got[1].host_rate) < 0.5


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 1), (6, 0), (7, 0), (None, 1), (9, None), (2, 5), (9, 0), (9, 1)], "doc_id long, quality int")
    model = quality_prior.learn(odd, labels)
    rows = quality_prior.score(odd, model, odd.source, odd.lang).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_prior.score(none, model, none.source, none.lang).count() == 0
    nothing = quality_prior.learn(none, labels.limit(0))
    assert all(r.evidence == 0 for r in quality_prior.score(odd, nothing, odd.source, odd.lang).collect())
