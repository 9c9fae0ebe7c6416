import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import queries, toxicity


def test_kernel_against_enumeration():
    pairs = [(b"idiot", b"idiot"), (b"id.iot", b"idiot"), (b"abcabc", b"cab"), (b"xyz", b"abc"), (b"ab", b"abc")]
    tokens, marks = toxicity.padded([a for a, _ in pairs], 8), toxicity.padded([b for _, b in pairs], 8)
    got = toxicity.kernels(tokens, marks)
    assert got == pytest.approx([brute.kernel(a.decode(), b.decode(), toxicity.ORDER, toxicity.DECAY) for a, b in pairs])


def trained():
    rng = random.Random(11)
    filler = [a + b for a in ("mor", "tel", "vin", "sar", "quo", "bel", "dran") for b in ("ta", "ric", "lon", "esh", "umi", "o")]
    clean = [" ".join(rng.choices(filler, k=30)) for _ in range(120)]
    bad = []
    for _ in range(60):
        words = rng.choices(filler, k=30)
        for i in rng.sample(range(30), 3):
            words[i] = rng.choice(["grumblefool", "snorkwit", "blatherhead"])
        bad.append(" ".join(words))
    return toxicity.fit(clean + bad, [0] * len(clean) + [1] * len(bad))


def test_gapped_and_inserted_insults():
    model = trained()
    insults = ["grumblefool snorkwit", "g.r.u.m.b.l.e.f.o.o.l s-n-o-r-k-w-i-t", "grumxblefool snoerkwit", "gru-mble-fool! snork_wit?", "g r u m b l e f o o l , snorkwit", "GRUMBLEFOOL SNORKWIT", "“grumblefool” «snorkwit»"]
    clean = ["a quiet walk by the mill", "the gardener mumbles and the foolish snorer", "", "unrelated words only " * 40]
    p = toxicity.score_batch(pa.array([f"morta telric {x} vinlon quo" for x in insults] + clean), model)
    assert (p[: len(insults)] >= 0.5).all() and (p[len(insults) :] < 0.5).all()
    # One insult in a long clean text counts for less than in a short one.
    one, many = toxicity.score_batch(pa.array(["snorkwit " + "morta telric " * k for k in (3, 2000)]), model)
    assert one > many


@pytest.mark.parametrize("word", ["gxrxuxmxbxlxexfxoxoxl", "s·n·o·r·k·w·i·t", "sn\u200b\u200bor\u200b\u200bkwit", "leave,snorkwit", "well...snorkwit", "mean/snorkwit/there", "grumble" + 5 * "x" + "fool", "supersnorkwit"])
def test_whole_tokens_are_compared(word):
    p = toxicity.score_batch(pa.array([f"morta {x} vinlon quo" for x in (word, "walking", "pxqxzxwxvxyxjxkxdx", "leave,walking")]), trained())
    assert p[0] >= 0.5 and (p[1:] < 0.5).all()


def test_masked_letters_get_a_likeness():
    model = trained()
    for word in ("snork*it", "snorkw1t", "grumblef00l"):
        _, like, _, _ = toxicity.tokens(pa.array([word]), model.landmarks, model.own)
        assert like.max(initial=0) > 0, word


def test_spelled_runs_end_with_their_text():
    model, text = trained(), "s n o r k w i t vinlon quo"
    alone = toxicity.score_batch(pa.array([text]), model)[0]
    for before in ("morta telric x", "a b", "", "s n o r"):
        assert toxicity.score_batch(pa.array([before, text]), model)[1] == pytest.approx(alone)
    assert alone >= 0.5
    assert (toxicity.score_batch(pa.array(["a b", "c d"]), model) < 0.5).all()


def test_query_against_brute_force(spark, tmp_path):
    """200 documents, insults plain and disguised among them; the query's scores against loops over all windows and subsequences."""
    rng = random.Random(5)
    filler = [a + b for a in ("mor", "tel", "vin", "sar", "quo", "bel", "drañ") for b in ("ta", "ric", "lon", "esh", "umi", "o'b")]
    insult = ["grumblefool", "snorkwit", "blatherhead", "G.R.U.M.B.L.E.F.O.O.L", "snxorkwit", "snorkit", "b*atherhead", "megasnorkwit", "well...blatherhead", "s n o r k w i t", "grumb-le/fool", "grumbxqzvkjlefool"]
    rows, labels = [], []
    for k in range(200):
        text = rng.choices(filler, k=rng.randrange(1, 30))
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(insult[:3] if k % 8 else insult))
        rows.append((k, " ".join(text) + rng.choice(["", ".", "!?", " - "])))
        if k % 7:
            labels.append((k, int(bad)))
    rows += [(500, None), (501, ""), (None, "snorkwit grumblefool"), (502, "漢字 — snorkwit… „blatherhead“ é"), (7, "a b c d snorkwit")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((repr(r.doc_id), r.held_out, r.predicted, r.score) for r in queries.op5_toxicity(spark, str(tmp_path)).collect())
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k, _ in rows}
    truth = {k: y for k, y in labels if not held[k]}
    sample = sorted((k, t) for k, t in rows if k in truth and t is not None)
    model = toxicity.fit([t for _, t in sample], [truth[k] for k, _ in sample])
    assert model.landmarks
    memo = {}
    scores = [(k, brute.toxic_score(t, model, toxicity, memo)) for k, t in rows]
    want = sorted((repr(k), held[k], int(s >= 0.5), s) for k, s in scores)
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-9)
    assert sum(x[2] for x in got) > 30


def test_held_out_labels_do_not_count(spark, tmp_path):
    """However many labels of held-out rows there are, the model stays the same."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["telric", "vinlon", "quota"], k=12)) + (" snorkwit grumblefool" if k % 5 == 0 else "")) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for more in (0, 20_000):
        labels = [(k, int(k % 5 == 0)) for k, _ in rows] + [(k, 1) for k in range(1000, 1000 + more) if zlib.crc32(str(k).encode()) % 5 == 0]
        where = tmp_path / str(more)
        docs.write.parquet(str(where / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(where / "labels.parquet"))
        scores.append(sorted((r.doc_id, r.score) for r in queries.op5_toxicity(spark, str(where)).collect()))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("word", ["grumbefool", "grum*lefool", "blaterhead", "blath*rhead", "megagrumblefool", "grumbxqzkjlefool"])
def test_disguised_insults(word):
    """Left out, masked, prefixed, five characters put in."""
    p = toxicity.score_batch(pa.array([f"morta {word} vinlon {word} quo {word}"]), trained())
    assert p[0] >= 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf).filter("held_out").collect()
    got = [(r.predicted, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]
    hit, bad, said = sum(p == y for p, y in got), sum(y for _, y in got), sum(p for p, _ in got)
    both = sum(p and y for p, y in got)
    assert len(got) > 300 and hit / len(got) >= 0.95 and both / bad >= 0.9 and both / max(1, said) >= 0.9


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 0), (7, 0), (None, 1), (9, None), (2, 5), (9, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.learn(none, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(odd, nothing).collect())
    p = {r.doc_id: r.score for r in toxicity.score(odd, trained()).collect()}
    assert p[1] == p[2] == p[3] and p[4] == p[5] and np.isfinite(list(p.values())).all()
