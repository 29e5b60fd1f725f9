"""CRF quality and factorization-machine toxicity: kernels against enumeration, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
import pytest

from tidewatch.llm import quality_crf as crf
from tidewatch.llm import toxicity_fm as fm


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    score, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    cut = np.array([0, 4, 5, 9])
    good, pairs, log_z = crf.marginals(score, cut, trans)
    want_pairs = np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(cut, cut[1:])):
        weight, hit, two = 0, np.zeros(b - a), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(score[a + k] * s for k, s in enumerate(states)) + sum(trans[s, r] for s, r in zip(states, states[1:])))
            weight += w
            hit += w * np.array(states)
            for s, r in zip(states, states[1:]):
                two[s, r] += w
        assert np.allclose(good[a:b], hit / weight)
        assert np.isclose(log_z[np.argsort(-np.diff(cut), kind="stable").tolist().index(d)], np.log(weight))
        want_pairs += two / weight
    assert np.allclose(pairs, want_pairs)


def test_line_features_do_not_depend_on_the_block():
    bodies = [b"one two two\nTHREE!! four", b"", "É é | x\n\n".encode(), b"a" * 50]
    x, length, cut = crf.line_features(bodies)
    alone = [crf.line_features([b]) for b in bodies]
    assert np.allclose(x, np.concatenate([a[0] for a in alone]))
    assert cut.tolist() == np.cumsum([len(a[0]) for a in alone]).tolist() == [2, 3, 6, 7]


def test_pair_terms_against_the_plain_sum():
    rng = np.random.default_rng(0)
    model = fm.FactorizationMachine(np.arange(6), 0.5, rng.normal(size=6), rng.normal(size=(6, 3)))
    doc, col = np.array([0, 0, 0, 2]), np.array([1, 3, 4, 5])
    raw = model.raw(doc, col, 3)
    want = 0.5 + model.weight[[1, 3, 4]].sum() + sum(model.factor[a] @ model.factor[b] for a, b in ((1, 3), (1, 4), (3, 4)))
    assert np.allclose(raw, [want, 0.5, 0.5 + model.weight[5]])


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(1)
    slots, label = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        slots.append(np.array(sorted({*rng.integers(100, 200, 5), *([1] if a else []), *([2] if b else [])})))
        label.append(float(a and b))
    model = fm.fit(slots, np.array(label))
    score = {k: model.raw(np.zeros(len(k), int), model.column[list(k)], 1)[0] for k in ((1,), (2,), (1, 2))}
    assert score[1, 2] > 0 > max(score[1,], score[2,])


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(spark, which):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    run = crf.score_quality if which == "quality" else fm.score_toxicity
    modulus, held = (3, 1) if which == "quality" else (4, 2)
    got = run(spark, docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    rows = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[which] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    ones = [r for r in rows if r[which] == (1 if which == "toxic" else 0)]
    assert np.mean([r.predicted == r[which] for r in ones]) > 0.8  # the rare class too; some 120 documents here


@pytest.mark.parametrize("run", [crf.score_quality, fm.score_toxicity])
def test_edge_cases(spark, run):
    docs = spark.createDataFrame([(1, "some fine words here", "a"), (1, "some fine words here", "b"), (None, None, "c"), (2, "", "d"),
                                  (3, "x " * 200000, "e"), (4, "BAD!! WORDS!!", "f"), (5, "\n\n", "g")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = run(spark, docs, labels, modulus=1, held=7).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    none = run(spark, docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert run(spark, docs.limit(0), labels).count() == 0


def test_a_long_document_trains_by_a_stretch_of_its_lines(spark):
    from tidewatch.llm import quality_crf as Q
    body = b"\n".join(b"line %d of plain words" % k for k in range(3000))
    cut = Q.stretch(body).split(b"\n")
    assert len(cut) == Q.SAMPLE_LINES and body.find(b"\n".join(cut)) >= 0 and Q.stretch(body) == Q.stretch(body)
    assert Q.stretch(b"") == b"" and Q.stretch(b"a\nb") == b"a\nb"
    good, bad = "\n".join(["A plain sentence of words, as people write."] * 3000), "\n".join(["BUY | NOW!!! $$$ 99999 ###"] * 3000)
    rows = [(k, good if k % 2 else bad) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = Q.score_quality(spark, docs, labels).collect()  # every labelled document is a long one
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
