"""The trained classifiers: exact parts against brute force, accuracy on documents held out."""

import itertools
import zlib

import numpy as np
import pytest

from tillwork.llm import langid, quality_crf
from tillwork.llm.queries import op1_quality_classifier, op9_language_id


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward_against_enumeration(seed):
    rnd = np.random.default_rng(seed)
    lengths = rnd.integers(1, 7, 6)
    first = np.r_[0, np.cumsum(lengths)]
    scores, moves = rnd.normal(size=first[-1]), rnd.normal(size=(2, 2))
    log_z, good, expected = quality_crf.forward_backward(scores, first, moves)
    total = np.zeros((2, 2))
    for c, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        weights, labels = [], list(itertools.product((0, 1), repeat=hi - lo))
        for y in labels:
            weights.append(np.exp(sum(scores[lo + i] * y[i] for i in range(hi - lo)) + sum(moves[a, b] for a, b in zip(y, y[1:]))))
        z = sum(weights)
        assert log_z[c] == pytest.approx(np.log(z))
        assert good[lo:hi] == pytest.approx(sum(w * np.array(y) for w, y in zip(weights, labels)) / z)
        for w, y in zip(weights, labels):
            for a, b in zip(y, y[1:]):
                total[a, b] += w / z
    assert expected == pytest.approx(total)


def test_gradient_against_differences():
    rnd = np.random.default_rng(3)
    import pandas as pd
    lines = [1, 4, 2]
    frame = pd.DataFrame({"label": [1, 0, 1], "features": [rnd.normal(size=(n, quality_crf.WIDTH)).astype(np.float32).tobytes() for n in lines],
                          "sizes": [np.ones(n, np.float32).tobytes() for n in lines]})
    w = rnd.normal(size=quality_crf.WIDTH + 3) / 4

    def loss(x):
        return next(quality_crf._gradient(x)(iter([frame])))
    slope = np.array(loss(w)["slope"][0])
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((loss(w + step)["loss"][0] - loss(w - step)["loss"][0]) / 2e-5, rel=1e-3, abs=1e-5)


def test_lines():
    texts = [b"", b"One line", b"A b\n\nA b\n", b"\n", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    x, size, first = quality_crf.line_features(data, offsets)
    assert first.tolist() == [0, 1, 2, 6, 8, 9]
    assert size.tolist() == [0, 8, 3, 0, 3, 0, 0, 0, 0]
    for i, t in enumerate(texts):      # a text's features do not depend on the texts around it
        alone, _, _ = quality_crf.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert x[first[i]:first[i + 1]] == pytest.approx(alone)
    assert x.shape[1] == quality_crf.WIDTH


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = op1_quality_classifier(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for y, p in judged if y == 1]) >= 0.97 and np.mean([1 - p for y, p in judged if y == 0]) >= 0.7


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a\n" * 3000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = quality_crf.train(docs, none)
    out = quality_crf.score(docs, model).collect()
    assert len(out) == 3 and all(r["score"] == pytest.approx(2 / 3) for r in out)
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    learned = quality_crf.train(spark.createDataFrame([(1, "fine text"), (2, "### ***")], "doc_id long, text string"), both)
    assert quality_crf.score(docs.limit(0), learned).count() == 0
    assert {r["doc_id"] for r in quality_crf.score(docs, learned).collect()} == {1, None}


def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = op9_language_id(spark, sf).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in out if r["held_out"]]) >= 0.98


def test_terms_against_a_plain_count():
    text = "Straße 日本"
    c = [ord(x) for x in f" {text.lower()} "]
    total = langid.term_counts(text).sum()
    assert total == len(c) + (len(c) - 1) + (len(c) - 2)
    assert (langid.term_counts("AB") == langid.term_counts("ab")).all() and langid.term_counts("").sum() == 3


def test_temperature():
    rnd = np.random.default_rng(0)
    scores = rnd.normal(size=(4000, 3))
    label = np.array([rnd.choice(3, p=p) for p in langid._softmax(scores / 2.5)])
    assert langid._temperature(scores, label) == pytest.approx(2.5, rel=0.2)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !", None), (2, "", None), (None, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()] == [("und", 0.0)] * 4
    known = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat", "en"), ("die katze", "de")] * 5)], "doc_id long, text string, lang string")
    model = langid.train(known)
    got = [r["lang_pred"] for r in langid.identify(docs.unionByName(known.limit(2)), model).collect()]
    assert got[:3] == ["und"] * 3 and got[4:] == ["en", "de"] and langid.identify(docs.limit(0), model).count() == 0


def test_the_quota_of_a_language_counts_documents(spark):
    """Many rows of one id, and many without an id, leave room for the others."""
    from tillwork.llm import langid

    lowest = min(range(101), key=lambda i: spark.sql(f"select xxhash64({i}L)").first()[0])
    rows = [(lowest, f"again {k}", "en") for k in range(300)] + [(i, f"text number {i}", "en") for i in range(101) if i != lowest]
    rows += [(None, f"ohne {k}", "de") for k in range(50)]
    seen = []
    kept = langid.materialize
    langid.materialize = lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1]
    try:
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_per_lang=200, settings=langid.Settings(rounds=1))
    finally:
        langid.materialize = kept
    sample = dict(seen)["sample"].groupBy("label").count().collect()
    assert sorted(r["count"] for r in sample) == [50, 101]
