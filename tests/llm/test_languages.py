from __future__ import annotations

import zlib

import numpy as np
import pytest

from footfall.llm.common import prepared, table
from footfall.llm.languages import PLACES, fit, held_out, ngram_counts, predicted, temperature

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs = table(prepared(spark), DATA, "documents")
    model = fit(docs)
    return model, predicted(docs, model).withColumn("held_out", held_out()).select("doc_id", "lang", "text", "held_out", "lang_pred", "score").collect()


def test_held_out_accuracy_and_calibration(results):
    _, rows = results
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    right = np.array([r.lang_pred == r.lang for r in own])
    scores = np.array([r.score for r in own])
    assert right.mean() > 0.98
    assert abs(scores.mean() - right.mean()) < 0.05 and (0 <= scores).all() and (scores <= 1).all()


def test_weights_are_sparse(results):
    model, _ = results
    assert 0.001 < (model.weights != 0).any(axis=1).mean() < 0.5


def test_ngrams_are_counted_whole(monkeypatch):
    text = ("The Dog, the cat — 12 " * 40).encode()
    want = ngram_counts(text)
    chars = " " + " ".join(["the", "dog", "the", "cat"] * 40) + "  "
    assert want.sum() == sum(len(chars[:-1]) - n + 1 for n in (1, 2, 3))
    monkeypatch.setattr("footfall.llm.languages._BLOCK", 7)
    assert (ngram_counts(text) == want).all()
    assert ngram_counts(b"12 \n") is None and len(want) == PLACES


def test_temperature_softens_overconfident_logits():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3))
    logits[np.arange(4000), labels] += 1
    assert 4 < temperature(logits * 10, labels) / temperature(logits * 2, labels) < 6
    assert temperature(np.zeros((0, 3)), np.array([], dtype=int)) == 1.0


def test_odd_rows(spark):
    data = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([("aaa bab aba " * 9, "aa"), ("xyx yyx xxy " * 9, "xx")] * 30)]
    data += [(None, None, "aa", 1.0), (900, "", "aa", 1.0), (901, "123 …", None, 1.0), (902, "aab", None, 1.0), (902, "aab", None, 1.0), (903, "xyx " * 100_000, "xx", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    rows = predicted(docs, fit(docs)).collect()
    assert len(rows) == len(data)
    for r in rows:
        want = "und" if r.doc_id in (None, 900, 901) else "aa" if "a" in r.text else "xx"
        assert r.lang_pred == want and (r.score == 0) == (want == "und")
    none = docs.where("lang is null")
    assert {r.lang_pred for r in predicted(none, fit(none)).collect()} == {"und"}
    assert predicted(docs.limit(0), fit(docs.limit(0))).collect() == []
    wordless = docs.where("doc_id = 900")
    assert {r.lang_pred for r in predicted(docs, fit(wordless)).collect()} == {"und"}


def test_prediction_does_not_see_the_label(spark):
    docs = table(prepared(spark), DATA, "documents")
    model = fit(docs)
    hidden = docs.selectExpr("doc_id", "text")
    a = {(r.doc_id, r.lang_pred, r.score) for r in predicted(hidden, model).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in predicted(docs, model).select("doc_id", "lang_pred", "score").collect()}
