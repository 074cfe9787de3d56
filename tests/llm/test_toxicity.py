"""The chain against enumeration; scores on edge rows and held-out documents."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm.toxicity import fit_field, forward_backward, in_training, toxicity, training_sample


def enumerated(score, trans, start):
    """Marginals and pairwise marginals of one text by summing over all taggings."""
    n = len(score)
    total, single, pair = 0.0, np.zeros(n), np.zeros((4, n))
    for tags in itertools.product((0, 1), repeat=n):
        weight = start if tags[0] else 1.0
        for i, t in enumerate(tags):
            weight *= math.exp(score[i]) if t else 1.0
            weight *= trans[tags[i - 1], t] if i else 1.0
        total += weight
        for i, t in enumerate(tags):
            single[i] += weight * t
            if i:
                pair[2 * tags[i - 1] + t, i] += weight
    return single / total, pair / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    trans, start = np.array([[1.0, 0.3], [0.6, 2.5]]), 0.4
    lengths = [1, 5, 2, 7, 1, 3]
    scores = [rng.normal(size=n) for n in lengths]
    first = np.concatenate([np.arange(n) == 0 for n in lengths])
    p, cells = forward_backward(np.concatenate(scores), first, trans, start)
    want = [enumerated(s, trans, start) for s in scores]
    np.testing.assert_allclose(p, np.concatenate([w[0] for w in want]), rtol=1e-9)
    np.testing.assert_allclose(cells, np.concatenate([w[1] for w in want], axis=1), rtol=1e-9, atol=1e-12)


def test_extreme_scores_stay_finite():
    score = np.array([1e6, -1e6, 30.0, -30.0] * 500)
    first = np.zeros(2000, dtype=bool)
    first[0] = True
    p, _ = forward_backward(score, first, np.array([[1.0, 0.1], [0.1, 1.0]]), 1.0)
    assert np.isfinite(p).all() and p.min() >= 0 and p.max() <= 1


def test_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    field = fit_field(training_sample(docs, labels, in_training(F.col("label_id"))))
    held = docs.join(labels.where(~in_training(F.col("doc_id"))), "doc_id")
    rows = toxicity(held, field).select("doc.text", "doc.toxic", "score", "spans").collect()
    right = [(r.score >= 0.5) == bool(r.toxic) for r in rows]
    assert sum(right) / len(right) > 0.97
    caught = [r.score >= 0.5 for r in rows if r.toxic]
    assert sum(caught) / len(caught) > 0.9
    for r in rows:
        for s in r.spans:
            assert r.text[s.start : s.start + s.length].strip()


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (4, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    field = fit_field(training_sample(edge_docs, labels, F.lit(True)))
    rows = toxicity(edge_docs, field).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(no_docs, field).collect() == []
    blank = fit_field(training_sample(no_docs, labels, F.lit(True)))
    assert {r.score for r in toxicity(edge_docs, blank).collect()} == {0.0}


def test_two_fits_in_one_session_equal_the_fits_alone(spark):
    """Workers outlive a fit; what they remember of one field must not reach the next."""
    from riskloom.llm import toxicity as module

    def fitted(bad):
        rows = [(i, f"{bad if i % 2 else 'calm'} word{i % 7} and more", i % 2) for i in range(60)]
        sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        return module.fit_field(sample).document

    alone = fitted("awful")
    assert fitted("horrid") != (0.0,)
    again = fitted("awful")
    np.testing.assert_allclose(again, alone, rtol=1e-9)
    # A field that knows the words of another table must be calibrated on its own weights.
    first, second = fitted("awful"), fitted("calm")
    assert first != second


def test_sample_takes_one_text_and_one_label_a_document(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = training_sample(docs, labels, F.lit(True)).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (2, "", 0)]
