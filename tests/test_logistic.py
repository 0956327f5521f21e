"""The classifier's optimiser: the optimum, in few evaluations, and its edges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from credsieve.operators import classify, logistic


def _samples(spark, rows=400):
    """Texts of common and of rare words; some repeat, some are empty."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    found = []
    for i in range(rows):
        label = int(rng.random() < 0.7)
        text = " ".join(words[min(2999, int(rng.paretovariate(0.4)) * (2 - label))] for _ in range(rng.randint(0, 12)))
        found.append((text, label))
    return spark.createDataFrame(found + found[:20], "text string, label int")


def test_optimum_in_few_evaluations(spark, monkeypatch):
    samples, seen = _samples(spark), []
    evaluate = logistic._evaluate
    monkeypatch.setattr(logistic, "_evaluate", lambda *a: seen.append(1) or evaluate(*a))
    model = classify.fit(samples)
    assert len(seen) < 60  # the estimator before took some hundred on the documents
    rows = model.transform(samples.withColumnRenamed("text", "model_text")).select("features", "label").collect()
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])
    regression = model.stages[-1]
    w, b, n = regression.coefficients.toArray(), regression.intercept, len(y)
    z = x @ w + b
    value = (np.logaddexp(0, z) - y * z).mean() + w @ w / (2 * n)
    residual = (1 / (1 + np.exp(-z)) - y) / n
    gradient = np.append(x.T @ residual + w / n, residual.sum())
    assert gradient @ gradient * n / 2 <= 1.01 * classify.TOLERANCE * value
    assert (regression.getMaxIter(), regression.getTol(), regression.getRegParam()) == (1000, 1e-6, 1 / n)


def test_blocks_are_bounded_and_keep_all(monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK_ENTRIES", 4)
    rows = [(1.0, [0, 2, 5], [1.0, 300.0, 2.0]), (0.0, [], []), (0.0, [1], [1.0]), (1.0, [0, 1, 2, 3, 4], [1.0] * 5)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())))],
        names=["label", "indices", "values"],
    )
    found = []
    for block in logistic._packed(iter([batch.slice(0, 1), batch.slice(1)])):
        labels, row, terms, counts = logistic._arrays([block.column(i)[0].as_py() for i in range(5)])
        assert len(terms) <= 4 or len(labels) == 1
        found += [(y, terms[row == i].tolist(), counts[row == i].tolist()) for i, y in enumerate(labels)]
    assert found == rows


def test_one_label_only(spark):
    samples = _samples(spark, 30).filter("label = 1")
    model = classify.fit(samples)
    assert model.stages[-1].intercept == float("inf")
    assert classify.predict_samples(model, samples).filter("prediction = 0").count() == 0


def test_other_labels_are_refused(spark):
    samples = spark.createDataFrame([("abc", 0), ("def", 1), ("ghi", 2)], "text string, label int")
    with pytest.raises(Exception, match="labels are 0 and 1"):
        classify.fit(samples)
