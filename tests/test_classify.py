"""Classifier: features, scores, blending, evaluation, storage."""

import math
import shutil
from collections import Counter

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.operators import classify
from test_text import char_wb

SECRETS = [f"key-{i:04x}{i * 7919 % 65536:04x}" for i in range(120)]
PLAIN = [f"the {w} word number {i}" for i in range(40) for w in ("red", "blue", "green")]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(t, 1) for t in SECRETS] + [(t, 0) for t in PLAIN]
    return spark.createDataFrame(rows, "text string, label int").coalesce(2).cache()


@pytest.fixture(scope="module")
def model(samples):
    return classify.fit(samples, max_iterations=50)


def test_features_follow_the_formula(spark, model):
    texts = SECRETS + PLAIN
    n = len(texts)
    df = Counter(g for t in texts for g in set(char_wb(t)))
    rows = spark.createDataFrame([(t,) for t in texts[:5] + texts[-5:]], [classify._INPUT])
    vocabulary = model.stages[1].vocabulary
    assert set(vocabulary) == set(df)
    for row in model.transform(rows).collect():
        counts = char_wb(row[classify._INPUT])
        weights = {g: c * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        got: SparseVector = row["features"]
        assert {vocabulary[i]: v for i, v in zip(got.indices, got.values)} == pytest.approx(
            {g: w / norm for g, w in weights.items()}
        )


def test_regularisation_is_that_of_summed_losses(spark, samples, model):
    """At the solution the gradient of sum(loss) + |w|^2 / 2 vanishes."""
    fitted = classify.fit(samples, tolerance=1e-6)
    regression = fitted.stages[-1]
    rows = fitted.transform(samples.withColumn(classify._INPUT, F.col("text"))).select(
        "features", "probability", "label"
    ).collect()
    gradient = regression.coefficients.toArray().copy()
    for row in rows:
        error = row["probability"][1] - row["label"]
        gradient[row["features"].indices] += error * row["features"].values
    assert abs(gradient).max() < 1e-2


def test_default_fit_is_converged(samples):
    """With the defaults the gradient vanishes as well."""
    fitted = classify.fit(samples)
    regression = fitted.stages[-1]
    rows = fitted.transform(samples.withColumn(classify._INPUT, F.col("text"))).select(
        "features", "probability", "label"
    ).collect()
    gradient = regression.coefficients.toArray().copy()
    for row in rows:
        error = row["probability"][1] - row["label"]
        gradient[row["features"].indices] += error * row["features"].values
    assert abs(gradient).max() < 1e-2


def test_separable_data_and_determinism(samples, model):
    row = classify.evaluate(model, samples).first()
    assert row["accuracy"] == 1.0 and row["total"] == 240
    again = classify.fit(samples, max_iterations=50)
    first = classify.predict_samples(model, samples).orderBy("text").collect()
    second = classify.predict_samples(again, samples).orderBy("text").collect()
    assert [r["p_secret"] for r in first] == pytest.approx([r["p_secret"] for r in second])


def test_timed_evaluation(samples, model):
    row = classify.evaluate_timed(model, samples).first()
    assert row["correct"] == 240 and row["rows_per_second"] == pytest.approx(240 / row["seconds"])


def test_split_is_stable_and_disjoint(samples):
    training, test = classify.split(samples)
    assert training.count() + test.count() == 240
    assert 0.65 < training.count() / 240 < 0.95
    assert training.intersect(test).count() == 0


def test_hashed_features(samples):
    hashed = classify.fit(samples, "hashed", max_iterations=5)
    assert classify.evaluate(hashed, samples).first()["accuracy"] == 1.0


def test_a_save_that_dies_leaves_the_version_before(spark, samples, tmp_path):
    path = str(tmp_path / "model")
    made = classify.fit(samples, max_iterations=3)
    first = classify.save_model(made, path)

    class Dying:
        def write(self):
            return self

        def save(self, place):
            made.write().save(place)
            shutil.rmtree(f"{place}/metadata")
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        classify.save_model(Dying(), path)
    assert classify.model_path(spark, path) == first
    assert classify.load_or_fit(path, samples, max_iterations=1).stages[-1].getMaxIter() == 3
    # The very first save dies: there is no model yet, and the next run trains one.
    with pytest.raises(KeyboardInterrupt):
        classify.save_model(Dying(), str(tmp_path / "none"))
    assert classify.model_path(spark, str(tmp_path / "none")) is None
    assert classify.load_or_fit(str(tmp_path / "none"), samples, max_iterations=2).stages[-1].getMaxIter() == 2
    # A newer version takes over; what was loaded or named before stays.
    second = classify.save_model(classify.fit(samples, max_iterations=4), path)
    assert classify.load_model(spark, path).stages[-1].getMaxIter() == 4 and second != first
    assert classify.load_model(spark, first).stages[-1].getMaxIter() == 3


def test_store(spark, samples, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(Exception):
        classify.load_or_fit(path)
    made = classify.load_or_fit(path, samples, max_iterations=10)
    loaded = classify.load_or_fit(path, samples, max_iterations=1)  # what is there is kept
    assert loaded.stages[-1].getMaxIter() == 10
    # A version that is there but damaged is an error, and is not replaced.
    shutil.copytree(tmp_path / "model", tmp_path / "broken")
    (damaged,) = (tmp_path / "broken" / "versions").iterdir()
    shutil.rmtree(damaged / "stages")
    with pytest.raises(Exception):
        classify.load_or_fit(str(tmp_path / "broken"), samples)
    assert list((tmp_path / "broken" / "versions").iterdir()) == [damaged]
    texts = [r["p_secret"] for r in classify.predict_samples(made, samples).orderBy("text").collect()]
    assert texts == [
        r["p_secret"] for r in classify.predict_samples(loaded, samples).orderBy("text").collect()
    ]
    facts = {r["name"]: r["value"] for r in classify.model_info(loaded, samples, path).collect()}
    assert facts["secrets_dataset_size"] == "120" and facts["total_dataset_size"] == "240"
    assert facts["vocabulary_size"] == str(len(made.stages[1].vocabulary))
    assert float(facts["saved_mb"]) > 0
    fresh, metrics = classify.retrain(str(tmp_path / "new"), samples, max_iterations=10)
    assert metrics.first()["total"] > 0 and fresh is not None


def rated(spark, *rows):
    schema = "type string, severity string, p_secret double, p_context double"
    return classify.rate(spark.createDataFrame(list(rows), schema)).collect()


def test_rate(spark):
    rows = rated(
        spark,
        ("Token", "", 0.7, None),
        ("Token", "", 0.70001, None),
        ("Token", "", 0.9, 0.45),
        ("Token", "", 0.5, 0.5),
        (settings.TYPE_TOO_MANY, "High", 0.99, 0.99),
        ("Token", "", None, 0.3),
        (settings.TYPE_TOO_MANY, "High", None, None),
        ("Token", "", 0.125, None),
    )
    assert [(r["severity"], r["confidence"]) for r in rows] == [
        ("Potential", 0.7), ("High", 0.7), ("Potential", 0.7), ("Potential", 0.5),
        ("Potential", 0.5), ("High", 1.0), ("High", 1.0), ("Potential", 0.12),
    ]
    assert rows[0]["context_confidence"] is None and rows[0]["context_prediction"] is None
    assert not rows[0]["confidence_averaged"] and rows[2]["confidence_averaged"]
    assert not rows[3]["secret_prediction"] and rows[2]["secret_prediction"]
    assert rows[5]["secret_confidence"] is None and rows[5]["context_confidence"] is None


def test_score_findings(spark, model):
    schema = "type string, secret string, context string, severity string, confidence double"
    findings = spark.createDataFrame(
        [("Token", "key-12ab34cd", " \n", "", 1.0), ("Token", "key-12ab34cd", "the red word", "", 1.0)],
        schema,
    )
    blank, both = classify.score_findings(findings, model).collect()
    assert blank["severity"] == "High" and blank["context_confidence"] is None
    assert both["context_confidence"] < 0.5 and both["confidence"] < blank["confidence"]
    plan = classify.score_findings(findings, model)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_predict_pairs(spark, model):
    pairs = spark.createDataFrame(
        [(1, "key-12ab34cd", None), (2, "key-12ab34cd", "the blue word number 1"), (3, "  ", "x")],
        "i int, text string, context string",
    )
    rows = {r["i"]: r for r in classify.predict_pairs(pairs, model).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["is_secret"] and not rows[1]["averaged_confidence"]
    assert rows[2]["averaged_confidence"] and rows[2]["context_prediction"] is False


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4
    row = classify.confusion_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (row["true_positives"], row["false_positives"]) == (3, 2)
    assert (row["false_negatives"], row["true_negatives"]) == (1, 4)
    assert row["accuracy"] == 0.7 and row["precision"] == 0.6 and row["recall"] == 0.75
    assert row["f1"] == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    none = classify.confusion_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int"))
    assert none.first()["precision"] == none.first()["f1"] == 0.0


def test_evaluation_csv(spark, model, tmp_path):
    (tmp_path / "t.csv").write_text(
        "secret_value,secret_type\nkey-12ab34cd,Secret\nthe red word,NotSecret\nkey-77ab34cd,notsecret\n"
    )
    errors = str(tmp_path / "errors")
    row = classify.evaluate_csv(spark, model, str(tmp_path / "t.csv"), errors).first()
    assert (row["total"], row["correct"], row["false_positives"]) == (3, 2, 1)
    [wrong] = spark.read.csv(errors, header=True).collect()
    assert wrong[:3] == ("key-77ab34cd", "notsecret", "Secret")


def test_ngram_frequencies(spark):
    texts = spark.createDataFrame([("aaaa b",), ("aaa",), ("",)], "text string")
    rows = {r["ngram"]: (r["occurrences"], r["texts"]) for r in
            classify.ngram_frequencies(texts).collect()}
    assert rows["aaa"] == (3, 2) and rows[" b "] == (1, 1) and rows[" aaa"] == (2, 2)
