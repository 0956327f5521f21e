"""Training over shards of the vocabulary against the pipeline that holds it whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credsieve.operators import classify, sharded


def samples(n, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        label = i % 2
        word = "".join(rnd.choice("abcdef0123456789" if label or rnd.random() < 0.2 else "aeioulmnrst") for _ in range(9))
        rows.append((f"{rnd.choice(['key', 'the', 'pwd'])} {word}", label))
    rows += [rows[0], rows[0], rows[1], ("", 0), ("same text", 0), ("same text", 1), ("ß 😀 é", 1)]
    return rows


def test_equals_the_whole_model(spark):
    frame = spark.createDataFrame(samples(150), "text string, label int")
    whole = classify.fit(frame, tolerance=1e-14)
    found = sharded.fit(frame.unionByName(spark.createDataFrame([("lost", None)], frame.schema)), shards=3, block_rows=40)
    assert found.gradient <= 1e-9 and found.evaluations < 200
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(samples(80, 2))] + [(-1, None), (-2, "zzz")], "id int, text string")
    expected = {r["id"]: r["p"] for r in classify.score(texts, "text", whole, "p").collect()}
    scored = {r["id"]: r["p_secret"] for r in sharded.score(texts, "id", "text", found).collect()}
    assert scored.keys() == expected.keys()
    assert max(abs(scored[i] - expected[i]) for i in scored) < 1e-6


def test_direction_is_that_of_two_loops():
    rng = np.random.default_rng(3)
    steps = rng.normal(size=(4, 30))
    changes = steps * rng.uniform(0.5, 2, 30)  # of a convex function: all inner products are positive
    g = rng.normal(size=30)
    q, alphas = -g, []
    for s, y in zip(steps[::-1], changes[::-1]):
        alphas.append(s @ q / (s @ y))
        q = q - alphas[-1] * y
    q = q * (steps[-1] @ changes[-1] / (changes[-1] @ changes[-1]))
    for s, y, a in zip(steps, changes, alphas[::-1]):
        q = q + (a - y @ q / (s @ y)) * s
    basis = np.vstack([np.stack([steps, changes], 1).reshape(-1, 30), g[None]])
    assert np.allclose(sharded._direction(basis @ basis.T) @ basis, q)


def test_nothing_to_train_on(spark):
    with pytest.raises(ValueError):
        sharded.fit(spark.createDataFrame([("x", None)], "text string, label int"))
