"""Hard negatives against brute force, and the parts of the method on their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credsieve.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, every):
    """Straight from the definition, over (vec_id, embedding, label)."""
    best = {}
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        whole = tuple(int(np.floor(float(np.float32(x)) * 256)) for x in v)
        best[vec_id] = min(best.get(vec_id, (label, whole)), (label, whole))
    found = []
    for anchor, (label, v) in best.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, lab) for i, (lab, w) in best.items() if i != anchor)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            found += [(anchor, positive, r, i, -p, -n) for r, (n, i, _) in enumerate(hard, 1)]
    return sorted(found)


def mined(spark, rows, every, parts=4):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = hn.mine(frame, F.col("id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def made(n, dims, seed, labels=4, ties=False):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = rnd.choice(centres)
        v = [c / 4 + rnd.gauss(0, 0.1) for c in centre]
        rows.append((i - n // 3, [round(x, 1) for x in v] if ties else v, 0 if i % 3 else rnd.randrange(labels)))
    return rows


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 95), (64, 64, 64), (70, 37, 129), (5, 200, 3), (130, 131, 67)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (hn.strassen(a, b) == a @ b).all()


def test_strassen_of_nothing():
    assert hn.strassen(np.zeros((3, 0), np.int64), np.zeros((0, 5), np.int64)).tolist() == [[0] * 5] * 3


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 4, (3, 40)), np.arange(40)[None].repeat(3, 0)
    parts = [(scores[:, i : i + 8], ids[:, i : i + 8]) for i in range(0, 40, 8)]
    results = []
    for order in (parts, parts[::-1]):
        heaps = hn.Heaps((3,), 5)
        for part in order:
            heaps.merge(*part)
        results.append((heaps.scores.tolist(), heaps.ids.tolist()))
    assert results[0] == results[1]
    expected = [sorted(zip(-s, i))[:5] for s, i in zip(scores, ids)]
    assert results[0][1] == [[int(i) for _, i in row] for row in expected]


@pytest.mark.parametrize("ties", [False, True])
def test_brute_force(spark, ties):
    rows = made(400, 12, 3, ties=ties)
    expected = brute_force(rows, 5)
    assert expected
    assert mined(spark, rows, 5) == expected


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE", 16)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    rows = made(300, 8, 4, ties=True)
    assert mined(spark, rows, 3, 9) == brute_force(rows, 3)


def test_odd_rows(spark):
    rows = made(120, 6, 5, labels=2, ties=True)
    rows += [
        (None, [0.5] * 6, 1), (1000, None, 1), (1005, [0.5] * 6, None), (1010, [None, 1.0], 1), (1015, [float("nan")] * 6, 1),
        (1020, [float("inf")] * 6, 0), (1025, [], 1), (1030, [1.0, 2.0], 1), (1035, [1.0] * 9, 0), (1040, [0.0] * 6, 1),
        (2000, [0.25] * 6, 0), (2000, [0.25] * 6, 0), (2000, [0.5] * 6, 0), (2000, [9.0] * 6, 1), rows[0], rows[0],
    ]
    assert mined(spark, rows, 5) == brute_force(rows, 5)


def test_nothing_to_mine(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], 5) == []  # no anchors
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 2)], 5) == []  # no positives


def test_clashing_columns(spark):
    rows = made(60, 4, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "tile", "block", "run", "score", "rank", "kind"):
        frame = frame.withColumn(name, F.lit("x"))
    found = hn.mine(frame, F.col("id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 5)
