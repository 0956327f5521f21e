import random

import numpy as np
from tables import CLASHING, sentence

from credsieve.llm import quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=900, seed=0):
    rnd = random.Random(seed)
    rows, labels, bad = [], [], set()
    for i in range(n):
        text = sentence(rnd, rnd.randint(30, 200))
        if i % 5 == 0:
            words = text.split()
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron", "scumbag", "vermin"]))
            text = " ".join(words)
        elif i % 7 == 0:
            text = " ".join(w for w in text.split()[:6] for _ in range(15))
        if i % 5 == 0 or i % 7 == 0:
            bad.add(i)
        rows.append((i, text, None, None, 1))
        if rnd.random() < 0.5:
            labels.append((i, int(not (i % 7 == 0 and i % 5)), int(i % 5 == 0)))
    return rows, labels, bad


def test_held_out_accuracy(spark):
    rows, labels, bad = corpus()
    known = {i for i, *_ in labels}
    found = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in found if r.doc_id not in known]
    assert len(found) == len(rows)
    missed = sum(r.kept for r in held if r.doc_id in bad) / sum(r.doc_id in bad for r in held)
    lost = sum(not r.kept for r in held if r.doc_id not in bad) / sum(r.doc_id not in bad for r in held)
    assert missed < 0.02 and lost < 0.02


def test_keeps_as_many_as_reach_the_cut(spark):
    rows, labels, _ = corpus(300, 1)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    choice, keys = quality.choose(docs, marks)
    keys = keys.collect()
    k = sum(r.weight >= choice.model.cut for r in keys)
    assert choice.least_key == sorted((r.key for r in keys), reverse=True)[k - 1]
    again = quality.choose(docs.repartition(7), marks)[0]
    assert again.least_key == choice.least_key


def test_kth_largest(spark):
    rnd = np.random.RandomState(0)
    values = [float(x) for x in np.concatenate([rnd.randn(500), np.full(300, 0.25), [1e9, -1e9]])]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 200, 350, 500, 802):
        assert quality.kth_largest(keys, k) == ordered[k - 1]
    assert quality.kth_largest(keys, 0) == float("inf")


def test_features_once_per_text():
    import pyarrow as pa

    ((first, owner, feature),) = quality.features(pa.array(["a a a a", None, "", "Größe der"]))
    assert first == 0 and set(owner.tolist()) == {0, 3}
    assert len(set(zip(owner.tolist(), feature.tolist()))) == len(owner)
    assert (feature[owner == 0] == quality._RUNS).sum() == 1


def test_windows_of_a_long_text_give_the_same_features():
    import pyarrow as pa

    rnd = random.Random(5)
    texts = [sentence(rnd, 300), "x" * 5000, "go " * 900, " \n" * 700, "Größe\tder " * 200, "spam " * 7 + "y" * 900 + " spam" * 7]
    texts += ["".join(rnd.choice("aB \n") for _ in range(3000)) for _ in range(5)]
    for text in texts:
        ((_, _, whole),) = quality.features(pa.array([text]), 1 << 20)
        for size in (5, 64, 701):
            ((_, owner, parts),) = quality.features(pa.array([text]), size)
            assert not owner.any() and parts.tolist() == whole.tolist()


def test_best_cut():
    cut = quality._best_cut(np.array([-64, 0, 63, 128]), np.array([0, 1, 5, 9]), np.array([7, 2, 1, 0]))
    assert cut == 0.5  # between the steps 0 and 63
    assert quality._best_cut(np.array([3]), np.array([2]), np.array([1])) == -np.inf
    assert quality._best_cut(np.array([3]), np.array([1]), np.array([2])) == np.inf


def test_texts_are_scored_once(spark, no_docs):
    rows, labels, _ = corpus(60, 2)
    docs = spark.createDataFrame(rows, DOCS)
    kept = quality.select_good(docs, spark.createDataFrame(labels, LABELS))
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()


def test_messy_rows(spark, clashing, messy_rows, no_docs):
    labels = spark.createDataFrame(
        [(i, int(i % 4 != 0), None if i % 3 else 0) for i in range(40)] + [(None, 1, 1), (5, 0, None), (100, None, None), (108, 1, 0)], LABELS
    )
    found = quality.classify(clashing, labels).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(r[0]) for r in messy_rows)
    assert {r.weight for r in found if r.doc_id in (100, 101)} == {0.0}
    kept = quality.select_good(clashing, labels)
    assert kept.columns == clashing.columns and set(CLASHING) < set(kept.columns)
    assert kept.count() == sum(r.kept for r in found)
    assert quality.select_good(clashing, labels.limit(0)).count() == len(messy_rows)
    assert quality.classify(no_docs, labels).count() == 0
