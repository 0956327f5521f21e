"""N-grams by words: the same terms, models and probabilities as by the stages of the pipeline, each word once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credsieve.operators import classify, logistic, terms
from credsieve.plans import catalog
from test_text import char_wb

ODD = ["", "a", "a a a", "ab ab", "key-12ab34cd key-12ab34cd", "\U0001f600\U0001f600 x\U0001f600y", "ß straße 漢字漢字", "a\x00b \x01", "x" * 300]


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢\U0001f600") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n)] + ODD


def _vocabulary(texts):
    return sorted({g for t in texts for g in char_wb(t)})


@pytest.mark.parametrize("piece", [1, 50, terms.PIECE])
@pytest.mark.parametrize("step", [1, 3])
def test_terms_of_texts(monkeypatch, piece, step):
    monkeypatch.setattr(terms, "PIECE", piece)
    monkeypatch.setattr(terms, "WORDS", min(piece, terms.WORDS))
    texts = _texts(80)
    known = _vocabulary(texts[::step])[::step]
    numbers = terms.Vocabulary(pa.array(known))
    rows, words = terms.words_of(pa.array(texts))
    found = []
    for place, some in terms.merged(rows, numbers.of_words(words)):
        ends = np.cumsum(some.sizes)
        assert len(ends) == place.stop - place.start
        for end, size in zip(ends, some.sizes):
            held = slice(end - size, end)
            found.append({known[i]: c for i, c in zip(some.numbers[held], some.counts[held])})
    kept = set(known)
    assert found == [{g: c for g, c in char_wb(t).items() if g in kept} for t in texts]


def test_large_counts_are_summed_as_well():
    row, number = np.array([0, 1, 0, 0]), np.array([(1 << 31) - 2, 5, 3, (1 << 31) - 2])
    some = terms._summed(row, number, np.array([1 << 40, 2, 1, 1]), 2)
    assert [x.tolist() for x in some] == [[2, 1], [3, (1 << 31) - 2, 5], [1, (1 << 40) + 1, 2]]


def test_rows_forth_and_back(monkeypatch):
    monkeypatch.setattr(terms, "_CACHED", 3)
    rows = terms.Rows(np.array([0, 2, 0, 5, 1, 0]), np.array([1, 3, 0, 1, 2, 3, 3, 2], np.int32), np.array([1, 2, 3, 4, 5, 6, 7, 8]))
    dense = np.zeros((6, 4))
    np.add.at(dense, (np.repeat(np.arange(6), rows.sizes), rows.numbers), rows.counts)
    x, y = np.arange(4) + 0.5, np.arange(6) - 2.5
    total = np.ones(4)
    rows.back(y, total)
    assert np.allclose(rows.times(x), dense @ x) and np.allclose(total, 1 + dense.T @ y)


def test_rows_without_counts_count_each_once():
    rows = terms.Rows(np.array([2, 0, 3]), np.array([1, 1, 0, 2, 0], np.int32))
    assert rows.times(np.array([1.0, 10.0, 100.0])).tolist() == [20, 0, 102]
    total = np.zeros(3)
    rows.back(np.array([1.0, 2.0, 3.0]), total)
    assert total.tolist() == [6, 2, 3]


def test_blocks_of_texts_are_bounded_and_keep_all(monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK_WORDS", 6)
    texts = ["a b", "c", "", "d e f g h i j k", "l", "m n o", "p q", "r"]
    batch = pa.RecordBatch.from_pydict({"label": pa.array(range(8), pa.float64()), "text": pa.array(texts)})
    parts = list(logistic._split(iter([batch.slice(0, 3), batch.slice(3, 3), batch.slice(6)])))
    assert [t for _, part in parts for t in part.to_pylist()] == texts
    assert np.concatenate([labels for labels, _ in parts]).tolist() == list(range(8))
    assert all(len(part) == 1 or sum(len(t.split(" ")) for t in part.to_pylist()) <= 6 for _, part in parts)


def test_a_word_is_gone_through_once_a_block(spark):
    samples = spark.createDataFrame([("password token", 1.0), ("token nothing", 0.0)] * 200, "text string, label double")
    known = _vocabulary(["password token nothing"])
    sent = spark.sparkContext.broadcast(terms.Vocabulary(pa.array(known)))
    blocks = logistic.text_blocks(samples.coalesce(1), sent).collect()
    assert sum(len(b.labels) for b in blocks) == 400 and sum(b.texts.counts.sum() for b in blocks) == 800
    assert sum(len(b.words.numbers) for b in blocks) == sum(sum(char_wb(w).values()) for w in ("password", "token", "nothing"))


def test_scores_are_those_of_the_stages(spark):
    rng = random.Random(1)
    texts = _texts(120)
    samples = spark.createDataFrame([(t, int("a" in t) ^ int(rng.random() < 0.1)) for t in texts], "text string, label int")
    model = classify.fit(samples)
    odd = [(t,) for t in _texts(40, 9)] + [(None,), ("  \t  ",), ("ÀÉ Σας ΑΣ İx",), ("A\nb\r\nC",)]
    rows = spark.createDataFrame(odd, "s string")
    both = classify._score_by_stages(classify.score(rows, "s", model, "p"), "s", model, "q")
    assert both.columns == ["s", "p", "q"]
    found = both.collect()
    assert len(found) == len(odd) and max(abs(r["p"] - r["q"]) for r in found) < 1e-12


def test_products_end_in_fewer_passes(spark):
    """The passes over all rows to the default tolerance, where a quasi-Newton method needs about twice as many."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = []
    for _ in range(3000):
        label = int(rng.random() < 0.8)
        rows.append((" ".join(words[min(2999, int(rng.paretovariate(0.4)) * (2 - label))] for _ in range(rng.randint(0, 30))), label))
    kept = []
    fit = logistic.fit
    try:
        logistic.fit = lambda *a: kept.append(fit(*a)) or kept[-1]
        classify.fit(spark.createDataFrame(rows, "text string, label int"))
    finally:
        logistic.fit = fit
    assert kept[0].passes < 45


def test_a_pass_leaves_no_shuffle_files(spark):
    kept = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = kept.size()
    parts = spark.sparkContext.parallelize(range(4), 4).flatMap(lambda i: [*logistic._slices(np.full(70_000, i * 1.0)), ("n", i)])
    vector, numbers = logistic._summed(parts, 70_000)
    assert (vector == 6).all() and len(vector) == 70_000 and numbers == {"n": 6}
    assert kept.size() <= before


def test_the_queries_hold_one_model(spark, tmp_path):
    places = []
    for name in ("one", "two"):
        place = tmp_path / name
        spark.createDataFrame(
            [(i, "src1", f"word{i % 7} text {i}") for i in range(60)], "doc_id long, source string, text string"
        ).write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{place}/labels.parquet")
        places.append(str(place))
    first = [catalog._model(spark, p)[0] for p in (places[0], places[0])]
    assert first[0] is first[1]
    catalog._model(spark, places[1])
    assert [key[1] for key in catalog._MODELS] == [places[1]]
    assert catalog.predict_pairs(spark, places[1]).filter(F.col("confidence").isNull()).count() == 0
