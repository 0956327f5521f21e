"""Language identification: the kernel against its definition, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from credsieve.llm import language_id as li

PARTS = {
    "aa": "ba ka lo mi nu".split(),
    "bb": "shra ter wend ost ing".split(),
    "cc": "ça été aux eau que".split(),
    "dd": "жа ко ли ста ров".split(),
}


def text_of(rnd, lang, words):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(words))


def made(n, seed=1):
    rnd = random.Random(seed)
    langs = ["aa", "aa", "aa", *PARTS]  # one is hot
    return [(i, text_of(rnd, lang, rnd.randint(2, 60)), lang) for i in range(n) for lang in [rnd.choice(langs)]]


def cells(text):
    row = np.zeros(li.CELLS, np.float32)
    li.mark_presence(text, row)
    return set(np.flatnonzero(row).tolist())


def plain_cells(text):
    """The n-grams of the normalised text one by one."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    normal = " " + " ".join(kept.split()) + " " if kept.strip() else " "
    out = set()
    for n in li.ORDERS:
        for i in range(len(normal) - n + 1):
            row = np.zeros(li.CELLS, np.float32)
            li._mark(np.array([ord(c) for c in normal[i : i + n]], np.uint32), row)
            # Marking a gram marks its own prefixes and parts too, all of which are grams of the text.
            out |= set(np.flatnonzero(row).tolist())
    return out


def test_presence_is_that_of_the_grams(monkeypatch):
    for text in ("The quick, BROWN fox!", "één  twee\n\ndrie 123 vier", "x", " a b ", "--a", "b?!", "Straße-ИВАН 日本"):
        assert cells(text) == plain_cells(text)
    long = text_of(random.Random(2), "bb", 300)
    whole = cells(long)
    monkeypatch.setattr(li, "PIECE", 7)
    assert cells(long) == whole


def test_repetition_does_not_count():
    assert cells("abc def " * 50) - cells("abc def abc") == set()


def test_weights_are_landmarks_times_coefficients(spark):
    """The values of the model equal kernel ridge regression written out over the Nyström features."""
    rows = made(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = li.fit(docs)
    assert model.languages == sorted(PARTS)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    matrix, _ = li.presence([r[1] for r in learned])
    order = sorted(range(len(learned)), key=lambda i: (learned[i][2], zlib.crc32(f"sample:{learned[i][0]}".encode())))
    each, chosen = li.LANDMARKS // len(PARTS), []
    for lang in sorted(PARTS):
        chosen += [i for i in order if learned[i][2] == lang][:each]
    marks = matrix[chosen]

    def kernel(x, y):
        shared = x @ y.T
        return shared / np.sqrt(np.outer(x.sum(1), y.sum(1)))

    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    some = values > 1e-8 * values[-1]
    root = vectors[:, some] / np.sqrt(values[some])
    features = kernel(matrix, marks) @ root
    goal = np.array([[1.0 if r[2] == lang else -1.0 for lang in sorted(PARTS)] for r in learned])
    gram = features.T @ features
    ridge = li.RIDGE * np.trace(gram) / len(gram)
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), features.T @ goal)
    assert np.allclose(model.values(matrix), features @ solved, atol=1e-3)


def test_held_out_accuracy(spark):
    rows = made(1200, 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = li.identify(docs).select("row.doc_id", "row.lang", "held_out", "lang_pred", "score").collect()
    assert len(found) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = made(300, 8)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    results = []
    for given in (rows, wrong):
        docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string").repartition(3)
        found = li.identify(docs).select("row.doc_id", "lang_pred", F.round("score", 4)).collect()
        results.append(sorted(map(tuple, found)))
    assert results[0] == results[1]


def test_messy_rows(clashing, messy_rows):
    found = li.identify(clashing.withColumn("held_out", F.lit("x")).withColumn("bits", F.lit(1))).collect()
    assert len(found) == len(messy_rows)
    assert set(found[0]["row"].asDict()) >= {"doc_id", "text", "held_out", "bits", "row"}
    for r in found:
        text = r["row"]["text"]
        empty = not any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == empty
        assert r["score"] == 0 if empty else 0 <= r["score"] <= 1
        if r["row"]["doc_id"] is None:
            assert r["held_out"]


def test_nothing_to_learn_from(spark, no_docs):
    assert li.identify(no_docs).collect() == []
    docs = spark.createDataFrame([(1, "some text", None), (None, "more", "en")], "doc_id bigint, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in li.identify(docs).collect()} == {("und", 0.0)}
