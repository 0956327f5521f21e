import math
import zlib
from collections import Counter

import pytest
from tables import spaced_words

from credsieve.llm import lm_scoring


def brute_force(rows, order):
    """The model by its definition, with plain dictionaries."""
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2, ["<s>", *spaced_words(t), "</s>"]) for i, t, *_ in rows]
    counts = {k: Counter() for k in range(1, order + 1)}
    for _, train, words in texts:
        if train:
            for k in counts:
                for i in range(max(1, k - 1), len(words)):
                    counts[k][tuple(words[i - k + 1 : i + 1])] += 1
    total, known = sum(counts[1].values()), len(counts[1])
    n_texts = sum(train for _, train, _ in texts)
    discounts, mass = {}, {}
    for k in range(2, order + 1):
        n = [sum(v == c for v in counts[k].values()) for c in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        found = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        discounts[k] = [min(max(d, 0.05), c - 0.05) for d, c in zip(found, (1, 2, 3))]
        mass[k] = Counter()
        for gram, c in counts[k].items():
            mass[k][gram[:-1]] += discounts[k][min(c, 3) - 1]

    def probability(history, word):
        k = len(history) + 1
        if k == 1:
            return (counts[1][(word,)] + 1) / (total + known + 1)
        lower = probability(history[1:], word)
        seen = n_texts if history == ("<s>",) else counts[k - 1][history]
        if not seen:
            return lower
        c = counts[k][(*history, word)]
        return (c - discounts[k][min(c, 3) - 1] if c else 0) / seen + mass[k][history] / seen * lower

    for i, train, words in texts:
        base = sum(math.log10((counts[1][(w,)] + 1) / (total + known + 1)) for w in words[1:])
        score = sum(math.log10(probability(tuple(words[max(0, j - order + 1) : j]), words[j])) for j in range(1, len(words)))
        yield i, not train, len(words) - 1, sum(counts[1][(w,)] > 0 for w in words[1:]), total, base, score


def same(got, expected):
    """Exact but for the scores, whose discounts are exchanged to six digits."""
    got, expected = (sorted(map(tuple, rows), key=lambda r: repr((r[0], r[2], round(r[5])))) for rows in (got, expected))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)


@pytest.mark.parametrize(("order", "block"), [(2, 1 << 20), (3, 2000)])
def test_as_brute_force(clashing, messy_rows, monkeypatch, order, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    rows = lm_scoring.score_texts(clashing, order).collect()
    same(rows, list(brute_force(messy_rows, order)))


def test_probabilities_of_all_words_sum_to_one(spark):
    """One-word texts continue the same start: their chances, with the end's and the unknown's, are whole."""
    train = [(i, "a b a c a b d", None, None, None) for i in range(3, 9)]
    words = ["a", "b", "c", "d"]
    rows = [*train, *[(i, w, None, None, None) for i, w in enumerate(words, 100)], (200, "", None, None, None), (201, "zzz", None, None, None)]
    found = {r[0]: r for r in brute_force(rows, 2)}
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(frame).collect()}
    assert all(abs(got[i] - found[i][6]) < 1e-4 for i in got)


def test_no_rows(no_docs):
    assert lm_scoring.score_texts(no_docs).count() == 0


def test_no_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    frame = spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")
    assert {(r.train_tokens, r.score, r.n_known) for r in lm_scoring.score_texts(frame).collect()} == {(0, 0.0, 0)}
