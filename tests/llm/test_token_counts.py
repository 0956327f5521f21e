import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credsieve.llm import token_counts as tc

PATH = public_tokenizers.path(tc.VOCABULARY)
PARTS = ["a", "b", " ", "  ", "\n", "'", "re", "'s", "'ll", "l", "!", "é", "漢", "😀", "\t", "1", "<|endoftext|>",
         "<|", "ing", "the", "\x1c", "\x85", " ", " ", "'ve", "'v", "aaaa", "    "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tc.PrefixCounts(PATH)


def test_every_prefix_as_the_library_counts_it(library, counter):
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        counts = counter.of_text(text)
        assert counts.tolist() == [library(text[:k]) for k in range(len(text) + 1)], repr(text)


def test_long_runs(library, counter):
    for text in ("a" * 3000, " " * 3000, "ab" * 2000, "é" * 1000, "the " * 3000):
        assert counter.of_text(text)[-1] == library(text)


def test_what_is_remembered_is_bounded(monkeypatch, library):
    """Long blobs are not kept, and short ones are forgotten when they hold too many bytes, within one text too."""
    monkeypatch.setattr(tc, "REMEMBERED_BYTES", 20_000)
    monkeypatch.setattr(tc, "REMEMBERED_PAIRS", 50)
    counter, rnd = tc.PrefixCounts(PATH), random.Random(9)
    words = ["".join(rnd.choice("abcdeé漢") for _ in range(rnd.choice([3, 9, 400]))) for _ in range(1500)]
    text = "  ".join(words)
    assert counter.of_text(text)[-1] == library(text)
    assert 0 < len(counter) and max(map(len, counter)) <= tc.REMEMBERED_CHARS
    assert sum(len(b.encode()) + len(c) for b, c in counter.items()) <= 20_000


def test_tables(spark, messy, clashing, no_docs, messy_rows, library):
    rows = tc.count_tokens(clashing, PATH, limit=20, prefixes=True).select("row.*", "n_bytes", "n_tokens", "fit_chars", "prefix_tokens").collect()
    assert len(rows) == len(messy_rows)
    assert {c for c in clashing.columns} <= set(rows[0].__fields__)
    for r in rows:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library(text))
        counts = np.frombuffer(r.prefix_tokens, "<i4")
        assert len(counts) == len(text) + 1 and counts[r.fit_chars] <= 20
        assert (counts[r.fit_chars + 1 :] > 20).all()
    assert tc.count_tokens(no_docs, PATH).count() == 0
