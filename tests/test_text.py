"""Column functions against plain Python."""

import itertools
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions import text as tx
from credsieve.functions.urls import repository_parts

TEXTS = [
    "", " ", "a", "ab", "abc", "Hello  World\t!", "été à la mode", "中文 字符", "😀😀 a😀b c",
    "x² y³ ¹", "①② ⁴₅", "٣ digits", "ǅ title", "\x1cpad\x1f", " line ", "ªº", "aaaa",
    "tab\tonly", "İstanbul ſt K", "a" * 300, "test-Sample", "\x01ctl", "\n", "x\ny",
]


def values(spark, column, texts=TEXTS, schema="text string"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {schema}")
    rows = frame.select("i", column.alias("v")).collect()
    return [row["v"] for row in sorted(rows, key=lambda r: r["i"])]


def test_extension_is_splitext(spark):
    names = ["".join(c) for n in range(1, 6) for c in itertools.product("a.b ", repeat=n)]
    names += ["x.tar.gz", "IMG.PNG", "types.d.ts", ".env", "Dockerfile", "a.", "old.java~", "..", "é.É"]
    expected = [os.path.splitext(n)[1].lower() for n in names]
    assert values(spark, tx.extension(F.col("text")), names) == expected


def test_strip_and_blank(spark):
    assert values(spark, tx.strip(F.col("text"))) == [t.strip() for t in TEXTS]
    assert values(spark, tx.is_blank(F.col("text"))) == [not t.strip() for t in TEXTS]


def test_mask(spark):
    assert values(spark, tx.mask(F.col("text")), ["", "abc", "abcd", "secret1"]) == [
        "", "***", "abcd", "secr***",
    ]


def test_relative_path(spark):
    got = values(
        spark, tx.relative_path(F.col("text"), "/tmp/x"),
        ["/tmp/x/a/b.py", "/tmp/x\\a\\b.py", "other/c", "/tmp/x"],
    )
    assert got == ["a/b.py", "a/b.py", "other/c", ""]


@pytest.mark.parametrize(
    "column, check",
    [
        (tx.has_digit, lambda s: any(c.isdigit() for c in s)),
        (tx.has_upper, lambda s: any(c.isupper() for c in s)),
        (tx.has_lower, lambda s: any(c.islower() for c in s)),
        (tx.has_special, lambda s: any(not c.isalnum() and not c.isspace() for c in s)),
        (tx.is_alphanumeric, lambda s: s.isalnum()),
    ],
)
def test_character_classes(spark, column, check):
    points = list(range(1, 0x600)) + list(range(0x2000, 0x2600)) + [0x4E2D, 0x1F600, 0x1D7CE]
    texts = TEXTS + [chr(p) for p in points]
    got = values(spark, column(F.col("text")), texts)
    assert [t for t, g in zip(texts, got) if g != check(t)] == []


def test_prefixes(spark):
    got = values(spark, tx.prefix_hits(F.col("text")), ["SK-1", "api_x", "key", "auth_ token_"])
    assert got == [["sk-"], ["api_"], [], ["auth_"]]


def test_quality_flags(spark):
    for name, column in tx.quality_flags(F.col("text")).items():
        check = {
            "empty_strings": lambda s: not s,
            "too_short": lambda s: 0 < len(s) < 8,
            "too_long": lambda s: len(s) > 512,
            "whitespace_only": str.isspace,
            "non_printable_chars": lambda s: any(ord(c) < 32 and c not in "\t\n\r" for c in s),
            "potential_test_data": lambda s: any(w in s.lower() for w in settings.TEST_WORDS),
        }[name]
        texts = [*TEXTS, "x" * 512, "x" * 513, "1234567", "12345678", "a\rb"]
        assert values(spark, column, texts) == [check(t) for t in texts], name


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def test_entropy(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("abcé中😀 \n.", k=rng.randint(1, 99))) for _ in range(200)]
    for got, text in zip(values(spark, tx.shannon_entropy(F.col("text")), texts), texts):
        assert got == pytest.approx(entropy(text) if text else 0.0, abs=1e-12)


def char_wb(text, smallest=3, largest=5):
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(smallest, largest + 1):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return Counter(grams)


def test_ngrams(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices("aBé中😀 \t.\x1c", k=rng.randint(1, 40))) for _ in range(300)]
    for got, text in zip(values(spark, tx.char_ngrams("text"), texts), texts):
        assert Counter(got) == char_wb(text), repr(text)


def test_repository_parts(spark):
    urls = [
        "https://host.example/coll/team/proj/_git/repo", "https://host.example/proj/_git/repo/",
        "http://h/_git/repo", "http://h/proj/_git", "http://h/a/b", "https://h:80/c/p/_git/r?x=1",
    ]
    got = values(spark, repository_parts(F.col("text")), urls)
    assert [tuple(r)[:4] for r in got[:2]] == [
        ("host.example", "coll/team", "proj", "repo"), ("host.example", "", "proj", "repo"),
    ]
    assert [r["problem"] is None for r in got] == [True, True, False, False, False, True]
    assert tuple(got[5])[:4] == ("h:80", "c", "p", "r")
