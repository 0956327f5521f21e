"""Tables with nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F
from tables import CLASHING, SCHEMA, WORDS, sentence


@pytest.fixture(scope="session")
def messy_rows():
    rnd = random.Random(7)
    base = [sentence(rnd, 60) for _ in range(6)]
    rows = []
    for i in range(40):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 1))
    rows += [
        (100, None, None, None, None),
        (101, "", "en", "src0", 0),
        (102, " \t\n ", "en", None, 3),
        (103, "One", "en", "src1", 3),
        (104, "one", "en", "src1", 3),
        (105, "one two\x0bthree", "en", "src1", 3),
        (106, "x" * 50_000, "en", "src1", 50_000),
        (107, sentence(rnd, 20_000), "en", "src2", 1),
        (108, base[0], "en", "src0", 1),
        (108, base[0], "en", "src0", 1),
        (None, base[0], "en", "src0", 1),
        (None, None, None, None, None),
        (None, "lonely words that nobody else has at all", None, "", 1),
        (-5, base[0] + " tail", "en", "src0", 1),
        (2**62, "ΑΒΓ δ ε   é", "el", "ß", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(messy):
    """The same rows with extra columns, some named as the operators name theirs."""
    return messy.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
