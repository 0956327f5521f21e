"""Dataset quality and repair against plain Python."""

import hashlib
import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.operators import quality, repair
from credsieve.plans import scans

from test_text import entropy

WORDS = ["api_key=abc1", "token: xy", "plain words", "test", "short", "sk-live", "ÄÖ ü", "x" * 520]


def make_samples(spark, positives, negatives):
    rows = [(t, 1) for t in positives] + [(t, 0) for t in negatives]
    return spark.createDataFrame(rows, "text string, label int").repartition(4)


def random_texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def data():
    return random_texts(1, 300), random_texts(2, 90)


@pytest.fixture(scope="module")
def samples(spark, data):
    return make_samples(spark, *data).cache()


def test_basic_statistics(samples, data):
    row = quality.basic_statistics(samples).first()
    lengths = [len(t) for t in data[0]]
    assert (row["secrets_count"], row["non_secrets_count"], row["total_count"]) == (300, 90, 390)
    assert row["class_balance"] == pytest.approx(300 / 390)
    assert row["secrets_avg_length"] == pytest.approx(statistics.mean(lengths))
    assert row["secrets_length_std"] == pytest.approx(statistics.stdev(lengths))


def first_rule(text):
    for rule in settings.RULES:
        if re.search(rule.pattern, text, re.IGNORECASE):
            return rule.id
    return None


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_metrics(samples, data):
    row = quality.metrics(samples).first()
    pos, neg = Counter(data[0]), Counter(data[1])
    assert row["secrets_exact_duplicates"] == sum(n > 1 for n in pos.values())
    assert row["non_secrets_exact_duplicates"] == sum(n > 1 for n in neg.values())
    assert row["cross_class_duplicates"] == len(set(pos) & set(neg))
    assert row["secrets_duplicate_ratio"] == pytest.approx(
        sum(n > 1 for n in pos.values()) / len(data[0])
    )
    uncovered = [t for t in data[0] if not first_rule(t)]
    assert row["uncovered_secrets_count"] == len(uncovered)
    assert row["secrets_coverage_ratio"] == pytest.approx(1 - len(uncovered) / 300)
    assert row["rules_matching_secrets"] == len({first_rule(t) for t in data[0]} - {None})
    everything = data[0] + data[1]
    assert row["too_long"] == sum(len(t) > 512 for t in everything)
    assert row["potential_test_data"] == sum("test" in t for t in everything)
    assert row["contains_uppercase"] == sum(any(c.isupper() for c in t) for t in everything)
    assert row["entropy_mean"] == pytest.approx(statistics.mean(map(entropy, everything)))
    assert row["entropy_std"] == pytest.approx(statistics.stdev(map(entropy, everything)))
    assert row["non_secrets_length_std"] == pytest.approx(statistics.stdev(map(len, data[1])))


def test_entropy_statistics(samples, data):
    row = quality.entropy_statistics(samples).first()
    entropies = [entropy(t) for t in data[0] + data[1]]
    assert row["mean"] == pytest.approx(statistics.mean(entropies))
    assert row["median"] == pytest.approx(statistics.median(entropies))
    assert row["std"] == pytest.approx(statistics.stdev(entropies))


@pytest.mark.parametrize("seed", range(6))
def test_exact_median(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([rng.random() * 8, 2.5]), rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
    frame = spark.createDataFrame(rows, "v double, w int")
    expected = statistics.median([v for v, w in rows for _ in range(w)])
    assert quality.exact_median(frame, "v", "w", 0.01).first()[0] == expected


def test_coverage_and_examples(samples, data):
    rows = {r["first_rule"]: r["secrets"] for r in quality.rule_coverage(samples).collect()}
    assert rows == Counter(map(first_rule, data[0])) | {k: 0 for k in rows if not rows[k]}
    shown = [r["text"] for r in quality.uncovered_examples(samples, limit=3)
             .filter("category = 'secrets'").orderBy("place").collect()]
    assert shown == sorted({t for t in data[0] if not first_rule(t)})[:3]


def test_empty_classes(spark):
    nothing = make_samples(spark, ["token: a1b2c3"], []).filter("label = 2")
    row = quality.scorecard(quality.metrics(nothing)).first()
    assert row["total_count"] == 0 and row["secrets_coverage_ratio"] == 0.0
    assert row["secrets_length_mean"] == 0.0
    only = quality.basic_statistics(make_samples(spark, ["abc"], [])).first()
    assert only["non_secrets_avg_length"] == only["secrets_length_std"] == 0.0
    assert repair.repair(nothing).count() == 0


def scored(spark, **values):
    """A metric row that is fine in every respect but the given ones."""
    row = {
        "total_count": 60000, "class_balance": 0.5, "secrets_duplicate_ratio": 0.0,
        "non_secrets_duplicate_ratio": 0.0, "cross_class_duplicates": 0,
        "secrets_coverage_ratio": 1.0, "total_issues": 0, "uncovered_secrets_count": 0, **values,
    }
    return quality.scorecard(spark.createDataFrame([row]))


@pytest.mark.parametrize(
    "values, criterion, score, penalty",
    [
        ({}, "dataset_size", 10, 0),
        ({"total_count": 49999}, "dataset_size", 8, 0),
        ({"total_count": 999}, "dataset_size", 0, 20),
        ({"class_balance": 0.4}, "class_balance", 10, 0),
        ({"class_balance": 0.7}, "class_balance", 8, 0),
        ({"class_balance": 0.71}, "class_balance", 6, 10),
        ({"class_balance": 0.95}, "class_balance", 0, 10),
        ({"secrets_duplicate_ratio": 0.05}, "duplicates", 7, 0),
        ({"non_secrets_duplicate_ratio": 0.051}, "duplicates", 4, 10),
        ({"cross_class_duplicates": 60}, "cross_class", 5, 25),
        ({"cross_class_duplicates": 61}, "cross_class", 0, 25),
        ({"secrets_coverage_ratio": 0.7}, "rule_coverage", 4, 0),
        ({"secrets_coverage_ratio": 0.69}, "rule_coverage", 2, 20),
        ({"total_issues": 600}, "data_quality", 10, 0),
        ({"total_issues": 60000}, "data_quality", 0, 15),
    ],
)
def test_scorecard(spark, values, criterion, score, penalty):
    row = scored(spark, **values).first()
    assert row[f"score_{criterion}"] == score
    weighted = 10 - (10 - score) * settings.SCORE_WEIGHTS[criterion]
    assert row["quality_score_10"] == pytest.approx(weighted, abs=0.051)
    assert row["overall_quality_score"] == pytest.approx(weighted * 10 - penalty)


def test_recommendations(spark):
    bad = scored(spark, total_count=900, cross_class_duplicates=5, secrets_coverage_ratio=0.5,
                 class_balance=0.1, secrets_duplicate_ratio=0.06, total_issues=99,
                 uncovered_secrets_count=4)
    rows = quality.recommendations(bad).collect()
    assert [r["level"] for r in rows] == ["critical"] * 3 + ["warning"] * 3 + ["suggestion"] * 2
    assert [r["code"] for r in rows if r["fixable"]] == ["cross_class", "duplicates", "data_quality"]
    assert "50.0%" in rows[2]["message"]
    assert quality.recommendations(scored(spark)).count() == 0


def plain_repair(positives, negatives):
    """The repair in straight Python, on lists."""
    overlap = set(positives) & set(negatives)
    uncovered_rows = sum(not first_rule(t) for t in positives)

    def flagged(t):
        return (len(t) < 8 or len(t) > 512 or any(ord(c) < 32 and c not in "\t\n\r" for c in t)
                or any(w in t.lower() for w in settings.TEST_WORDS))

    pos = {t for t in positives if not flagged(t)}
    neg = {t for t in negatives if t not in overlap and not flagged(t)}
    if 0 < uncovered_rows < 0.3 * len(pos):
        pos = {t for t in pos if first_rule(t)}

    def ordered(texts):
        return sorted(texts, key=lambda t: (hashlib.md5(t.encode()).hexdigest(), t))

    pos, neg = ordered(pos), ordered(neg)
    if pos and neg:
        share = len(pos) / (len(pos) + len(neg))
        if share < 0.2:
            neg = neg[: len(pos) * 4]
        elif share > 0.8:
            pos = pos[: len(neg) * 4]
    return set(pos), set(neg)


@pytest.mark.filterwarnings("ignore::FutureWarning")
@pytest.mark.parametrize("n_pos, n_neg, covered", [(300, 90, True), (200, 6, True), (9, 250, True), (80, 80, False)])
def test_repair(spark, n_pos, n_neg, covered):
    rng = random.Random(n_pos)
    lead = "api_key=" if covered else "value "
    positives = [f"{lead}{rng.randint(0, n_pos)}abcdef" for _ in range(n_pos)] + ["nothing here"]
    negatives = [f"line number {rng.randint(0, 999)}" for _ in range(n_neg)] + positives[:3]
    negatives += ["tiny", "a\x01bcdefgh", "y" * 600, "an example here"]
    samples = make_samples(spark, positives, negatives)
    got = {(r["text"], r["label"]) for r in repair.repair(samples).collect()}
    pos, neg = plain_repair(positives, negatives)
    assert got == {(t, 1) for t in pos} | {(t, 0) for t in neg}
    report = {r["step"]: r["rows"] for r in repair.repair_report(samples).collect()}
    assert (report["secrets_after"], report["non_secrets_after"]) == (len(pos), len(neg))
    removed = sum(n for step, n in report.items() if step.startswith(("removed", "trimmed")))
    assert report["rows_before"] - removed == len(pos) + len(neg)


def test_one_text_may_fill_a_third_of_the_rows(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "api_key=hothot").otherwise(
            F.concat(F.lit("api_key="), "id")).alias("text"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    row = quality.duplicates(hot).first()
    assert (row["cross_class_duplicates"], row["secrets_exact_duplicates"]) == (1, 1)
    plan = quality.duplicates(hot)._jdf.queryExecution().toString()
    assert "partial_count" in plan


def test_report_before_and_after(samples):
    rows = scans.quality_before_after(samples).collect()
    values = {(r["stage"], r["metric"]): r["value"] for r in rows}
    assert values["before", "cross_class_duplicates"] > 0
    assert values["after", "cross_class_duplicates"] == 0
    assert values["after", "total_issues"] == 0
    assert values["after", "secrets_exact_duplicates"] == 0


def test_raw_line_issues(spark):
    lines = spark.createDataFrame(
        [(bytearray(b),) for b in (b"", b" \t", b"ok", b"\xff\xfe", b"")], "value binary"
    )
    assert tuple(quality.raw_line_issues(lines).first()) == (5, 2, 1, 1)
