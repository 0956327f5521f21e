import pytest
from tables import CLASHING, SCHEMA, spaced_words

from credsieve.llm import mixing


def expected_targets(sizes):
    """Filled by hand: share the rest by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = mixing.SHARE * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > 2 * sizes[s]}
        if not full:
            target.update({s: left * weights[s] / total for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


def check(docs, rows):
    plan = mixing.plan_mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(spaced_words(r[1]))
    target = expected_targets(sizes)
    assert len(plan) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in plan:
        assert r.size == len(spaced_words(r.row.text)) and r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(target[r.row.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.row.source] += r.taken
    for s in sizes:
        largest = max(len(spaced_words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6
    return plan


def test_messy_rows(clashing, messy_rows):
    plan = check(clashing, messy_rows)
    again = mixing.plan_mix(clashing.repartition(5)).collect()
    assert sorted(repr((r.row.doc_id, r.size, r.taken, r.first_position)) for r in plan) == sorted(
        repr((r.row.doc_id, r.size, r.taken, r.first_position)) for r in again
    )


def test_hot_source_over_many_bins(spark):
    rows = [(i, "w " * (1 + i % 9), None, "hot" if i % 3 else f"s{i % 4}", 1) for i in range(3000)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_mixed_documents(clashing, messy_rows, no_docs):
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and set(CLASHING) < set(mixed.columns)
    passes = sum(r.passes for r in mixing.plan_mix(clashing).collect())
    assert mixed.count() == passes
    assert mixing.mix(no_docs).count() == 0 and mixing.plan_mix(no_docs).count() == 0


def test_weights_move_in_time(spark):
    """A source whose weight rises comes later on average than one whose weight falls."""
    rows = [(i, "w w w", None, f"s{i % 3}", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    order = [r.source for r in mixing.mix(docs).collect()]
    mean = {s: sum(i for i, x in enumerate(order) if x == s) / order.count(s) for s in set(order)}
    assert mean["s0"] < mean["s1"] < mean["s2"]
    half = order[: len(order) // 2].count("s0") / order.count("s0")
    assert half == pytest.approx(0.625, abs=0.03)  # the integral of the falling schedule to the middle
