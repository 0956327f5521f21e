import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from credsieve.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, vector int"


def brute_force(rows):
    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if usable(v) else None for _, v, *_ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids, default=None)
    return [(r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)]


def cloud(seed, noise, groups=12, size=15, single=150):
    rnd = np.random.RandomState(seed)
    vectors = [c + noise * rnd.randn(32) for c in rnd.randn(groups, 32) for _ in range(size)]
    vectors += list(rnd.randn(single, 32))
    random.Random(seed).shuffle(vectors)
    return [(i, [float(np.float32(x)) for x in v], i % 4, 0, 0) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("block", [2000, 4])
def test_tight_groups_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = cloud(1, 0.1)
    v = rows[0][1]
    rows += [(1000, v, None, 0, 0), (1001, v, 1, 0, 0), (1001, v, 1, 0, 0), (None, v, 1, 0, 0), (1002, None, 1, 0, 0)]
    rows += [(1003, [], 1, 0, 0), (1004, [0.0] * 32, 1, 0, 0), (1005, [float("nan"), *v[1:]], 1, 0, 0)]
    rows += [(1006, [None, *v[1:]], 1, 0, 0), (1007, [float("inf"), *v[1:]], 1, 0, 0), (1008, v[:5], 1, 0, 0), (1009, v[:5], 1, 0, 0)]
    rows += [(1010, [x * 1e30 for x in v], 1, 0, 0), (1011, [x * 1e-30 for x in v], 1, 0, 0), (-1, [-x for x in v], 1, 0, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in ed.link(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_force(rows)))


def test_recall_near_the_threshold(spark):
    """Groups whose members lie around the threshold: never a false link, and nine in ten found."""
    rows = cloud(3, 0.33, groups=30, size=12)
    expected = {r[0]: r[1] for r in brute_force(rows)}
    got = {r.vec_id: r.n_links for r in ed.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= expected[i] for i in expected)
    assert sum(expected.values()) > 500
    assert sum(got.values()) >= 0.9 * sum(expected.values())


@pytest.mark.parametrize("rows_in_all, cosine", [(600, 0.93), (2400, 0.93), (6000, 0.93), (2400, 0.97), (2400, 0.89)])
def test_recall_in_a_dense_group(spark, rows_in_all, cosine):
    """A third of the rows are one Gaussian group of a given mean cosine: never a false link, nine in ten found."""
    rnd = np.random.RandomState(rows_in_all)
    noise = np.sqrt((1 / cosine - 1) / 32)
    centre = rnd.randn(32)
    group = centre / np.linalg.norm(centre) + noise * rnd.randn(rows_in_all // 3, 32)
    vectors = np.vstack([group, rnd.randn(rows_in_all - len(group), 32)])[rnd.permutation(rows_in_all)]
    rows = [(i, [float(np.float32(x)) for x in v], 0, 0, 0) for i, v in enumerate(vectors)]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = ed.link(spark.createDataFrame(rows, SCHEMA)).collect()
    got = np.zeros(rows_in_all, int)
    for r in found:
        got[r.vec_id] = r.n_links
    assert len(found) == rows_in_all and (got <= expected).all()
    assert expected.sum() > rows_in_all
    assert got.sum() >= 0.9 * expected.sum()


def test_no_rows(spark):
    assert ed.link(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size, shift", [(64, 0.63), (256, 0.0), (256, 0.63)])
def test_recall_with_a_shared_direction_and_many_numbers(spark, tmp_path, size, shift):
    """20,000 vectors of a given mean cosine with groups around the threshold: nine links in ten are found, and far
    fewer pairs are candidates than there are."""
    rnd, n = np.random.RandomState(size), 20_000
    rest = rnd.randn(n, size)
    for a in range(0, n // 10, 4):
        rest[a : a + 4] = rnd.randn(size) + rnd.uniform(0.1, 0.38 if not shift else 0.62) * rnd.randn(4, size)
    mean = rnd.randn(size)
    vectors = np.sqrt((1 - shift) / size) * rest + np.sqrt(shift) * mean / np.linalg.norm(mean)
    vectors = vectors[rnd.permutation(n)].astype(np.float32)
    flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * size, vectors.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat}), tmp_path / "v.parquet")
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = np.concatenate([(unit[a : a + 2000] @ unit.T >= 0.9).sum(axis=1) for a in range(0, n, 2000)]) - 1
    got = np.zeros(n, int)
    for r in ed.link(spark.read.parquet(str(tmp_path / "v.parquet"))).collect():
        got[r.vec_id] = r.n_links
    assert (got <= expected).all() and expected.sum() > 2000
    assert got.sum() >= 0.95 * expected.sum()
    known = ed._pivots(unit[:512], 0.9)
    assert len(known.points) > 400 and not len(known.groups)
    near = np.argsort(-(ed._centred(unit[:1000], known.mean) @ known.centred.T), axis=1, kind="stable")[:, : ed.NEAREST]
    likely = sum((np.isin(near[i + 1 :], near[i]).sum(axis=1) >= ed.SHARED).sum() for i in range(1000))
    assert likely < 0.02 * 1000 * 999 / 2


def test_merged_lists_count_shared_pivots():
    """Against plain sets: shared pivots of similar rank, in the first list of a pair only."""
    rnd = np.random.RandomState(5)
    near = [rnd.permutation(20)[: ed.NEAREST].astype(np.int32) for _ in range(60)]
    around = [np.flatnonzero(rnd.rand(3) < 0.1).astype(np.int32) for _ in range(60)]
    times = np.zeros((60, 60), int)
    for pivot in range(20):
        own = [i for i in range(60) if pivot in np.sort(near[i])[: ed.NEAREST - 6 + 1]]
        if not own:
            continue
        marks = [near[i] for i in own]
        groups = [around[i] for i in own]
        times[np.ix_(own, own)] += ed._merge(False, pivot, (marks, marks), (groups, groups), 6)
    for i in range(60):
        for j in range(60):
            ranks = [abs(near[i].tolist().index(p) - near[j].tolist().index(p)) for p in set(near[i]) & set(near[j])]
            meets = sum(r <= ed.RANKS for r in ranks) >= 6 and not set(around[i]) & set(around[j])
            assert times[i, j] == meets
