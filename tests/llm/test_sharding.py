from collections import defaultdict

from tables import CLASHING, SCHEMA

from credsieve.llm.sharding import shard


def check(rows, limit):
    """Shards partition the hash space, fit the limit, and were split only where they had to be."""
    shards = defaultdict(lambda: [0, 0])
    for r in rows:
        shards[r.shard][0] += r.n_bytes
        shards[r.shard][1] += 1
        assert len(r.shard) == r.depth and set(r.shard) <= {"0", "1"}
    for r in rows:
        assert [r.shard_bytes, r.shard_rows] == shards[r.shard]
        assert r.shard_bytes <= limit or r.shard_rows == 1
    for a in shards:
        assert not any(b != a and b.startswith(a) for b in shards)
        parent = a[:-1]
        inside = [v for b, v in shards.items() if b.startswith(parent)]
        assert not a or (sum(v[0] for v in inside) > limit and sum(v[1] for v in inside) > 1)


def test_messy_rows(clashing, messy_rows, no_docs):
    for limit in (10**9, 60_000, 2_000, 300):
        rows = shard(clashing, limit).collect()
        assert len(rows) == len(messy_rows)
        assert sum(r.n_bytes for r in rows) == sum(len((r[1] or "").encode()) for r in messy_rows)
        check(rows, limit)
    assert set(CLASHING) < set(rows[0].row.__fields__)
    assert shard(no_docs).count() == 0


def test_many_rows_of_one_id(spark):
    rows = [(7, "x" * 100, None, None, 1)] * 400 + [(None, "y" * 100, None, None, 1)] * 300 + [(i, "z" * 50, None, None, 1) for i in range(300)]
    found = shard(spark.createDataFrame(rows, SCHEMA).repartition(6), 3_000).collect()
    assert len(found) == 1000
    check(found, 3_000)
