"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest reference points in their order, nearest first. There is one
inverted list for each pivot. Two vectors are candidates when they share enough of their nearest pivots at
similar ranks: the lists of the other pivots are merged within each list and count that. Candidates are
verified by cosine in double precision, so no pair below the threshold is linked; a pair whose pivots differ
too much may be missed, which the tests measure against brute force. Who must share ``shared`` of ``nearest``
pivots shares one of the first ``nearest - shared + 1`` by number, so a vector goes to the lists of those only.

Pivots are a bounded sample, about as many as the root of the number of vectors allows, thinned so that no
two are near each other: pivots within one dense group would be told apart by noise only, and its members
would not agree on them. What is near follows from the distances in the sample, and pivots are ranked after
the sample's mean is taken off, so a direction that all vectors share neither thins the pivots nor makes some
of them near to all. All vectors are indexed, whatever the number of pivots. A vector close to a pivot of a dense group is
listed under that pivot alone, and so is every vector that could link with it by the triangle inequality:
links inside a group around a pivot are all found, in one list. Bitwise equal vectors are one node with a count. A
long list is cut into blocks, and each pair of its blocks is one task, so no task holds more than two blocks. A pair
that meets in several lists is counted in the first of them only. Tasks return counts and links that connect, not pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing
and are their own component; vectors of different lengths do not link; repeated rows link with each
other; an empty table gives an empty result; extra columns, labels among them, are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import staged
from credsieve.llm.graph import Sets, components

THRESHOLD = 0.9
#: Nearest pivots that describe a vector, how many of them two vectors must share, and by how much the
#: ranks of a shared pivot may differ.
NEAREST = 12
SHARED = 3
RANKS = 8
#: Pivots at most (a broadcast of 16 bytes for each of their numbers), and the fewest.
MAX_PIVOTS = 16_384
MIN_PIVOTS = 32
#: Pivots are further apart than this part of the sample's median distance; a dense group lies within it
#: together with all that could link with its members.
APART = 0.7
#: A pivot with so many vectors of the sample close around it stands for a dense group.
DENSE = 8
#: Vectors of a list that are verified together, and vectors described at once.
BLOCK = 2000
DESCRIBED = 1000


class Pivots(NamedTuple):
    """Reference points for vectors of one length."""

    points: np.ndarray  # of length 1
    mean: np.ndarray
    centred: np.ndarray  # the points without the mean, of length 1
    groups: np.ndarray  # numbers of those that stand for dense groups
    around: float  # distance within which such a pivot covers a vector
    reach: float  # distance within which lies all that links with a covered vector


def _normed(vectors: np.ndarray) -> np.ndarray:
    """Scaled first, so that no finite vector over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _centred(unit: np.ndarray, mean: np.ndarray) -> np.ndarray:
    moved = unit - mean
    return moved / np.maximum(np.sqrt((moved * moved).sum(axis=1, keepdims=True)), 1e-12)


def _distances(unit: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ points.T)))


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles, usable): whether the vector can link at all."""
    numbers = F.col("embedding").cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(numbers, lambda x: x != 0)
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        numbers.alias("vector"),
        F.coalesce(fine & some, F.lit(False)).alias("usable"),
    )


def _pivots(sample: np.ndarray, threshold: float) -> Pivots:
    """The sample without points that are near one before them."""
    unit = _normed(sample)
    some = unit[:1000]
    pairs = _distances(some, some)[np.triu_indices(len(some), 1)]
    reach = APART * float(np.median(pairs)) if len(pairs) else 0.0
    around = reach - math.sqrt(max(0.0, 2 - 2 * threshold)) - 1e-9
    kept, n = np.empty_like(unit), 0
    for point in unit:
        if not n or _distances(kept[:n], point[None, :]).min() >= reach:
            kept[n] = point
            n += 1
    points = kept[:n].copy()
    close = np.concatenate([(_distances(points[a : a + 500], unit) <= around).sum(axis=1) for a in range(0, n, 500)])
    mean = unit.mean(axis=0)
    return Pivots(points, mean, _centred(points, mean), np.flatnonzero(close >= DENSE), around, reach)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Bytes of each vector, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    exact = (single == vectors).all(axis=1)
    return [a.tobytes() if e else b.tobytes() for a, b, e in zip(single, vectors, exact)]


def _unpacked(rows: list[bytes], size: int) -> np.ndarray:
    return _normed(np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * size else np.float64).astype(np.float64) for r in rows]))


def _describe(pivots, nearest: int, shared: int):
    """Each vector once for every list it goes to: of the pivots of dense groups in reach and, unless one of
    them covers it, of the first of its nearest pivots by number."""

    def lists(vectors: np.ndarray, known: Pivots):
        """For each vector its nearest pivots in order, groups in reach, and whether one covers it."""
        unit = _normed(vectors)
        take = min(nearest, len(known.points))
        likeness = _centred(unit, known.mean) @ known.centred.T
        near = np.argsort(-likeness, axis=1, kind="stable")[:, :take].astype(np.int32)
        away = _distances(unit, known.points[known.groups])
        return near, away <= known.reach, (away <= known.around).any(axis=1)

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector")).to_numpy()
            for size in np.unique(sizes).tolist():
                known = pivots.value[size]
                places = np.flatnonzero(sizes == size)
                for first in range(0, len(places), DESCRIBED):
                    part = batch.take(pa.array(places[first : first + DESCRIBED]))
                    vectors = pc.list_flatten(part.column("vector")).to_numpy().reshape(-1, size)
                    near, reached, covered = lists(vectors, known)
                    x, g = np.nonzero(reached)
                    most = near.shape[1] - min(shared, near.shape[1]) + 1
                    open_ = np.flatnonzero(~covered)
                    own = np.sort(near[open_], axis=1)[:, :most]
                    rows = pa.array(np.concatenate([x, np.repeat(open_, own.shape[1])]))
                    around = [known.groups[r].astype(np.int32).tobytes() for r in reached]
                    columns = {
                        "size": np.full(len(rows), size, np.int32),
                        "dense": np.arange(len(rows)) < len(x),
                        "pivot": np.concatenate([known.groups[g], own.ravel()]).astype(np.int32),
                        "node": part.column("node").take(rows),
                        "copies": part.column("copies").take(rows),
                        "vector": pa.array(_packed(vectors), pa.binary()).take(rows),
                        "near": pa.array([n.tobytes() for n in near], pa.binary()).take(rows),
                        "around": pa.array(around, pa.binary()).take(rows),
                    }
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return run


class _Postings:
    """Within one block of a list: for each mark its vectors, and the ranks they give it."""

    def __init__(self, marks: list[np.ndarray]) -> None:
        lengths = np.array([len(m) for m in marks])
        flat = np.concatenate(marks)
        order = np.argsort(flat, kind="stable")
        self.rows = np.repeat(np.arange(len(marks)), lengths)[order]
        self.ranks = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
        self.marks, first = np.unique(flat[order], return_index=True)
        self.spans = dict(zip(self.marks.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(flat)])))

    def of(self, mark: int):
        start, end = self.spans[mark]
        return self.rows[start:end], self.ranks[start:end]


def _merge(dense: bool, pivot: int, near, around, shared: int) -> np.ndarray:
    """Which pairs of two blocks are candidates that no earlier list has.

    Lists of dense groups come first, then those of nearest pivots by number. In these, the lists of all other
    pivots are merged and count how many each pair shares at similar ranks.
    """
    one, two = (_Postings(marks) for marks in around)
    candidate = np.ones((len(around[0]), len(around[1])), bool)
    for mark in np.intersect1d(one.marks, two.marks).tolist():
        if not dense or mark < pivot:
            candidate[np.ix_(one.of(mark)[0], two.of(mark)[0])] = False
    if dense:
        return candidate
    one, two = (_Postings(marks) for marks in near)
    counts = np.zeros(candidate.shape, np.uint8)
    for mark in np.intersect1d(one.marks, two.marks).tolist():
        (a, ranks_a), (b, ranks_b) = one.of(mark), two.of(mark)
        if mark < pivot:
            candidate[np.ix_(a, b)] = False
        else:
            counts[np.ix_(a, b)] += np.abs(ranks_a[:, None] - ranks_b[None, :]) <= RANKS
    return candidate & (counts >= shared)


def _close(a: np.ndarray, b: np.ndarray, candidate: np.ndarray, threshold: float):
    """Rows and columns of candidates whose cosine reaches the threshold."""
    found = []
    for start in range(0, len(a), 500):
        rows = slice(start, start + 500)
        x, y = np.nonzero(candidate[rows])
        if 20 * len(x) < candidate[rows].size:
            cosines = [np.einsum("ij,ij->i", a[rows][x[i : i + 50_000]], b[y[i : i + 50_000]]) for i in range(0, len(x), 50_000)]
            good = np.concatenate([*cosines, np.empty(0)]) >= threshold
        else:
            good = (a[rows] @ b.T)[x, y] >= threshold
        found.append((x[good] + start, y[good]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _verify(threshold: float, shared: int):
    def run(key, table):
        """Counts of links by node, and links that connect, of one list or pair of its blocks."""
        size, dense, pivot, first, second = (k.as_py() for k in key)
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        nodes, copies, blocks = (table.column(c).to_numpy() for c in ("node", "copies", "own"))
        unit = _unpacked(table.column("vector").to_pylist(), size)
        near, around = ([np.frombuffer(m, np.int32) for m in table.column(c).to_pylist()] for c in ("near", "around"))
        counts, connected, links = np.zeros(len(nodes), np.int64), Sets(len(nodes)), []
        left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
        if len(left) and len(right):
            both = [[[m[i] for i in side] for side in (left, right)] for m in (near, around)]
            needed = min(shared, len(near[0]))
            candidate = _merge(dense, pivot, *both, needed)
            if first == second:
                candidate = np.triu(candidate, 1)
            x, y = _close(unit[left], unit[right], candidate, threshold)
            x, y = left[x], right[y]
            np.add.at(counts, x, copies[y])
            np.add.at(counts, y, copies[x])
            links = [(i, j) for i, j in zip(x.tolist(), y.tolist()) if connected.join(i, j)]
        linked = np.flatnonzero(counts)
        x, y = (np.array(v, dtype=np.int64) for v in zip(*links)) if links else (np.empty(0, np.int64),) * 2
        none = np.full(len(links), -1)
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes[linked], nodes[x]]), pa.int64()),
                "b": pa.array(np.concatenate([np.full(len(linked), -1), nodes[y]]), pa.int64(), mask=np.arange(len(linked) + len(links)) < len(linked)),
                "n_links": pa.array(np.concatenate([counts[linked], none]), pa.int64()),
            }
        )

    return run


def link(vectors: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    rows = staged(_usable(vectors).withColumn("row", F.monotonically_increasing_id()))
    classes = rows.filter("usable").groupBy("vector").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    classes = staged(classes)
    total = classes.count()
    n_pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, 2 ** math.ceil(math.log2(2 * math.sqrt(max(1, total))))))
    points: dict[int, list] = {}
    for r in classes.sort(F.xxhash64("vector"), "node").limit(n_pivots).select("vector").collect():
        points.setdefault(len(r.vector), []).append(r.vector)
    for r in classes.groupBy(F.size("vector")).agg(F.first("vector").alias("vector")).collect():
        points.setdefault(len(r.vector), [r.vector])  # lengths that the sample has not met
    pivots = spark.sparkContext.broadcast({d: _pivots(np.array(v, dtype=np.float64), threshold) for d, v in points.items()})
    listed = "size int, dense boolean, pivot int, node bigint, copies bigint, vector binary, near binary, around binary"
    keyed = staged(classes.select("node", "copies", "vector").mapInArrow(_describe(pivots, nearest, shared), listed))
    key = ["size", "dense", "pivot"]
    lists = keyed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    lists = lists.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = keyed.join(lists, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "node", "own", "copies", "vector", "near", "around")
    found = staged(met.groupBy(*key, "one", "two").applyInArrow(_verify(threshold, shared), "a bigint, b bigint, n_links bigint"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("others"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    placed = classes.join(counts, "node", "left").join(roots, "node", "left")
    placed = staged(
        placed.select(
            "node", "vector", "least", F.coalesce("root", "node").alias("root"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = placed.join(named, "root").select("vector", "n_links", "component_id")
    linked = rows.filter("usable").join(by_vector, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
