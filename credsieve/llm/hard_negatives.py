"""Hard negatives for contrastive training: rows close to an anchor that carry another label.

Scores are exact inner products of whole-number vectors. Anchors and candidates are packed into tiles of
64-bit integers, and the product of an anchor tile and a candidate tile is taken by Strassen's recursion:
the matrices are cut in four (odd sides padded with zeros), seven half-size products and eighteen additions
give the whole. Only sums, differences and products of integers occur, so the result is exact.

The scores of a tile are never kept. Two passes over the tiles keep heaps instead, which merge: the first
keeps for every anchor its best rows of the same label; the second keeps for every anchor and positive the
best rows of other labels inside the positive's score window. A task works through a run of candidate tiles
for one block of anchors and merges its heaps tile by tile; the heaps of all tasks are merged by a ranked
window, of which Spark ranks each task's rows before the shuffle.

Every anchor meets every row, in blocks: each candidate tile is sent once to each block of ``ANCHORS``
anchors, and a task's run of at most ``RUN_TILES`` tiles streams through it. So no task holds more than one
block, one tile and their scores, whatever the number of rows; hot labels change nothing, as labels only
mask scores.

Defined cases: rows with a null id, label or vector, or any null or non-finite component, take no part, nor
do those with a component of 1,024 or more in size (their products could leave 64 bits). Vectors of different
lengths are padded with zeros; an empty vector scores 0 with all. Of rows with the same id the smallest (label,
vector) stands for all. Ties go to the smaller id. Anchors without positives, and positives without
negatives in their window, give no rows. Empty tables give empty results; only the named columns are read,
so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import staged

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of the positive's score.
WINDOW = (50, 95)
SCALE = 256
#: Anchors of a block, rows of a candidate tile, and tiles that one task takes for a block at most.
ANCHORS, TILE, RUN_TILES = 512, 2048, 64
#: Sides from which on a product is cut in four.
CUT = 32
_LARGEST = 1 << 10
_NONE = np.iinfo(np.int64).min  # the score of an empty place in a heap
_NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, exact."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= CUT:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        padded = strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))
        return padded[:m, :n]
    i, j, l = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((m, n), np.int64)
    p = strassen(a11 + a22, b11 + b22)
    out[:i, :l], out[i:, l:] = p, p
    p = strassen(a21 + a22, b11)
    out[i:, :l] = p
    out[i:, l:] -= p
    p = strassen(a11, b12 - b22)
    out[:i, l:] = p
    out[i:, l:] += p
    p = strassen(a22, b21 - b11)
    out[:i, :l] += p
    out[i:, :l] += p
    p = strassen(a11 + a12, b22)
    out[:i, :l] -= p
    out[:i, l:] += p
    out[i:, l:] += strassen(a21 - a11, b11 + b12)
    out[:i, :l] += strassen(a12 - a22, b21 + b22)
    return out


class Heaps:
    """The ``size`` best (score, id) of each of many owners; scores first, then smaller ids. They merge."""

    def __init__(self, shape: tuple[int, ...], size: int) -> None:
        self.scores = np.full((*shape, size), _NONE)
        self.ids = np.full((*shape, size), _NO_ID)

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        size = self.scores.shape[-1]
        scores, ids = np.concatenate([self.scores, scores], -1), np.concatenate([self.ids, ids], -1)
        order = np.lexsort((ids, ~scores), axis=-1)[..., :size]  # ~x orders like -x and cannot overflow
        self.scores, self.ids = np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _ranked(scores: np.ndarray, mask: np.ndarray, most: int | None) -> np.ndarray:
    """Columns of each row that the mask keeps, best score first, then from left to right; -1 beyond."""
    columns = scores.shape[1]
    key = np.where(mask, scores * columns + (columns - 1 - np.arange(columns)), _NONE)
    if most is not None and most < columns:
        key = np.partition(key, columns - most, axis=1)[:, columns - most :]
    key.sort(axis=1)
    key = key[:, ::-1]
    return np.where(key == _NONE, -1, columns - 1 - np.mod(key, columns))


def _picked(values: np.ndarray, columns: np.ndarray, empty: int) -> np.ndarray:
    return np.where(columns < 0, empty, np.take_along_axis(values, np.maximum(columns, 0), 1))


# --- tiles -----------------------------------------------------------------------------------


def usable(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that take part; v holds the whole-number components."""
    x = F.col(embedding)
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    sound = F.when(F.forall(x, fit), whole)
    named = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), sound.alias("v"))
    taking_part = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    one = taking_part.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("id", "row.label", "row.v")


def _packed_tiles(rows: DataFrame, size: int, tag: str) -> DataFrame:
    """Runs of rows as single rows (tile, n, width, and id, label, v and what else there is as binaries)."""
    more = [c for c in rows.columns if c not in ("id", "label", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def tile() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).sort_by("id").combine_chunks()
            v = table.column("v").combine_chunks()
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(table), int(sizes.max(initial=0))), np.int32)
            filled = np.arange(matrix.shape[1]) < sizes[:, None]
            matrix[filled] = v.flatten().to_numpy()
            columns = [table.column(c).to_numpy().astype(np.int64) for c in ("id", "label")]
            lists = [np.array(table.column(c).to_pylist(), np.int64) for c in more]
            out = [TaskContext.get().partitionId() << 32 | number, len(table), matrix.shape[1]]
            out += [x.tobytes() for x in (*columns, matrix, *lists)]
            number += 1
            names = [tag, "n", "width", "id", "label", "v", *more]
            types = [pa.int64()] * 3 + [pa.binary()] * (3 + len(more))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types)], names=names)

        for batch in batches:
            while len(batch):
                room = size - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == size:
                    yield tile()
                    held.clear()
        if held:
            yield tile()

    binaries = "".join(f", {c} binary" for c in ("id", "label", "v", *more))
    # Full tiles, also where many tasks hold a few rows each.
    tasks = max(1, -(-rows.count() // (8 * size)))
    return rows.coalesce(tasks).mapInArrow(run, f"{tag} bigint, n bigint, width bigint{binaries}")


class _Tile:
    def __init__(self, row: dict) -> None:
        n, width = row["n"], row["width"]
        self.ids = np.frombuffer(row["id"], np.int64)
        self.labels = np.frombuffer(row["label"], np.int64)
        self.v = np.frombuffer(row["v"], np.int32).reshape(n, width).astype(np.int64)

    def scores(self, other: "_Tile") -> np.ndarray:
        """The inner products of own and other rows; the shorter vectors go on as zeros."""
        width = min(self.v.shape[1], other.v.shape[1])
        return strassen(np.ascontiguousarray(self.v[:, :width]), np.ascontiguousarray(other.v[:, :width].T))


class _SameLabel:
    """For a block of anchors: their best other rows of the same label."""

    schema = "anchor bigint, positive bigint, score bigint"

    def __init__(self, row: dict) -> None:
        self.anchors = _Tile(row)
        self.heaps = Heaps((row["n"],), POSITIVES)

    def see(self, tile: _Tile) -> None:
        anchors = self.anchors
        scores = anchors.scores(tile)
        mask = (anchors.labels[:, None] == tile.labels) & (anchors.ids[:, None] != tile.ids)
        best = _ranked(scores, mask, POSITIVES)
        ids = np.where(best < 0, _NO_ID, tile.ids[best])
        self.heaps.merge(_picked(scores, best, _NONE), ids)

    def result(self) -> pa.RecordBatch:
        some = self.heaps.scores != _NONE
        anchors = np.repeat(self.anchors.ids, some.sum(axis=1))
        columns = [anchors, self.heaps.ids[some], self.heaps.scores[some]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "positive", "score"])


class _InWindow:
    """For a block of anchors with positives: the best rows of other labels in each positive's window."""

    schema = "anchor bigint, positive bigint, positive_score bigint, negative bigint, score bigint"

    def __init__(self, row: dict) -> None:
        self.anchors = _Tile(row)
        shape = row["n"], POSITIVES
        self.positives = np.frombuffer(row["positives"], np.int64).reshape(shape)
        self.scores = np.frombuffer(row["scores"], np.int64).reshape(shape)
        self.heaps = Heaps(shape, NEGATIVES)

    def see(self, tile: _Tile) -> None:
        low, high = WINDOW
        scores = self.anchors.scores(tile)
        mask = self.anchors.labels[:, None] != tile.labels
        # One ranking of the tile serves all positives: a window is a stretch of it.
        ranked = _ranked(scores, mask, None)
        ordered = _picked(scores, ranked, _NONE)
        width = ordered.shape[1]
        floor = _NONE // 100
        times = np.where(ordered == _NONE, _NONE, 100 * np.maximum(ordered, floor))
        for slot in range(POSITIVES):
            known = self.scores[:, slot] != _NONE
            score = np.where(known, self.scores[:, slot], 0)
            first = (times > high * score[:, None]).sum(axis=1)
            at = first[:, None] + np.arange(NEGATIVES)
            place = np.minimum(at, width - 1)
            inside = (at < width) & known[:, None]
            inside &= np.take_along_axis(times, place, 1) >= low * score[:, None]
            best = np.where(inside, np.take_along_axis(ranked, place, 1), -1)
            new = np.where(best < 0, _NO_ID, tile.ids[best])
            own = Heaps((0,), NEGATIVES)
            own.scores, own.ids = self.heaps.scores[:, slot], self.heaps.ids[:, slot]
            own.merge(_picked(scores, best, _NONE), new)
            self.heaps.scores[:, slot], self.heaps.ids[:, slot] = own.scores, own.ids

    def result(self) -> pa.RecordBatch:
        some = self.heaps.scores != _NONE
        row, slot, _ = np.nonzero(some)
        columns = [self.anchors.ids[row], self.positives[row, slot], self.scores[row, slot],
                   self.heaps.ids[some], self.heaps.scores[some]]
        names = ["anchor", "positive", "positive_score", "negative", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _meet(blocks: DataFrame, tiles: DataFrame, kind: type) -> DataFrame:
    """What ``kind`` finds for all anchor blocks over all tiles, one row set for each task's run of tiles.

    Tiles are numbered in a row; a run holds ``RUN_TILES`` of them or fewer, so that a few blocks still give all
    cores work. Each (block, run) is one partition: its block comes first, then its tiles.
    """
    spark = tiles.sparkSession
    n_blocks, n_tiles = blocks.count(), tiles.count()
    if not n_blocks or not n_tiles:
        return spark.createDataFrame([], kind.schema)
    wanted = max(1, 2 * spark.sparkContext.defaultParallelism // n_blocks)
    run = max(1, min(RUN_TILES, -(-n_tiles // wanted)))
    runs = -(-n_tiles // run)
    order = Window.orderBy("tile")  # two numbers a tile, not the tiles
    numbered = tiles.select("tile").select("tile", (F.row_number().over(order) - 1).alias("at"))
    placed = tiles.join(numbered, "tile").select(F.expr(f"cast(at div {run} as int)").alias("run"), "n", "width", "id", "label", "v")
    names = [c for c in blocks.columns if c not in ("block", "n", "width", "id", "label", "v")]
    order = Window.orderBy("block")
    at = blocks.select("block").select("block", (F.row_number().over(order) - 1).alias("at"))
    anchors = blocks.join(at, "block").drop("block")
    # Each block goes to all runs, each tile to all blocks.
    left = anchors.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("kind", F.lit(0))
    right = placed.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("kind", F.lit(1))
    for name in names:
        right = right.withColumn(name, F.lit(None).cast("binary"))
    target = (F.col("at") * runs + F.col("run")).cast("int")
    both = left.unionByName(right).withColumn("target", target)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["kind"] == 0:
                    if current is not None:
                        yield current.result()
                    current = kind(row)
                else:
                    current.see(_Tile(row))
        if current is not None:
            yield current.result()

    return both.repartitionById(n_blocks * runs, "target").sortWithinPartitions("target", "kind").mapInArrow(work, kind.schema)


def _top(rows: DataFrame, owner: list[str], other: str, size: int) -> DataFrame:
    """The best rows of each owner, with their rank: the merge of the heaps of all tasks."""
    order = Window.partitionBy(*owner).orderBy(F.col("score").desc(), F.col(other))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(
    rows: DataFrame,
    is_anchor,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose
    ``id`` meets ``is_anchor``: for each of an anchor's first positives its first hard negatives."""
    candidates = staged(usable(rows, vec_id, embedding, label))
    tiles = staged(_packed_tiles(candidates, TILE, "tile"))
    anchors = candidates.filter(is_anchor)
    blocks = staged(_packed_tiles(anchors, ANCHORS, "block"))
    positives = staged(_top(_meet(blocks, tiles, _SameLabel), ["anchor"], "positive", POSITIVES))
    listed = positives.groupBy(F.col("anchor").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive", "score"))).alias("best")
    )

    def filled(field: str, empty: int):
        places = F.sequence(F.lit(0), F.lit(POSITIVES - 1))
        return F.transform(places, lambda i: F.coalesce(F.get("best", i)[field], F.lit(empty))).alias(f"{field}s")

    having = anchors.join(listed, "id").select("id", "label", "v", filled("positive", _NO_ID), filled("score", _NONE))
    blocks = staged(_packed_tiles(having, ANCHORS, "block"))
    found = _meet(blocks, tiles, _InWindow)
    ranked = _top(found, ["anchor", "positive", "positive_score"], "negative", NEGATIVES)
    return ranked.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
