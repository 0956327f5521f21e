"""Logistic regression with an L2 penalty over sparse counts, for vocabularies that the driver can hold.

It minimises mean(loss) + penalty / 2 * |w|^2 over rows of weighted counts of unit length, as Spark ML's does
without standardization, to the same optimum. Spark ML steps in a space where every feature is divided by its
deviation, which makes the penalty of rare terms very steep there: some hundred iterations for n-grams. Here the steps
are Newton's in the features' own space, each found by conjugate gradients: the more rows, the smaller the penalty and
the more remembered steps a quasi-Newton method would need. Six vectors are held, however many steps there are.

Rows are packed once into blocks of bounded size, kept by the executors: the words of each text and the terms of each
of the block's distinct words (``terms``), so the terms of a word that many texts have are gone through once a block. A
pass sends a vector to the tasks, each adds up the gradient of its blocks, and the sums are added slice by slice in a
shuffle; the driver sees one vector of the vocabulary's length per pass, as it holds the model.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators import terms as tm

#: Entries of a block, words of a block of texts, and coefficients of a slice.
BLOCK_ENTRIES, BLOCK_WORDS, SLICE = 1 << 20, 1 << 20, 1 << 15
#: A Newton step is found to this part of the gradient, or less where that is small, in so many products at most.
FORCING, PRODUCTS = 0.1, 250


class Fitted(NamedTuple):
    """The weights of the terms, their coefficients and the intercept; how many steps and passes it took."""

    weights: np.ndarray
    coefficients: np.ndarray
    intercept: float
    rows: int
    steps: int
    passes: int


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (label, indices, values) as blocks: labels, sizes of rows, and all terms and counts in a row."""
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        if not np.isin(labels, (0.0, 1.0)).all():
            raise ValueError("labels are 0 and 1")
        indices, values = batch.column(1), batch.column(2)
        sizes = np.diff(indices.offsets.to_numpy())
        terms, counts = indices.flatten().to_numpy(), values.flatten().to_numpy()
        ends = np.cumsum(sizes)
        first = 0
        while first < len(labels):
            start = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + BLOCK_ENTRIES, "right")))
            part, held = slice(first, last), slice(start, ends[last - 1])
            # Counts are whole numbers, most of them small.
            kind = np.min_scalar_type(int(counts[held].max(initial=0)))
            block = (labels[part], sizes[part], terms[held], counts[held].astype(kind))
            yield pa.RecordBatch.from_pydict(
                {"labels": [block[0].astype("<f8").tobytes()], "sizes": [block[1].astype("<i4").tobytes()],
                 "terms": [block[2].astype("<i4").tobytes()], "counts": [block[3].tobytes()], "kind": [kind.str]},
                schema=_BLOCK,
            )
            first = last


_BLOCK = pa.schema([(name, pa.binary()) for name in ("labels", "sizes", "terms", "counts")] + [("kind", pa.string())])
_BLOCK_SQL = "labels binary, sizes binary, terms binary, counts binary, kind string"


def _arrays(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label of each row, row of each entry, term of each entry, count of each entry)."""
    labels, sizes = np.frombuffer(block[0], "<f8"), np.frombuffer(block[1], "<i4")
    row = np.repeat(np.arange(len(sizes)), sizes)
    # Numpy adds by places of its own index type many times as fast as by others.
    return labels, row, np.frombuffer(block[2], "<i4").astype(np.intp), np.frombuffer(block[3], block[4])


class _Block(NamedTuple):
    """Texts with their labels, as words of the block and terms of the words."""

    labels: np.ndarray
    texts: tm.Rows
    words: tm.Rows
    lengths: np.ndarray | None = None

    def margins(self, scaled: np.ndarray) -> np.ndarray:
        """The sum of the scaled coefficients over the terms of each text of unit length."""
        return self.texts.times(self.words.times(scaled)) / self.lengths

    def back(self, values: np.ndarray, total: np.ndarray) -> None:
        """Adds the values of the texts to the terms of each, texts of unit length."""
        of_words = np.zeros(len(self.words.sizes))
        self.texts.back(values / self.lengths, of_words)
        self.words.back(of_words, total)


def _of_vectors(block: tuple) -> _Block:
    """A packed block, whose texts are known by their terms only: each is a word of its own."""
    labels, _, terms, counts = _arrays(block)
    each = np.arange(len(labels), dtype=np.int32)
    sizes = np.frombuffer(block[1], "<i4")
    return _Block(labels, tm.Rows(np.ones_like(sizes), each, np.ones(len(each), np.uint8)), tm.Rows(sizes, terms.astype(np.int32), counts))


def vector_blocks(counted: DataFrame) -> tuple[RDD, int]:
    """Blocks of rows (label, counts), counts a sparse vector over all terms, and the number of terms."""
    vectors = counted.select(F.col("label").cast("double"), F.unwrap_udt("counts").alias("v"))
    some = vectors.select("v.size").first()
    if some is None:
        raise ValueError("no samples to train on")
    plain = vectors.select("label", "v.indices", "v.values")
    return plain.mapInArrow(_packed, _BLOCK_SQL).rdd.map(tuple).map(_of_vectors), some[0]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows of (label, text) in pieces of at most so many words as a block has, or of one text."""
    labels, texts, held = [], [], 0
    for batch in batches:
        column = batch.column(1).cast(pa.large_string())
        ends = np.cumsum(pc.add(pc.count_substring(column, " "), 1).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(column):
            start = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, start + BLOCK_WORDS - held, "right"))
            last = max(last, first if held else first + 1)
            if last > first:
                labels.append(batch.column(0)[first:last].to_numpy(zero_copy_only=False))
                texts.append(column[first:last])
                held += int(ends[last - 1] - start)
            if last < len(column):
                yield np.concatenate(labels), pa.concat_arrays(texts)
                labels, texts, held = [], [], 0
            first = last
    if texts:
        yield np.concatenate(labels), pa.concat_arrays(texts)


def text_blocks(samples: DataFrame, vocabulary: Broadcast) -> RDD:
    """Blocks of rows (label, text), texts of words between single spaces."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in _split(batches):
            if not np.isin(labels, (0.0, 1.0)).all():
                raise ValueError("labels are 0 and 1")
            rows, words = tm.words_of(texts)
            block = _Block(labels.astype(float), rows, vocabulary.value.of_words(words))
            yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(block, pickle.HIGHEST_PROTOCOL)]}, schema=schema)

    schema = pa.schema([("block", pa.binary())])
    return samples.select("label", "text").mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def _slices(vector: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(vector), SLICE):
        yield at, vector[at : at + SLICE]


def _summed(parts: RDD, size: int) -> tuple[np.ndarray, dict[str, float]]:
    """The sum of slices by their place, and of the single numbers by their name."""
    tasks = max(1, min(parts.context.defaultParallelism, -(-size // SLICE)))

    def add(pairs: Iterator[tuple]) -> Iterator[tuple]:
        sums = {}
        for at, part in pairs:
            if at in sums:
                sums[at] += part
            else:
                sums[at] = part
        return iter(sums.items())

    dealt = parts.partitionBy(tasks, lambda at: 0 if isinstance(at, str) else at // SLICE)
    vector, numbers = np.zeros(size), {}
    for at, part in dealt.mapPartitions(add).collect():
        if isinstance(at, str):
            numbers[at] = part
        else:
            vector[at : at + len(part)] = part
    _forget(dealt)
    return vector, numbers


def _forget(dealt: RDD) -> None:
    """Removes the files of a shuffle that is over; Spark does it only when the driver happens to collect its garbage."""
    context = dealt.context._jsc.sc()
    if context.cleaner().isDefined():
        shuffle = dealt._jrdd.rdd().dependencies().head().rdd().dependencies().head().shuffleId()
        context.cleaner().get().doCleanupShuffle(shuffle, False)


def _texts_by_term(blocks: RDD, size: int) -> tuple[np.ndarray, dict[str, float]]:
    """In how many rows each term is; the number of rows and of those labelled 1."""

    def count(part: Iterator[_Block]) -> Iterator[tuple]:
        texts, rows, ones = np.zeros(size), 0, 0.0
        for block in part:
            for _, some in tm.merged(block.texts, block.words):
                np.add.at(texts, some.numbers, (some.counts > 0).astype(float))
            rows, ones = rows + len(block.labels), ones + float(block.labels.sum())
        yield from _slices(texts)
        yield from (("rows", rows), ("ones", ones))

    return _summed(blocks.mapPartitions(count), size)


def _with_lengths(blocks: RDD, weights: np.ndarray) -> RDD:
    """Blocks with the length of each row's weighted counts, 1 for a row without terms."""
    sent = blocks.context.broadcast(weights)
    return blocks.map(lambda block: block._replace(lengths=lengths(block.texts, block.words, sent.value)))


def lengths(texts: tm.Rows, words: tm.Rows, weights: np.ndarray) -> np.ndarray:
    """The length of each text's weighted counts, 1 for a text without terms."""
    found, squared = np.ones(len(texts.sizes)), weights**2
    for place, some in tm.merged(texts, words):
        squares = some._replace(counts=some.counts**2).times(squared)
        found[place] = np.where(squares > 0, np.sqrt(squares), 1.0)
    return found


def _logistic(z: np.ndarray) -> np.ndarray:
    # By the half angle, which cannot overflow.
    return 0.5 * (1 + np.tanh(0.5 * z))


def _evaluate(blocks: RDD, weights: np.ndarray, point: np.ndarray, rows: int, penalty: float):
    """The objective and its gradient; the intercept is the last number of the point."""
    size = len(weights)
    sent = blocks.context.broadcast((weights * point[:-1], float(point[-1])))

    def gradients(part: Iterator[_Block]) -> Iterator[tuple]:
        scaled, intercept = sent.value
        gradient, loss, slope = np.zeros(size), 0.0, 0.0
        for block in part:
            z = block.margins(scaled) + intercept
            loss += float((np.logaddexp(0, z) - block.labels * z).sum())
            residual = _logistic(z) - block.labels
            slope += float(residual.sum())
            block.back(residual, gradient)
        yield from _slices(gradient)
        yield from (("loss", loss), ("slope", slope))

    gradient, numbers = _summed(blocks.mapPartitions(gradients), size)
    sent.destroy()
    value = numbers["loss"] / rows + penalty / 2 * float(point[:-1] @ point[:-1])
    return value, _with_penalty(gradient, weights, point, numbers["slope"], rows, penalty)


def _with_penalty(sums: np.ndarray, weights: np.ndarray, point: np.ndarray, slope: float, rows: int, penalty: float):
    """The mean over the rows, of the terms and the intercept, and the penalty's part."""
    found = penalty * point
    sums *= weights
    sums /= rows
    found[:-1] += sums
    found[-1] = slope / rows  # the intercept has no penalty
    return found


#: What a worker has found at the last point: how the loss of its blocks' texts curves there.
_CURVES: dict = {}


def _curves(at: Broadcast, place: tuple, block: _Block) -> np.ndarray:
    """The second derivative of each text's loss by its margin, found once at a point in a worker."""
    name, scaled, intercept = at.value
    if _CURVES.get("name") != name:
        _CURVES.clear()
        _CURVES["name"] = name
    if place not in _CURVES:
        p = _logistic(block.margins(scaled) + intercept)
        _CURVES[place] = p * (1 - p)
    return _CURVES[place]


def _product(blocks: RDD, weights: np.ndarray, at: Broadcast, direction: np.ndarray, rows: int, penalty: float) -> np.ndarray:
    """The change of the gradient along a direction, in single precision: it makes steps, and where they end is told
    from the gradient itself."""
    size = len(weights)
    sent = blocks.context.broadcast(((weights * direction[:-1]).astype("f4"), float(direction[-1])))

    def changes(index: int, part: Iterator[_Block]) -> Iterator[tuple]:
        scaled, shift = sent.value
        change, slope = np.zeros(size), 0.0
        for i, block in enumerate(part):
            values = _curves(at, (index, i), block) * (block.margins(scaled) + shift)
            slope += float(values.sum())
            block.back(values, change)
        yield from _slices(change.astype("f4"))
        yield ("slope", slope)

    change, numbers = _summed(blocks.mapPartitionsWithIndex(changes), size)
    sent.destroy()
    return _with_penalty(change, weights, direction, numbers["slope"], rows, penalty)


def _newton(product: Callable[[np.ndarray], np.ndarray], gradient: np.ndarray, enough: float) -> tuple[np.ndarray, int]:
    """The Newton step by conjugate gradients, until what is left of the gradient has this length; and the products."""
    step, left = np.zeros_like(gradient), -gradient
    direction, square = left.copy(), float(left @ left)
    for done in range(1, PRODUCTS + 1):
        change = product(direction)
        curve = float(direction @ change)
        if not curve > 0:
            break  # rounding has taken over
        step += square / curve * direction
        left -= square / curve * change
        before, square = square, float(left @ left)
        if square <= enough * enough:
            break
        direction *= square / before
        direction += left
    return (step if step.any() else -gradient), done


def fit(blocks: RDD, size: int, max_iterations: int, tolerance: float) -> Fitted:
    """Fits blocks of labelled texts over so many terms.

    Terms weigh ``ln((1+n)/(1+texts)) + 1``, rows have unit length, and the penalty is 1 / n. Training ends after
    ``max_iterations`` steps, or when the objective can lie above its optimum by no more than ``tolerance`` of it:
    as it curves by the penalty at least, that is |gradient|^2 / (2 * penalty). Rows of one label only give
    coefficients of 0 and an infinite intercept, as Spark ML does.
    """
    first = blocks.persist(StorageLevel.DISK_ONLY)
    texts, numbers = _texts_by_term(first, size)
    rows, ones = int(numbers.get("rows", 0)), numbers.get("ones", 0.0)
    if not rows:
        raise ValueError("no samples to train on")
    weights = np.log((1 + rows) / (1 + texts)) + 1
    del texts
    if ones in (0, rows):
        first.unpersist()
        return Fitted(weights, np.zeros(size), np.inf if ones else -np.inf, rows, 0, 0)
    # Each task hands on a whole gradient, so there are no more tasks than cores.
    cores = first.context.defaultParallelism
    blocks = _with_lengths(first, weights).coalesce(cores).persist(StorageLevel.MEMORY_AND_DISK)
    penalty, point = 1.0 / rows, np.append(np.zeros(size), np.log(ones / (rows - ones)))
    value, gradient = _evaluate(blocks, weights, point, rows, penalty)
    first.unpersist()
    passes, done = 1, 0
    while done < max_iterations and gradient @ gradient > 2 * penalty * tolerance * value:
        at = blocks.context.broadcast((uuid.uuid4().hex, weights * point[:-1], float(point[-1])))
        long = float(gradient @ gradient) ** 0.5
        # Nearer than half the end's length there is nothing to gain.
        enough = max(min(FORCING, long**0.5) * long, (penalty * tolerance * value / 2) ** 0.5)
        move, products = _newton(lambda v: _product(blocks, weights, at, v, rows, penalty), gradient, enough)
        at.destroy()
        passes += products
        slope, length = float(gradient @ move), 1.0
        while True:
            tried = point + length * move
            tried_value, tried_gradient = _evaluate(blocks, weights, tried, rows, penalty)
            passes += 1
            # Steps that change the value in its last digits only are judged by the gradient.
            flat = abs(tried_value - value) <= 1e-13 * value and tried_gradient @ tried_gradient < gradient @ gradient
            better = tried_value <= value + 1e-4 * length * slope or flat
            if better or length < 1e-10:
                break
            length /= 2
        if not better:
            break  # no better point can be told from this one
        point, value, gradient = tried, tried_value, tried_gradient
        done += 1
    blocks.unpersist()
    return Fitted(weights, point[:-1], float(point[-1]), rows, done, passes)
