"""The classifier's training for vocabularies beyond one machine.

The same model as ``classify.fit``: TF-IDF over character n-grams and logistic regression with the same penalty, to
the same optimum. Here nothing has the length of the vocabulary in one place. Terms are dealt over shards by hash and
numbered inside them; a row of the state table holds one shard's coefficients, gradient and last steps. Training rows are
packed into blocks, each with its own short list of terms.

An evaluation is three exchanges: the shards send each block the coefficients it asks for; the blocks compute
their losses and residuals and add up their gradient by term before sending it back, so a term crosses once a block;
the shards add up the blocks. The optimiser is L-BFGS in its vector-free form: its vectors stay in the shards,
which hand the driver their inner products (a few hundred numbers a shard), and the driver answers with the weight of each
vector in the next step. Every accepted step is written to the shared folder, which also ends the lineage.

Texts that repeat with one label are one row with a weight. Nulls count as empty texts, and rows without a label are left
out. An empty training set is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.operators.classify import _term_counts
from credsieve.session import materialize

SHARDS, BLOCK_ROWS, MEMORY = 32, 2048, 10
#: Training ends when the gradient is this small, or after so many evaluations.
GRADIENT, EVALUATIONS = 1e-9, 1000
#: The shard of the intercept, which has no penalty.
_BIAS = -1


class ShardedModel(NamedTuple):
    """(ngram, idf, coefficient) of all terms, as a stored table, and the intercept."""

    terms: DataFrame
    intercept: float
    evaluations: int
    gradient: float


# --- features --------------------------------------------------------------------------------


def _rows(training: DataFrame) -> DataFrame:
    """(row, text, label, times): each distinct sample once."""
    counted = (
        training.filter(F.col("label").isNotNull())
        .groupBy(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
        .agg(F.count("*").alias("times"))
    )
    return materialize(counted.withColumn("row", F.monotonically_increasing_id()))


def _index(terms: DataFrame, total: int, shards: int) -> DataFrame:
    """(ngram, idf, shard, slot): where the coefficient of each term lies."""
    counted = terms.groupBy("ngram").agg(F.sum("times").alias("texts"))
    idf = F.log((1 + F.lit(total)) / (1 + F.col("texts"))) + 1
    shard = F.pmod(F.xxhash64("ngram"), F.lit(shards)).cast("int")
    slot = F.row_number().over(Window.partitionBy("shard").orderBy("ngram")) - 1
    return materialize(
        counted.select("ngram", idf.alias("idf"), shard.alias("shard")).withColumn("slot", slot)
    )


def _pack(table: pa.Table) -> pa.Table:
    """One block: its rows as a sparse matrix over its own list of terms, and that list by shard."""
    block = table.column("block")[0].as_py()
    get = {name: table.column(name).to_numpy() for name in ("row", "label", "times", "shard", "slot", "w")}
    rows, first, row = np.unique(get["row"], return_index=True, return_inverse=True)
    real = get["shard"] >= 0  # a text without terms has one row that holds none
    row, key = row[real], get["shard"][real].astype(np.int64) << 32 | get["slot"][real].astype(np.int64)
    terms, column = np.unique(key, return_inverse=True)
    order = np.lexsort((column, row))
    row, column, w = row[order], column[order], get["w"][real][order]
    norms = np.sqrt(np.bincount(row, w * w, len(rows)))
    w = w / norms[row]
    starts = np.searchsorted(terms >> 32, np.arange(int((terms >> 32).max(initial=-1)) + 2))
    asked = [(s, (terms[a:b] & 0xFFFFFFFF).astype("<i4").tobytes())
             for s, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())) if b > a]
    asked.append((_BIAS, np.zeros(1, "<i4").tobytes()))
    n = len(asked)

    def once(values: np.ndarray, kind: str) -> list:
        return [values.astype(kind).tobytes()] + [None] * (n - 1)

    return pa.table(
        {
            "block": pa.array([block] * n, pa.int64()),
            "shard": pa.array([s for s, _ in asked], pa.int32()),
            "slots": pa.array([b for _, b in asked], pa.binary()),
            "label": pa.array(once(get["label"][first], "<f8"), pa.binary()),
            "times": pa.array(once(get["times"][first], "<f8"), pa.binary()),
            "row": pa.array(once(row, "<i4"), pa.binary()),
            "column": pa.array(once(column, "<i4"), pa.binary()),
            "w": pa.array(once(w, "<f8"), pa.binary()),
        }
    )


# --- evaluations -----------------------------------------------------------------------------


class _Shard:
    """One shard's vectors: the point, the gradient there, and the last steps and changes of gradient."""

    def __init__(self, row: pa.Table) -> None:
        self.size = row.column("size")[0].as_py()
        self.shard = row.column("shard")[0].as_py()
        vectors = np.frombuffer(row.column("vectors")[0].as_py(), "<f8").reshape(-1, self.size)
        self.x, self.g, self.kept = vectors[0], vectors[1], vectors[2:]  # steps and changes in turn

    def basis(self) -> np.ndarray:
        return np.vstack([self.kept, self.g[None]])

    def moved(self, weights: np.ndarray | None) -> np.ndarray:
        """The point after a step that is a weighted sum of the basis."""
        return self.x if weights is None else self.x + weights @ self.basis()


def _answers(weights: np.ndarray | None) -> Callable:
    def answer(asked: pa.Table, state: pa.Table) -> pa.Table:
        x = _Shard(state).moved(weights)
        values = [x[np.frombuffer(s, "<i4")].tobytes() for s in asked.column("slots").to_pylist()]
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "values": pa.array(values, pa.binary())})

    return answer


def _gradients(total: float) -> Callable:
    def gradient(block: pa.Table, answers: pa.Table) -> pa.Table:
        """Loss and gradient of one block, the latter by shard over the block's own terms."""
        places = block.column("shard").to_pylist()
        known = dict(zip(answers.column("shard").to_pylist(), answers.column("values").to_pylist()))
        listed = sorted(s for s in places if s != _BIAS)
        x = np.concatenate([np.frombuffer(known[s]) for s in listed] or [np.empty(0)])
        main = next(i for i, v in enumerate(block.column("label").to_pylist()) if v is not None)
        part = {name: block.column(name)[main].as_py() for name in ("label", "times", "row", "column", "w")}
        y, c = np.frombuffer(part["label"]), np.frombuffer(part["times"])
        row, column = np.frombuffer(part["row"], "<i4"), np.frombuffer(part["column"], "<i4")
        w = np.frombuffer(part["w"])
        z = np.bincount(row, w * x[column], len(y)) + np.frombuffer(known[_BIAS])[0]
        loss = float((c * (np.logaddexp(0, z) - y * z)).sum()) / total
        residual = c * (1 / (1 + np.exp(-z)) - y) / total
        g = np.bincount(column, w * residual[row], len(x))
        slots = dict(zip(places, block.column("slots").to_pylist()))
        sizes = [len(slots[s]) >> 2 for s in listed]
        parts = np.split(g, np.cumsum(sizes)[:-1]) if sizes else []
        out = [(s, slots[s], p.tobytes(), 0.0) for s, p in zip(listed, parts)]
        out.append((_BIAS, slots[_BIAS], np.array([residual.sum()]).tobytes(), loss))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["shard", "slots", "part", "loss"])

    return gradient


def _update(weights: np.ndarray | None, penalty: float, memory: int) -> Callable:
    def update(parts: pa.Table, state: pa.Table) -> pa.Table:
        """The shard at the new point: its vectors, their inner products, and its share of the objective."""
        old = _Shard(state)
        x, g = old.moved(weights), np.zeros(old.size)
        for slots, part in zip(parts.column("slots").to_pylist(), parts.column("part").to_pylist()):
            g[np.frombuffer(slots, "<i4")] += np.frombuffer(part)  # a block names a slot once
        value = float(np.sum(parts.column("loss").to_numpy()))
        if old.shard != _BIAS:
            g += penalty * x
            value += penalty / 2 * float(x @ x)
        kept = old.kept
        if weights is not None:
            kept = np.vstack([kept, (x - old.x)[None], (g - old.g)[None]])[-2 * memory :]
        basis = np.vstack([kept, g[None]])
        vectors = np.vstack([x[None], g[None], kept])
        return pa.table(
            {
                "shard": pa.array([old.shard], pa.int32()),
                "size": pa.array([old.size], pa.int64()),
                "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
                "products": pa.array([(basis @ basis.T).tobytes()], pa.binary()),
                "value": pa.array([value], pa.float64()),
            }
        )

    return update


def _direction(products: np.ndarray) -> np.ndarray:
    """The L-BFGS step as weights of the basis (steps and changes in turn, then the gradient), from its inner
    products alone."""
    n = len(products)
    weights = np.zeros(n)
    weights[-1] = -1.0
    alphas = {}
    pairs = range(0, n - 1, 2)
    for i in reversed(pairs):
        alphas[i] = weights @ products[i] / products[i, i + 1]
        weights[i + 1] -= alphas[i]
    if n > 1:
        weights *= products[n - 3, n - 2] / products[n - 2, n - 2]
    for i in pairs:
        weights[i] += alphas[i] - weights @ products[i + 1] / products[i, i + 1]
    return weights


def fit(
    training: DataFrame,
    shards: int = SHARDS,
    block_rows: int = BLOCK_ROWS,
    gradient: float = GRADIENT,
    evaluations: int = EVALUATIONS,
    memory: int = MEMORY,
) -> ShardedModel:
    """Trains on (text, label). More data want more ``shards``: a shard's vectors and one block are what a task holds."""
    rows = _rows(training)
    total, n_rows = rows.agg(F.sum("times"), F.count("*")).first()
    if not total:
        raise ValueError("no labelled samples to train on")
    terms = materialize(_term_counts(rows, "text", "row", "times"))
    index = _index(terms, total, shards)
    blocks = -(-n_rows // block_rows)
    weighted = terms.join(index, "ngram").select("row", "shard", "slot", (F.col("tf") * F.col("idf")).alias("w"))
    nothing = rows.select("row").join(terms.select("row").distinct(), "row", "left_anti")
    blank = nothing.select("row", F.lit(-2).alias("shard"), F.lit(0).alias("slot"), F.lit(0.0).alias("w"))
    entries = weighted.unionByName(blank).join(rows.select("row", "label", "times"), "row")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias("block")
    packed = materialize(
        entries.select(block, "row", "label", "times", "shard", "slot", "w")
        .groupBy("block")
        .applyInArrow(
            _pack,
            "block bigint, shard int, slots binary, label binary, times binary, row binary, column binary, w binary",
        )
    )
    asked = packed.select("block", "shard", "slots")
    sizes = index.groupBy("shard").agg(F.count("*").alias("size"))
    bias = sizes.sparkSession.createDataFrame([(_BIAS, 1)], "shard int, size bigint")
    start = sizes.unionByName(bias).select(
        "shard", "size", F.unhex(F.repeat(F.lit("00"), (F.col("size") * 16).cast("int"))).alias("vectors")
    )
    penalty = 1.0 / total
    fields = "shard int, size bigint, vectors binary, products binary, value double"

    def evaluate(state: DataFrame, weights: np.ndarray | None) -> tuple[DataFrame, float, np.ndarray]:
        vectors = state.select(F.col("shard").alias("at"), "shard", "size", "vectors")
        answers = (
            asked.groupBy("shard")
            .cogroup(vectors.groupBy("at"))
            .applyInArrow(_answers(weights), "block bigint, shard int, values binary")
        )
        named = answers.select(F.col("block").alias("of"), "shard", "values")
        parts = (
            packed.groupBy("block")
            .cogroup(named.groupBy("of"))
            .applyInArrow(_gradients(float(total)), "shard int, slots binary, part binary, loss double")
        )
        new = materialize(
            parts.groupBy("shard").cogroup(vectors.groupBy("at")).applyInArrow(_update(weights, penalty, memory), fields)
        )
        summed, value = 0.0, 0.0
        for row in new.select("products", "value").collect():  # one row a shard, a few hundred numbers each
            flat = np.frombuffer(row["products"])
            summed = summed + flat.reshape(round(len(flat) ** 0.5), -1)
            value += row["value"]
        return new, value, summed

    state, value, products = evaluate(materialize(start), None)
    done = 1
    while done < evaluations and products[-1, -1] ** 0.5 > gradient:
        weights = _direction(products)
        slope = float(weights @ products[-1])
        step = 1.0 if len(products) > 1 else min(1.0, 1.0 / products[-1, -1] ** 0.5)
        while True:
            tried, tried_value, tried_products = evaluate(state, step * weights)
            done += 1
            # Steps that no longer change the value in its last digits are judged by the gradient alone.
            flat = abs(tried_value - value) <= 1e-13 * abs(value) and tried_products[-1, -1] <= products[-1, -1]
            if tried_value <= value + 1e-4 * step * slope or flat or done >= evaluations or step < 1e-10:
                break
            step /= 2
        if tried_value > value and not flat:
            break  # no better point can be told from this one
        state, value, products = tried, tried_value, tried_products

    def unpack(part: pa.Table) -> pa.Table:
        shard = _Shard(part)
        return pa.table(
            {
                "shard": pa.array([shard.shard] * shard.size, pa.int32()),
                "slot": pa.array(np.arange(shard.size), pa.int32()),
                "coefficient": pa.array(shard.x, pa.float64()),
            }
        )

    flat_state = state.select("shard", "size", "vectors").groupBy("shard").applyInArrow(unpack, "shard int, slot int, coefficient double")
    table = materialize(index.join(flat_state, ["shard", "slot"]).select("ngram", "idf", "coefficient"))
    intercept = flat_state.filter(F.col("shard") == _BIAS).first()["coefficient"]
    return ShardedModel(table, intercept, done, float(products[-1, -1] ** 0.5))


def score(rows: DataFrame, key: str, column: str, model: ShardedModel) -> DataFrame:
    """(key, p_secret): the probability that a text is a secret, by joining its terms with the model's table.
    Keys name rows; repeated ones must have the same text."""
    texts = rows.select(F.col(key).alias("key"), F.coalesce(column, F.lit("")).alias("text")).dropDuplicates(["key"])
    known = _term_counts(texts, "text", "key").join(model.terms, "ngram")
    w = F.col("tf") * F.col("idf")
    sums = known.groupBy("key").agg(F.sum(w * F.col("coefficient")).alias("dot"), F.sqrt(F.sum(w * w)).alias("norm"))
    margin = F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)) + F.lit(model.intercept)
    found = texts.select("key").join(sums, "key", "left")
    return found.select(F.col("key").alias(key), (1 / (1 + F.exp(-margin))).alias("p_secret"))
