"""Quality classifier by importance resampling over hashed n-grams.

Two generative models are fitted on labelled documents: one of the target (good and not toxic), one
of the raw mixture of all labelled documents. Each model gives the share of documents that hold a
hashed feature; features are words, character n-grams, and runs of one word. A document's
importance weight is the sum of the log ratios of its features. Ratios are shrunk towards zero by
their standard error and a dead zone, so that rare features and the common ones say nothing.

Gumbel noise of a small temperature, drawn from the document id, turns the weights into a sample
without replacement: the ``k`` largest noisy weights are kept. ``k`` is the number of documents whose
weight reaches the cut that separates the labelled rows best. The k-th largest is found by repeated
histograms, without a global sort.

Only the labelled rows are bounded: at most ``MAX_LABELLED`` of them, those of the smallest hash.
Every document is scored whole.

Defined cases: null and empty texts have no features and weight 0; null labels are passed over, a
document labelled twice is good only if both labels are; without labels of both kinds all documents
are kept; repeated rows get equal weights; equal noisy weights are kept or rejected together; extra
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import (
    _BASE, _BYTE_VALUES, _FOLD, _powers, SPACED, annotated, mix, staged, text_chunks, word_hashes, word_spans,
)

#: Labelled rows the models are fitted on, at most.
MAX_LABELLED = 50_000
BUCKET_BITS = 18
CHARACTERS = 5
RUNS = (4, 6, 8, 12)
#: Added to both counts; ratios within e^DEAD_ZONE of 1 or ERRORS standard errors say nothing.
SMOOTHING = 1.0
DEAD_ZONE = 1.0
ERRORS = 2.0
TEMPERATURE = 0.05
#: The cut is looked for at steps of a weight, of which a unit holds this many, within this range of 0.
CUT_STEPS, CUT_RANGE = 64, 1024
#: Bytes of text whose features are found at once: they take some hundred times that. Longer texts are read in
#: windows of that size.
FEATURE_BYTES = 256 << 10
BINS = 1024

_WORDS, _CHARACTERS, _RUNS = 0, 1 << BUCKET_BITS, 2 << BUCKET_BITS
FEATURES = _RUNS + len(RUNS)


def features(column: pa.Array, size: int = FEATURE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row, feature) of runs of whole texts; each feature of a text once.

    A text of more than ``size`` bytes is read in windows of that many.
    """
    for first, raw, offsets in text_chunks(column, size):
        if len(raw) > size:
            found = _of_long(raw, size)
            yield first, np.zeros(len(found), np.int64), found
            continue
        starts, ends, at = word_spans(raw, offsets, SPACED)
        words = word_hashes(raw, starts, ends)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        parts = [(owner, _bucket(words) + _WORDS)]
        if len(words):
            fresh = np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])
            begins = np.flatnonzero(fresh)
            lengths = np.diff(np.append(begins, len(words)))
            for i, least in enumerate(RUNS):
                long = begins[lengths >= least]
                parts.append((owner[long], np.full(len(long), _RUNS + i)))
        grams = _character_grams(raw)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = text[CHARACTERS - 1 :] == text[: len(grams)]
        parts.append((text[: len(grams)][inside], grams[inside] + _CHARACTERS))
        keys = np.unique(np.concatenate([(o << 20) | f for o, f in parts]))
        yield first, keys >> 20, keys & ((1 << 20) - 1)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of byte values times the powers of the base."""
    up, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[values] * up[: len(values)], out=sums[1:])
    return sums


def _character_grams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the character n-gram at each place; all white space is one character."""
    n = CHARACTERS
    if len(raw) < n:
        return np.empty(0, np.int64)
    sums = _sums(np.where(SPACED[raw], _FOLD[raw], np.uint8(32)))
    _, down = _powers(len(raw) + 1)
    return _bucket(mix((sums[n:] - sums[:-n]) * down[: len(raw) - n + 1]))


def _of_long(raw: np.ndarray, size: int) -> np.ndarray:
    """The features of one text, window by window; words and runs go on over the edges.

    The word at a window's end is carried as its sum so far and its length, the run as its word and length.
    """
    present = np.zeros(FEATURES, dtype=bool)
    carried, length = np.uint64(0), 0
    run_word, run = None, 0
    for begin in range(0, len(raw), size):
        piece = raw[begin : begin + size]
        present[_character_grams(raw[max(0, begin - CHARACTERS + 1) : begin + size]) + _CHARACTERS] = True
        starts, ends, _ = word_spans(piece, np.array([0, len(piece)]), SPACED)
        sums = _sums(_FOLD[piece])
        _, down = _powers(len(piece) + 1)
        words = (sums[ends] - sums[starts]) * down[starts]
        sizes = ends - starts
        if length and len(starts) and starts[0] == 0:
            words[:1] = carried + words[:1] * np.uint64(pow(_BASE, length, 1 << 64))
            sizes[0] += length
        elif length:
            words, sizes = np.append(carried, words), np.append(length, sizes)
        carried, length = np.uint64(0), 0
        if len(ends) and ends[-1] == len(piece) and begin + size < len(raw):
            carried, length = words[-1], int(sizes[-1])
            words = words[:-1]
        if not len(words):
            continue
        words = mix(words)
        present[_bucket(words) + _WORDS] = True
        begins = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        lengths = np.diff(np.append(begins, len(words)))
        if words[0] == run_word:
            lengths[0] += run
        run_word, run = words[-1], int(lengths[-1])
        for i, least in enumerate(RUNS):
            present[_RUNS + i] |= lengths.max() >= least
    return np.flatnonzero(present)


@dataclass
class Model:
    """The log ratio of each feature, and the least weight of a kept document."""

    ratios: np.ndarray
    cut: float

    def weights(self, column: pa.Array) -> np.ndarray:
        total = np.zeros(len(column))
        for first, owner, feature in features(column):
            sums = np.bincount(owner, weights=self.ratios[feature])
            total[first : first + len(sums)] = sums
        return total


def _labels(labels: DataFrame, limit: int) -> list:
    return (
        labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(1))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .select("doc_id", ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"))
        .sort(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
        .collect()
    )


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """The two models from the labelled documents, and the cut that separates those best."""
    context = docs.sparkSession.sparkContext
    good = {r.doc_id: r.good for r in _labels(labels, limit)}
    known = context.broadcast(good)

    def labelled(batches):
        for batch in batches:
            kinds = [known.value.get(d) for d in batch.column("doc_id").to_pylist()]
            rows = [i for i, k in enumerate(kinds) if k is not None]
            if rows:
                texts = batch.column("text").take(pa.array(rows))
                yield texts, np.array([kinds[i] for i in rows])

    def count(batches):
        raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for texts, kinds in labelled(batches):
            for first, owner, feature in features(texts):
                raw += np.bincount(feature, minlength=FEATURES)
                target += np.bincount(feature[kinds[first + owner]], minlength=FEATURES)
            n = len(kinds), int(kinds.sum())
            yield _counts([FEATURES], [n[0]], [n[1]])
        seen = np.flatnonzero(raw)
        yield _counts(seen, raw[seen], target[seen])

    narrow = docs.select("doc_id", "text")
    counted = narrow.mapInArrow(count, "feature bigint, n_raw bigint, n_target bigint")
    sums = counted.groupBy("feature").agg(F.sum("n_raw").alias("r"), F.sum("n_target").alias("t"))
    raw, target = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for row in sums.collect():  # as many as there are features, a fixed number
        raw[row.feature], target[row.feature] = row.r, row.t
    if not 0 < target[-1] < raw[-1]:
        return Model(np.zeros(FEATURES), -np.inf)
    expected = raw[:-1] * (target[-1] / raw[-1]) + SMOOTHING
    ratio = np.log((target[:-1] + SMOOTHING) / expected)
    error = DEAD_ZONE + ERRORS / np.sqrt(expected)
    model = Model(np.sign(ratio) * np.maximum(0, np.abs(ratio) - error), 0.0)
    shared = context.broadcast(model)

    def weigh(batches):
        for texts, kinds in labelled(batches):
            places = np.floor(np.clip(shared.value.weights(texts), -CUT_RANGE, CUT_RANGE) * CUT_STEPS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places.astype(np.int64)), pa.array(kinds)], names=["place", "good"]
            )

    places = narrow.mapInArrow(weigh, "place bigint, good boolean").groupBy("place").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    rows = sorted(places.collect())  # as many as there are steps, a fixed number
    model.cut = _best_cut(*(np.array(column) for column in zip(*rows)))
    return model


def _counts(features_, raw, target) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (features_, raw, target)],
        names=["feature", "n_raw", "n_target"],
    )


def _best_cut(places: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which on keeping makes fewest mistakes, midway to the step below."""
    lost = np.concatenate([[0], np.cumsum(good)])  # good ones below the cut
    left = bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    at = int(np.argmin(lost + left))
    if at == 0:
        return -np.inf
    if at == len(places):
        return np.inf
    return float(places[at - 1] + places[at] + 1) / 2 / CUT_STEPS


def _gumbel(ids: list, temperature: float) -> np.ndarray:
    """Noise of each document, the same in every run."""
    known = np.array([0 if i is None else i & (2**64 - 1) for i in ids], dtype=np.uint64)
    uniform = (mix(known * np.uint64(2) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) + 0.5
    return -temperature * np.log(-np.log(uniform / 2**53))


def scored(docs: DataFrame, model: Model, temperature: float = TEMPERATURE, keep: list[str] | None = None) -> DataFrame:
    """``row`` with its log importance ``weight`` and the noisy ``key``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        weights = shared.value.weights(columns[1])
        keys = weights + _gumbel(columns[0].to_pylist(), temperature)
        return [pa.array(weights), pa.array(keys)]

    return annotated(docs, run, "weight double, key double", ["doc_id", "text"], keep)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The exact k-th largest ``key``, by histograms that close in on it."""
    if k <= 0:
        return float("inf")
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or low == high:
        return low if low is not None else float("-inf")
    above = 0
    while True:
        width = (high - low) / BINS
        if low + width <= low:
            return low
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if above + row.n >= k:
                if row.low == row.high:
                    return row.low
                low, high = row.low, row.high
                break
            above += row.n


@dataclass
class Choice:
    model: Model
    least_key: float


def choose(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> tuple[Choice, DataFrame]:
    """The fitted model with the key of the last kept document, and ``row`` (all columns, or those to keep),
    weight and key of all documents, which are scored once and stored."""
    model = fit(docs, labels)
    rows = staged(scored(docs, model, keep=keep))
    k = rows.filter(F.col("weight") >= model.cut).count()
    return Choice(model, kth_largest(rows.select("key"), k)), rows


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, weight, key, kept of every document."""
    choice, rows = choose(docs, labels, ["doc_id"])
    return rows.select("row.doc_id", "weight", "key", (F.col("key") >= F.lit(choice.least_key)).alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, columns unchanged."""
    choice, rows = choose(docs, labels)
    return rows.filter(F.col("key") >= F.lit(choice.least_key)).select("row.*")
