"""The language of a text, by string kernels.

*Kernel.* A text is lower-cased, every run of characters that are no letters becomes one space, and its
character n-grams of all lengths in ``ORDERS`` (a blended spectrum) are noted as present or not, each in one of
``CELLS`` cells by hash. The kernel of two texts is the number of cells they share, divided by the root of
the product of their own numbers: cosines of presence, so neither length nor repetition counts.

*Learning.* Kernel ridge regression, one language against the rest, in the space that Nyström landmarks span:
``LANDMARKS`` training texts, dealt evenly over the languages, give the kernel matrix whose inverse root maps
the kernel values of a text to features. Spark adds up the products of features of all training texts; the driver
solves a system of the size of the landmarks. Training texts are a bounded sample, at most ``TRAINING``
documents in even parts per language (those of the smallest hashes), of at most ``LANGUAGES`` languages, the most
frequent ones.

*Scoring.* A batch of texts is a matrix of presence; its product with the landmarks' presence gives kernel values,
and the product of these with the coefficients gives one value per language. As matrix products associate, landmarks
and coefficients are multiplied beforehand: a worker multiplies each batch by one matrix of cells and languages, which
is what the tasks receive (at most 67 MB, by ``CELLS`` and ``LANGUAGES``; 1.3 MB for four languages).
Every text is read whole, in pieces that overlap.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as is everything where nothing could be
learned. Rows without an id are never learned from; rows with a null language are not either. Equal values go to
the language that comes first by code point. Repeated rows each get their prediction; an empty table gives an empty result;
extra columns stay inside ``row``, so names cannot clash. Prediction reads the text alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import annotated, staged

ORDERS = (1, 2, 3, 4)
CELLS = 1 << 16
#: Bounds of the training sample, the landmarks and the languages; weight of the ridge.
TRAINING, LANDMARKS, LANGUAGES, RIDGE = 8192, 256, 255, 1e-2
#: Characters looked at in one go, and texts of one matrix.
PIECE, ROWS = 1 << 18, 64
UNKNOWN = "und"

_SHIFT = np.uint32(32 - CELLS.bit_length() + 1)
_FACTOR = np.uint32(0x9E3779B1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


def mark_presence(text: str | None, row: np.ndarray) -> bool:
    """Set the cells of a text's n-grams in a row of zeros; whether it has any letter."""
    text, letters, any_letter = (text or "").lower(), _letters(), False
    tail, after_letter = np.full(1, 32, np.uint32), False
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[points]
        any_letter |= bool(is_letter.any())
        before = np.concatenate([[after_letter], is_letter[:-1]])
        after_letter = is_letter[-1]
        chars = np.where(is_letter, points, np.uint32(32))[is_letter | before]
        tail = _mark(np.concatenate([tail, chars]), row)
    if after_letter:
        _mark(np.append(tail, np.uint32(32)), row)
    return any_letter


def _mark(chars: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sets the cells of all n-grams of the characters; gives those that the next ones may go on from."""
    hashes = np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        hashes = (hashes[: len(chars) - n + 1] ^ chars[n - 1 :]) * _FACTOR
        hashes ^= hashes >> np.uint32(15)
        if n in ORDERS:
            row[(hashes * _FACTOR) >> _SHIFT] = 1
    return chars[-(max(ORDERS) - 1) :]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of presence of some texts, and which of them have letters."""
    matrix = np.zeros((len(texts), CELLS), np.float32)
    return matrix, np.array([mark_presence(t, row) for t, row in zip(texts, matrix)], bool)


class Model(NamedTuple):
    """Languages in code point order, and for each cell its weight in every language's value."""

    languages: list[str]
    weights: np.ndarray

    def values(self, matrix: np.ndarray) -> np.ndarray:
        """One value per text and language: about 1 for its own language and -1 for others."""
        own = np.sqrt(np.maximum(matrix.sum(axis=1), 1))
        return (matrix @ self.weights) / own[:, None]


def in_training(doc_id: Column) -> Column:
    """Whether a document may be learned from: by its id, never null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _unpacked(bits: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(-1, CELLS // 8)
    return np.unpackbits(flat, axis=1).astype(np.float32)


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared cells over the root of the product of own cells."""
    own = np.outer(np.maximum(x.sum(axis=1), 1), np.maximum(y.sum(axis=1), 1))
    return (x @ y.T).astype(np.float64) / np.sqrt(own)


def _sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> tuple[list[str], DataFrame]:
    """The languages, and the training sample (lang, rank, bits)."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & in_training(F.col(doc_id)))
    counted = labelled.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in counted.collect()}
    share = TRAINING // max(1, len(counts))
    # Half as many again as needed pass by hash; the smallest ranks of them stay.
    rows = [(name, min(1.0, 1.5 * share / n)) for name, n in counts.items()]
    parts = docs.sparkSession.createDataFrame(rows, "lang string, part double")
    place = F.crc32(F.concat(F.lit("sample:"), F.col(doc_id).cast("string")).cast("binary"))
    chosen = (
        labelled.select(F.col(lang).alias("lang"), place.alias("place"), F.col(text).alias("text"))
        .join(F.broadcast(parts), "lang")
        .filter(F.col("place") < F.col("part") * (1 << 32))
    )

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        bits = []
        for text in columns[0]:
            matrix, has_letters = presence([text.as_py()])
            bits.append(np.packbits(matrix[0].astype(bool)).tobytes() if has_letters[0] else None)
        return [pa.array(bits, pa.binary())]

    marked = annotated(chosen, run, "bits binary", ["text"], ["lang", "place"]).filter("bits IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("place", F.xxhash64("bits"), "bits")
    ranked = marked.select("row.*", "bits").withColumn("rank", F.row_number().over(order))
    return sorted(counts), ranked.filter(F.col("rank") <= share).select("lang", "rank", "bits")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the text and language of the documents that ``in_training`` picks."""
    languages, sample = _sample(docs, doc_id, text, lang)
    sample = staged(sample)
    each = max(1, LANDMARKS // max(1, len(languages)))
    # A bounded number of landmarks, 8 KB each.
    marks = sample.filter(F.col("rank") <= each).orderBy("lang", "rank").select("bits").limit(max(LANDMARKS, LANGUAGES)).collect()
    if not marks:
        return Model([], np.zeros((CELLS, 0), np.float32))
    landmarks = _unpacked(pa.array([bytes(r["bits"]) for r in marks]))
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks))
    some = values > 1e-8 * values[-1]
    root = vectors[:, some] / np.sqrt(values[some])
    packed = np.packbits(landmarks.astype(bool), axis=1)
    where = {name: i for i, name in enumerate(languages)}

    def run(batches):
        mapped, left, right = None, None, None
        for batch in batches:
            if mapped is None:
                mapped = np.unpackbits(packed, axis=1).astype(np.float32)
                left, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(where)))
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                features = _kernel(_unpacked(part.column("bits")), mapped) @ root
                own = np.full((len(part), len(where)), -1.0)
                own[np.arange(len(part)), [where[v] for v in part.column("lang").to_pylist()]] = 1
                left += features.T @ features
                right += features.T @ own
        if mapped is not None:
            out = [pa.array([x.tobytes()], pa.binary()) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(out, names=["l", "r"])

    # One row per task, and few tasks, as the sample is bounded.
    sums = sample.select("lang", "bits").coalesce(8).mapInArrow(run, "l binary, r binary").collect()
    size = root.shape[1]
    left = sum(np.frombuffer(s["l"]).reshape(size, size) for s in sums)
    right = sum(np.frombuffer(s["r"]).reshape(size, -1) for s in sums)
    ridge = RIDGE * np.trace(left) / size
    coefficients = root @ np.linalg.solve(left + ridge * np.eye(size), right)
    own = np.sqrt(np.maximum(landmarks.sum(axis=1), 1))
    return Model(languages, (landmarks.T @ (coefficients / own[:, None])).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns or those to keep) with ``lang_pred`` and ``score``: half of one and the best value,
    within 0 and 1."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        names, scores = [], []
        column = columns[0]
        for at in range(0, len(column), ROWS):
            matrix, has_letters = presence(column.slice(at, ROWS).to_pylist())
            if not model.languages:
                has_letters[:] = False
            best = np.zeros(len(matrix), np.int64)
            score = np.zeros(len(matrix))
            if has_letters.any():
                values = model.values(matrix)
                best = values.argmax(axis=1)
                score = np.clip((1 + values.max(axis=1)) / 2, 0, 1)
            names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letters)]
            scores += np.where(has_letters, score, 0.0).tolist()
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return annotated(docs, run, "lang_pred string, score double", [text], keep)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learns from the documents outside the held-out part and predicts all: ``row``, ``held_out``,
    ``lang_pred``, ``score``."""
    keep = docs.columns if keep is None else keep
    model = fit(docs)
    found = predict(docs, model, keep=list(dict.fromkeys([*keep, "doc_id"])))
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in keep])
    held_out = ~in_training(F.col("row.doc_id"))
    return found.select(row.alias("row"), held_out.alias("held_out"), "lang_pred", "score")
