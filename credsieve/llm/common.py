"""Helpers shared by the operators: tables, scratch storage, and words as hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.session import shared_dir

#: Most bytes of text whose words are hashed at once; one longer text is taken alone.
CHUNK_BYTES = 2 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(frame: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The frame written to the cluster's shared folder and read back: lineage ends there, and the
    rows survive lost executors."""
    path = shared_dir(frame.sparkSession)
    writer = frame.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def lower_ascii(column):
    """A-Z to a-z, everything else as it is."""
    return F.translate(column, _UPPER, _LOWER)


def byte_class(separators: str) -> np.ndarray:
    """For each byte whether it belongs to a word; bytes of non-ASCII characters always do."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Words are runs of anything but space and the controls from tab to carriage return.
SPACED = byte_class(" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = np.uint64(1)
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte starts and ends of the words of a run of texts, and the word index each text begins at."""
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.take(is_word, raw, out=inside[1:-1])
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets] = True  # a word never reaches over the edge of its text
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | begins))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | begins))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word with A-Z lower-cased; equal words have equal hashes anywhere."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[_FOLD[raw]] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def fold_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of word hashes."""
    total = np.zeros_like(parts[0])
    for part in parts:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
    return total


def packed(frame: DataFrame):
    """All columns as one struct, so that their names cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns])


def annotated(
    frame: DataFrame, function, schema: str, inputs: list[str], keep: list[str] | None = None
) -> DataFrame:
    """``row`` (all columns, or those to keep) beside new columns that ``function`` gives for its
    input columns: it maps a list of Arrow arrays to a list of Arrow arrays, as in the schema."""
    keep = frame.columns if keep is None else keep
    needed = list(dict.fromkeys([*keep, *inputs]))
    source = frame.select(packed(frame.select(*[f"`{c}`" for c in needed])).alias("row"))
    names = [field.strip().split()[0] for field in ddl_fields(schema)]
    row_type = frame.select(*[f"`{c}`" for c in keep]).schema.simpleString()
    kept = [needed.index(c) for c in keep]
    read_at = [needed.index(c) for c in inputs]

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            parts = row.flatten()
            columns = function([parts[i] for i in read_at])
            fields = [row.type.field(i) for i in kept]
            out = pa.StructArray.from_arrays([parts[i] for i in kept], fields=fields)
            yield pa.RecordBatch.from_arrays([out, *columns], names=["row", *names])

    return source.mapInArrow(run, f"row {row_type}, {schema}")


def ddl_fields(schema: str) -> list[str]:
    """The fields of a DDL schema, split at its outer commas."""
    fields, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            fields.append(schema[last:i])
            last = i + 1
    return [*fields, schema[last:]]
