"""Extendible hashing: shards by hash prefix, none over a byte limit. DataFrame operations only.

A directory maps prefixes of a document's hash bits to shards. It starts with one shard; a shard
over the limit is split on its next bit, and only such shards are split. The sums of all prefixes of
a level come from one histogram of cells, so a round settles many levels at once.

The hash has 40 bits of the document id and 22 bits of a salt stored with the row, so that rows of
one id (or of no id) can be told apart as well. A row is never cut: a document over the limit ends
up in a shard of its own.

Defined cases: a null text has no bytes; a null id hashes as the text ``null``; repeated rows are
rows of their own; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import packed, staged

SHARD_BYTES = 4 << 20
BITS = 62
ID_BITS = 40
#: Levels below the expected one that the first histogram covers.
SPARE_LEVELS = 4


def hashed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` with its bytes and its hash bits."""
    kept = docs if keep is None else docs.select(*keep)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    top = F.conv(F.substring(F.md5(name), 1, ID_BITS // 4), 16, 10).cast("long")
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - (BITS - ID_BITS))
    return docs.select(
        packed(kept).alias("row"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.shiftleft(top, BITS - ID_BITS).bitwiseOR(salt).alias("hash"),
    )


def _round(rows: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """For each cell of level ``bottom`` its shard: the first prefix that holds few enough bytes.

    ``depth`` is null where even the cell is over the limit.
    """
    cells = rows.groupBy(F.shiftright("hash", BITS - bottom).alias("cell")).agg(
        F.sum("n_bytes").alias("cell_bytes"), F.count("*").alias("cell_rows")
    )
    levels = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bottom} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(
        F.sum("cell_bytes").alias("shard_bytes"), F.sum("cell_rows").alias("shard_rows")
    )
    fits = f"shard_bytes <= {limit} OR shard_rows = 1 OR depth = {BITS}"
    found = levels.join(buckets.filter(fits), ["depth", "prefix"])
    best = found.groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("shard")
    )
    return cells.select("cell").join(best, "cell", "left")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``row`` with its bytes and its shard: ``shard`` (the prefix as bits), its depth, bytes, rows."""
    rows = staged(hashed(docs, keep))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = max(0, math.ceil(math.log2(max(1, total) / limit))) + SPARE_LEVELS
    top, done = 0, []
    while True:
        bottom = min(BITS, top + step)
        directory = staged(_round(rows, top, bottom, limit))
        placed = rows.withColumn("cell", F.shiftright("hash", BITS - bottom)).join(directory, "cell")
        done.append(placed.filter("shard IS NOT NULL"))
        if directory.filter("shard IS NULL").isEmpty():
            break
        rows = placed.filter("shard IS NULL").select("row", "n_bytes", "hash")
        top = bottom
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    depth = F.col("shard.depth")
    bits = F.lpad(F.bin("shard.prefix"), depth, "0")
    return result.select(
        "row",
        "n_bytes",
        F.when(depth == 0, F.lit("")).otherwise(bits).alias("shard"),
        depth.cast("long").alias("depth"),
        F.col("shard.shard_bytes").alias("shard_bytes"),
        F.col("shard.shard_rows").alias("shard_rows"),
    )
