"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

The mix takes ``share`` times the words of all sources. Each source gets its part by weight, at
most ``max_repeats`` times its own words; what a full source leaves is shared again by weight.
Within a source the documents follow one another in hash order, pass after pass, and are taken while
their middle lies below the source's target. So no document is cut, and the words taken miss the
target by half a document at most.

Every source has a weight that changes linearly over training. Its integral from the start is the
source's demand up to that time; inverting it at a document's place gives the document's training
position.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources
without words have target 0; repeated rows are documents of their own; rows with equal ids are
ordered by size; an empty table gives an empty mix. Extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import packed, staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
#: By how much of itself a source's weight rises (or falls) from the middle to the end of training.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows of a source and hash bin that are put in order together, about.
BIN_ROWS = 256

_WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` with its words, its source as a key without nulls, and its place in hash order."""
    kept = docs if keep is None else docs.select(*keep)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return docs.select(
        packed(kept).alias("row"),
        F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source")).alias("source_key"),
        "source",
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("place"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("tie"),
    )


def targets(
    documents: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """One row per source: its words, its weight, and the words the mix is to take from it.

    All targets are ``min(cap, level * weight)`` for one level. In the order of cap by weight the
    first source that the level of the rest does not fill gives it.
    """
    sources = documents.groupBy("source_key", F.col("source").alias("_source")).agg(
        F.sum("size").alias("source_size")
    )
    ordered = Window.orderBy(F.col("_source").asc_nulls_last())  # as many rows as there are sources
    rank = F.row_number().over(ordered) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    slopes = F.array(*[F.lit(float(s)) for s in SLOPES])
    sources = sources.select(
        "*",
        F.get(listed, rank % len(weights)).alias("weight"),
        F.get(slopes, rank % len(SLOPES)).alias("slope"),
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    demand = F.sum("source_size").over(everything) * F.lit(float(share))
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = (demand - filled) / F.sum("weight").over(after)
    level = F.when(level <= F.col("cap") / F.col("weight"), level)
    sources = sources.withColumn("level", level).withColumn("demand", demand)
    first = F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))).over(everything)
    return sources.select(
        "source_key", "source_size", "weight", "slope", "demand",
        F.when(first.isNull(), F.col("cap"))
        .otherwise(F.least("cap", first["level"] * F.col("weight")))
        .alias("target"),
    )


def placed(documents: DataFrame, rows: int, **options) -> DataFrame:
    """Every document with its source's figures and the words of its source that come before it.

    The running sum goes over small hash bins, then over the bins of a source, so that a hot source
    is spread over many tasks.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / BIN_ROWS)))
    documents = documents.withColumn("bin", F.shiftright("place", 60 - bits))
    plan = targets(documents, **options)
    earlier = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        documents.groupBy("source_key", "bin")
        .agg(F.sum("size").alias("bin_size"))
        .withColumn("offset", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
        .join(plan, "source_key")
        .drop("bin_size")
    )
    within = Window.partitionBy("source_key", "bin").orderBy("place", "tie", "size")
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        documents.withColumn("running", running)
        .join(bins, ["source_key", "bin"])
        .withColumn("start", F.col("offset") + F.col("running") - F.col("size"))
    )


def _middle(turn):
    return turn * F.col("source_size") + F.col("start") + F.col("size") / 2


def with_passes(documents: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The passes that take the document, and the words taken."""
    passes = sum((F.when(_middle(F.lit(k)) < F.col("target"), 1).otherwise(0) for k in range(max_repeats)), F.lit(0))
    return documents.withColumn("passes", passes).withColumn("taken", F.col("passes") * F.col("size"))


def position(turn):
    """The place in training of a pass over a document, in words: with ``u`` the part of its source
    that lies before it, the root of ``slope t^2 + (1 - slope) t = u``."""
    u = _middle(turn) / F.col("target")
    b = 1 - F.col("slope")
    root = (F.sqrt(b * b + 4 * F.col("slope") * u) - b) / (2 * F.col("slope"))
    time = F.when(F.col("slope") == 0, u).otherwise(root)
    return F.floor(time * F.col("demand")).cast("long")


def plan_mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document: what the mix takes of it and where its first pass comes."""
    documents = staged(sized(docs, keep))
    return with_passes(placed(documents, documents.count())).withColumn(
        "first_position", F.when(F.col("passes") > 0, position(F.lit(0)))
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, in the order of training; columns unchanged."""
    documents = with_passes(placed(sized(docs), docs.count()))
    turns = documents.filter("passes > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("turn")
    )
    return (
        turns.withColumn("position", position(F.col("turn")))
        .sort("position", "place", "turn")
        .select("row.*")
    )
