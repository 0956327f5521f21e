"""Repair of a two-class text dataset.

All steps are filters over the profile of distinct texts and a handful of counts taken from it:

1. texts of both classes leave the negatives,
2. each class keeps one row per text,
3. texts with a quality flag go,
4. positives no rule covers go if they are fewer than 30% of the positives left,
5. the larger class is trimmed to four times the smaller when it fills more than 80%.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.operators.quality import FLAGS, judge
from credsieve.session import materialize

UNCOVERED_SHARE = 0.3
TRIM_FACTOR = 4


def _judged(judged: DataFrame) -> DataFrame:
    """Judged texts with the class they keep, and whether they are flagged or covered."""
    flagged = F.lit(False)
    for flag in FLAGS:
        flagged = flagged | F.col(flag)
    return judged.select(
        "*",
        (F.col("n_pos") > 0).cast("int").alias("label"),
        flagged.alias("flagged"),
        F.col("first_rule").isNotNull().alias("covered"),
    )


def _counts(judged: DataFrame) -> DataFrame:
    """One row with the rows every step removes and the size each class is trimmed to."""
    c = F.col
    positive, both = c("label") == 1, (c("n_pos") > 0) & (c("n_neg") > 0)

    def total(what: Column) -> Column:
        return F.coalesce(F.sum(what), F.lit(0))

    kept = judged.agg(
        total(c("n_pos") + c("n_neg")).alias("rows_before"),
        total(F.when(both, c("n_neg"))).alias("overlap"),
        total(F.when(positive, c("n_pos") - 1).otherwise(c("n_neg") - 1)).alias("duplicates"),
        F.count_if(c("flagged")).alias("flagged"),
        total(F.when(~c("covered"), c("n_pos"))).alias("uncovered_rows"),
        F.count_if(positive & ~c("flagged")).alias("pos_left"),
        F.count_if(positive & ~c("flagged") & ~c("covered")).alias("pos_uncovered"),
        F.count_if(~positive & ~c("flagged")).alias("neg_left"),
    )
    drop_uncovered = (c("uncovered_rows") > 0) & (
        c("uncovered_rows") < c("pos_left") * UNCOVERED_SHARE
    )
    kept = kept.withColumn("drop_uncovered", drop_uncovered).withColumn(
        "pos", c("pos_left") - F.when(c("drop_uncovered"), c("pos_uncovered")).otherwise(0)
    ).withColumn("neg", c("neg_left"))
    share = F.when((c("pos") > 0) & (c("neg") > 0), c("pos") / (c("pos") + c("neg")))
    return kept.select(
        "*",
        F.when(share > 0.8, F.least(c("pos"), c("neg") * TRIM_FACTOR))
        .otherwise(c("pos")).alias("keep_pos"),
        F.when(share < 0.2, F.least(c("neg"), c("pos") * TRIM_FACTOR))
        .otherwise(c("neg")).alias("keep_neg"),
    )


def repair_report(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """Rows each step removes, in order, and the class sizes left: (step, rows)."""
    c = F.col
    steps = {
        "rows_before": c("rows_before"),
        "removed_overlap": c("overlap"),
        "removed_duplicates": c("duplicates"),
        "removed_flagged": c("flagged"),
        "removed_uncovered": F.when(c("drop_uncovered"), c("pos_uncovered")).otherwise(0),
        "trimmed_secrets": c("pos") - c("keep_pos"),
        "trimmed_non_secrets": c("neg") - c("keep_neg"),
        "secrets_after": c("keep_pos"),
        "non_secrets_after": c("keep_neg"),
    }
    counts = _counts(_judged(judge(samples, rules)))
    rows = [
        F.struct(
            F.lit(place).alias("place"),
            F.lit(step).alias("step"),
            value.cast("bigint").alias("rows"),
        )
        for place, (step, value) in enumerate(steps.items(), start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _keep_first(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The first rows of each label by (hash, text), as many as ``targets`` (label, target) says.

    Rows are counted per prefix of the hash, which spreads distinct texts evenly. Prefixes before
    the cut pass whole; only the rows of the one prefix at the cut are ordered.
    """
    hashed = rows.withColumn("hash", F.md5(F.col("text").cast("binary"))).withColumn(
        "prefix", F.substring("hash", 1, 4)
    )
    # At most 2 x 65,536 prefixes.
    counts = hashed.groupBy("label", "prefix").agg(F.count("*").alias("n"))
    running = (
        Window.partitionBy("label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = (
        counts.withColumn("upto", F.sum("n").over(running))
        .join(F.broadcast(targets), "label")
        .select(
            "label",
            "prefix",
            (F.col("target") - (F.col("upto") - F.col("n"))).alias("room"),
            (F.col("upto") <= F.col("target")).alias("whole"),
        )
        .filter(F.col("room") > 0)
    )
    columns = rows.columns
    marked = hashed.join(F.broadcast(placed), ["label", "prefix"])
    order = Window.partitionBy("label", "prefix").orderBy("hash", "text")
    at_cut = (
        marked.filter(~F.col("whole"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("room"))
    )
    return marked.filter("whole").select(columns).unionByName(at_cut.select(columns))


def keep(judged: DataFrame) -> DataFrame:
    """The judged texts the repair keeps, each with its ``label``.

    ``judged`` is read several times, so it should be a stored table.
    """
    marked = _judged(judged)
    counts = materialize(_counts(marked))
    drop_uncovered = counts.select("drop_uncovered").scalar()
    left = marked.filter(~F.col("flagged")).filter(
        (F.col("label") == 0) | F.col("covered") | ~drop_uncovered
    )
    targets = counts.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("label"), F.col("keep_pos").alias("target")),
                F.struct(F.lit(0).alias("label"), F.col("keep_neg").alias("target")),
            )
        )
    )
    return _keep_first(left.select(*judged.columns, "label"), targets)


def repair(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """The repaired samples (text, label)."""
    needed = judge(samples, rules).select("text", "n_pos", "n_neg", "first_rule", *FLAGS)
    return keep(materialize(needed)).select("text", "label")
