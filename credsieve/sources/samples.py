"""Labelled text samples: (text, label) with label 1 for a secret."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions import text as tx

# What ends a line for Python's str.splitlines besides the newlines of the text reader.
_OTHER_LINE_ENDS = r"[\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def _stripped(lines: DataFrame) -> DataFrame:
    return lines.select(tx.strip(F.col("value")).alias("text")).filter(F.col("text") != "")


def _every_line(lines: DataFrame) -> DataFrame:
    """Split at the line ends the reader does not know; blank lines stay.

    Each row was closed by a newline, so an empty last piece is a line of its own.
    """
    return lines.select(F.explode(F.split("value", _OTHER_LINE_ENDS)).alias("text"))


def read_samples(
    spark: SparkSession, positives: str, negatives: str, mode: str = "quality"
) -> DataFrame:
    """Both classes of a line-per-sample dataset.

    ``quality`` trims lines and drops blank ones; ``training`` keeps every line as it is and also
    splits at the other Unicode line ends.
    """
    shape = {"quality": _stripped, "training": _every_line}[mode]

    def one(path: str, label: int) -> DataFrame:
        return shape(spark.read.text(path)).withColumn("label", F.lit(label))

    return one(positives, 1).unionByName(one(negatives, 0))


def clean_evaluation(rows: DataFrame) -> DataFrame:
    """Samples (text, label, expected) of a table (secret_value, secret_type)."""
    value, kind = tx.strip(F.col("secret_value")), tx.strip(F.col("secret_type"))
    return rows.select(
        value.alias("text"),
        (F.lower(kind) == "secret").cast("int").alias("label"),
        kind.alias("expected"),
    ).filter((F.col("text") != "") & (F.col("expected") != ""))


def read_evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples of a CSV file with a header."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return clean_evaluation(rows)
