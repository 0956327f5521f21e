"""Scan requests: one row per project to scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REQUEST_FIELDS = ("ProjectName", "RepoUrl", "RefType", "Ref", "CallbackUrl")
REQUEST_SCHEMA = T.StructType([T.StructField(n, T.StringType(), False) for n in REQUEST_FIELDS])


def make_requests(spark: SparkSession, rows) -> DataFrame:
    """Requests of dicts or tuples; a missing field is refused."""
    return spark.createDataFrame(
        [tuple(r[n] for n in REQUEST_FIELDS) if isinstance(r, dict) else tuple(r) for r in rows],
        REQUEST_SCHEMA,
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON lines."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)
