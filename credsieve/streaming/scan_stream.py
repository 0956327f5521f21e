"""Continuous scan of arriving files.

A file is one row, so all its findings fall in one micro-batch: the scan of a batch is the scan of
its files and needs no state between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credsieve.operators.classify import score_findings
from credsieve.operators.scan import scan_files
from credsieve.plans import scans
from credsieve.session import scratch
from credsieve.sources.files import stream_files, visible_files
from credsieve.sources.tree import SETTLE

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_tree(spark: SparkSession, root: str, settle: float = SETTLE) -> DataFrame:
    """All files arriving below ``root/<project>/``, hidden and empty ones too, once each. A file is taken when it has
    lain still for ``settle`` seconds. Contents are read by the scan of the batch."""
    return stream_files(spark, root, settle)


def stream_visible_tree(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Files arriving below ``root/<project>/`` by Spark's own file source, which can bound the files of a batch but
    passes over empty files and names that start with ``.`` or ``_``."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", True)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return visible_files(reader.load(root), root)


def start_scan(
    files: DataFrame,
    output: str,
    checkpoint: str,
    model=None,
    scan: Callable[[DataFrame], DataFrame] = scan_files,
    once: bool = False,
    reports: str | None = None,
    requests: DataFrame | None = None,
) -> StreamingQuery:
    """Scan each micro-batch and write its findings to ``output/query=<id>/batch=<id>``.

    The query's id lives in its checkpoint. A batch that is replayed after a failure overwrites its
    own folder and nothing else; a new checkpoint into the same output adds to it.

    With ``reports`` and ``requests`` each batch also gives the reports, with languages, frameworks
    and totals, of the requested projects among its files.
    """
    key = "sql.streaming.queryId"

    def write(batch: DataFrame, batch_id: int) -> None:
        findings = scan(batch)
        if model is not None:
            findings = score_findings(findings, model)
        query = batch.sparkSession.sparkContext.getLocalProperty(key)
        place = f"query={query}/batch={batch_id}"
        findings.write.mode("overwrite").parquet(f"{output}/{place}")
        if reports is not None:
            names = batch.select(F.col("project").alias("ProjectName")).distinct()
            asked = requests.join(names, "ProjectName", "left_semi")
            with scratch(batch.sparkSession):
                made = scans.scan_requests(asked, batch, model)
                made.write.mode("overwrite").parquet(f"{reports}/{place}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_findings(spark: SparkSession, output: str) -> DataFrame:
    """All findings written so far."""
    return spark.read.parquet(output).drop("query", "batch")
