"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the cores.
Every query is run once to its last row without collecting it. ``rates`` holds scanned lines and
scored rows per second over all lines and all sentences of ``documents``, and evaluated rows per
second over all labelled samples.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from credsieve.operators import classify, scan
from credsieve.plans import fixtures as fx
from credsieve.plans.catalog import QUERIES
from credsieve.session import build_session
from credsieve.sources.files import to_lines, with_names

HEADLINES = (
    "scan_findings", "rule_scan", "rule_hits_all", "cap_per_file", "exclusion_summary",
    "language_summary", "framework_report", "quality_basic", "quality_duplicates",
    "quality_coverage", "quality_patterns", "entropy_stats", "quality_scorecard",
    "repair_dataset", "quality_report_before_after", "ngram_frequencies", "blend_severity",
    "confusion_metrics", "scan_report", "archive_scan", "stream_scan",
)


def timed(action) -> tuple[float, object]:
    start = time.perf_counter()
    result = action()
    return round(time.perf_counter() - start, 3), result


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        seconds[name], _ = timed(lambda: drain(QUERIES[name](spark, sf_dir)))

    documents = with_names(
        fx.documents(spark, sf_dir).select(
            F.col("source").alias("project"),
            F.concat(F.lit("d"), "doc_id").alias("path"),
            F.col("text").alias("content"),
        )
    )
    lines = to_lines(documents)
    n_lines = lines.count()
    seconds["scan_document_lines"], _ = timed(lambda: drain(scan.scan_lines(lines)))

    samples = fx.samples(spark, sf_dir)
    training, test = classify.split(samples)
    seconds["fit_model"], model = timed(lambda: classify.fit(training))
    accuracy = classify.evaluate(model, test).first()["accuracy"]
    seconds["evaluate_model"], metrics = timed(lambda: classify.evaluate(model, samples).first())
    seconds["score_document_lines"], _ = timed(
        lambda: drain(classify.predict_samples(model, lines.select("text")))
    )
    # Rows about as long as a secret: the sentences of the same documents.
    sentences = (
        lines.select(F.explode(F.split("text", "[.\n]")).alias("text"))
        .select(F.trim("text").alias("text"))
        .filter(F.length("text") > 0)
    )
    size = sentences.agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("chars")).first()
    seconds["score_document_sentences"], _ = timed(
        lambda: drain(classify.predict_samples(model, sentences))
    )
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": {
                    "scanned_lines_per_sec": round(n_lines / seconds["scan_document_lines"], 1),
                    "scored_rows_per_sec": round(n_lines / seconds["score_document_lines"], 1),
                    "scored_sentences_per_sec": round(
                        size["n"] / seconds["score_document_sentences"], 1
                    ),
                    "evaluated_rows_per_sec": round(
                        metrics["total"] / seconds["evaluate_model"], 1
                    ),
                },
                "test_accuracy": round(accuracy, 4),
                "lines": n_lines,
                "sentences": size["n"],
                "chars_per_sentence": round(size["chars"], 1),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
