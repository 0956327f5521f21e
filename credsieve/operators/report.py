"""Scan reports per project, request checks, and their sinks."""

from __future__ import annotations

import base64
import gzip
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve import settings
from credsieve.functions.urls import repository_parts
from credsieve.operators import quality
from credsieve.operators.repair import repair
from credsieve.operators.scan import mask_findings
from credsieve.session import materialize

#: Results of one record; every project's are cut at its multiples.
RESULTS_PER_RECORD = 10_000


# --- requests --------------------------------------------------------------------------------


def check_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Every request with its commit, or ``not_found`` and the reason.

    ``projects`` holds (project, commit) of what is there to scan. A URL with ``_git`` is expected.
    """
    url_problem = repository_parts(F.col("RepoUrl"))["problem"]
    missing = F.concat(F.col("RefType"), F.lit(" '"), F.col("Ref"), F.lit("' not found"))
    joined = requests.join(
        projects.select(F.col("project").alias("ProjectName"), "commit"), "ProjectName", "left"
    )
    problem = F.coalesce(url_problem, F.when(F.col("commit").isNull(), missing))
    return joined.select(
        "ProjectName",
        "RefType",
        "Ref",
        F.when(problem.isNull(), F.col("commit")).otherwise("not_found").alias("commit"),
        problem.alias("problem"),
    )


def validate_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """All or nothing: accepted when every request resolves, else the first problem by project."""
    checked = check_requests(requests, projects)
    failed = F.col("problem").isNotNull()
    totals = checked.agg(
        F.count_if(~failed).alias("resolved"),
        F.count_if(failed).alias("failed"),
        F.min_by("problem", F.when(failed, F.col("ProjectName"))).alias("first_problem"),
    )
    return totals.select(
        F.when(F.col("failed") == 0, "accepted").otherwise("validation_failed").alias("status"),
        F.when(F.col("failed") == 0, "All requests resolved")
        .otherwise(F.concat(F.lit("Not all requests resolve: "), "first_problem"))
        .alias("message"),
        "resolved",
        "failed",
    )


# --- reports ---------------------------------------------------------------------------------


def placed_results(findings: DataFrame) -> DataFrame:
    """Findings with their ``position`` within their project, by path, line and rule.

    They are sorted in ranges, so a project of very many findings lies in many partitions; what is added up to number
    them is one row per project and partition.
    """
    order = ["project", "path", "line", "rule_ord"]
    ranged = findings.repartitionByRange(*order).sortWithinPartitions(*order, "secret", "context")
    stored = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))
    run = F.shiftright("_at", 33)
    runs = stored.groupBy("project", run.alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("project").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    position = F.col("_before") + F.col("_at") - F.col("_first")
    numbered = stored.withColumn("_run", run).join(starts, ["project", "_run"])
    return numbered.select(*findings.columns, position.alias("position"))


def scan_report(
    requests: DataFrame,
    findings: DataFrame,
    exclusions: DataFrame,
    languages: DataFrame,
    frameworks: DataFrame,
    masked: bool = True,
    per_record: int = RESULTS_PER_RECORD,
) -> DataFrame:
    """Nested records per request, all of one shape: ``part`` of ``parts``, what is known of the project as a
    whole, and the results of that part in order. Part p holds the positions from p * ``per_record`` on; a project
    without findings has one part without results.

    A project without readable files gives a record with status Error; the others are unaffected.
    Secrets are starred unless ``masked`` is off.
    """
    shown = materialize(mask_findings(findings) if masked else findings)
    fields = [name for name in findings.columns if name != "project"]
    kind = shown.select(F.array(F.struct(*fields))).schema.fields[0].dataType
    placed = placed_results(shown).withColumn("part", F.floor(F.col("position") / per_record).cast("int"))
    gathered = placed.groupBy("project", "part").agg(
        F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("row")))).alias("rows")
    )
    results = gathered.select("project", "part", F.transform("rows", lambda r: r["row"]).alias("results"))
    counts = shown.groupBy("project").agg(F.count("*").alias("n_results"))
    totals = exclusions.select("project", "files_excluded", "all_files", "skipped_files")
    per_language = languages.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("language", "files", "extensions"))).alias("languages")
    )
    per_framework = frameworks.groupBy("project").agg(
        F.array_sort(
            F.collect_list(F.struct("framework", "kind", "count_label", "description", "files"))
        ).alias("frameworks")
    )
    header = (
        requests.select(
            F.col("ProjectName").alias("project"),
            F.col("RepoUrl").alias("repo_url"),
            F.col("Ref").alias("commit"),
        )
        .join(totals, "project", "left")
        .join(per_language, "project", "left")
        .join(per_framework, "project", "left")
        .join(counts, "project", "left")
    )
    found = F.col("all_files").isNotNull()
    n_results = F.coalesce("n_results", F.lit(0))
    return header.join(results, "project", "left").select(
        F.when(found, "completed").otherwise("Error").alias("status"),
        F.when(found, "Scanned Successfully")
        .otherwise("Process Error: the project has no readable files")
        .alias("message"),
        "project",
        "repo_url",
        "commit",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.greatest(F.ceil(n_results / per_record), F.lit(1)).cast("int").alias("parts"),
        n_results.alias("n_results"),
        F.coalesce("results", F.array().cast(kind)).alias("results"),
        F.coalesce("files_excluded", F.lit(0)).alias("files_excluded"),
        F.coalesce("all_files", F.lit(0)).alias("all_files"),
        F.coalesce("skipped_files", F.lit("")).alias("skipped_files"),
        F.coalesce("languages", F.array()).alias("languages"),
        F.coalesce("frameworks", F.array()).alias("frameworks"),
    )


def report_results(reports: DataFrame) -> DataFrame:
    """The results of reports as rows, with their position in the project."""
    return reports.select("project", "part", F.posexplode("results").alias("place", "result")).select(
        "project", "part", "place", "result.*"
    )


# --- sinks -----------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _gzip_base64(text: pd.Series) -> pd.Series:
    return text.map(lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())


def report_envelopes(reports: DataFrame) -> DataFrame:
    """Reports as compressed text with the sizes before and after and the saving in percent."""
    packed = reports.select("project", "part", F.to_json(F.struct("*")).alias("json")).select(
        "project",
        "part",
        _gzip_base64("json").alias("data"),
        F.octet_length("json").alias("original_size"),
    )
    size = F.octet_length(F.unbase64("data"))
    # The whole envelope as JSON is what travels, and what the saving is measured by.
    envelope = F.octet_length(
        F.format_string(
            '{"compressed": true, "data": "%s", "original_size": %d, "compressed_size": %d}',
            "data", "original_size", size,
        )
    )
    return packed.select(
        "project",
        "part",
        F.lit(True).alias("compressed"),
        "data",
        "original_size",
        size.alias("compressed_size"),
        F.round((1 - envelope / F.col("original_size")) * 100, 1).alias("saving"),
    )


@F.pandas_udf(T.StringType())
def _opened(data: pd.Series) -> pd.Series:
    return data.map(lambda d: gzip.decompress(base64.b64decode(d)).decode())


def open_envelopes(envelopes: DataFrame) -> DataFrame:
    """Envelopes with the report in ``json`` in place of the compressed ``data``."""
    kept = [name for name in envelopes.columns if name != "data"]
    return envelopes.select(*kept, _opened("data").alias("json"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as gzip-compressed JSON lines."""
    reports.write.mode("overwrite").option("compression", "gzip").json(path)


def quality_lines(judged: DataFrame, scored: DataFrame) -> DataFrame:
    """The quality report as text: rows (place, line) in reading order.

    Metrics by section, then advice, then the first texts found in both classes and the first
    secrets no rule covers.
    """
    sections = list(quality.SECTIONS)
    names = [name for metrics in quality.SECTIONS.values() for name in metrics]

    def place(base: int, values: list[str], name: str) -> Column:
        order = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        return (base + order).cast("int").alias("place")

    label = scored.select(
        F.lit(0).alias("place"),
        F.format_string("Quality %.1f of 10: %s", "quality_score_10", "quality_label").alias("line"),
    )
    metrics = quality.tidy(scored).select(
        place(100, names, "metric"),
        F.format_string(
            "%d. %s / %s: %.4f",
            F.array_position(F.array(*[F.lit(v) for v in sections]), F.col("section")),
            "section",
            "metric",
            "value",
        ).alias("line"),
    )
    advice = quality.recommendations(scored).select(
        place(1000, ["critical", "warning", "suggestion"], "level"),
        F.format_string(
            "%s: %s%s", "level", "message", F.when(F.col("fixable"), " (repairable)").otherwise("")
        ).alias("line"),
    )
    positive, negative = F.col("n_pos") > 0, F.col("n_neg") > 0
    kinds = {
        "in both classes": (positive & negative, 5),
        "not covered": (positive & F.col("first_rule").isNull(), 10),
    }
    lines = label.unionByName(metrics).unionByName(advice)
    for base, (kind, (holds, limit)) in zip((2000, 3000), kinds.items()):
        shown = judged.filter(holds).select(F.lit(kind).alias("category"), "text")
        lines = lines.unionByName(
            quality.examples(shown, "category", limit=limit).select(
                (base + F.col("place")).alias("place"),
                F.concat_ws(": ", "category", "text").alias("line"),
            )
        )
    return lines


def write_quality_report(samples: DataFrame, path: str, rules=settings.RULES) -> None:
    """The report on samples below a path: ``json`` with the metrics, ``text`` to read."""
    judged = materialize(quality.judge(samples, rules))
    scored = materialize(quality.scorecard(quality.summarize(judged, len(rules))))
    quality.tidy(scored).write.mode("overwrite").json(f"{path}/json")
    # A bounded number of lines: one file keeps them in order.
    ordered = quality_lines(judged, scored).orderBy("place", "line").select("line")
    ordered.coalesce(1).write.mode("overwrite").text(f"{path}/text")


def write_samples(samples: DataFrame, path: str) -> dict[str, str]:
    """One text file set per class below a new path; refuses a path that exists already."""
    samples.select("text", "label").write.mode("error").partitionBy("label").text(path)
    return {"positives": f"{path}/label=1", "negatives": f"{path}/label=0"}


def write_repaired(samples: DataFrame, base: str, rules=settings.RULES) -> dict[str, str]:
    """The repaired samples as a new version below ``base``; what was read stays as it is."""
    version = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    return write_samples(repair(samples, rules), f"{base}/version={version}")
