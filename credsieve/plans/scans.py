"""Whole scans and dataset checks, composed of the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.operators import classify, inventory, quality, repair, report, scan
from credsieve.session import materialize
from credsieve.sources.archives import archive_problems, expand_archives, member_files


class ScanResult(NamedTuple):
    findings: DataFrame
    exclusions: DataFrame
    languages: DataFrame
    frameworks: DataFrame


def scan_projects(
    files: DataFrame,
    model=None,
    rules=settings.RULES,
    false_positives=settings.FALSE_POSITIVES,
    extensions=settings.EXCLUDED_EXTENSIONS,
    names=settings.EXCLUDED_FILES,
    languages=settings.LANGUAGES,
    frameworks=settings.FRAMEWORKS,
    manifests=settings.MANIFEST_FILES,
    max_secrets: int = settings.MAX_SECRETS_PER_FILE,
    max_line_length: int = settings.MAX_LINE_LENGTH,
) -> ScanResult:
    """Findings (scored with a model), exclusion totals, languages and frameworks of all projects.

    Languages and totals never read a content; Spark prunes the column.
    """
    findings = scan.scan_files(
        files, rules, false_positives, extensions, names, max_secrets, max_line_length
    )
    if model is not None:
        findings = classify.score_findings(findings, model)
    return ScanResult(
        findings,
        scan.exclusion_summary(files, extensions, names),
        inventory.language_summary(files, languages),
        inventory.framework_report(inventory.framework_evidence(files, frameworks, manifests)),
    )


def _report(requests: DataFrame, result: ScanResult, masked: bool, rules=settings.RULES) -> DataFrame:
    """Reports of a scan. The findings are written once, masked before that where they are to be, so contents are
    matched only once and no secret is stored in clear."""
    shown = scan.mask_findings(result.findings, rules) if masked else result.findings
    return report.scan_report(requests, *result._replace(findings=shown), masked=False)


def scan_requests(requests: DataFrame, files: DataFrame, model=None, masked=True, **options):
    """Reports of all requested projects in one run; a project that fails leaves the others be.

    The requests pick among the results: contents are neither counted nor joined. Where ``files`` is
    partitioned by project, filter it by the projects beforehand.
    """
    rules = options.get("rules", settings.RULES)
    return _report(requests, scan_projects(files, model, **options), masked, rules)


def scan_request(
    requests: DataFrame, files: DataFrame, project: str, model=None, masked=True, **options
):
    """The report of one project."""
    one = requests.filter(F.col("ProjectName") == project)
    mine = files.filter(F.col("project") == project)
    rules = options.get("rules", settings.RULES)
    return _report(one, scan_projects(mine, model, **options), masked, rules)


def scan_archives(archives: DataFrame, **options) -> ScanResult:
    """The scan of uploaded archives (project, content). They are expanded once, into the shared
    folder, as four plans read them."""
    return scan_projects(member_files(materialize(expand_archives(archives))), **options)


def report_archives(requests: DataFrame, archives: DataFrame, model=None, masked=True, **options):
    """Reports of archives; one that cannot be read gives status Error and leaves the others be."""
    members = materialize(expand_archives(archives))
    problems = (
        archive_problems(members)
        .groupBy("project")
        .agg(F.min("problem").alias("problem"), F.count("*").alias("broken"))
    )
    rules = options.get("rules", settings.RULES)
    reports = _report(requests, scan_projects(member_files(members), model, **options), masked, rules)
    joined = reports.join(problems, "project", "left")
    failed = F.col("problem").isNotNull()
    lost = (F.col("status") == "Error") & failed
    message = (
        F.when(lost, F.concat(F.lit("Process Error: "), "problem"))
        .when(failed, F.concat("message", F.lit(" without "), "broken", F.lit(" unreadable members")))
        .otherwise(F.col("message"))
    )
    return joined.withColumn("message", message).select(*reports.columns)


def quality_before_after(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """The quality report of a dataset and of its repaired form: (stage, section, metric, value).

    The texts are judged once and stored; the repair keeps a part of them with their judgements.
    """
    judged = materialize(quality.judge(samples, rules))
    kept = materialize(repair.keep(judged))
    one_each = kept.withColumns({"n_pos": F.col("label"), "n_neg": 1 - F.col("label")})

    def stage(texts: DataFrame, name: str) -> DataFrame:
        scored = quality.scorecard(quality.summarize(texts, len(rules)))
        return quality.tidy(scored).withColumn("stage", F.lit(name))

    return stage(judged, "before").unionByName(stage(one_each, "after"))
