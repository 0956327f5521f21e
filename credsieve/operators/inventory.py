"""What a project is made of: languages and framework evidence.

These operators see all files, also the ones a scan leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions.regex import to_java
from credsieve.sources.files import with_content
from credsieve.sources.tables import language_table

OTHER = "Other"
KINDS = ("manifest", "config_file", "code")


def language_summary(files: DataFrame, languages=settings.LANGUAGES) -> DataFrame:
    """Files and distinct extensions per project and language.

    A file counts for every language that lists its extension, or for "Other". Files are counted
    per extension first, so the second grouping sees one row per distinct extension. The
    extensions of a language are as many as it lists; those of "Other" know no bound and are rows
    of ``language_extensions`` only.
    """
    listed = F.collect_list(F.when(F.col("language") != OTHER, F.col("ext")))
    return (
        language_extensions(files, languages)
        .groupBy("project", "language")
        .agg(F.sum("files").alias("files"), F.array_sort(listed).alias("extensions"))
    )


def language_extensions(files: DataFrame, languages=settings.LANGUAGES) -> DataFrame:
    """Files per project, language and extension; extensions in no group count as "Other"."""
    counted = files.groupBy("project", "ext").agg(F.count("*").alias("files"))
    table = language_table(files.sparkSession, languages)
    return counted.join(table, "ext", "left").select(
        "project", F.coalesce("language", F.lit(OTHER)).alias("language"), "ext", "files"
    )


def matching_patterns(content: Column, patterns) -> Column:
    """The patterns found in a content when case is ignored, as an array."""
    return F.array_compact(
        F.array(*[F.when(content.rlike(to_java(p, True)), F.lit(p)) for p in patterns])
    )


def has_any_pattern(content: Column, patterns) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | content.rlike(to_java(pattern, True))
    return found


def contained(content: Column, literals) -> Column:
    """The literals a content holds, as an array."""
    return F.array_compact(
        F.array(*[F.when(F.contains(content, F.lit(d)), F.lit(d)) for d in literals])
    )


def code_pattern_hits(files: DataFrame, framework: str, patterns) -> DataFrame:
    """One row (project, path, framework, patterns) per file that holds a pattern."""
    return with_content(files).select(
        "project",
        "path",
        F.lit(framework).alias("framework"),
        matching_patterns(F.col("content"), patterns).alias("patterns"),
    ).filter(F.size("patterns") > 0)


def merge_detections(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of detections (project, framework, path) without repeated files."""
    keys = ["project", "framework", "path"]
    return first.select(keys).unionByName(second.select(keys)).dropDuplicates(keys)


def framework_files(
    files: DataFrame, frameworks=settings.FRAMEWORKS, manifests=settings.MANIFEST_FILES
) -> DataFrame:
    """Evidence rows (project, framework, kind, path, dependencies), one pass over the files.

    A manifest counts when it holds a dependency literal, a config file by its name, and a code
    file when its extension fits and a pattern is found. The name tests come before the content.
    """
    name, ext, content = F.col("file_name"), F.col("ext"), F.col("content")
    none = F.array().cast("array<string>")

    def evidence(framework: str, kind: str, dependencies: Column) -> Column:
        return F.struct(
            F.lit(framework).alias("framework"),
            F.lit(kind).alias("kind"),
            dependencies.alias("dependencies"),
        )

    found = []
    for framework, rule in frameworks.items():
        if rule.dependencies and manifests:
            held = contained(content, rule.dependencies)
            is_manifest = name.isin(list(manifests))
            found.append(
                F.when(is_manifest & (F.size(held) > 0), evidence(framework, "manifest", held))
            )
        if rule.files:
            is_config = name.isin(list(rule.files))
            found.append(F.when(is_config, evidence(framework, "config_file", none)))
        if rule.code_extensions and rule.code_patterns:
            is_code = ext.isin(list(rule.code_extensions)) & has_any_pattern(
                content, rule.code_patterns
            )
            found.append(F.when(is_code, evidence(framework, "code", none)))

    names = set(manifests).union(*(rule.files for rule in frameworks.values()))
    exts = set().union(*(rule.code_extensions for rule in frameworks.values()))
    candidates = files.filter(name.isin(sorted(names)) | ext.isin(sorted(exts)))
    return with_content(candidates).select("project", "path", F.inline(F.array_compact(F.array(*found))))


def framework_evidence(
    files: DataFrame,
    frameworks=settings.FRAMEWORKS,
    manifests=settings.MANIFEST_FILES,
    max_files: int | None = settings.MAX_EVIDENCE_FILES,
) -> DataFrame:
    """Files and dependencies per project, framework and kind: the first files by path.

    Spark applies the limit before the shuffle too, so a huge project sends a bounded number of
    rows per task, and the lists built afterwards are bounded as well. None keeps all files.
    """
    by_path = Window.partitionBy("project", "framework", "kind").orderBy("path")
    first = framework_files(files, frameworks, manifests)
    if max_files is not None:
        place = F.row_number().over(by_path)
        first = first.withColumn("place", place).filter(F.col("place") <= max_files)
    return first.groupBy("project", "framework", "kind").agg(
        F.count("*").alias("file_count"),
        F.array_sort(F.collect_list("path")).alias("files"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dependencies")))).alias(
            "dependencies"
        ),
    )


def framework_report(
    evidence: DataFrame, max_listed: int = settings.MAX_LISTED_FILES
) -> DataFrame:
    """Readable evidence: count label, description and the listed files."""
    label = F.when(F.col("file_count") > max_listed, f"{max_listed}+").otherwise(
        F.col("file_count").cast("string")
    )
    described = evidence.withColumn("count_label", label)
    text = (
        F.when(
            F.col("kind") == "manifest",
            F.concat(
                F.lit("Dependency of "), "framework", F.lit(" found in "), "count_label",
                F.lit(" manifests ("), F.array_join("dependencies", ", "), F.lit(")"),
            ),
        )
        .when(
            F.col("kind") == "config_file",
            F.concat(
                F.lit("Found "), "count_label", F.lit(" configuration files of "), "framework"
            ),
        )
        .otherwise(
            F.concat(F.col("framework"), F.lit(" mentioned in "), "count_label", F.lit(" files"))
        )
    )
    return described.select(
        "project",
        "framework",
        "kind",
        "file_count",
        "count_label",
        text.alias("description"),
        F.slice("files", 1, max_listed).alias("files"),
        "dependencies",
    )
