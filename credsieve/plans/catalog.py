"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions import text as tx
from credsieve.functions.urls import repository_parts
from credsieve.operators import classify, inventory, quality, repair, report, scan, sharded
from credsieve.plans import fixtures as fx
from credsieve.plans import scans
from credsieve.session import shared_dir
from credsieve.sources import tree
from credsieve.sources.archives import expand_archives, list_archives
from credsieve.sources.files import read_tree, to_lines, with_names
from credsieve.sources.samples import clean_evaluation, read_samples
from credsieve.streaming.scan_stream import read_findings, start_scan, stream_tree

# Lower limits than the defaults, so that the given tables reach them.
SECRETS_CAP = 2
LINE_CAP = 2000
EVIDENCE_CAP = 8
LISTED_CAP = 7
RESULTS_CAP = 5

# Archives that a task holds before it hands them on.
ARCHIVE_BYTES = 4 << 20

BROKEN_PROJECT = "src3"
SINGLE_PROJECT = "src1"

# Rules that match a line more than once, and parts of each other's matches.
MASK_RULES = (
    settings.Rule("tok", "Tok", r"tok_[a-z0-9]{6,}", "HIGH"),
    settings.Rule("key", "Key", r"[a-z0-9]{4}_[a-z0-9]{4}", "HIGH"),
    settings.Rule("end", "End", r"end=[a-z0-9]{2,9}", "HIGH"),
)


def _rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(
        *[
            F.round(name, digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in frame.dtypes
        ]
    )


# --- scan ------------------------------------------------------------------------------------


def line_split(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    source = docs.select(
        F.col("source").alias("project"),
        F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("content"),
    )
    return to_lines(source).select(
        "project", "path", "line", F.length("text").alias("n_chars"), F.md5("text").alias("hash")
    )


def _matches(spark, sf_dir, **limits):
    return scan.match_rules(to_lines(fx.files(spark, sf_dir)), **limits)


def rule_scan(spark, sf_dir):
    return _matches(spark, sf_dir)


def rule_hits_all(spark, sf_dir):
    return scan.all_rule_hits(to_lines(fx.files(spark, sf_dir))).drop("text")


def false_positive_filter(spark, sf_dir):
    return scan.drop_false_positives(_matches(spark, sf_dir)).drop("severity", "confidence")


def long_line_rows(spark, sf_dir):
    rows = _matches(spark, sf_dir, max_line_length=LINE_CAP)
    return rows.filter(F.col("type") == settings.TYPE_LONG_LINE).drop("rule_ord", "confidence")


def cap_per_file(spark, sf_dir):
    rows = scan.drop_false_positives(_matches(spark, sf_dir, max_line_length=LINE_CAP))
    return scan.cap_per_file(rows, SECRETS_CAP)


def scan_findings(spark, sf_dir):
    return scan.scan_files(fx.files(spark, sf_dir))


def file_exclusion(spark, sf_dir):
    return scan.exclude_files(fx.files(spark, sf_dir)).select("project", "path", "file_name", "ext")


def exclusion_summary(spark, sf_dir):
    return scan.exclusion_summary(fx.files(spark, sf_dir))


def findings_by_project(spark, sf_dir):
    return scan.findings_by_project(scan.scan_files(fx.files(spark, sf_dir)))


def mask_secrets(spark, sf_dir):
    return scan.mask_findings(scan.scan_files(fx.files(spark, sf_dir))).select(
        "project", "path", "line", "type", "secret", "context"
    )


def mask_all_matches(spark, sf_dir):
    """Lines with two matches of one rule, and with matches of two rules that overlap."""
    text = F.concat(
        F.lit(" tok_"), F.substring("h", 1, 8), F.lit(" and tok_"), F.substring("h", 9, 8), F.lit("_"),
        F.substring("h", 17, 4), F.lit(", end="), F.substring("h", 1, 6), F.lit("\n"),
    )
    lines = fx.documents(spark, sf_dir).select(
        F.col("source").alias("project"), F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(1).alias("line"), text.alias("text")
    )
    return scan.mask_findings(scan.scan_lines(lines, MASK_RULES), MASK_RULES).select(
        "project", "path", "type", "secret", "context"
    )


def path_parts(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    below = tx.relative_path(F.col("url"), "https://")
    return with_names(pages.select("page_id", below.alias("path")))


# --- inventory -------------------------------------------------------------------------------


def language_summary(spark, sf_dir):
    return inventory.language_summary(fx.files(spark, sf_dir)).withColumn(
        "extensions", F.array_join("extensions", ",")
    )


def language_extensions(spark, sf_dir):
    return inventory.language_extensions(fx.files(spark, sf_dir))


def _evidence(spark, sf_dir):
    """Evidence with all files in one project, so that the caps are reached."""
    files = fx.files(spark, sf_dir).withColumn("project", F.lit("all"))
    return inventory.framework_evidence(files, max_files=EVIDENCE_CAP)


def framework_files(spark, sf_dir):
    return inventory.framework_files(fx.files(spark, sf_dir)).withColumn(
        "dependencies", F.array_join("dependencies", ",")
    )


def framework_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select(
        "project",
        "framework",
        "kind",
        "file_count",
        F.array_join("files", ",").alias("files"),
        F.array_join("dependencies", ",").alias("dependencies"),
    )


def framework_report(spark, sf_dir):
    return inventory.framework_report(_evidence(spark, sf_dir), LISTED_CAP).select(
        "project",
        "framework",
        "kind",
        "count_label",
        "description",
        F.array_join("files", ",").alias("files"),
    )


def code_patterns(spark, sf_dir):
    rule = settings.FRAMEWORKS["Vue"]
    hits = inventory.code_pattern_hits(fx.files(spark, sf_dir), "Vue", rule.code_patterns)
    return hits.withColumn("patterns", F.array_join("patterns", ","))


def merged_detections(spark, sf_dir):
    found = inventory.framework_files(fx.files(spark, sf_dir))
    code = inventory.code_pattern_hits(
        fx.files(spark, sf_dir), "Vue", settings.FRAMEWORKS["Vue"].code_patterns
    )
    return inventory.merge_detections(found, code)


# --- dataset quality -------------------------------------------------------------------------


def quality_basic(spark, sf_dir):
    return _rounded(quality.basic_statistics(fx.samples(spark, sf_dir)))


def quality_duplicates(spark, sf_dir):
    return _rounded(quality.duplicates(fx.samples(spark, sf_dir)))


def quality_overlap(spark, sf_dir):
    return quality.overlap(fx.samples(spark, sf_dir))


def duplicate_examples(spark, sf_dir):
    return quality.duplicate_examples(fx.samples(spark, sf_dir))


def quality_coverage(spark, sf_dir):
    return quality.rule_coverage(fx.samples(spark, sf_dir)).withColumn(
        "first_rule", F.coalesce("first_rule", F.lit("none"))
    )


def uncovered_examples(spark, sf_dir):
    return quality.uncovered_examples(fx.samples(spark, sf_dir))


def quality_issues(spark, sf_dir):
    return quality.quality_issues(fx.samples(spark, sf_dir))


def issue_examples(spark, sf_dir):
    return quality.issue_examples(fx.samples(spark, sf_dir))


def quality_patterns(spark, sf_dir):
    return quality.pattern_distribution(fx.samples(spark, sf_dir))


def quality_prefixes(spark, sf_dir):
    return quality.prefix_distribution(fx.samples(spark, sf_dir))


def top_lengths(spark, sf_dir):
    return quality.top_lengths(fx.samples(spark, sf_dir))


def entropy_stats(spark, sf_dir):
    return _rounded(quality.entropy_statistics(fx.samples(spark, sf_dir)))


def raw_line_issues(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return quality.raw_line_issues(docs.select(F.explode(F.split("text", "\n")).alias("value")))


def quality_scorecard(spark, sf_dir):
    row = quality.scorecard(quality.metrics(fx.samples(spark, sf_dir)))
    names = [f"score_{name}" for name in quality.CRITERIA]
    return _rounded(row.select(*names, "quality_score_10", "overall_quality_score", "quality_label"))


def quality_recommendations(spark, sf_dir):
    row = quality.scorecard(quality.metrics(fx.samples(spark, sf_dir)))
    return quality.recommendations(row).select("level", "code", "fixable")


def repair_dataset(spark, sf_dir):
    return repair.repair(fx.samples(spark, sf_dir))


def repair_dataset_covered(spark, sf_dir):
    return repair.repair(fx.covered_samples(spark, sf_dir))


def repair_report(spark, sf_dir):
    return repair.repair_report(fx.samples(spark, sf_dir))


def repair_report_covered(spark, sf_dir):
    return repair.repair_report(fx.covered_samples(spark, sf_dir))


def quality_report_before_after(spark, sf_dir):
    return _rounded(scans.quality_before_after(fx.covered_samples(spark, sf_dir)), 4)


def quality_export(spark, sf_dir):
    """The exported metrics, read back."""
    path = f"{shared_dir(spark)}/report"
    report.write_quality_report(fx.covered_samples(spark, sf_dir), path)
    return _rounded(spark.read.json(f"{path}/json").select("section", "metric", "value"), 4)


def repaired_files(spark, sf_dir):
    """The repaired samples, written as a new version and read back."""
    paths = report.write_repaired(fx.samples(spark, sf_dir), f"{shared_dir(spark)}/repaired")
    return read_samples(spark, paths["positives"], paths["negatives"])


def sample_files(spark, sf_dir):
    """Samples written by class and read back in both modes: how often each text is there."""
    labelled = fx.samples(spark, sf_dir).filter("label IN (0, 1)")
    paths = report.write_samples(labelled, f"{shared_dir(spark)}/samples")
    quality_mode, training_mode = (
        read_samples(spark, paths["positives"], paths["negatives"], mode).withColumn("mode", F.lit(mode))
        for mode in ("quality", "training")
    )
    read = quality_mode.unionByName(training_mode)
    return read.groupBy("mode", "label", "text").agg(F.count("*").alias("n_rows"))


# --- classifier ------------------------------------------------------------------------------


def ngram_frequencies(spark, sf_dir):
    return classify.ngram_frequencies(fx.table(spark, sf_dir, "conversations").select("text"))


def idf_weights(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "conversations").select("text")
    return _rounded(classify.idf_weights(texts))


def tfidf_features(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _rounded(classify.tfidf_features(texts, "item_id"))


def _probabilities(spark, sf_dir):
    """Made-up probabilities of two texts per order line."""
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "N", settings.TYPE_LONG_LINE)
        .otherwise("Token")
        .alias("type"),
        F.lit("").alias("severity"),
        (F.col("l_discount") * 10).alias("p_secret"),
        F.when(F.col("l_linenumber") > 1, F.col("l_tax") * 12.5).alias("p_context"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def blend_severity(spark, sf_dir):
    return classify.rate(_probabilities(spark, sf_dir).drop("label"))


def _guesses(spark, sf_dir):
    return _probabilities(spark, sf_dir).withColumn(
        "prediction", (F.col("p_secret") > 0.5).cast("int")
    )


def confusion_metrics(spark, sf_dir):
    return _rounded(classify.confusion_metrics(_guesses(spark, sf_dir)))


def wrong_predictions(spark, sf_dir):
    text = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return classify.wrong_predictions(_guesses(spark, sf_dir).withColumn("text", text))


def evaluation_samples(spark, sf_dir):
    kind = F.element_at(
        F.array(*[F.lit(v) for v in ("Secret", " secret ", "NotSecret", "", " ")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    docs = fx.documents(spark, sf_dir)
    return clean_evaluation(
        docs.select(
            F.concat(F.lit("  "), "text", F.lit("\t")).alias("secret_value"),
            kind.alias("secret_type"),
        )
    ).select(F.md5("text").alias("text_hash"), "label", "expected")


_MODELS: dict[tuple, object] = {}


def _model(spark, sf_dir):
    """The model of the training split, fitted once for the queries that follow each other on a folder, and the test
    split. The driver holds one model at a time."""
    training, test = classify.split(fx.samples(spark, sf_dir))
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = classify.fit(training)
    return _MODELS[key], test


def train_score(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return classify.score_findings(scan.scan_files(fx.files(spark, sf_dir)), model)


def evaluate_model(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    return classify.evaluate(model, test)


def predict_pairs(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    docs = fx.documents(spark, sf_dir)
    context = F.when(F.col("doc_id") % 3 > 0, F.col("text"))
    pairs = docs.select("doc_id", F.col("template").alias("text"), context.alias("context"))
    return classify.predict_pairs(pairs, model).drop("text", "context")


def model_info(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    info = classify.model_info(model, fx.samples(spark, sf_dir))
    return info.filter(F.col("name") != "regularisation")


def _small_model(spark, sf_dir):
    """A model of five terms, fitted to its optimum."""
    small = fx.small_samples(spark, sf_dir)
    return classify.fit(small, tolerance=1e-15), small


def small_model(spark, sf_dir):
    """The probability of each distinct text by the trained model."""
    model, small = _small_model(spark, sf_dir)
    texts = small.select("text").union(small.select("context").filter("context IS NOT NULL")).distinct()
    return classify.score(texts, "text", model, "p").select("text", F.round("p", 4).alias("p_secret"))


def sharded_model(spark, sf_dir):
    """The same by the training whose vocabulary lies in shards."""
    small = fx.small_samples(spark, sf_dir)
    model = sharded.fit(small, shards=2, block_rows=256)
    texts = small.select("text").union(small.select("context").filter("context IS NOT NULL")).distinct()
    scored = sharded.score(texts.withColumn("key", F.col("text")), "key", "text", model)
    return scored.select(F.col("key").alias("text"), F.round("p_secret", 4).alias("p_secret"))


def small_evaluate(spark, sf_dir):
    """Metrics of the trained model over all samples."""
    model, small = _small_model(spark, sf_dir)
    return _rounded(classify.evaluate(model, small))


def small_findings(spark, sf_dir):
    """Findings scored by the trained model, some without a context, some of a special kind."""
    model, small = _small_model(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 9 == 0, settings.TYPE_TOO_MANY).otherwise("Token")
    findings = small.select(
        "doc_id", kind.alias("type"), F.col("text").alias("secret"), "context", F.lit("").alias("severity"),
        F.lit(1.0).alias("confidence"),
    )
    return classify.score_findings(findings, model)


def small_pairs(spark, sf_dir):
    """Pairs rated by the trained model."""
    model, small = _small_model(spark, sf_dir)
    return classify.predict_pairs(small.select("doc_id", "text", "context"), model)


def training_split(spark, sf_dir):
    samples = fx.samples(spark, sf_dir)
    part = F.when(classify.in_training(F.col("text"), F.col("label")), "training").otherwise("test")
    return samples.groupBy(part.alias("part"), "label").agg(F.count("*").alias("rows"))


# --- requests and reports --------------------------------------------------------------------


def _projects(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()
    return docs.withColumn("commit", F.md5("project"))


def request_check(spark, sf_dir):
    return report.check_requests(fx.requests(spark, sf_dir), _projects(spark, sf_dir))


def request_validation(spark, sf_dir):
    return report.validate_requests(fx.requests(spark, sf_dir), _projects(spark, sf_dir))


def repo_url_parts(spark, sf_dir):
    """Repository URLs made of page URLs, with and without enough steps around ``_git``."""
    pages = fx.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    tail = F.element_at(
        F.array(*[F.lit(t) for t in (
            "/coll/proj/_git/repo", "/a/b/proj/_git/repo/x", "/proj/_git/r", "/_git/r",
            "/proj/_git", "/proj/repo",
        )]),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    parts = repository_parts(F.concat(host, tail))
    return pages.select("page_id", parts.alias("p")).select("page_id", "p.*")


def scan_report(spark, sf_dir):
    reports = scans.scan_requests(fx.requests(spark, sf_dir), fx.files(spark, sf_dir))
    return reports.select(
        "status",
        "message",
        "project",
        "repo_url",
        "commit",
        "files_excluded",
        "all_files",
        "skipped_files",
        F.size("results").alias("n_results"),
        F.size("languages").alias("n_languages"),
        F.size("frameworks").alias("n_frameworks"),
    )


def single_scan(spark, sf_dir):
    """The report of one requested project."""
    one = scans.scan_request(fx.requests(spark, sf_dir), fx.files(spark, sf_dir), SINGLE_PROJECT)
    return one.select("status", "message", "project", "all_files", "files_excluded", F.size("results").alias("n_results"))


def opened_envelopes(spark, sf_dir):
    """Reports packed into envelopes and read from them again."""
    reports = scans.scan_requests(fx.requests(spark, sf_dir), fx.files(spark, sf_dir))
    opened = report.open_envelopes(report.report_envelopes(reports))

    def field(name: str):
        return F.get_json_object("json", f"$.{name}")

    return opened.select(
        "project",
        *[field(name).alias(name) for name in ("status", "message", "repo_url", "commit")],
        *[field(name).cast("bigint").alias(name) for name in ("files_excluded", "all_files")],
        F.json_array_length(field("results")).alias("n_results"),
        (F.octet_length("json") == F.col("original_size")).alias("whole"),
    )


def report_results(spark, sf_dir):
    """The results of the reports row by row; a record holds few, so that projects take several."""
    findings = scan.scan_files(fx.files(spark, sf_dir))
    files = fx.files(spark, sf_dir)
    reports = report.scan_report(
        fx.requests(spark, sf_dir),
        findings,
        scan.exclusion_summary(files),
        inventory.language_summary(files),
        inventory.framework_report(inventory.framework_evidence(files)),
        per_record=RESULTS_CAP,
    )
    return report.report_results(reports).select(
        "project", "part", "place", "path", "line", "type", "secret"
    )


def csv_evaluation(spark, sf_dir):
    """The metrics that are counted while the misclassified rows are written, and how many were."""
    rows = _guesses(spark, sf_dir).withColumn("text", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    errors = f"{shared_dir(spark)}/errors"
    metrics = classify.write_evaluation(rows, errors)
    written = spark.read.option("header", True).csv(errors).agg(F.count("*").alias("written"))
    return _rounded(metrics.join(written))


# --- archives and streams --------------------------------------------------------------------


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive per file, row by row, handed on in batches of bounded size."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        projects, contents = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(projects, pa.string()), pa.array(contents, pa.binary())], names=["project", "content"]
        )

    rows, held = [], 0
    for batch in batches:
        for values in zip(batch.column("project"), batch.column("path"), batch.column("content")):
            project, path, content = (value.as_py() for value in values)
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(path, content)
                archive.writestr("../evil/" + path, content)
                archive.writestr("/abs/" + path, content)
            rows.append((project, buffer.getvalue()))
            held += len(rows[-1][1])
            if held >= ARCHIVE_BYTES:
                yield made(rows)
                rows, held = [], 0
    if rows:
        yield made(rows)


def _archives(spark, sf_dir):
    """One archive per file, each with two members of unsafe paths besides."""
    files = fx.files(spark, sf_dir).select("project", "path", "content")
    return files.mapInArrow(_zip, "project string, content binary")


def archive_members(spark, sf_dir):
    return expand_archives(_archives(spark, sf_dir)).select(
        "project", "path", F.octet_length("raw").alias("bytes"), "problem"
    )


def archive_scan(spark, sf_dir):
    return scans.scan_archives(_archives(spark, sf_dir)).findings


def archive_inventory(spark, sf_dir):
    result = scans.scan_archives(_archives(spark, sf_dir))

    def number(rows, name):
        return rows.groupBy("project").agg(F.count("*").alias(name))

    totals = result.exclusions.select("project", "all_files", "files_excluded", "skipped_files")
    joined = totals.join(number(result.languages, "n_languages"), "project", "left").join(
        number(result.frameworks, "n_frameworks"), "project", "left"
    )
    return joined.fillna(0, ["n_languages", "n_frameworks"])


def archive_report(spark, sf_dir):
    """Reports of archives, those of one project damaged."""
    damaged = F.when(F.col("project") == BROKEN_PROJECT, F.lit(b"no archive")).otherwise(F.col("content"))
    archives = _archives(spark, sf_dir).withColumn("content", damaged)
    reports = scans.report_archives(fx.requests(spark, sf_dir), archives)
    return reports.select("status", "message", "project", "all_files", F.size("results").alias("n_results"))


def _tree_rows(spark, sf_dir):
    """Documents as files of a tree, some of them hidden, in hidden folders or empty."""
    docs = fx.table(spark, sf_dir, "documents")
    name = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN concat('.env', doc_id) WHEN 1 THEN concat('.git/_netrc', doc_id) "
        "ELSE concat('src/d', doc_id, '.txt') END"
    )
    content = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    return docs.select(F.col("source").alias("project"), name.alias("path"), content.alias("content"))


def _write_files(root: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, path, content in batch.itertuples(index=False):
                system, place, _ = tree.storage(f"{root}/{project}/{path}")
                system.create_dir(place.rpartition("/")[0])
                with system.open_output_stream(place) as target:
                    target.write(content.encode())
            yield pd.DataFrame({"written": [len(batch)]})

    return write


def _tree(spark, sf_dir) -> str:
    root = shared_dir(spark)
    _tree_rows(spark, sf_dir).mapInPandas(_write_files(root), "written bigint").agg(F.sum("written")).collect()
    return root


def _line_counts(files: DataFrame) -> DataFrame:
    """Each file with its size and number of lines."""
    lines = to_lines(files).groupBy("project", "path").agg(F.count("*").alias("n_lines"))
    counted = files.select("project", "path", "length").join(lines, ["project", "path"], "left")
    return counted.fillna(0, ["n_lines"])


def tree_files(spark, sf_dir):
    """A tree of all documents: hidden and empty files are listed and read as well."""
    return _line_counts(read_tree(spark, _tree(spark, sf_dir)))


def stream_tree_files(spark, sf_dir):
    """The same tree as a stream of arriving files."""
    root, folder = _tree(spark, sf_dir), shared_dir(spark)
    query = start_scan(
        stream_tree(spark, root, settle=0), f"{folder}/findings", f"{folder}/checkpoint", scan=_line_counts, once=True
    )
    query.awaitTermination()
    return read_findings(spark, f"{folder}/findings")


def _write_archives(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members come by archive and path; each is written as it comes, and one archive is open at a time."""
        name, target, archive, written = None, None, None, 0

        def close() -> None:
            if archive is not None:
                archive.writestr("../outside", "no")
                archive.close()
                target.close()

        for batch in batches:
            for values in zip(*[batch.column(c) for c in ("project", "part", "path", "content")]):
                project, part, path, content = (value.as_py() for value in values)
                if (project, part) != name:
                    close()
                    name = project, part
                    system, place, _ = tree.storage(f"{root}/all/{project}-{part}.zip")
                    system.create_dir(place.rpartition("/")[0])
                    target = system.open_output_stream(place)
                    archive = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(path, content)
                written += 1
        close()
        yield pa.RecordBatch.from_pydict({"written": [written]})

    return write


def archive_ranges(spark, sf_dir):
    """Members of archives on storage, read by range: up to eight archives of a source's documents."""
    root = shared_dir(spark)
    rows = _tree_rows(spark, sf_dir).withColumn("part", F.length("path") % 8)
    placed = rows.repartition("project", "part").sortWithinPartitions("project", "part", "path", "content")
    placed.mapInArrow(_write_archives(root), "written bigint").agg(F.sum("written")).collect()
    return expand_archives(list_archives(spark, root)).select(
        "project", "path", F.octet_length("raw").alias("bytes"), "problem"
    )


def _arriving(spark, sf_dir):
    """The documents table as a stream of files; the table is one file or a folder of them."""
    schema = fx.table(spark, sf_dir, "documents").schema
    # As a pattern: Spark takes a plain path of a stream for a folder, and a file is none.
    arriving = (
        spark.readStream.schema(schema)
        .parquet(f"{sf_dir}/documents.parque[t]")
        .select(
            F.col("source").alias("project"),
            F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"),
            F.col("text").alias("content"),
        )
    )
    return with_names(arriving)


def stream_scan(spark, sf_dir):
    """The same scan over a stream of the documents table."""
    folder = shared_dir(spark)
    query = start_scan(
        _arriving(spark, sf_dir), f"{folder}/findings", f"{folder}/checkpoint", once=True
    )
    query.awaitTermination()
    return read_findings(spark, f"{folder}/findings")


def stream_report(spark, sf_dir):
    """Reports of a stream of the documents table."""
    folder = shared_dir(spark)
    query = start_scan(
        _arriving(spark, sf_dir),
        f"{folder}/findings",
        f"{folder}/checkpoint",
        once=True,
        reports=f"{folder}/reports",
        requests=fx.requests(spark, sf_dir),
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/reports").select(
        "status", "project", "all_files", "files_excluded", F.size("results").alias("n_results")
    )


QUERIES = {
    query.__name__: query
    for query in (
        line_split, rule_scan, rule_hits_all, false_positive_filter, long_line_rows, cap_per_file,
        scan_findings, file_exclusion, exclusion_summary, findings_by_project, mask_secrets, mask_all_matches,
        path_parts, language_summary, language_extensions, framework_files, framework_evidence, framework_report,
        code_patterns, merged_detections, quality_basic, quality_duplicates, quality_overlap,
        duplicate_examples, quality_coverage, uncovered_examples, quality_issues, issue_examples,
        quality_patterns, quality_prefixes, top_lengths, entropy_stats, raw_line_issues,
        quality_scorecard, quality_recommendations, repair_dataset, repair_dataset_covered,
        repair_report, repair_report_covered, repaired_files, sample_files, quality_report_before_after, quality_export, ngram_frequencies, idf_weights,
        tfidf_features, blend_severity, confusion_metrics, wrong_predictions, evaluation_samples, train_score,
        evaluate_model, predict_pairs, model_info, small_model, sharded_model, small_evaluate, small_findings, small_pairs,
        training_split, request_check, request_validation,
        repo_url_parts, scan_report, single_scan, opened_envelopes, report_results, csv_evaluation, archive_members, archive_scan,
        archive_inventory, archive_report, archive_ranges, tree_files, stream_scan, stream_report, stream_tree_files,
    )
}
