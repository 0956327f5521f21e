"""Reports, request checks, sinks, streams."""

import base64
import gzip
import json
import threading

import pytest
from pyspark.sql import functions as F

from credsieve.operators import report
from credsieve.plans import scans
from credsieve.session import materialize, scratch, shared_dir
from credsieve.sources.files import with_names
from credsieve.sources.requests import make_requests
from credsieve.sources.samples import read_samples
from credsieve.streaming import scan_stream


@pytest.fixture(scope="module")
def files(spark):
    rows = [("one", f"f{i}.py", f"token=abc{i:03d}\n") for i in range(40)]
    rows += [("two", "main.ts", "import x from '@nestjs/core'\n"), ("two", "a.png", "")]
    return with_names(
        spark.createDataFrame(rows, "project string, path string, content string")
    ).cache()


@pytest.fixture(scope="module")
def requests(spark):
    url = "https://dev.example.com/c/p/_git/r"
    return make_requests(spark, [(p, url, "Branch", "main", "cb") for p in ("one", "two", "gone")])


def test_reports(files, requests):
    rows = {r["project"]: r for r in scans.scan_requests(requests, files).collect()}
    assert {p: r["status"] for p, r in rows.items()} == {
        "one": "completed", "two": "completed", "gone": "Error",
    }
    assert len(rows["one"]["results"]) == 40 and rows["one"]["parts"] == 1
    assert rows["one"]["results"][0]["secret"] == "toke" + "*" * 8
    assert rows["two"]["results"] == [] and rows["two"]["skipped_files"] == "*.png"
    assert rows["two"]["frameworks"][0]["framework"] == "NestJS"
    assert rows["gone"]["message"].startswith("Process Error") and rows["gone"]["all_files"] == 0
    [alone] = scans.scan_request(requests, files, "one", masked=False).collect()
    assert alone["results"][0]["secret"].startswith("token=abc")


def test_records_have_one_shape_at_every_size(files, requests):
    result = scans.scan_projects(files)
    rows = report.scan_report(requests, *result, per_record=15).filter("project = 'one'").orderBy("part").collect()
    assert [(r["part"], r["parts"], len(r["results"])) for r in rows] == [(0, 3, 15), (1, 3, 15), (2, 3, 10)]
    assert [f["path"] for r in rows for f in r["results"]] == sorted(f"f{i}.py" for i in range(40))
    [whole] = report.scan_report(requests, *result).filter("project = 'one'").collect()
    left_out = ("part", "parts", "results")
    for row in rows:
        assert {k: v for k, v in row.asDict().items() if k not in left_out} == {
            k: v for k, v in whole.asDict().items() if k not in left_out
        }


def test_project_of_very_many_findings(spark, requests):
    n = 50_000
    findings = spark.range(n).select(
        F.lit("one").alias("project"), F.format_string("f%05d", F.col("id") % 9973).alias("path"),
        (F.col("id") / 9973).cast("int").alias("line"), F.lit(1).alias("rule_ord"), F.lit("T").alias("type"),
        F.lit("secret").alias("secret"), F.lit("a secret").alias("context"), F.lit("").alias("severity"),
        F.lit(1.0).alias("confidence"),
    )
    result = scans.scan_projects(with_names(spark.createDataFrame([("one", "a", "")], "project string, path string, content string")))
    reports = report.scan_report(requests, findings, *result[1:])
    rows = reports.filter("project = 'one'").select("part", "parts", F.size("results"), "all_files", "n_results").collect()
    assert sorted(map(tuple, rows)) == [(p, 5, 10_000, 1, n) for p in range(5)]
    placed = report.report_results(reports).select("path", "line", (F.col("part") * 10_000 + F.col("place")).alias("at"))
    assert [tuple(r) for r in placed.orderBy("at").select("path", "line").collect()] == sorted(
        (f"f{i % 9973:05d}", i // 9973) for i in range(n)
    )


def test_scratch_blocks_leave_what_others_made(spark):
    outer, started, done = {}, threading.Event(), threading.Event()

    def other_thread():
        started.wait(60)
        outer["table"] = materialize(spark.range(5).select("id"))
        done.set()

    thread = threading.Thread(target=other_thread)
    thread.start()
    with scratch(spark):
        mine = materialize(spark.range(3).select("id"))
        started.set()
        assert done.wait(120)
        with scratch(spark):
            inner = materialize(spark.range(2).select("id"))
        assert mine.count() == 3
        with pytest.raises(Exception):
            inner.count()
    thread.join()
    assert outer["table"].count() == 5
    with pytest.raises(Exception):
        mine.count()


def test_envelopes_and_files(spark, files, requests, tmp_path):
    reports = materialize(scans.scan_requests(requests, files))
    for row in report.report_envelopes(reports).collect():
        packed = base64.b64decode(row["data"])
        plain = gzip.decompress(packed)
        assert (len(plain), len(packed)) == (row["original_size"], row["compressed_size"])
        assert json.loads(plain)["project"] == row["project"]
        assert row["compressed"] is True
        names = ("compressed", "data", "original_size", "compressed_size")
        envelope = json.dumps({name: row[name] for name in names})
        assert row["saving"] == pytest.approx((1 - len(envelope) / row["original_size"]) * 100, abs=0.06)
    path = str(tmp_path / "reports")
    report.write_reports(reports, path)
    assert list((tmp_path / "reports").glob("*.json.gz"))
    assert spark.read.json(path).count() == 3


def test_request_checks(spark, requests):
    projects = spark.createDataFrame([("one", "c1"), ("two", "c2")], "project string, commit string")
    rows = {r["ProjectName"]: r for r in report.check_requests(requests, projects).collect()}
    assert rows["one"]["commit"] == "c1" and rows["gone"]["commit"] == "not_found"
    assert rows["gone"]["problem"] == "Branch 'main' not found"
    failed = report.validate_requests(requests, projects).first()
    assert failed["status"] == "validation_failed" and "'main' not found" in failed["message"]
    fine = report.validate_requests(requests.filter("ProjectName != 'gone'"), projects).first()
    assert (fine["status"], fine["resolved"], fine["failed"]) == ("accepted", 2, 0)


def test_quality_sinks(spark, tmp_path):
    samples = spark.createDataFrame(
        [("token: a1b2c3d4", 1), ("token: a1b2c3d4", 1), ("plain words", 0)], "text string, label int"
    )
    path = str(tmp_path / "quality")
    report.write_quality_report(samples, path)
    stored = {r["metric"]: r["value"] for r in spark.read.json(f"{path}/json").collect()}
    assert stored["total_count"] == 3.0 and stored["secrets_exact_duplicates"] == 1.0
    lines = [r[0] for r in spark.read.text(f"{path}/text").collect()]
    assert lines[0].startswith("Quality ")
    assert "1. basic_statistics / total_count: 3.0000" in lines
    assert lines[-1] == "suggestion: Add samples so that the model generalises better."
    assert lines.index("critical: Only 3 samples; have 10000 or more per class.") > 5
    targets = report.write_samples(samples, str(tmp_path / "v2"))
    back = read_samples(spark, targets["positives"], targets["negatives"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, samples.collect()))
    with pytest.raises(Exception):
        report.write_samples(samples, str(tmp_path / "v2"))
    versions = report.write_repaired(samples, str(tmp_path / "all"))
    assert read_samples(spark, *versions.values()).count() == 2


def test_quality_text_shows_examples(spark, tmp_path):
    rows = [("plain words", 1), ("plain words", 0), ("other words", 1), ("token: a1b2c3d4", 1)]
    samples = spark.createDataFrame(rows, "text string, label int")
    report.write_quality_report(samples, str(tmp_path))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert lines[-3:] == [
        "in both classes: plain words", "not covered: other words", "not covered: plain words",
    ]


def write_tree(root, start, n):
    for i in range(start, start + n):
        folder = root / f"p{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.txt").write_text(f"token=abc{i:03d}\n" * (60 if i == 4 else 1))


def test_stream_equals_batch(spark, tmp_path):
    from credsieve.operators.scan import scan_files
    from credsieve.sources.files import read_visible_tree

    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for start in (0, 7):
        write_tree(root, start, 7)
        arriving = scan_stream.stream_visible_tree(spark, str(root), files_per_batch=3)
        query = scan_stream.start_scan(arriving, out, check, once=True)
        query.awaitTermination()
    streamed = scan_stream.read_findings(spark, out)
    batch = scan_files(read_visible_tree(spark, str(root)))
    assert sorted(streamed.collect()) == sorted(batch.select(streamed.columns).collect())
    assert batch.count() == 14 and len(list((tmp_path / "out").glob("query=*/batch=*"))) >= 4


def test_stream_of_all_files_sees_hidden_ones_once(spark, tmp_path):
    from credsieve.operators.scan import scan_files
    from credsieve.sources.files import read_tree

    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for start in (0, 7, 14):  # two restarts of the query
        write_tree(root, start, 7)
        (root / "p0" / f".env{start}").write_text(f"token=hid{start:03d}\n")
        (root / "p1" / ".git").mkdir(exist_ok=True)
        (root / "p1" / ".git" / f"_netrc{start}").write_text("")
        arriving = scan_stream.stream_tree(spark, str(root), settle=0)
        query = scan_stream.start_scan(arriving, out, check, once=True)
        query.awaitTermination()
    streamed = scan_stream.read_findings(spark, out)
    batch = scan_files(read_tree(spark, str(root)))
    assert sorted(streamed.collect()) == sorted(batch.select(streamed.columns).collect())
    assert streamed.filter("path like '.env%'").count() == 3 and streamed.count() == 24
    # Nothing new: no batch, nothing twice.
    before = len(list((tmp_path / "out").glob("query=*/batch=*")))
    scan_stream.start_scan(scan_stream.stream_tree(spark, str(root), settle=0), out, check, once=True).awaitTermination()
    assert len(list((tmp_path / "out").glob("query=*/batch=*"))) == before


def test_stream_waits_until_a_file_lies_still(tmp_path):
    from credsieve.sources.tree import TreeStream

    write_tree(tmp_path, 0, 1)
    assert TreeStream({"root": str(tmp_path), "settle": "3600"}).latestOffset() == {"modified": -1}
    stream = TreeStream({"root": str(tmp_path), "settle": "0"})
    offset = stream.latestOffset()
    assert offset["modified"] > 0 and stream.latestOffset() == offset


def test_shared_dir_is_the_one_the_cluster_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(root + "/") and shared_dir(spark) != shared_dir(spark)
    stored = materialize(spark.range(3).select(F.col("id") * 2))
    assert stored.count() == 3
    assert all(name.startswith(f"file://{root}/") for name in stored.inputFiles())
