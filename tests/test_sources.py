"""Readers: trees, lines, archives, settings, samples, requests."""

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.plans import scans
from credsieve.sources import archives, files, requests, samples, tables


def lines_of(spark, content):
    frame = spark.createDataFrame([("p", "f", content)], "project string, path string, content string")
    return [(r["line"], r["text"]) for r in sorted(files.to_lines(frame).collect())]


@pytest.mark.parametrize(
    "content",
    ["a\nb\n", "a\nb", "a\r\nb\rc\n", "\n\n", "", "x", "a b\u0085c\n", "\r", "a\r\n\r\nb", "\x0b\n"],
)
def test_lines_are_those_of_readlines(spark, content):
    expected = io.StringIO(content, newline=None).readlines()
    assert lines_of(spark, content) == list(enumerate(expected, start=1))


@pytest.fixture
def tree(tmp_path):
    for path, raw in {
        "one/src/a.py": b"ok\n",
        "one/bad.txt": b"caf\xe9 t\xc3\xa9\xff!",
        "one/.env": b"hidden",
        "two/_x.TAR.GZ": b"",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(raw)
    return str(tmp_path)


def test_visible_tree_and_invalid_utf8(spark, tree):
    rows = {(r["project"], r["path"]): r for r in files.read_visible_tree(spark, tree).collect()}
    assert set(rows) == {("one", "src/a.py"), ("one", "bad.txt")}
    assert rows["one", "bad.txt"]["content"] == b"caf\xe9 t\xc3\xa9\xff!".decode("utf-8", "ignore")
    assert rows["one", "src/a.py"]["file_name"] == "a.py"


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_tree_has_all_files(spark, tree, scheme):
    found = files.with_content(files.read_tree(spark, scheme + tree))
    rows = {(r["project"], r["path"]): r for r in found.collect()}
    assert set(rows) == {
        ("one", "src/a.py"), ("one", "bad.txt"), ("one", ".env"), ("two", "_x.TAR.GZ"),
    }
    assert rows["one", "bad.txt"]["content"] == b"caf\xe9 t\xc3\xa9\xff!".decode("utf-8", "ignore")
    assert rows["two", "_x.TAR.GZ"]["ext"] == ".gz" and rows["one", ".env"]["content"] == "hidden"
    assert rows["two", "_x.TAR.GZ"]["content"] == "" and rows["two", "_x.TAR.GZ"]["length"] == 0


def test_tree_equals_a_listing_of_its_own(spark, tmp_path):
    """SQL over a listing that the test writes itself, with folders of every depth and odd names."""
    rnd, expected = random.Random(5), []
    for i in range(120):
        parts = [rnd.choice(["a", ".git", "_d", "ü b", "x=1"]) for _ in range(rnd.randint(0, 4))]
        name = rnd.choice([".env", "_netrc", "f.py", "no ending", "a%20b#c"]) + str(i)
        folder = tmp_path / "root" / f"p{i % 3}" / "/".join(parts)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * (i % 5))
        expected.append((f"p{i % 3}", "/".join([*parts, name]), i % 5))
    spark.createDataFrame(expected, "project string, path string, length bigint").createOrReplaceTempView("expected")
    for folders in (1, 2, 1000):
        found = spark.read.format(files._registered(spark)).option("root", str(tmp_path / "root"))
        found.option("folders", folders).load().createOrReplaceTempView("found")
        extra = spark.sql("SELECT project, path, length FROM found EXCEPT ALL SELECT * FROM expected").count()
        assert (extra, spark.table("found").count()) == (0, 120)


def test_contents_are_read_only_where_needed(spark, tree):
    found = files.read_tree(spark, tree)
    os.remove(os.path.join(tree, "one", ".env"))  # listed by the plan's run, not by the plan
    result = scans.scan_projects(files.read_tree(spark, tree))
    plan = result.languages._jdf.queryExecution().toString() + result.exclusions._jdf.queryExecution().toString()
    assert "raw" not in plan and found.count() == 3
    assert "raw" in result.findings._jdf.queryExecution().toString()


def test_unreadable_file_leaves_the_others_be(spark, tree):
    os.symlink("/nowhere/at/all", os.path.join(tree, "one", "gone.txt"))
    os.symlink(tree, os.path.join(tree, "one", "loop"))
    listed = files.read_tree(spark, tree)
    found = files.with_content(listed)
    rows = {(r["project"], r["path"]): r for r in found.collect()}
    assert rows["one", "gone.txt"]["content"] is None and rows["one", ".env"]["content"] == "hidden"
    assert files.to_lines(listed).filter("path = 'gone.txt'").count() == 0
    assert [tuple(r) for r in files.file_problems(listed).collect()] == [
        ("one", "gone.txt", "unreadable file: it leads nowhere")
    ]
    # A file that goes between the listing and the reading is a problem of its own.
    ghost = listed.withColumn("location", F.concat("location", F.lit(".gone")))
    assert {r["problem"] for r in files.file_problems(ghost).collect()} == {
        "unreadable file: it leads nowhere", "unreadable file: FileNotFoundError",
    }


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, raw in members.items():
            archive.writestr(name, raw)
    return buffer.getvalue()


@pytest.mark.parametrize("read", [archives.read_archives, archives.list_archives])
def test_archives(spark, tmp_path, read):
    long_path = "d" * 120 + "/" + "n" * 150
    (tmp_path / "app.zip").write_bytes(
        zipped(
            {
                "src/a.py": "x=1\n", "../b.py": "no", "/abs.py": "no", "img/A.PNG": "no",
                "package.json": "{}", "dir/": "", f"{long_path}1.py": "y", f"{long_path}2.py": "z",
            }
        )
    )
    damaged = bytearray(zipped({"good.py": "fine\n" * 50, "hurt.py": "lost\n" * 50}))
    at = damaged.rindex(b"hurt.py", 0, damaged.index(b"PK\x01\x02")) + len("hurt.py")
    damaged[at : at + 4] = b"\xff" * 4
    (tmp_path / "hurt.zip").write_bytes(bytes(damaged))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    found = read(spark, str(tmp_path))
    members = archives.expand_archives(found).collect()
    problems = {(r["project"], r["path"]): r["problem"] for r in members if r["problem"]}
    assert set(problems) == {("app", "../b.py"), ("app", "/abs.py"), ("bad", None), ("hurt", "hurt.py")}
    assert all(r["raw"] is None for r in members if r["problem"])
    kept = {(r["project"], r["path"]): r["content"] for r in archives.archive_files(found).collect()}
    assert set(kept) == {
        ("app", "src/a.py"), ("app", "img/A.PNG"), ("app", "package.json"), ("app", f"{long_path}1.py"),
        ("app", f"{long_path}2.py"), ("hurt", "good.py"),
    }
    broken = archives.archive_problems(archives.expand_archives(found)).collect()
    assert sorted(r["project"] for r in broken) == ["bad", "hurt"]


def test_members_are_read_by_range(spark, tmp_path, monkeypatch):
    """An archive is never read whole, its runs go to many tasks, and every kind of damage stays with its member."""
    rnd = random.Random(3)
    members = {f"d{i % 7}/f{i}.txt": rnd.randbytes(2000) for i in range(200)} | {"empty": b"", "ü/ß.txt": b"x" * 90_000}
    (tmp_path / "big.zip").write_bytes(zipped(members))
    with zipfile.ZipFile(tmp_path / "kinds.zip", "w") as archive:
        for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
            archive.writestr(f"k{kind}", b"the same text " * 100, kind)
    (tmp_path / "cut.zip").write_bytes(zipped({"a": "text"})[:-10])
    (tmp_path / "empty.zip").write_bytes(zipped({}))
    os.symlink("/nowhere", tmp_path / "gone.zip")
    index = archives.archive_index(archives.list_archives(spark, str(tmp_path)))
    # Runs of about 20 KB: many tasks read parts of the one archive.
    runs = index.withColumn("run", F.floor(F.col("at") / 20_000))
    assert runs.filter("project = 'big'").select("run").distinct().count() > 10
    read = archives.read_members(runs)
    tasks = read.filter("project = 'big'").select(F.spark_partition_id()).distinct().count()
    rows = {(r["project"], r["path"]): r for r in read.collect()}
    assert tasks > 4
    assert {p: r["raw"] for (z, p), r in rows.items() if z == "big"} == members
    assert {r["raw"] for (z, _), r in rows.items() if z == "kinds"} == {b"the same text " * 100}
    assert {z for z, p in rows if p is None} == {"cut", "gone"} and not any(z == "empty" for z, _ in rows)
    assert all(r["problem"].startswith("unreadable archive") for (z, p), r in rows.items() if p is None)
    # Places that do not hold what the directory says.
    for change, said in (("at + 3", "no member begins"), ("at + 1000000000", "beyond"), ("at", "")):
        moved = index.filter("path = 'd0/f0.txt'").withColumn("at", F.expr(change))
        (row,) = archives.read_members(moved).collect()
        assert (row["raw"] == members["d0/f0.txt"]) if not said else said in row["problem"]
    wrong = index.filter("path = 'd0/f0.txt'").withColumn("crc", F.col("crc") + 1)
    assert "Bad CRC" in archives.read_members(wrong).first()["problem"]


def test_archive_reports(spark):
    angular = '{"dependencies": {"@angular/core": "1"}}'
    rows = [
        ("app", zipped({"package.json": angular, "a.py": "token=abc123xyz\n", "b.png": "x"})),
        ("bad", b"not a zip"),
    ]
    found = spark.createDataFrame(rows, "project string, content binary")
    url = "https://dev.example.com/c/p/_git/r"
    asked = requests.make_requests(spark, [(p, url, "Branch", "main", "cb") for p in ("app", "bad", "gone")])
    reports = {r["project"]: r for r in scans.report_archives(asked, found).collect()}
    app = reports["app"]
    assert (app["status"], app["all_files"], app["files_excluded"]) == ("completed", 3, 2)
    assert app["skipped_files"] == "*.png, package.json" and len(app["results"]) == 1
    assert [(f["framework"], f["kind"]) for f in app["frameworks"]] == [("Angular", "manifest")]
    assert reports["bad"]["status"] == "Error" and "unreadable archive" in reports["bad"]["message"]
    assert reports["gone"]["status"] == "Error" and "no readable files" in reports["gone"]["message"]


def test_bytes_that_are_no_text(spark):
    rnd = random.Random(4)
    parts = [b"a", b"\xff", b"\xc3\xa9", b"\xc3", b"\xed\xa0\x80", "\ufffd".encode(), "\ue000".encode(), b"\xf0\x9f\x98", b"\xc0\x80", b"0", b"1"]
    rows = [(b"".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))),) for _ in range(800)]
    frame = spark.createDataFrame([*rows, (None,)], "raw binary")
    got = frame.select("raw", files.decode(F.col("raw")).alias("text")).collect()
    assert all(r["text"] == (None if r["raw"] is None else bytes(r["raw"]).decode("utf-8", "ignore")) for r in got)


def test_settings_round_trip(spark, tmp_path):
    (tmp_path / "rules.json").write_text(
        json.dumps(
            [
                {"id": "a", "message": "A", "pattern": "a+", "severity": "HIGH"},
                {"id": "b", "message": "B", "pattern": "(", "severity": "HIGH"},
            ]
        )
    )
    with pytest.raises(ValueError, match="invalid regular expression"):
        tables.load_rules(spark, str(tmp_path / "rules.json"))
    (tmp_path / "good.json").write_text(
        json.dumps([{"id": "a", "message": "A", "pattern": "a+", "severity": "HIGH"}])
    )
    assert [r.id for r in tables.load_rules(spark, str(tmp_path / "good.json"))] == ["a"]
    (tmp_path / "names.json").write_text('{"excluded_files": ["x", "y", "x"]}')
    assert tables.load_values(spark, str(tmp_path / "names.json"), "excluded_files") == ("x", "y")
    (tmp_path / "lang.json").write_text('{"r": {"extensions": [".R", ".r"]}}')
    assert tables.load_languages(spark, str(tmp_path / "lang.json")) == {"r": (".r",)}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "fw.yml").write_text(
        yaml.safe_dump({"frameworks": {"X": {"files": ["x.json"]}}, "manifest_files": ["m"]})
    )
    frameworks, manifests = tables.load_frameworks(spark, str(tmp_path / "fw.yml"))
    assert frameworks["X"].files == ("x.json",) and frameworks["X"].dependencies == ()
    assert manifests == ("m",)
    (tmp_path / "crlf.yml").write_bytes(b"false_positive:\r\n- sha1\r\n- png\r\n")
    assert tables.load_values(spark, str(tmp_path / "crlf.yml"), "false_positive") == ("sha1", "png")


@pytest.mark.parametrize(
    "data, kind, problems",
    [
        (None, "rules", [(0, "", "empty")]),
        ({"a": 1}, "rules", [(0, "", "not a list of rules")]),
        (["x"], "rules", [(1, "", "not an object")]),
        ([{"id": "a", "message": 1, "pattern": "x"}], "rules",
         [(1, "message", "not a string"), (1, "severity", "missing")]),
        ({"other": []}, "false_positive", [(0, "false_positive", "key is missing")]),
        ({"excluded_files": "x"}, "excluded_files", [(0, "excluded_files", "not a list")]),
        ({"excluded_files": ["x"]}, "excluded_files", []),
    ],
)
def test_settings_checks(spark, data, kind, problems):
    assert [tuple(r) for r in tables.check_settings(spark, data, kind).collect()] == problems


def test_rule_tables(spark):
    assert tables.rule_table(spark).count() == len(settings.RULES) == 11
    assert len(settings.EXCLUDED_EXTENSIONS) == len(set(settings.EXCLUDED_EXTENSIONS)) == 89
    assert len(set(settings.EXCLUDED_FILES)) == 30 and len(settings.FALSE_POSITIVES) == 21


def test_sample_readers(spark, tmp_path):
    (tmp_path / "pos.txt").write_bytes("  key \n\n\ta\x0bb\r\nlast x\n".encode())
    (tmp_path / "neg.txt").write_bytes(b"plain\n")
    paths = str(tmp_path / "pos.txt"), str(tmp_path / "neg.txt")
    quality = {(r["text"], r["label"]) for r in samples.read_samples(spark, *paths).collect()}
    assert quality == {("key", 1), ("a\x0bb", 1), ("last x", 1), ("plain", 0)}
    training = samples.read_samples(spark, *paths, mode="training")
    positives = sorted(r["text"] for r in training.filter("label = 1").collect())
    assert positives == sorted((tmp_path / "pos.txt").read_bytes().decode().splitlines())


def test_evaluation_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'secret_value,secret_type\n" a ""q"" , b ",Secret\n,Secret\nx,\n y , notsecret \n"two\nlines",SECRET\n'
    )
    rows = samples.read_evaluation_csv(spark, str(tmp_path / "t.csv")).collect()
    assert {tuple(r) for r in rows} == {
        ('a "q" , b', 1, "Secret"), ("y", 0, "notsecret"), ("two\nlines", 1, "SECRET"),
    }


def test_requests(spark, tmp_path):
    row = dict(zip(requests.REQUEST_FIELDS, ("p", "u", "Tag", "v1", "c")))
    made = requests.make_requests(spark, [row, ("q", "u", "Branch", "main", "c")])
    assert made.schema == requests.REQUEST_SCHEMA and made.count() == 2
    made.write.json(str(tmp_path / "r"))
    assert requests.read_requests(spark, str(tmp_path / "r")).count() == 2
    with pytest.raises(KeyError):
        requests.make_requests(spark, [{"ProjectName": "p"}])


def test_spread_leaves_large_sources_alone(spark):
    small = spark.range(10).coalesce(1)
    assert files.spread(small).rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 20)
    assert files.spread(wide).rdd.getNumPartitions() == 20
