"""The scan against hand-written rows and a plain Python scan."""

import hashlib
import io
import re

import pytest
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions.regex import danger
from credsieve.operators import inventory, scan
from credsieve.plans import fixtures as fx
from credsieve.plans import scans
from credsieve.settings import Framework, Rule
from credsieve.sources.files import to_lines, with_names

SF = "/root/testdata/sf0.001"


def make_files(spark, rows):
    return with_names(spark.createDataFrame(rows, "project string, path string, content string"))


def test_url_rule_keeps_the_newline(spark):
    files = make_files(spark, [("p", "a.txt", "see https://admin:hunter@db/x\nnext")])
    [row] = scan.scan_files(files).collect()
    assert row["type"] == "Password in URL"
    assert row["secret"] == "https://admin:hunter@db/x\n"
    assert row["context"] == "see https://admin:hunter@db/x"
    assert scan.scan_files(make_files(spark, [("p", "a", "https://admin:hunter@db/x")])).count() == 0


def test_line_length_counts_the_newline(spark):
    just = "token=" + "a1" * 4 + " " * (100 - 14)
    files = make_files(spark, [("p", "a", just), ("p", "b", just + "\nx"), ("p", "c", "é" * 100)])
    rows = {r["path"]: r for r in scan.scan_files(files, max_line_length=100).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["type"] == "Token"
    assert rows["b"]["type"] == settings.TYPE_LONG_LINE and rows["b"]["severity"] == "Potential"
    assert hashlib.md5((just + "\n").encode()).hexdigest() in rows["b"]["secret"]
    assert rows["b"]["context"] == "Line 1 is very long. Length: 101."


def test_false_positive_looks_at_the_context_only(spark):
    lines = ["api_key=abcdef", "api_key=abcdef INTEGRITY", "x = '{ENV.' api_key=1"]
    files = make_files(spark, [("p", "a", "\n".join(lines))])
    assert [r["line"] for r in scan.scan_files(files).collect()] == [1]
    matches = scan.match_rules(to_lines(files))
    assert scan.drop_false_positives(matches, ()).count() == 3
    assert scan.drop_false_positives(matches, ("a.c",)).count() == 3


def test_summary_replaces_all_rows_of_a_file(spark):
    many = "\n".join([f"token=abc{i:03d}" for i in range(4)] + ["z" * 60])
    files = make_files(spark, [("p", "many", many), ("p", "few", many[:30])])
    rows = scan.scan_files(files, max_secrets=3, max_line_length=50).collect()
    [summary] = [r for r in rows if r["path"] == "many"]
    secrets = "\n".join(f"token=abc{i:03d}" for i in range(4))
    assert summary["type"] == settings.TYPE_TOO_MANY
    assert (summary["line"], summary["severity"]) == (0, "High")
    assert hashlib.md5(secrets.encode()).hexdigest() in summary["secret"]
    assert summary["context"] == f"Secrets found: 4\nAll secrets follow:\n{secrets}"
    assert len([r for r in rows if r["path"] == "few"]) == 2
    # Exactly at the cap nothing is replaced, and long lines do not count.
    assert scan.scan_files(files, max_secrets=4, max_line_length=50).count() == 7


def test_one_file_with_very_many_lines(spark):
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200000)), lambda i: F.concat(
        F.lit("token=a"), i.cast("string"), F.lit("xyz12"))), "\n")
    files = with_names(spark.range(1).select(
        F.lit("p").alias("project"), F.lit("big.txt").alias("path"), content.alias("content")))
    [row] = scan.scan_files(files).collect()
    assert row["context"].startswith("Secrets found: 200000\n")
    assert row["context"].count("\n") == 200001


def test_exclusion(spark):
    names = ["a.PNG", "x.tar.gz", "yarn.lock", "package.json", "Package.json", "rebar.lock",
             ".env", "README", "pom.xml", ".elixir_ls/rebar.lock"]
    files = make_files(spark, [("p", f"d/{n}", "") for n in names])
    kept = {r["path"] for r in scan.exclude_files(files).collect()}
    assert kept == {"d/Package.json", "d/.env", "d/README"}
    [row] = scan.exclusion_summary(files).collect()
    assert (row["all_files"], row["scanned_files"], row["files_excluded"]) == (10, 3, 7)
    assert row["skipped_files"] == "*.gz, *.lock, *.png, package.json, pom.xml"


def test_rules_without_keywords_and_empty_matches(spark):
    rules = (Rule("r1", "Any", r"x*", "LOW"), Rule("r2", "Hex", r"[0-9a-f]{8}", "LOW"))
    files = make_files(spark, [("p", "a", "deadbeef")])
    rows = scan.scan_files(files, rules=rules, false_positives=()).collect()
    assert {(r["type"], r["secret"]) for r in rows} == {("Any", ""), ("Hex", "deadbeef")}


def plain_scan(content, max_secrets=50, max_line_length=15000):
    """The same scan of one content in straight Python."""
    long_lines, found = [], []
    for number, line in enumerate(io.StringIO(content, newline=None).readlines(), start=1):
        if len(line) > max_line_length:
            long_lines.append((number, settings.TYPE_LONG_LINE))
            continue
        for rule in settings.RULES:
            match = re.search(rule.pattern, line)
            context = line.strip()
            if match and not any(f.lower() in context.lower() for f in settings.FALSE_POSITIVES):
                found.append((number, rule.message, match.group(), context))
    if len(found) > max_secrets:
        return [(0, settings.TYPE_TOO_MANY)]
    return long_lines + found


@pytest.mark.filterwarnings("ignore::FutureWarning")
@pytest.mark.parametrize("limits", [{}, {"max_secrets": 2, "max_line_length": 2000}])
def test_scan_equals_plain_python(spark, limits):
    files = fx.files(spark, SF).cache()
    got = {}
    for r in scan.scan_files(files, extensions=(), names=(), **limits).collect():
        special = r["type"] in settings.SPECIAL_TYPES
        row = (r["line"], r["type"]) + (() if special else (r["secret"], r["context"]))
        got.setdefault(r["path"], []).append(row)
    expected = {f["path"]: plain_scan(f["content"], **limits) for f in files.collect()}
    expected = {path: rows for path, rows in expected.items() if rows}
    assert {p: sorted(r) for p, r in got.items()} == {p: sorted(r) for p, r in expected.items()}


def test_rule_tester(spark):
    texts = spark.createDataFrame([(1, "api_key=token_x1"), (2, "none")], "i int, text string")
    hits = [(r["i"], r["rule_id"], r["rule_severity"]) for r in scan.all_rule_hits(texts).collect()]
    assert sorted(hits) == [(1, "id.apikey", "HIGH")]


def test_masking_hides_the_context_too(spark):
    files = make_files(spark, [("p", "a", "x api_key=abcdef;"), ("p", "b", "token=abc123\n" * 3)])
    rows = scan.mask_findings(scan.scan_files(files, max_secrets=2)).collect()
    by_path = {r["path"]: r for r in rows}
    assert by_path["a"]["secret"] == "api_" + "*" * 11
    assert by_path["a"]["context"] == "x api_" + "*" * 11
    assert by_path["b"]["context"] == "Secrets found: 3"


def test_masking_hides_all_secrets_of_a_line(spark):
    slack = "xoxb-123456789012-123456789012-123456789012-" + "0123456789abcdef" * 2
    line = f"api_key=abcdefgh1234 {'-' * 100} {slack} password=Aa1!bcdefgh"
    rows = scan.mask_findings(scan.scan_files(make_files(spark, [("p", "a", line)]))).collect()
    assert len(rows) >= 3
    for row in rows:
        assert slack[4:] not in row["context"] and "abcdefgh1234" not in row["context"]
        assert "Aa1!bcdefgh" not in row["context"] and len(row["context"]) == len(line)


def test_default_language_map_is_whole():
    assert len(settings.LANGUAGES) == 41
    extensions = [ext for group in settings.LANGUAGES.values() for ext in group]
    assert len({e.lower() for e in extensions}) == 292


def test_excluded_files_never_reach_the_lines(spark):
    plan = scan.scan_files(fx.files(spark, SF))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1


def test_languages(spark):
    names = ["a.py", "b.PY", "c.d.ts", "x.zip", "Dockerfile", ".env", "m.jar", "r.R"]
    languages = {**settings.LANGUAGES, "forbidden": (".zip", ".jar")}
    files = make_files(spark, [("p", n, "") for n in names])
    rows = {r["language"]: (r["files"], r["extensions"]) for r in
            inventory.language_summary(files, languages).collect()}
    assert rows == {
        "python": (2, [".py"]), "typescript": (1, [".ts"]), "forbidden": (2, [".jar", ".zip"]),
        "java": (1, [".jar"]), "Other": (2, []), "r": (1, [".r"]), "archive": (1, [".zip"]),
    }


def test_framework_caps_and_kinds(spark):
    rows = [("p", f"d{i:03d}/package.json", '{"vue": 1}') for i in range(130)]
    rows += [("p", "angular.json", ""), ("p", "x.ts", "IMPORT a FROM '@Angular/core'"),
             ("p", "y.py", "@angular/"), ("q", "pom.xml", "vue-router")]
    evidence = inventory.framework_evidence(make_files(spark, rows))
    got = {(r["project"], r["framework"], r["kind"]): r for r in
           inventory.framework_report(evidence).collect()}
    assert set(got) == {
        ("p", "Vue", "manifest"), ("p", "Angular", "config_file"), ("p", "Angular", "code"),
        ("q", "Vue", "manifest"),
    }
    many = got["p", "Vue", "manifest"]
    assert many["count_label"] == "100+" and many["file_count"] == 101
    assert many["files"] == [f"d{i:03d}/package.json" for i in range(100)]
    assert got["q", "Vue", "manifest"]["dependencies"] == ["vue", "vue-router"]
    assert "(vue, vue-router)" in got["q", "Vue", "manifest"]["description"]


def test_framework_limit_runs_before_the_shuffle(spark):
    plan = inventory.framework_evidence(fx.files(spark, SF))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_custom_frameworks(spark):
    frameworks = {"X": Framework(files=("x.cfg",)), "Y": Framework(dependencies=("dep",))}
    files = make_files(spark, [("p", "x.cfg", "dep"), ("p", "m.txt", "dep")])
    rows = inventory.framework_files(files, frameworks, ("m.txt",)).collect()
    assert {(r["framework"], r["kind"]) for r in rows} == {("X", "config_file"), ("Y", "manifest")}


def test_scan_of_several_projects(spark):
    result = scans.scan_projects(make_files(spark, [("p", "a.py", "token=abc123")]))
    assert result.findings.count() == result.exclusions.count() == result.languages.count() == 1
    assert result.frameworks.count() == 0


def test_caps_can_be_switched_off(spark):
    long = "x" * 20_000 + " api_key=abcdef123"
    rows = [("p", "many", "token=abc123\n" * 60), ("p", "long", long)]
    rows += [("q", f"f{i:03d}/angular.json", "{}") for i in range(120)]
    files = make_files(spark, rows)
    found = scan.scan_files(files, max_secrets=None, max_line_length=None)
    assert {r["path"]: r["count"] for r in found.groupBy("path").count().collect()} == {"many": 60, "long": 1}
    [evidence] = inventory.framework_evidence(files, max_files=None).collect()
    assert evidence["file_count"] == 120 == len(evidence["files"])


# --- all matches are starred -----------------------------------------------------------------


def masked_contexts(spark, lines, rules=settings.RULES):
    rows = [("p", "f", i, line) for i, line in enumerate(lines, start=1)]
    frame = spark.createDataFrame(rows, "project string, path string, line int, text string")
    findings = scan.scan_lines(frame, rules)
    return {r["line"]: r["context"] for r in scan.mask_findings(findings, rules).collect()}


def starred_by_python(line, rules):
    """Stars over every match of every rule, by Python's own matcher."""
    context = line.strip()
    shown = list(context)
    for rule in rules:
        for match in re.finditer(rule.pattern, context + "\n"):
            start = match.start() + (4 if len(match.group()) >= 4 else 0)
            shown[start : match.end()] = "*" * (min(match.end(), len(context)) - start)
    return "".join(shown)


TWO = (
    settings.Rule("t", "Tok", r"tok_[a-z0-9]{6,}", "HIGH"),
    settings.Rule("k", "Key", r"[a-z0-9]{4}_[a-z0-9]{4}\b", "HIGH"),
    settings.Rule("e", "End", r"end=[^ ]{2,9}[\"'\s]", "HIGH"),
)


@pytest.mark.parametrize(
    "line",
    [
        "tok_abcdef12 and tok_zyxwvu98\n",
        "tok_abcdef_1234 overlaps tok_aaaaaa_bbbb",
        "end=12345 end=67890\n",
        "  end=short\n",
        "ab tok_abcdef \U0001f600 tok_ghijkl é\n",
        "﷐tok_abcdef﷑ tok_ghijkl\n",
        "tok_abcdef tok_abcdef tok_abcde tok_abcdefg\n",
    ],
)
def test_every_match_of_every_rule_is_starred(spark, line):
    assert masked_contexts(spark, [line], TWO)[1] == starred_by_python(line, TWO)


def test_second_token_of_a_line_is_starred(spark):
    first, second = "123456789:" + "A" * 35, "987654321:" + "B" * 35
    jwts = "eyJhbGciabc.eyJzdef123.sig456789 eyJhbGcizzz.eyJzyyy999.sig111222"
    shown = masked_contexts(spark, [f"bot {first} bot {second}\n", jwts + "\n"])
    assert "BBBBB" not in shown[1] and "AAAAA" not in shown[1]
    assert "eyJzyyy" not in shown[2] and "eyJzdef" not in shown[2]


# --- rules that could end a task -------------------------------------------------------------


def test_danger_of_patterns():
    assert danger("(a|bc)*!") == "deep" and danger("(?:ab+)+x") == "nested" and danger("(x+)*y") == "nested"
    assert danger(r"[ab]*c+(?:def)?x{1,20}(?=.*z)") is None
    assert not any(danger(rule.pattern) for rule in settings.RULES)


def test_a_rule_that_overflows_leaves_the_rest_alone(spark):
    deep = settings.Rule("deep", "Deep", "(a|bc)*!", "HIGH")
    endless = settings.Rule("endless", "Endless", r"(?:q|qq)+[!?]", "HIGH")
    lines = [
        ("p", "f", 1, "bc" * 7000 + "!\n"), ("p", "f", 2, "aabc!\n"), ("p", "g", 1, "q" * 1500 + "\n"),
        ("p", "g", 2, "qq!\n"), ("p", "h", 1, "token=abc123xyz\n"),
    ]
    frame = spark.createDataFrame(lines, "project string, path string, line int, text string")
    rules = (*settings.RULES, deep, endless)
    found = {(r["path"], r["line"], r["type"]): r["secret"] for r in scan.match_rules(frame, rules).collect()}
    assert found["f", 1, "Deep"] == "bc" * 7000 + "!" and found["f", 2, "Deep"] == "aabc!"
    assert found["g", 2, "Endless"] == "qq!" and ("g", 1, "Endless") not in found
    usual = {(r["path"], r["line"], r["type"]) for r in scan.match_rules(frame).collect()}
    assert usual < set(found) and usual
    problems = [tuple(r) for r in scan.match_problems(frame, rules).collect()]
    assert problems == [("p", "g", 1, "endless", "no answer after 2.0 seconds")]
    assert scan.match_problems(frame).collect() == []
    hits = scan.all_rule_hits(frame, rules).filter("rule_id = 'deep'").select("path", "line").collect()
    assert sorted(map(tuple, hits)) == [("f", 1), ("f", 2), ("g", 2)]
