"""Settings tables read from YAML or JSON, their checks, and their DataFrame forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions.regex import compile_problem
from credsieve.settings import Framework, Rule

try:
    import yaml
except ImportError:  # only needed for .yml files
    yaml = None

RULE_FIELDS = ("id", "message", "pattern", "severity")
RULE_SCHEMA = (
    "rule_ord int, id string, message string, pattern string, severity string, "
    "keywords array<string>"
)


def read_settings(spark: SparkSession, path: str):
    """Parsed content of one settings file, from any file system Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    content = (text[0] if text else "").replace("\r\n", "\n").replace("\r", "\n")
    if path.endswith(".json"):
        return json.loads(content)
    if yaml is None:
        raise ImportError("reading YAML settings needs the yaml package; use JSON instead")
    return yaml.safe_load(content)


def _rule_problems(data) -> list[tuple[int, str, str]]:
    if not isinstance(data, list):
        return [(0, "", "not a list of rules")]
    problems = []
    for row, rule in enumerate(data, start=1):
        if not isinstance(rule, dict):
            problems.append((row, "", "not an object"))
            continue
        for name in RULE_FIELDS:
            if name not in rule:
                problems.append((row, name, "missing"))
            elif not isinstance(rule[name], str):
                problems.append((row, name, "not a string"))
        pattern = rule.get("pattern")
        wrong = compile_problem(pattern) if isinstance(pattern, str) else None
        if wrong:
            problems.append((row, "pattern", f"invalid regular expression: {wrong}"))
    return problems


def settings_problems(data, kind: str) -> list[tuple[int, str, str]]:
    """What is wrong with parsed settings of a kind, as (row, field, problem)."""
    if not data:
        return [(0, "", "empty")]
    if kind == "rules":
        return _rule_problems(data)
    if not isinstance(data, dict) or kind not in data:
        return [(0, kind, "key is missing")]
    if not isinstance(data[kind], list):
        return [(0, kind, "not a list")]
    return [
        (row, kind, "not a string")
        for row, value in enumerate(data[kind], start=1)
        if not isinstance(value, str)
    ]


def check_settings(spark: SparkSession, data, kind: str) -> DataFrame:
    """Problems of parsed settings; no rows when they are sound.

    ``kind`` is ``rules``, ``excluded_files``, ``excluded_extensions`` or ``false_positive``.
    """
    return spark.createDataFrame(
        settings_problems(data, kind), "row int, field string, problem string"
    )


def _require(data, kind: str):
    problems = settings_problems(data, kind)
    if problems:
        raise ValueError(f"{kind}: {problems}")
    return data


def load_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules of a file, in order. A file with any problem is refused as a whole, so that no detector
    is switched off by a typo; ``check_settings`` lists the problems."""
    return tuple(
        Rule(*(rule[name] for name in RULE_FIELDS), tuple(rule.get("keywords") or ()) or None)
        for rule in _require(read_settings(spark, path), "rules")
    )


def load_values(spark: SparkSession, path: str, kind: str) -> tuple[str, ...]:
    """Distinct values of an exclusion or false-positive file, in order."""
    return tuple(dict.fromkeys(_require(read_settings(spark, path), kind)[kind]))


def load_languages(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Language map ``{name: {"extensions": [...]}}`` of a file."""
    return {
        name: tuple(dict.fromkeys(ext.lower() for ext in entry.get("extensions", [])))
        for name, entry in read_settings(spark, path).items()
    }


def load_frameworks(
    spark: SparkSession, path: str
) -> tuple[dict[str, Framework], tuple[str, ...]]:
    """Framework rules and manifest file names of a file."""
    data = read_settings(spark, path)
    frameworks = {
        name: Framework(*(tuple(entry.get(field) or ()) for field in Framework._fields))
        for name, entry in (data.get("frameworks") or {}).items()
    }
    return frameworks, tuple(data.get("manifest_files") or ())


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A settings table; broadcast as long as its row count proves it small."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= settings.BROADCAST_ROWS else frame


def rule_table(spark: SparkSession, rules=settings.RULES) -> DataFrame:
    rows = [
        (order, r.id, r.message, r.pattern, r.severity, list(r.keywords) if r.keywords else None)
        for order, r in enumerate(rules, start=1)
    ]
    return small_table(spark, rows, RULE_SCHEMA)


def language_table(spark: SparkSession, languages=settings.LANGUAGES) -> DataFrame:
    rows = [(name, ext) for name, exts in languages.items() for ext in dict.fromkeys(exts)]
    return small_table(spark, rows, "language string, ext string")
