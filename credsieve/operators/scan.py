"""Finding secrets: file exclusion, rule matching, false positives, per-file caps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions import text as tx
from credsieve.functions.regex import danger, guarded_search, needs_guard, to_java
from credsieve.settings import TYPE_LONG_LINE, TYPE_TOO_MANY, Rule
from credsieve.sources.files import to_lines

FINDING_FIELDS = ("line", "rule_ord", "type", "secret", "context", "severity", "confidence")

# Characters that match an ASCII letter when case is ignored but do not lower-case to it alone.
_CASE_ODDITIES = ("\u0130", "\u0131", "\u017f", "\u212a")


# --- files -----------------------------------------------------------------------------------


def _exclusions(extensions, names) -> tuple[Column, Column]:
    by_extension = F.col("ext").isin(list(extensions))
    return by_extension, ~by_extension & F.col("file_name").isin(list(names))


def exclude_files(
    files: DataFrame,
    extensions=settings.EXCLUDED_EXTENSIONS,
    names=settings.EXCLUDED_FILES,
) -> DataFrame:
    """Files to scan. Works on names alone, so it runs before any content is touched."""
    by_extension, by_name = _exclusions(extensions, names)
    return files.filter(~by_extension & ~by_name)


def exclusion_summary(
    files: DataFrame,
    extensions=settings.EXCLUDED_EXTENSIONS,
    names=settings.EXCLUDED_FILES,
) -> DataFrame:
    """Per project: all, scanned and excluded file counts and what was skipped, sorted.

    The skipped values come from the exclusion tables, so the set per project stays small.
    """
    by_extension, by_name = _exclusions(extensions, names)
    skipped = F.when(by_extension, F.concat(F.lit("*"), "ext")).when(by_name, F.col("file_name"))
    return (
        files.select("project", skipped.alias("skipped"))
        .groupBy("project")
        .agg(
            F.count("*").alias("all_files"),
            F.count_if(F.col("skipped").isNull()).alias("scanned_files"),
            F.count("skipped").alias("files_excluded"),
            F.array_join(F.array_sort(F.collect_set("skipped")), ", ").alias("skipped_files"),
        )
    )


# --- rules -----------------------------------------------------------------------------------


def _may_hit(rule: Rule, text: Column, low: Column, ignore_case: bool) -> Column:
    """A cheap condition that every match of the rule meets."""
    if not rule.keywords:
        return F.lit(True)
    possible = tx.contains_any(low, rule.keywords)
    return possible | tx.contains_any(text, _CASE_ODDITIES) if ignore_case else possible


def _hits(rule: Rule, text: Column, low: Column, ignore_case: bool = False) -> Column:
    return _first_match(rule, text, low, ignore_case).isNotNull() if danger(rule.pattern) else (
        _may_hit(rule, text, low, ignore_case) & text.rlike(to_java(rule.pattern, ignore_case))
    )


def _guarded(rule: Rule, text: Column, low: Column, ignore_case: bool = False) -> Column:
    """The match outside the JVM, of the texts that need it."""
    needed = _may_hit(rule, text, low, ignore_case) & needs_guard(rule.pattern, text)
    return guarded_search(rule.pattern, F.when(needed, text), ignore_case)


def _first_match(rule: Rule, text: Column, low: Column, ignore_case: bool = False) -> Column:
    """The first match of a rule, null without one. A rule that can end a task is kept from the texts it can do so on."""
    java = to_java(rule.pattern, ignore_case)
    native = F.when(
        _may_hit(rule, text, low, ignore_case) & text.rlike(java), F.regexp_extract(text, java, 0)
    )
    if danger(rule.pattern) is None:
        return native
    guard = needs_guard(rule.pattern, text)
    return F.when(guard, _guarded(rule, text, low, ignore_case)["found"]).otherwise(F.when(~guard, native))


def shared_literals(keywords, shortest: int = 3) -> list[str]:
    """A few literals such that every keyword holds one of them.

    Keywords that have a part in common are tested by that part, so a line without any of them is
    passed over after fewer searches.
    """
    left, chosen = set(keywords), []
    while left:
        parts = left | {
            word[start:end]
            for word in left
            for start in range(len(word))
            for end in range(start + shortest, len(word) + 1)
        }
        best = max(parts, key=lambda part: (sum(part in word for word in left), len(part), part))
        chosen.append(best)
        left = {word for word in left if best not in word}
    return chosen


def _any_may_hit(rules, text: Column, low: Column) -> Column:
    """A cheap condition that every line with a match of any rule meets."""
    if not all(rule.keywords for rule in rules):
        return F.lit(True)
    return tx.contains_any(low, shared_literals({k for rule in rules for k in rule.keywords}))


def match_rules(
    lines: DataFrame,
    rules=settings.RULES,
    max_line_length: int | None = settings.MAX_LINE_LENGTH,
) -> DataFrame:
    """First match of each rule on each line, and one row for each line too long to scan.

    The rules are unrolled into literal patterns, each behind its keyword test, so one pass over
    the lines does it all and lines without a hit are dropped inside the same stage. The lower-case
    copy of the line is computed once for all keyword tests, the context only for hits. Without a
    ``max_line_length`` lines of any length are scanned.
    """
    text, low = F.col("text"), F.col("low")

    def row(order: int, kind: str, secret: Column, context: Column, severity: str) -> Column:
        return F.struct(
            F.lit(order).alias("rule_ord"),
            F.lit(kind).alias("type"),
            secret.alias("secret"),
            context.alias("context"),
            F.lit(severity).alias("severity"),
            F.lit(1.0).alias("confidence"),
        )

    note = F.lit(f"Line not scanned: longer than {max_line_length} characters. Hash: ")
    too_long = row(
        0,
        TYPE_LONG_LINE,
        F.concat(note, F.md5(text.cast("binary"))),
        F.format_string("Line %d is very long. Length: %d.", "line", F.length(text)),
        "Potential",
    )
    found = [
        F.when(
            _hits(rule, text, low),
            row(order, rule.message, _first_match(rule, text, low), tx.strip(text), ""),
        )
        for order, rule in enumerate(rules, start=1)
    ]
    no_scan = F.lit(False) if max_line_length is None else F.length(text) > max_line_length
    hits = F.when(no_scan, F.array(too_long)).when(
        _any_may_hit(rules, text, low), F.array_compact(F.array(*found))
    )
    return lines.select(
        "project", "path", "line", "text", F.lower("text").alias("low")
    ).select("project", "path", "line", F.inline(hits))


def match_problems(
    lines: DataFrame,
    rules=settings.RULES,
    max_line_length: int | None = settings.MAX_LINE_LENGTH,
) -> DataFrame:
    """(project, path, line, rule_id, problem) of rules that gave no answer on a line.

    Only rules that could end a task or try for ever have any; their long lines are matched outside the JVM and
    under a time limit (see ``functions.regex.danger``). All other rows are scanned as usual.
    """
    schema = "project string, path string, line int, rule_id string, problem string"
    risky = [rule for rule in rules if danger(rule.pattern)]
    if not risky:
        return lines.sparkSession.createDataFrame([], schema)
    text, low = F.col("text"), F.col("low")
    if max_line_length is not None:
        lines = lines.filter(F.length("text") <= max_line_length)
    rows = lines.select("project", "path", "line", "text", F.lower("text").alias("low"))
    found = rows.select(
        "project",
        "path",
        "line",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(rule.id).alias("rule_id"), _guarded(rule, text, low)["problem"].alias("problem"))
                    for rule in risky
                ]
            )
        ).alias("found"),
    )
    return found.select("project", "path", "line", "found.*").filter(F.col("problem").isNotNull())


def drop_false_positives(findings: DataFrame, literals=settings.FALSE_POSITIVES) -> DataFrame:
    """Drop findings whose context holds a false-positive literal, ignoring case.

    Lines too long to scan are no matches and stay.
    """
    if not literals:
        return findings
    quoted = "|".join(sorted({re.escape(literal.lower()) for literal in literals}))
    return findings.filter(
        (F.col("type") == TYPE_LONG_LINE) | ~F.lower("context").rlike(quoted)
    )


def cap_per_file(
    findings: DataFrame, max_secrets: int | None = settings.MAX_SECRETS_PER_FILE
) -> DataFrame:
    """Replace all rows of a file that has too many matches by one summary row.

    The summary carries the count, every secret in (line, rule) order and their hash. Findings, not
    contents, are shuffled once by file. They are counted before they are gathered, and those of
    files over the cap are gathered without their contexts, which the summary does not show: what
    comes together is at most the secrets of one file. None lists every file in full.
    """
    if max_secrets is None:
        return findings.select("project", "path", *FINDING_FIELDS)
    match = lambda row: row["type"] != TYPE_LONG_LINE
    matches = F.count_if(F.col("type") != TYPE_LONG_LINE).over(
        Window.partitionBy("project", "path")
    )
    counted = findings.withColumn("matches", matches)
    kept_context = F.when(F.col("matches") <= max_secrets, F.col("context")).alias("context")
    fields = [kept_context if name == "context" else F.col(name) for name in FINDING_FIELDS]
    files = (
        counted.select("project", "path", "matches", F.struct(*fields).alias("finding"))
        .groupBy("project", "path")
        .agg(F.collect_list("finding").alias("rows"), F.max("matches").alias("matches"))
    )
    secrets = F.array_join(
        F.transform(
            F.sort_array(F.filter(F.col("rows"), match)), lambda row: row["secret"]
        ),
        "\n",
    )
    files = files.withColumn("secrets", F.when(F.col("matches") > max_secrets, secrets))
    summary = F.struct(
        F.lit(0).alias("line"),
        F.lit(0).alias("rule_ord"),
        F.lit(TYPE_TOO_MANY).alias("type"),
        F.concat(
            F.lit(f"File not listed in full: more than {max_secrets} secrets. Hash of all: "),
            F.md5(F.col("secrets").cast("binary")),
        ).alias("secret"),
        F.concat(
            F.lit("Secrets found: "), F.col("matches"), F.lit("\nAll secrets follow:\n"), "secrets"
        ).alias("context"),
        F.lit("High").alias("severity"),
        F.lit(1.0).alias("confidence"),
    )
    kept = F.when(F.col("secrets").isNotNull(), F.array(summary)).otherwise(F.col("rows"))
    return files.select("project", "path", F.inline(kept))


def scan_lines(
    lines: DataFrame,
    rules=settings.RULES,
    false_positives=settings.FALSE_POSITIVES,
    max_secrets: int | None = settings.MAX_SECRETS_PER_FILE,
    max_line_length: int | None = settings.MAX_LINE_LENGTH,
) -> DataFrame:
    """Findings of numbered lines."""
    matches = match_rules(lines, rules, max_line_length)
    return cap_per_file(drop_false_positives(matches, false_positives), max_secrets)


def scan_files(
    files: DataFrame,
    rules=settings.RULES,
    false_positives=settings.FALSE_POSITIVES,
    extensions=settings.EXCLUDED_EXTENSIONS,
    names=settings.EXCLUDED_FILES,
    max_secrets: int | None = settings.MAX_SECRETS_PER_FILE,
    max_line_length: int | None = settings.MAX_LINE_LENGTH,
) -> DataFrame:
    """Findings of source files, without the excluded ones."""
    lines = to_lines(exclude_files(files, extensions, names))
    return scan_lines(lines, rules, false_positives, max_secrets, max_line_length)


def all_rule_hits(texts: DataFrame, rules=settings.RULES, text: str = "text") -> DataFrame:
    """One row per text and rule that hits it, with the rule's id, message and severity."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _hits(rule, F.col(text), F.col("_low")),
                    F.struct(
                        F.lit(rule.id).alias("rule_id"),
                        F.lit(rule.message).alias("message"),
                        F.lit(rule.severity).alias("rule_severity"),
                    ),
                )
                for rule in rules
            ]
        )
    )
    guarded = F.when(_any_may_hit(rules, F.col(text), F.col("_low")), hits)
    kept = [name for name in texts.columns]
    return texts.withColumn("_low", F.lower(text)).select(*kept, F.inline(guarded))


def first_rule(text: Column, low: Column, rules=settings.RULES) -> Column:
    """Id of the first rule, in order, that hits a text when case is ignored; null without one."""
    return F.coalesce(
        *[F.when(_hits(rule, text, low, ignore_case=True), rule.id) for rule in rules]
    )


# --- findings --------------------------------------------------------------------------------


# Around a match. Characters that no text should hold; those that do are read as the third meanwhile.
_OPEN, _CLOSE, _STRAY = "\ufdd0", "\ufdd1", "\ufdd2"


def masked_view(context: Column, rule: Rule) -> Column:
    """The context with all matches of a rule starred, the same length.

    The context ends its line, so the line end it was stripped of is put back for the match. Matches that must not
    meet a long context inside the JVM are left to the secrets that were found.
    """
    plain = F.translate(F.concat(context, F.lit("\n")), _OPEN + _CLOSE, _STRAY * 2)
    marked = F.regexp_replace(plain, F.lit(to_java(rule.pattern)), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.transform(
        F.split(marked, _OPEN),
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(
                tx.mask(F.substring_index(piece, _CLOSE, 1)),
                F.substring(piece, F.length(F.substring_index(piece, _CLOSE, 1)) + 2, F.length(piece)),
            )
        ),
    )
    view = F.substring(F.array_join(pieces, ""), F.lit(1), F.length(context))
    possible = _may_hit(rule, context, F.lower(context), False)
    return F.when(possible & ~needs_guard(rule.pattern, context), view).otherwise(context)


def mask_findings(findings: DataFrame, rules=settings.RULES) -> DataFrame:
    """Star the secrets, also where a context holds them: its own, all others found on its line, and every
    further match of any rule in the context, of which a finding shows only the first.

    A character is starred when it is so for any of these, so overlapping ones are one span and leave
    nothing in clear. A summary row holds nothing but secrets below its first two lines, which go.
    """
    hidden = tx.mask(F.col("secret"))
    special = F.col("type").isin(list(settings.SPECIAL_TYPES))
    bare = F.trim(F.col("secret"), F.lit("\n"))
    # The secrets of one line: at most one per rule.
    secrets = (
        findings.filter(~special & (bare != ""))
        .groupBy("project", "path", "line")
        .agg(F.collect_set(bare).alias("_secrets"))
    )
    known = F.transform("_secrets", lambda s: F.replace(F.col("context"), s, tx.mask(s)))
    matched = F.array(*[masked_view(F.col("context"), rule) for rule in rules])
    views = F.concat(F.coalesce(known, F.array().cast("array<string>")), matched.cast("array<string>"))
    starred = F.aggregate(
        F.array_distinct(views),
        F.split(F.col("context"), ""),
        lambda shown, view: F.when(F.col("context") == view, shown).otherwise(
            F.zip_with(shown, F.split(view, ""), lambda x, y: F.when(y == "*", y).otherwise(x))
        ),
    )
    masked = F.array_join(starred, "")
    columns = findings.columns
    findings = findings.join(secrets, ["project", "path", "line"], "left")
    return findings.select(
        *[
            {
                "secret": F.when(special, F.col("secret")).otherwise(hidden).alias("secret"),
                "context": F.when(special, F.substring_index("context", "\n", 1))
                .otherwise(masked)
                .alias("context"),
            }.get(name, F.col(name))
            for name in columns
        ]
    )


def findings_by_project(findings: DataFrame) -> DataFrame:
    """Number of findings per project, type and severity."""
    return findings.groupBy("project", "type", "severity").agg(F.count("*").alias("findings"))
