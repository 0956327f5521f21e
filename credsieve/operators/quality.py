"""Quality of a two-class text dataset.

Sums over rows are one narrow pass. Where distinct texts count, ``profile`` groups the samples by
text once, with map-side combining, and everything else is computed per distinct text and weighted
by how often each class holds it; a text that fills a third of the rows costs no more than a rare
one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve import settings
from credsieve.functions import text as tx
from credsieve.operators.scan import first_rule
from credsieve.session import materialize

FLAGS = (
    "empty_strings", "too_short", "too_long", "whitespace_only", "non_printable_chars",
    "potential_test_data",
)
PATTERNS = (
    "contains_digits", "contains_uppercase", "contains_lowercase", "contains_special_chars",
    "contains_spaces", "alphanumeric_only",
)
CRITERIA = tuple(settings.SCORE_WEIGHTS)

_ENTROPY_STEP = 1 / 4096


def profile(samples: DataFrame) -> DataFrame:
    """One row per distinct text with its number of positives and negatives."""
    return samples.groupBy("text").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )


def _rows(samples: DataFrame) -> DataFrame:
    """Samples with the counts of ``profile``, row by row: for sums over rows, which need no
    grouping by text and hence no shuffle of texts."""
    return samples.select(
        "text",
        F.when(F.col("label") == 1, 1).otherwise(0).alias("n_pos"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("n_neg"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


# --- sections --------------------------------------------------------------------------------


def basic_statistics(samples: DataFrame) -> DataFrame:
    """Counts, class balance, and mean and standard deviation of the lengths, in one pass."""
    positive, negative = F.col("label") == 1, F.col("label") == 0
    length = F.length("text")

    def of_class(which: Column, prefix: str) -> list[Column]:
        lengths = F.when(which, length)
        return [
            F.count_if(which).alias(f"{prefix}_count"),
            F.coalesce(F.avg(lengths), F.lit(0.0)).alias(f"{prefix}_avg_length"),
            F.coalesce(F.stddev_samp(lengths), F.lit(0.0)).alias(f"{prefix}_length_std"),
        ]

    return samples.agg(
        *of_class(positive, "secrets"),
        *of_class(negative, "non_secrets"),
        F.count("*").alias("total_count"),
        _ratio(F.count_if(positive), F.count("*")).alias("class_balance"),
    )


def _duplicate_columns() -> list[Column]:
    pos, neg = F.col("n_pos"), F.col("n_neg")
    return [
        F.count_if(pos > 1).alias("secrets_exact_duplicates"),
        F.count_if(neg > 1).alias("non_secrets_exact_duplicates"),
        F.count_if((pos > 0) & (neg > 0)).alias("cross_class_duplicates"),
        _ratio(F.count_if(pos > 1), F.sum(pos)).alias("secrets_duplicate_ratio"),
        _ratio(F.count_if(neg > 1), F.sum(neg)).alias("non_secrets_duplicate_ratio"),
    ]


def duplicates(samples: DataFrame) -> DataFrame:
    """Repeated values per class, their ratio to all rows, and texts of both classes.

    Texts are told apart by a digest, so none is shuffled.
    """
    digests = samples.select(F.sha2("text", 256).alias("text"), "label")
    return profile(digests).agg(*_duplicate_columns())


def overlap(samples: DataFrame) -> DataFrame:
    """The texts found in both classes with their counts."""
    return profile(samples).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def examples(rows: DataFrame, category: str, text: str = "text", limit: int = 5) -> DataFrame:
    """First texts per category in text order. Spark limits each task before the shuffle."""
    order = Window.partitionBy(category).orderBy(text)
    return (
        rows.select(category, text)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
    )


def duplicate_examples(samples: DataFrame, limit: int = 5) -> DataFrame:
    """First repeated texts of each class and first texts of both classes."""
    pos, neg = F.col("n_pos"), F.col("n_neg")
    kinds = F.array_compact(
        F.array(
            F.when(pos > 1, F.lit("secrets")),
            F.when(neg > 1, F.lit("non_secrets")),
            F.when((pos > 0) & (neg > 0), F.lit("cross_class")),
        )
    )
    return examples(
        profile(samples).select(F.explode(kinds).alias("category"), "text"), "category", limit=limit
    )


def with_first_rule(rows: DataFrame, rules=settings.RULES) -> DataFrame:
    """Add ``first_rule``, the first rule that hits the text when case is ignored."""
    low = rows.withColumn("_low", F.lower("text"))
    return low.withColumn("first_rule", first_rule(F.col("text"), F.col("_low"), rules)).drop(
        "_low"
    )


def rule_coverage(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """Samples per class and first rule; a null rule counts the samples no rule covers."""
    return (
        with_first_rule(_rows(samples), rules)
        .groupBy("first_rule")
        .agg(F.sum("n_pos").alias("secrets"), F.sum("n_neg").alias("non_secrets"))
    )


def uncovered_examples(samples: DataFrame, rules=settings.RULES, limit: int = 10) -> DataFrame:
    """First distinct uncovered texts of each class."""
    judged = with_first_rule(profile(samples), rules)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("n_pos") > 0, F.lit("secrets")),
            F.when(F.col("n_neg") > 0, F.lit("non_secrets")),
        )
    )
    # Not a filter: the optimizer would push it below and run the rules twice.
    uncovered = F.when(F.col("first_rule").isNull(), kinds)
    return examples(
        judged.select(F.explode(uncovered).alias("category"), "text"), "category", limit=limit
    )


def raw_line_issues(lines: DataFrame) -> DataFrame:
    """Blank lines and lines that are not UTF-8, counted over raw lines (column ``value``).

    The readers drop such lines, so the sample checks cannot see them.
    """
    value = F.col("value")
    plain = value.cast("string")
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_if(plain == "").alias("empty_strings"),
        F.count_if((plain != "") & tx.is_blank(plain)).alias("whitespace_only"),
        F.count_if(~F.is_valid_utf8(plain)).alias("encoding_issues"),
    )


def quality_issues(samples: DataFrame) -> DataFrame:
    """Rows per quality flag, as (issue, rows)."""
    weight = F.col("n_pos") + F.col("n_neg")
    flags = tx.quality_flags(F.col("text"))
    sums = _rows(samples).agg(
        *[F.coalesce(F.sum(F.when(flags[f], weight)), F.lit(0)).alias(f) for f in FLAGS]
    )
    return sums.unpivot([], list(FLAGS), "issue", "rows")


def issue_examples(samples: DataFrame, limit: int = 5) -> DataFrame:
    """First distinct texts per quality flag."""
    flags = tx.quality_flags(F.col("text"))
    kinds = F.array_compact(F.array(*[F.when(flags[f], F.lit(f)) for f in FLAGS]))
    return examples(
        profile(samples).select(F.explode(kinds).alias("issue"), "text"), "issue", limit=limit
    )


def _pattern_flags() -> dict[str, Column]:
    text = F.col("text")
    return {
        "contains_digits": tx.has_digit(text),
        "contains_uppercase": tx.has_upper(text),
        "contains_lowercase": tx.has_lower(text),
        "contains_special_chars": tx.has_special(text),
        "contains_spaces": F.contains(text, F.lit(" ")),
        "alphanumeric_only": tx.is_alphanumeric(text),
    }


def pattern_distribution(samples: DataFrame) -> DataFrame:
    """Rows per character-class pattern, as (pattern, rows)."""
    weight = F.col("n_pos") + F.col("n_neg")
    flags = _pattern_flags()
    sums = _rows(samples).agg(
        *[F.coalesce(F.sum(F.when(flags[f], weight)), F.lit(0)).alias(f) for f in PATTERNS]
    )
    return sums.unpivot([], list(PATTERNS), "pattern", "rows")


def prefix_distribution(samples: DataFrame, prefixes=settings.KEY_PREFIXES) -> DataFrame:
    """Rows per key prefix; prefixes without rows are left out."""
    return (
        samples.select(F.explode(tx.prefix_hits(F.col("text"), prefixes)).alias("prefix"))
        .groupBy("prefix")
        .agg(F.count("*").alias("rows"))
    )


def top_lengths(samples: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent text lengths."""
    return (
        samples.groupBy(F.length("text").alias("length"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "length")
        .limit(limit)
    )


# --- entropy ---------------------------------------------------------------------------------


def exact_median(rows: DataFrame, value: str, weight: str, step: float) -> DataFrame:
    """Exact weighted median as one row (median).

    Values are counted per bucket of width ``step``; only the one or two buckets that hold the
    middle ranks are ordered value by value. ``step`` must leave a bounded number of buckets, as it
    does for entropies, which stay below the number of bits of a length.
    """
    bucketed = rows.select(
        F.floor(F.col(value) / step).alias("bucket"),
        F.col(value).alias("value"),
        F.col(weight).alias("weight"),
    )
    counts = bucketed.groupBy("bucket").agg(F.sum("weight").alias("n"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    ranked = counts.select(
        "bucket",
        "n",
        F.sum("n").over(running).alias("upto"),
        F.sum("n").over(everything).alias("total"),
    )
    low, high = F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")
    middle = ranked.filter((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select(
        "bucket", (F.col("upto") - F.col("n")).alias("before"), low.alias("low"), high.alias("high")
    )
    # At most two rows: the buckets of the two middle ranks.
    values = (
        bucketed.join(F.broadcast(middle), "bucket")
        .groupBy("bucket", "before", "low", "high", "value")
        .agg(F.sum("weight").alias("n"))
    )
    in_bucket = (
        Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = values.withColumn("upto", F.col("before") + F.sum("n").over(in_bucket))
    first = F.col("upto") - F.col("n") + 1

    def holds(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(first, F.col("upto")), F.col("value")))

    return placed.agg(((holds("low") + holds("high")) / 2).alias("median"))


def _entropies(samples: DataFrame) -> DataFrame:
    """Distinct entropies and how many samples have each."""
    return (
        _rows(samples)
        .select(
            tx.shannon_entropy(F.col("text")).alias("entropy"),
            (F.col("n_pos") + F.col("n_neg")).alias("weight"),
        )
        .groupBy("entropy")
        .agg(F.sum("weight").alias("weight"))
    )


def _weighted_moments(value: Column, weight: Column, prefix: str) -> list[Column]:
    n = F.sum(weight).cast("double")
    mean = F.try_divide(F.sum(value * weight), n)
    squares = F.sum(value * value * weight)
    spread = F.try_divide(F.greatest(squares - n * mean * mean, F.lit(0.0)), n - 1)
    return [
        F.coalesce(mean, F.lit(0.0)).alias(f"{prefix}_mean"),
        F.coalesce(F.sqrt(spread), F.lit(0.0)).alias(f"{prefix}_std"),
    ]


def entropy_statistics(samples: DataFrame) -> DataFrame:
    """Mean, exact median and sample standard deviation of the entropies of all samples.

    The counted entropies are written first: they are few, and three results need them.
    """
    rows = materialize(_entropies(samples))
    median = exact_median(rows, "entropy", "weight", _ENTROPY_STEP).scalar()
    return rows.agg(*_weighted_moments(F.col("entropy"), F.col("weight"), "entropy")).select(
        F.col("entropy_mean").alias("mean"),
        F.coalesce(median, F.lit(0.0)).alias("median"),
        F.col("entropy_std").alias("std"),
    )


# --- scorecard -------------------------------------------------------------------------------


def judge(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """Every distinct text with its counts, first rule, quality flags, patterns and entropy."""
    flags = {**tx.quality_flags(F.col("text")), **_pattern_flags()}
    return with_first_rule(profile(samples), rules).select(
        "text",
        "n_pos",
        "n_neg",
        "first_rule",
        *[column.alias(name) for name, column in flags.items()],
        tx.shannon_entropy(F.col("text")).alias("entropy"),
    )


def metrics(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """All metrics of the dataset as one wide row: one grouping by text, one global aggregate."""
    return summarize(judge(samples, rules), len(rules))


def summarize(judged: DataFrame, total_rules: int) -> DataFrame:
    """All metrics of judged texts as one wide row. Columns nobody reads are not computed."""
    pos, neg = F.col("n_pos"), F.col("n_neg")
    texts = judged.select(
        "*", (pos + neg).alias("weight"), F.length("text").cast("double").alias("length")
    )
    weight, length = F.col("weight"), F.col("length")

    def total(condition: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, what)), F.lit(0))

    uncovered = F.col("first_rule").isNull()
    zero = F.lit(0)
    row = texts.agg(
        F.coalesce(F.sum(pos), zero).alias("secrets_count"),
        F.coalesce(F.sum(neg), zero).alias("non_secrets_count"),
        F.coalesce(F.sum(weight), zero).alias("total_count"),
        _ratio(F.sum(pos), F.sum(weight)).alias("class_balance"),
        *_weighted_moments(length, pos, "secrets_length"),
        *_weighted_moments(length, neg, "non_secrets_length"),
        *_duplicate_columns(),
        F.coalesce(F.size(F.collect_set(F.when(pos > 0, F.col("first_rule")))), zero)
        .cast("bigint").alias("rules_matching_secrets"),
        F.coalesce(F.size(F.collect_set(F.when(neg > 0, F.col("first_rule")))), zero)
        .cast("bigint").alias("rules_matching_non_secrets"),
        total(uncovered, pos).alias("uncovered_secrets_count"),
        total(uncovered, neg).alias("uncovered_non_secrets_count"),
        _ratio(F.sum(F.when(~uncovered, pos)), F.sum(pos)).alias("secrets_coverage_ratio"),
        _ratio(F.sum(F.when(~uncovered, neg)), F.sum(neg)).alias("non_secrets_coverage_ratio"),
        *[total(F.col(name), weight).alias(name) for name in (*FLAGS, *PATTERNS)],
        *_weighted_moments(F.col("entropy"), weight, "entropy"),
    )
    issues = sum((F.col(name) for name in FLAGS), F.lit(0))
    return row.withColumn("total_issues", issues).withColumn(
        "total_rules", F.lit(total_rules).cast("bigint")
    )


def _ladder(value: Column, steps: list[tuple], otherwise: int, at_least: bool) -> Column:
    """The score of the first step whose bound the value meets."""
    score = None
    for bound, points in steps:
        meets = value >= bound if at_least else value <= bound
        score = F.when(meets, points) if score is None else score.when(meets, points)
    return score.otherwise(otherwise)


def scorecard(metric_row: DataFrame) -> DataFrame:
    """Add six 0-10 scores, their weighted total, the 0-100 score and the quality label.

    Works on the wide row of ``metrics``.
    """
    total, balance = F.col("total_count"), F.col("class_balance")
    repeated = F.greatest("secrets_duplicate_ratio", "non_secrets_duplicate_ratio")
    crossing, coverage = F.col("cross_class_duplicates"), F.col("secrets_coverage_ratio")
    issues = F.col("total_issues") / F.greatest(total, F.lit(1))

    balance_score = F.lit(0)
    for low, high, points in ((0.1, 0.9, 3), (0.2, 0.8, 6), (0.3, 0.7, 8), (0.4, 0.6, 10)):
        balance_score = F.when(balance.between(low, high), points).otherwise(balance_score)
    share_steps = [(0.01, 10), (0.05, 7), (0.1, 4), (0.2, 2)]
    scores = {
        "dataset_size": _ladder(
            total, [(50000, 10), (20000, 8), (10000, 6), (5000, 4), (1000, 2)], 0, True
        ),
        "class_balance": balance_score,
        "duplicates": _ladder(repeated, share_steps, 0, False),
        "cross_class": F.when(crossing == 0, 10).when(crossing <= total * 0.001, 5).otherwise(0),
        "rule_coverage": _ladder(
            coverage, [(0.95, 10), (0.9, 8), (0.8, 6), (0.7, 4), (0.5, 2)], 0, True
        ),
        "data_quality": _ladder(issues, share_steps, 0, False),
    }
    scored = metric_row.select(
        "*",
        repeated.alias("max_duplicate_ratio"),
        issues.alias("issues_ratio"),
        *[scores[name].alias(f"score_{name}") for name in CRITERIA],
    )
    weighted = sum(
        (F.col(f"score_{name}") * settings.SCORE_WEIGHTS[name] for name in CRITERIA), F.lit(0.0)
    )
    penalties = (
        (total < 1000, 20),
        (crossing > 0, 25),
        (coverage < 0.7, 20),
        ((balance < 0.3) | (balance > 0.7), 10),
        (F.col("max_duplicate_ratio") > 0.05, 10),
        (F.col("issues_ratio") > 0.05, 15),
    )
    lost = sum((F.when(meets, points).otherwise(0) for meets, points in penalties), F.lit(0))
    rated = scored.withColumn("weighted_score", weighted).select(
        "*",
        F.bround("weighted_score", 1).alias("quality_score_10"),
        F.greatest(F.lit(0.0), F.col("weighted_score") * 10 - lost).alias("overall_quality_score"),
    )
    label = (
        F.when(F.col("quality_score_10") >= 8.5, "excellent")
        .when(F.col("quality_score_10") >= 7.0, "good")
        .when(F.col("quality_score_10") >= 5.5, "satisfactory")
        .when(F.col("quality_score_10") >= 3.0, "poor")
        .otherwise("critical")
    )
    return rated.withColumn("quality_label", label)


def recommendations(scored_row: DataFrame) -> DataFrame:
    """Advice rows (level, code, message, fixable) for a scored metric row."""
    c = F.col

    def percent(value: str) -> Column:
        return F.format_number(c(value) * 100, 1)

    def advice(when: Column, level: str, code: str, message: Column, fixable: bool) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(level).alias("level"),
                F.lit(code).alias("code"),
                message.alias("message"),
                F.lit(fixable).alias("fixable"),
            ),
        )

    rows = [
        advice(
            c("total_count") < 1000, "critical", "dataset_size",
            F.format_string("Only %d samples; have 10000 or more per class.", "total_count"),
            False,
        ),
        advice(
            c("cross_class_duplicates") > 0, "critical", "cross_class",
            F.format_string("%d texts are in both classes.", "cross_class_duplicates"), True,
        ),
        advice(
            c("secrets_coverage_ratio") < 0.7, "critical", "rule_coverage",
            F.format_string("Rules cover only %s%% of the secrets.",
                            percent("secrets_coverage_ratio")), False,
        ),
        advice(
            (c("class_balance") < 0.3) | (c("class_balance") > 0.7), "warning", "class_balance",
            F.format_string("Classes are unbalanced: %s%% secrets; aim for 30 to 70.",
                            percent("class_balance")), False,
        ),
        advice(
            c("max_duplicate_ratio") > 0.05, "warning", "duplicates",
            F.format_string("Many duplicates: %s%%.", percent("max_duplicate_ratio")), True,
        ),
        advice(
            c("issues_ratio") > 0.05, "warning", "data_quality",
            F.format_string("Many quality issues: %d.", "total_issues"), True,
        ),
        advice(
            c("total_count") < 10000, "suggestion", "more_data",
            F.lit("Add samples so that the model generalises better."), False,
        ),
        advice(
            c("uncovered_secrets_count") > 0, "suggestion", "add_rules",
            F.format_string("Add rules for %d uncovered secrets or check their labels.",
                            "uncovered_secrets_count"), False,
        ),
    ]
    return scored_row.select(F.inline(F.array_compact(F.array(*rows))))


SECTIONS = {
    "basic_statistics": (
        "secrets_count", "non_secrets_count", "total_count", "class_balance",
        "secrets_length_mean", "secrets_length_std", "non_secrets_length_mean",
        "non_secrets_length_std",
    ),
    "duplicates": (
        "secrets_exact_duplicates", "non_secrets_exact_duplicates", "cross_class_duplicates",
        "secrets_duplicate_ratio", "non_secrets_duplicate_ratio",
    ),
    "rule_coverage": (
        "total_rules", "rules_matching_secrets", "rules_matching_non_secrets",
        "secrets_coverage_ratio", "non_secrets_coverage_ratio", "uncovered_secrets_count",
        "uncovered_non_secrets_count",
    ),
    "quality_issues": (*FLAGS, "total_issues"),
    "patterns": (*PATTERNS, "entropy_mean", "entropy_std"),
    "scores": (
        *(f"score_{name}" for name in CRITERIA), "quality_score_10", "overall_quality_score",
    ),
}


def tidy(scored_row: DataFrame) -> DataFrame:
    """A scored metric row as rows (section, metric, value)."""
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("value"),
        )
        for section, names in SECTIONS.items()
        for name in names
    ]
    return scored_row.select(F.inline(F.array(*rows)))


def quality_report(samples: DataFrame, rules=settings.RULES) -> DataFrame:
    """The whole report as rows (section, metric, value)."""
    return tidy(scorecard(metrics(samples, rules)))
