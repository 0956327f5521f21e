"""The registered queries in plain SQL over the same tables, for checking.

The SQL engine has no look-ahead, so the three rules that use it are written out: after the first
keyword the rest of the line must hold a digit and a lower-case letter, or a special character and
an alphanumeric one. The match then starts at the last place (60 characters on, at most) from which
that is still so, and takes 6 to 32 more characters.
"""

from __future__ import annotations

from credsieve import settings
from credsieve.plans import catalog
from credsieve.plans import fixtures as fx

_SPECIAL = r"[*.!@#$%^&(){}\[\]:;<>,.?/~_+\-=|]"
_KEYWORDS = {
    "id.pass": "passw|pass_|_pass|pswd|pwd|cred|secret",
    "id.token": "token",
    "id.keytabs": "keystore|keytab|truststore",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, literals) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(v)})" for v in literals) + ")"


def _listed(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


def _last(column: str, members: str) -> str:
    """Zero-based place of the last member of a class, -1 without one."""
    return (
        f"CASE WHEN regexp_matches({column}, '{members}') "
        f"THEN length(regexp_extract({column}, '^(.*){members}', 1)) ELSE -1 END"
    )


def _rest(keywords: str) -> str:
    word = f"regexp_extract(text, '(?i:{keywords})')"
    return (
        f"regexp_extract(substr(text, instr(text, {word}) + length({word})), '^[^\\n]*')"
    )


def _lookahead(order: int, rule) -> str:
    """Findings of one look-ahead rule over ``lines``."""
    keywords = _KEYWORDS[rule.id]
    return f"""
SELECT project, path, line, {order} AS rule_ord, {_quoted(rule.message)} AS type,
       concat(word, substr(rest, 1, CAST(skip + least(32, length(rest) - skip) AS BIGINT))) AS secret,
       text
FROM (SELECT *, least(60, length(rest) - 6, greatest(least(d, l), least(s, a))) AS skip
      FROM (SELECT *, {_last("rest", "[0-9]")} AS d, {_last("rest", "[a-z]")} AS l,
                   {_last("rest", _SPECIAL)} AS s, {_last("rest", "[0-9a-zA-Z]")} AS a
            FROM (SELECT *, regexp_extract(text, '(?i:{keywords})') AS word,
                         {_rest(keywords)} AS rest
                  FROM short_lines WHERE regexp_matches(text, '(?i:{keywords})'))))
WHERE length(rest) >= 6 AND skip >= 0"""


def _simple(order: int, rule) -> str:
    pattern = rule.pattern.replace(r"[\w_-]", r"[\p{L}\p{N}_-]").replace("'", "''")
    return f"""
SELECT project, path, line, {order} AS rule_ord, {_quoted(rule.message)} AS type,
       regexp_extract(text, '{pattern}') AS secret, text
FROM short_lines WHERE regexp_matches(text, '{pattern}')"""


def _findings(scanned: str = "SELECT * FROM files", longest: int = settings.MAX_LINE_LENGTH) -> str:
    """CTEs up to ``matches``: rule matches and long lines of the scanned files."""
    hits = " UNION ALL ".join(
        (_lookahead if rule.id in _KEYWORDS else _simple)(order, rule)
        for order, rule in enumerate(settings.RULES, start=1)
    )
    return f"""scanned AS ({scanned}), {fx.SQL_LINES},
short_lines AS (SELECT * FROM lines WHERE length(text) <= {longest}),
hits AS ({hits}),
matches AS (
  SELECT project, path, line, rule_ord, type, secret, {fx.sql_strip("text")} AS context,
         '' AS severity, CAST(1 AS DOUBLE) AS confidence FROM hits
  UNION ALL
  SELECT project, path, line, 0, '{settings.TYPE_LONG_LINE}',
         concat('Line not scanned: longer than {longest} characters. Hash: ', md5(text)),
         concat('Line ', line, ' is very long. Length: ', length(text), '.'), 'Potential',
         CAST(1 AS DOUBLE)
  FROM lines WHERE length(text) > {longest})"""


_FALSE = _any("lower(context)", [v.lower() for v in settings.FALSE_POSITIVES])
_TRUE_MATCHES = f"""true_matches AS (
  SELECT * FROM matches WHERE type = '{settings.TYPE_LONG_LINE}' OR NOT {_FALSE})"""


def _capped(most: int) -> str:
    """CTE ``findings``: true matches with the cap per file applied."""
    return f"""{_TRUE_MATCHES},
per_file AS (
  SELECT project, path, count(*) AS n, string_agg(secret, chr(10) ORDER BY line, rule_ord) AS secrets
  FROM true_matches WHERE type <> '{settings.TYPE_LONG_LINE}'
  GROUP BY project, path HAVING count(*) > {most}),
findings AS (
  SELECT * FROM true_matches t WHERE NOT EXISTS (
    SELECT 1 FROM per_file p WHERE p.project = t.project AND p.path = t.path)
  UNION ALL
  SELECT project, path, 0, 0, '{settings.TYPE_TOO_MANY}',
         concat('File not listed in full: more than {most} secrets. Hash of all: ', md5(secrets)),
         concat('Secrets found: ', n, chr(10), 'All secrets follow:', chr(10), secrets), 'High',
         CAST(1 AS DOUBLE)
  FROM per_file)"""


_BY_EXT = f"ext IN {_listed(settings.EXCLUDED_EXTENSIONS)}"
_BY_NAME = f"file_name IN {_listed(settings.EXCLUDED_FILES)}"
_KEPT_FILES = f"SELECT * FROM files WHERE NOT ({_BY_EXT}) AND NOT ({_BY_NAME})"
_FINDINGS = (
    f"{fx.SQL_FILES}, {_findings(_KEPT_FILES)}, {_capped(settings.MAX_SECRETS_PER_FILE)}"
)
_DOC_FILES = """docs_as_files AS (
  SELECT source AS project, concat('d', doc_id, '.txt') AS path, text AS content FROM documents)"""

_EXCLUSIONS = f"""exclusions AS (
  SELECT project, count(*) AS all_files, count(*) - count(skipped) AS scanned_files,
         count(skipped) AS files_excluded,
         coalesce(string_agg(DISTINCT skipped, ', ' ORDER BY skipped), '') AS skipped_files
  FROM (SELECT project, CASE WHEN {_BY_EXT} THEN concat('*', ext)
                             WHEN {_BY_NAME} THEN file_name END AS skipped FROM files)
  GROUP BY project)"""


def _languages(languages) -> str:
    rows = ", ".join(
        f"({_quoted(name)}, {_quoted(ext)})" for name, exts in languages.items() for ext in exts
    )
    return f"""languages(language, ext) AS (VALUES {rows}),
language_rows AS (
  SELECT project, coalesce(language, 'Other') AS language, count(*) AS files,
         coalesce(string_agg(DISTINCT l.ext, ',' ORDER BY l.ext), '') AS extensions
  FROM files f LEFT JOIN languages l ON f.ext = l.ext GROUP BY ALL)"""


def _grams(table: str, key: str) -> str:
    """CTE ``grams``: every character n-gram of every word of a table's texts."""
    return f"""words AS (
  SELECT {key}, concat(' ', unnest(string_split(trim(
    regexp_replace(lower(text), '[{fx.SPACES}]+', ' ', 'g')), ' ')), ' ') AS word FROM {table}),
grams AS (
  SELECT {key}, substr(word, k, n) AS ngram
  FROM (SELECT *, unnest(generate_series(1, length(word) - n + 1)) AS k
        FROM (SELECT *, unnest([3, 4, 5]) AS n FROM words WHERE word <> '  ')))"""


def _framework_rows() -> str:
    selects = []
    for name, rule in settings.FRAMEWORKS.items():
        held = ", ".join(
            f"CASE WHEN contains(content, {_quoted(d)}) THEN {_quoted(d)} END"
            for d in rule.dependencies
        )
        selects.append(
            f"SELECT project, path, '{name}' AS framework, 'manifest' AS kind, "
            f"[x FOR x IN [{held}] IF x IS NOT NULL] AS dependencies FROM files "
            f"WHERE file_name IN {_listed(settings.MANIFEST_FILES)} "
            f"AND {_any('content', rule.dependencies)}"
        )
        selects.append(
            f"SELECT project, path, '{name}', 'config_file', [] FROM files "
            f"WHERE file_name IN {_listed(rule.files)}"
        )
        found = " OR ".join(
            f"regexp_matches(content, {_quoted('(?i)' + p)})" for p in rule.code_patterns
        )
        selects.append(
            f"SELECT project, path, '{name}', 'code', [] FROM files "
            f"WHERE ext IN {_listed(rule.code_extensions)} AND ({found})"
        )
    return f"evidence_rows AS ({' UNION ALL '.join(selects)})"


_EVIDENCE = f"""{_framework_rows()},
placed AS (
  SELECT 'all' AS project, framework, kind, path, dependencies,
         row_number() OVER (PARTITION BY framework, kind ORDER BY path) AS place
  FROM evidence_rows),
first_files AS (SELECT * FROM placed WHERE place <= {catalog.EVIDENCE_CAP}),
evidence AS (
  SELECT project, framework, kind, count(*) AS file_count,
         list_sort(list_distinct(flatten(list(dependencies)))) AS dependencies
  FROM first_files GROUP BY ALL)"""

_PROFILE = """profile AS (
  SELECT text, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
         count(*) AS w FROM samples GROUP BY text)"""

_FLAGS = {
    "empty_strings": "text = ''",
    "too_short": "text <> '' AND length(text) < 8",
    "too_long": "length(text) > 512",
    "whitespace_only": f"text <> '' AND {fx.sql_strip('text')} = ''",
    "non_printable_chars": r"regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')",
    "potential_test_data": _any("lower(text)", settings.TEST_WORDS),
}
_PATTERNS = {
    "contains_digits": r"regexp_matches(text, '[\p{Nd}²³¹]')",
    "contains_uppercase": r"regexp_matches(text, '\p{Lu}')",
    "contains_lowercase": r"regexp_matches(text, '[\p{Ll}ªº]')",
    "contains_special_chars": rf"regexp_matches(text, '[^\p{{L}}\p{{N}}{fx.SPACES}]')",
    "contains_spaces": "contains(text, ' ')",
    "alphanumeric_only": r"regexp_matches(text, '^[\p{L}\p{N}]+$')",
}


def _covers(rule) -> str:
    """Whether a rule hits ``text`` when case is ignored."""
    if rule.id not in _KEYWORDS:
        pattern = rule.pattern.replace(r"[\w_-]", r"[\p{L}\p{N}_-]")
        return f"regexp_matches(text, {_quoted('(?i)' + pattern)})"
    rest = _rest(_KEYWORDS[rule.id])

    def has(members: str) -> str:
        return f"regexp_matches({rest}, '{members}')"

    return (
        f"(regexp_matches(text, '(?i:{_KEYWORDS[rule.id]})') AND length({rest}) >= 6 AND "
        f"(({has('[0-9]')} AND {has('[a-zA-Z]')}) OR ({has(_SPECIAL)} AND {has('[0-9a-zA-Z]')})))"
    )


_COVERED = f"""covered AS (
  SELECT *, CASE {" ".join(f"WHEN {_covers(r)} THEN '{r.id}'" for r in settings.RULES)} END
         AS first_rule
  FROM profile)"""


def _stacked(columns: dict[str, str], name: str) -> str:
    """One row per named condition with the weight of the texts that meet it."""
    return " UNION ALL ".join(
        f"SELECT '{key}' AS {name}, CAST(coalesce(sum(w) FILTER ({test}), 0) AS BIGINT) AS rows "
        f"FROM profile"
        for key, test in columns.items()
    )


_DUPLICATES = """
 count(*) FILTER (n_pos > 1) AS secrets_exact_duplicates,
 count(*) FILTER (n_neg > 1) AS non_secrets_exact_duplicates,
 count(*) FILTER (n_pos > 0 AND n_neg > 0) AS cross_class_duplicates,
 coalesce(count(*) FILTER (n_pos > 1) / nullif(sum(n_pos), 0), 0) AS secrets_duplicate_ratio,
 coalesce(count(*) FILTER (n_neg > 1) / nullif(sum(n_neg), 0), 0) AS non_secrets_duplicate_ratio"""

_ENTROPY = """chars AS (SELECT text, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM profile),
shares AS (
  SELECT text, count(*) / length(text) AS p FROM chars GROUP BY text, ch),
entropies AS (SELECT text, -sum(p * log2(p)) AS entropy FROM shares GROUP BY text)"""


def _metrics(stage: str = "") -> str:
    """CTE with all metrics as one row, of ``samples`` or of another stage's samples."""
    flags = ", ".join(
        f"CAST(coalesce(sum(w) FILTER ({test}), 0) AS BIGINT) AS {key}"
        for key, test in {**_FLAGS, **_PATTERNS}.items()
    )

    def moments(weight: str, prefix: str) -> str:
        mean = f"sum(length(text) * {weight}) / nullif(sum({weight}), 0)"
        return (
            f"coalesce({mean}, 0) AS {prefix}_mean, "
            f"coalesce(sqrt((sum(length(text) * length(text) * {weight}) - "
            f"sum({weight}) * ({mean}) * ({mean})) / nullif(sum({weight}) - 1, 0)), 0) "
            f"AS {prefix}_std"
        )

    return f"""metrics{stage} AS (
  SELECT sum(n_pos) AS secrets_count, sum(n_neg) AS non_secrets_count, sum(w) AS total_count,
    sum(n_pos) / sum(w) AS class_balance,
    {moments("n_pos", "secrets_length")}, {moments("n_neg", "non_secrets_length")},
    {_DUPLICATES},
    {len(settings.RULES)} AS total_rules,
    count(DISTINCT first_rule) FILTER (n_pos > 0) AS rules_matching_secrets,
    count(DISTINCT first_rule) FILTER (n_neg > 0) AS rules_matching_non_secrets,
    coalesce(sum(n_pos) FILTER (first_rule IS NULL), 0) AS uncovered_secrets_count,
    coalesce(sum(n_neg) FILTER (first_rule IS NULL), 0) AS uncovered_non_secrets_count,
    coalesce(sum(n_pos) FILTER (first_rule IS NOT NULL), 0) / sum(n_pos) AS secrets_coverage_ratio,
    coalesce(sum(n_neg) FILTER (first_rule IS NOT NULL), 0) / sum(n_neg)
      AS non_secrets_coverage_ratio,
    {flags}
  FROM covered{stage}),
scored{stage} AS (
  SELECT *, greatest(secrets_duplicate_ratio, non_secrets_duplicate_ratio) AS dup,
    {" + ".join(_FLAGS)} AS total_issues, ({" + ".join(_FLAGS)}) / greatest(total_count, 1) AS bad
  FROM metrics{stage}),
steps{stage} AS (
  SELECT *,
    CASE WHEN total_count >= 50000 THEN 10 WHEN total_count >= 20000 THEN 8
         WHEN total_count >= 10000 THEN 6 WHEN total_count >= 5000 THEN 4
         WHEN total_count >= 1000 THEN 2 ELSE 0 END AS score_dataset_size,
    CASE WHEN class_balance BETWEEN 0.4 AND 0.6 THEN 10 WHEN class_balance BETWEEN 0.3 AND 0.7 THEN 8
         WHEN class_balance BETWEEN 0.2 AND 0.8 THEN 6 WHEN class_balance BETWEEN 0.1 AND 0.9 THEN 3
         ELSE 0 END AS score_class_balance,
    CASE WHEN dup <= 0.01 THEN 10 WHEN dup <= 0.05 THEN 7 WHEN dup <= 0.1 THEN 4
         WHEN dup <= 0.2 THEN 2 ELSE 0 END AS score_duplicates,
    CASE WHEN cross_class_duplicates = 0 THEN 10
         WHEN cross_class_duplicates <= total_count * 0.001 THEN 5 ELSE 0 END AS score_cross_class,
    CASE WHEN secrets_coverage_ratio >= 0.95 THEN 10 WHEN secrets_coverage_ratio >= 0.9 THEN 8
         WHEN secrets_coverage_ratio >= 0.8 THEN 6 WHEN secrets_coverage_ratio >= 0.7 THEN 4
         WHEN secrets_coverage_ratio >= 0.5 THEN 2 ELSE 0 END AS score_rule_coverage,
    CASE WHEN bad <= 0.01 THEN 10 WHEN bad <= 0.05 THEN 7 WHEN bad <= 0.1 THEN 4
         WHEN bad <= 0.2 THEN 2 ELSE 0 END AS score_data_quality
  FROM scored{stage}),
card{stage} AS (
  SELECT *, round_even(total, 1) AS quality_score_10,
    greatest(0, total * 10
      - CASE WHEN total_count < 1000 THEN 20 ELSE 0 END
      - CASE WHEN cross_class_duplicates > 0 THEN 25 ELSE 0 END
      - CASE WHEN secrets_coverage_ratio < 0.7 THEN 20 ELSE 0 END
      - CASE WHEN class_balance < 0.3 OR class_balance > 0.7 THEN 10 ELSE 0 END
      - CASE WHEN dup > 0.05 THEN 10 ELSE 0 END
      - CASE WHEN bad > 0.05 THEN 15 ELSE 0 END) AS overall_quality_score
  FROM (SELECT *, {" + ".join(
      f"score_{n} * CAST({w} AS DOUBLE)" for n, w in settings.SCORE_WEIGHTS.items())} AS total
        FROM steps{stage}))"""


_SAMPLES = f"{fx.SQL_SAMPLES}, {_PROFILE}"
_REPAIR = f"""judged AS (
  SELECT *, CASE WHEN n_pos > 0 THEN 1 ELSE 0 END AS label,
         ({" OR ".join(f"({test})" for test in _FLAGS.values())}) AS flagged FROM covered),
counts AS (
  SELECT sum(w) AS rows_before,
    coalesce(sum(n_neg) FILTER (n_pos > 0 AND n_neg > 0), 0) AS overlap,
    sum(CASE WHEN label = 1 THEN n_pos - 1 ELSE n_neg - 1 END) AS duplicates,
    count(*) FILTER (flagged) AS flagged,
    coalesce(sum(n_pos) FILTER (first_rule IS NULL), 0) AS uncovered_rows,
    count(*) FILTER (label = 1 AND NOT flagged) AS pos_left,
    count(*) FILTER (label = 1 AND NOT flagged AND first_rule IS NULL) AS pos_uncovered,
    count(*) FILTER (label = 0 AND NOT flagged) AS neg
  FROM judged),
decided AS (
  SELECT *, uncovered_rows > 0 AND uncovered_rows < pos_left * 0.3 AS drop_uncovered FROM counts),
sized AS (
  SELECT *, pos_left - CASE WHEN drop_uncovered THEN pos_uncovered ELSE 0 END AS pos FROM decided),
targets AS (
  SELECT *,
    CASE WHEN pos > 0 AND neg > 0 AND pos / (pos + neg) > 0.8 THEN least(pos, neg * 4)
         ELSE pos END AS keep_pos,
    CASE WHEN pos > 0 AND neg > 0 AND pos / (pos + neg) < 0.2 THEN least(neg, pos * 4)
         ELSE neg END AS keep_neg FROM sized),
ranked AS (
  SELECT text, label, row_number() OVER (PARTITION BY label ORDER BY md5(text), text) AS place
  FROM judged, targets
  WHERE NOT judged.flagged AND (label = 0 OR first_rule IS NOT NULL OR NOT drop_uncovered)),
repaired AS (
  SELECT text, CAST(label AS INTEGER) AS label FROM ranked, targets
  WHERE place <= CASE WHEN label = 1 THEN keep_pos ELSE keep_neg END)"""
_REPAIR_STEPS = {
    "rows_before": "rows_before",
    "removed_overlap": "overlap",
    "removed_duplicates": "duplicates",
    "removed_flagged": "flagged",
    "removed_uncovered": "CASE WHEN drop_uncovered THEN pos_uncovered ELSE 0 END",
    "trimmed_secrets": "pos - keep_pos",
    "trimmed_non_secrets": "neg - keep_neg",
    "secrets_after": "keep_pos",
    "non_secrets_after": "keep_neg",
}
_REPAIR_REPORT = " UNION ALL ".join(
    f"SELECT {place} AS place, '{step}' AS step, CAST({value} AS BIGINT) AS rows FROM targets"
    for place, (step, value) in enumerate(_REPAIR_STEPS.items(), start=1)
)
_COVERED_SAMPLES = f"{fx.SQL_COVERED_SAMPLES}, {_PROFILE}, {_COVERED}"


def _tidy(stage: str, name: str) -> str:
    from credsieve.operators.quality import SECTIONS

    return " UNION ALL ".join(
        f"SELECT '{name}' AS stage, '{section}' AS section, '{metric}' AS metric, "
        f"round(CAST({metric} AS DOUBLE), 4) AS value FROM {source}{stage}"
        for section, metrics in SECTIONS.items()
        for metric in metrics
        for source in ["entropy_row" if metric.startswith("entropy") else "card"]
    )


def _entropy_row(stage: str, profile: str) -> str:
    return f"""chars{stage} AS (
  SELECT text, w, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM {profile}),
shares{stage} AS (
  SELECT text, w, count(*) / length(text) AS p FROM chars{stage} GROUP BY text, w, ch),
entropies{stage} AS (
  SELECT w, -sum(p * log2(p)) AS e FROM shares{stage} GROUP BY text, w),
entropy_row{stage} AS (
  SELECT sum(e * w) / sum(w) AS entropy_mean,
         sqrt((sum(e * e * w) - sum(w) * power(sum(e * w) / sum(w), 2)) / (sum(w) - 1))
           AS entropy_std
  FROM entropies{stage})"""


_PROBABILITIES = f"""probabilities AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'N' THEN '{settings.TYPE_LONG_LINE}' ELSE 'Token' END AS type,
    l_discount * 10 AS p,
    CASE WHEN l_linenumber > 1 THEN l_tax * 12.5 END AS c,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""

def _optimum() -> str:
    """CTEs up to ``fitted`` (the optimum's coefficients) and ``known`` (text, p): the penalised logistic loss of the
    small samples, minimised by accelerated gradient steps in a recursive query. Each step is one pass over the distinct samples."""
    terms = fx.SMALL_TERMS
    tf = {t: f"(length(text) - length(replace(text, '{t}', '')))" for t in terms}
    names = [*terms, "one"]
    y = {t: f"(w_{t} + momentum * (w_{t} - v_{t}))" for t in names}
    margin = " + ".join(f"{y[t]} * x_{t}" for t in names)
    steps = ", ".join(
        f"any_value({y[t]}) - (sum(times * (1 / (1 + exp(-({margin}))) - label) * x_{t}) / any_value(n)"
        + (f" + any_value({y[t]}) / any_value(n)" if t != "one" else "") + ") / any_value(bound)"
        for t in names
    )
    raw = " ".join(f"{tf[t]} * idf_{t} AS r_{t}," for t in terms)
    norm = "sqrt(" + " + ".join(f"r_{t} * r_{t}" for t in terms) + ")"
    idf = ", ".join(f"ln((1 + count(*)) / (1 + count(*) FILTER (contains(text, '{t}')))) + 1 AS idf_{t}" for t in terms)
    xs = ", ".join(f"r_{t} / {norm} AS x_{t}" for t in terms)
    return f"""{fx.SQL_SMALL},
totals AS (SELECT count(*)::DOUBLE AS n, {idf} FROM small),
texts AS (SELECT DISTINCT text FROM small UNION SELECT DISTINCT context FROM small WHERE context IS NOT NULL),
raw AS (SELECT text, {raw} n FROM texts, totals),
vectors AS (SELECT text, n, {xs}, 1 AS x_one FROM raw),
samples AS (
  SELECT v.*, label, times, 0.5 + 1 / n AS bound,
    (sqrt(0.5 + 1 / n) - sqrt(1 / n)) / (sqrt(0.5 + 1 / n) + sqrt(1 / n)) AS momentum
  FROM (SELECT text, label, count(*) AS times FROM small GROUP BY ALL) JOIN vectors v USING (text)),
steps AS (
  SELECT 0 AS k, {", ".join(f"0::DOUBLE AS w_{t}" for t in names)}, {", ".join(f"0::DOUBLE AS v_{t}" for t in names)}
  UNION ALL
  SELECT k + 1, {steps}, {", ".join(f"any_value(w_{t})" for t in names)}
  FROM steps, samples WHERE k < 4000 GROUP BY k),
fitted AS (SELECT * FROM steps WHERE k = 4000),
known AS (
  SELECT text, 1 / (1 + exp(-({" + ".join(f"w_{t} * x_{t}" for t in names)}))) AS p FROM vectors, fitted)"""


_RATED = """rated AS (
  SELECT small.*, a.p AS p, b.p AS c,
    CASE WHEN b.p IS NULL THEN a.p ELSE (a.p * 1.0::DOUBLE + b.p * 0.8::DOUBLE) / 1.8::DOUBLE END AS final
  FROM small JOIN known a USING (text) LEFT JOIN known b ON b.text = small.context)"""

_TRAINING = "substr(md5(concat(label, ':', text)), 1, 4) < 'cccd'"

_REQUEST_CHECK = """checked AS (
  SELECT project AS ProjectName, ref_type AS RefType, ref AS Ref, m.commit,
    CASE WHEN NOT contains(url, '/_git/') THEN 'no _git in the URL'
         WHEN m.commit IS NULL THEN concat(ref_type, ' ''', ref, ''' not found') END AS problem
  FROM requests LEFT JOIN (
    SELECT DISTINCT source AS name, md5(source) AS commit FROM documents) m ON name = project)"""

_EXAMPLES = """SELECT category, text, CAST(place AS INTEGER) AS place FROM (
  SELECT category, text, row_number() OVER (PARTITION BY category ORDER BY text) AS place
  FROM ({rows})) WHERE place <= {limit}"""


def _examples(kinds: dict[str, str], source: str, limit: int, name: str = "category") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{kind}' AS category, text FROM {source} WHERE {test}"
        for kind, test in kinds.items()
    )
    return _EXAMPLES.format(rows=rows, limit=limit).replace(
        "SELECT category, text, CAST", f"SELECT category AS {name}, text, CAST"
    )


_TREE = r"""rows_ AS (
  SELECT source AS project, CASE doc_id % 4 WHEN 0 THEN concat('.env', doc_id)
    WHEN 1 THEN concat('.git/_netrc', doc_id) ELSE concat('src/d', doc_id, '.txt') END AS path,
    CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(text, '') END AS content FROM documents),
counted AS (
  SELECT project, path, strlen(content)::BIGINT AS length,
    regexp_replace(content, '\r\n?', chr(10), 'g') AS plain FROM rows_)"""
_TREE_LINES = f"""WITH {_TREE}
SELECT project, path, length, (len(string_split(plain, chr(10)))
  - CASE WHEN plain = '' OR plain LIKE concat('%', chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM counted"""


def _starred(value: str) -> str:
    return (
        f"CASE WHEN length({value}) < 4 THEN repeat('*', length({value})) "
        f"ELSE concat(substr({value}, 1, 4), repeat('*', length({value}) - 4)) END"
    )


def _view(pattern: str) -> str:
    """The context with all matches of a pattern starred."""
    marked = f"regexp_replace(context, '{pattern}', concat(chr(1), '\\0', chr(2)), 'g')"
    inside = "string_split(p, chr(2))"
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p, i: CASE WHEN i = 1 THEN p "
        f"ELSE concat({_starred(inside + '[1]')}, {inside}[2]) END), '')"
    )


def _masked_all() -> str:
    rules = catalog.MASK_RULES
    hits = " UNION ALL ".join(
        f"SELECT project, path, {_quoted(r.message)} AS type, regexp_extract(context, '{r.pattern}') AS secret, context "
        f"FROM contexts WHERE regexp_matches(context, '{r.pattern}')"
        for r in rules
    )
    views = ", ".join(_view(r.pattern) for r in rules)
    return f"""WITH h AS (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
contexts AS (
  SELECT source AS project, concat('d', doc_id) AS path, concat('tok_', substr(h, 1, 8), ' and tok_', substr(h, 9, 8),
    '_', substr(h, 17, 4), ', end=', substr(h, 1, 6)) AS context FROM h),
hits AS ({hits}), seen AS (SELECT *, [{views}] AS views FROM hits)
SELECT project, path, type, {_starred("secret")} AS secret,
  array_to_string(list_transform(range(1, length(context) + 1), lambda i:
    CASE WHEN len(list_filter(views, lambda v: substr(v, i, 1) = '*')) > 0 THEN '*'
         ELSE substr(context, i, 1) END), '') AS context FROM seen"""


ORACLES = {
    "line_split": f"""WITH scanned AS (
  SELECT source AS project, CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents),
{fx.SQL_LINES}
SELECT project, path, line, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS hash FROM lines""",
    "rule_scan": f"WITH {fx.SQL_FILES}, {_findings()} SELECT * FROM matches",
    "rule_hits_all": f"""WITH {fx.SQL_FILES}, {_findings(longest=1_000_000_000)},
rules(rule_ord, rule_id, message, rule_severity) AS (VALUES {", ".join(
    f"({n}, {_quoted(r.id)}, {_quoted(r.message)}, {_quoted(r.severity)})"
    for n, r in enumerate(settings.RULES, start=1))})
SELECT project, path, line, rule_id, message, rule_severity FROM hits JOIN rules USING (rule_ord)""",
    "false_positive_filter": f"""WITH {fx.SQL_FILES}, {_findings()}, {_TRUE_MATCHES}
SELECT project, path, line, rule_ord, type, secret, context FROM true_matches""",
    "long_line_rows": f"""WITH {fx.SQL_FILES}, {_findings(longest=catalog.LINE_CAP)}
SELECT project, path, line, type, secret, context, severity FROM matches
WHERE type = '{settings.TYPE_LONG_LINE}'""",
    "cap_per_file": f"""WITH {fx.SQL_FILES}, {_findings(longest=catalog.LINE_CAP)},
{_capped(catalog.SECRETS_CAP)} SELECT * FROM findings""",
    "scan_findings": f"WITH {_FINDINGS} SELECT * FROM findings",
    "file_exclusion": f"""WITH {fx.SQL_FILES}
SELECT project, path, file_name, ext FROM ({_KEPT_FILES})""",
    "exclusion_summary": f"WITH {fx.SQL_FILES}, {_EXCLUSIONS} SELECT * FROM exclusions",
    "findings_by_project": f"""WITH {_FINDINGS}
SELECT project, type, severity, count(*) AS findings FROM findings GROUP BY ALL""",
    "mask_secrets": f"""WITH {_FINDINGS}
SELECT project, path, line, type,
  CASE WHEN type IN {_listed(settings.SPECIAL_TYPES)} THEN secret
       WHEN length(secret) < 4 THEN repeat('*', length(secret))
       ELSE concat(substr(secret, 1, 4), repeat('*', length(secret) - 4)) END AS secret,
  CASE WHEN type IN {_listed(settings.SPECIAL_TYPES)} THEN string_split(context, chr(10))[1]
       ELSE array_to_string(list_transform(range(1, length(context) + 1), lambda i:
         CASE WHEN len(list_filter(views, lambda v: substr(v, i, 1) = '*')) > 0 THEN '*'
              ELSE substr(context, i, 1) END), '') END AS context
FROM (SELECT f.*, (
  SELECT list(DISTINCT replace(f.context, s, CASE WHEN length(s) < 4 THEN repeat('*', length(s))
                               ELSE concat(substr(s, 1, 4), repeat('*', length(s) - 4)) END))
  FROM (SELECT trim(g.secret, chr(10)) AS s FROM findings g
        WHERE g.project = f.project AND g.path = f.path AND g.line = f.line
          AND g.type NOT IN {_listed(settings.SPECIAL_TYPES)}) WHERE s <> '') AS views
  FROM findings f)""",
    "path_parts": """WITH below AS (
  SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS path
  FROM pages),
named AS (SELECT *, regexp_extract(path, '[^/]*$') AS file_name FROM below)
SELECT *, lower(regexp_extract(file_name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM named""",
    "language_summary": f"""WITH {fx.SQL_FILES}, {_languages(settings.LANGUAGES)}
SELECT * FROM language_rows""",
    "language_extensions": f"""WITH {fx.SQL_FILES}, {_languages(settings.LANGUAGES)}
SELECT project, coalesce(language, 'Other') AS language, f.ext, count(*) AS files
FROM files f LEFT JOIN languages l ON f.ext = l.ext GROUP BY ALL""",
    "framework_files": f"""WITH {fx.SQL_FILES}, {_framework_rows()}
SELECT project, path, framework, kind, array_to_string(dependencies, ',') AS dependencies
FROM evidence_rows""",
    "framework_evidence": f"""WITH {fx.SQL_FILES}, {_EVIDENCE}
SELECT project, framework, kind, file_count, files,
       array_to_string(dependencies, ',') AS dependencies
FROM evidence JOIN (SELECT framework, kind, string_agg(path, ',' ORDER BY path) AS files
                    FROM first_files GROUP BY ALL) USING (framework, kind)""",
    "framework_report": f"""WITH {fx.SQL_FILES}, {_EVIDENCE},
labelled AS (
  SELECT *, CASE WHEN file_count > {catalog.LISTED_CAP} THEN '{catalog.LISTED_CAP}+'
                 ELSE CAST(file_count AS VARCHAR) END AS count_label FROM evidence)
SELECT project, framework, kind, count_label,
  CASE kind
    WHEN 'manifest' THEN concat('Dependency of ', framework, ' found in ', count_label,
      ' manifests (', array_to_string(dependencies, ', '), ')')
    WHEN 'config_file' THEN concat('Found ', count_label, ' configuration files of ', framework)
    ELSE concat(framework, ' mentioned in ', count_label, ' files') END AS description, files
FROM labelled JOIN (SELECT framework, kind, string_agg(path, ',' ORDER BY path) AS files
                    FROM first_files WHERE place <= {catalog.LISTED_CAP} GROUP BY ALL)
  USING (framework, kind)""",
    "code_patterns": f"""WITH {fx.SQL_FILES}, found AS (
  SELECT project, path, [x FOR x IN [{", ".join(
    f"CASE WHEN regexp_matches(content, {_quoted('(?i)' + p)}) THEN {_quoted(p)} END"
    for p in settings.FRAMEWORKS["Vue"].code_patterns)}] IF x IS NOT NULL] AS hits FROM files)
SELECT project, path, 'Vue' AS framework, array_to_string(hits, ',') AS patterns
FROM found WHERE len(hits) > 0""",
    "merged_detections": f"""WITH {fx.SQL_FILES}, {_framework_rows()}
SELECT project, framework, path FROM evidence_rows
UNION
SELECT project, 'Vue', path FROM files WHERE {" OR ".join(
    f"regexp_matches(content, {_quoted('(?i)' + p)})"
    for p in settings.FRAMEWORKS["Vue"].code_patterns)}""",
    "quality_basic": f"""WITH {fx.SQL_SAMPLES}
SELECT count(*) FILTER (label = 1) AS secrets_count,
  round(coalesce(avg(length(text)) FILTER (label = 1), 0), 6) AS secrets_avg_length,
  round(coalesce(stddev_samp(length(text)) FILTER (label = 1), 0), 6) AS secrets_length_std,
  count(*) FILTER (label = 0) AS non_secrets_count,
  round(coalesce(avg(length(text)) FILTER (label = 0), 0), 6) AS non_secrets_avg_length,
  round(coalesce(stddev_samp(length(text)) FILTER (label = 0), 0), 6) AS non_secrets_length_std,
  count(*) AS total_count,
  round(count(*) FILTER (label = 1) / count(*), 6) AS class_balance
FROM samples""",
    "quality_duplicates": f"""WITH {_SAMPLES}, d AS (SELECT {_DUPLICATES} FROM profile)
SELECT secrets_exact_duplicates, non_secrets_exact_duplicates, cross_class_duplicates,
  round(secrets_duplicate_ratio, 6) AS secrets_duplicate_ratio,
  round(non_secrets_duplicate_ratio, 6) AS non_secrets_duplicate_ratio FROM d""",
    "quality_overlap": f"""WITH {_SAMPLES}
SELECT text, n_pos, n_neg FROM profile WHERE n_pos > 0 AND n_neg > 0""",
    "duplicate_examples": f"WITH {_SAMPLES} " + _examples(
        {"secrets": "n_pos > 1", "non_secrets": "n_neg > 1",
         "cross_class": "n_pos > 0 AND n_neg > 0"}, "profile", 5),
    "quality_coverage": f"""WITH {_SAMPLES}, {_COVERED}
SELECT coalesce(first_rule, 'none') AS first_rule, CAST(sum(n_pos) AS BIGINT) AS secrets,
       CAST(sum(n_neg) AS BIGINT) AS non_secrets FROM covered GROUP BY 1""",
    "uncovered_examples": f"WITH {_SAMPLES}, {_COVERED} " + _examples(
        {"secrets": "n_pos > 0 AND first_rule IS NULL",
         "non_secrets": "n_neg > 0 AND first_rule IS NULL"}, "covered", 10),
    "quality_issues": f"WITH {_SAMPLES} " + _stacked(_FLAGS, "issue"),
    "issue_examples": f"WITH {_SAMPLES} " + _examples(_FLAGS, "profile", 5, "issue"),
    "quality_patterns": f"WITH {_SAMPLES} " + _stacked(_PATTERNS, "pattern"),
    "quality_prefixes": f"""WITH {fx.SQL_SAMPLES},
prefixes(prefix) AS (VALUES {", ".join(f"({_quoted(p)})" for p in settings.KEY_PREFIXES)})
SELECT prefix, count(*) AS rows FROM samples JOIN prefixes ON starts_with(lower(text), prefix)
GROUP BY prefix""",
    "top_lengths": f"""WITH {fx.SQL_SAMPLES}
SELECT CAST(length(text) AS INTEGER) AS length, count(*) AS rows FROM samples GROUP BY 1
ORDER BY rows DESC, 1 LIMIT 10""",
    "entropy_stats": f"""WITH {_SAMPLES}, {_ENTROPY}
SELECT round(avg(entropy), 6) AS mean, round(median(entropy), 6) AS median,
       round(stddev_samp(entropy), 6) AS std FROM samples JOIN entropies USING (text)""",
    "raw_line_issues": f"""WITH lines AS (
  SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT count(*) AS lines, count(*) FILTER (value = '') AS empty_strings,
  count(*) FILTER (value <> '' AND {fx.sql_strip("value")} = '') AS whitespace_only,
  CAST(0 AS BIGINT) AS encoding_issues FROM lines""",
    "quality_scorecard": f"""WITH {_SAMPLES}, {_COVERED}, {_metrics()}
SELECT {", ".join(f"CAST(score_{n} AS INTEGER) AS score_{n}" for n in settings.SCORE_WEIGHTS)},
  round(quality_score_10, 6) AS quality_score_10,
  round(CAST(overall_quality_score AS DOUBLE), 6) AS overall_quality_score,
  CASE WHEN quality_score_10 >= 8.5 THEN 'excellent' WHEN quality_score_10 >= 7 THEN 'good'
       WHEN quality_score_10 >= 5.5 THEN 'satisfactory' WHEN quality_score_10 >= 3 THEN 'poor'
       ELSE 'critical' END AS quality_label FROM card""",
    "quality_recommendations": f"""WITH {_SAMPLES}, {_COVERED}, {_metrics()},
advice(level, code, fixable, holds) AS (
  SELECT 'critical', 'dataset_size', false, total_count < 1000 FROM card UNION ALL
  SELECT 'critical', 'cross_class', true, cross_class_duplicates > 0 FROM card UNION ALL
  SELECT 'critical', 'rule_coverage', false, secrets_coverage_ratio < 0.7 FROM card UNION ALL
  SELECT 'warning', 'class_balance', false, class_balance < 0.3 OR class_balance > 0.7 FROM card
  UNION ALL
  SELECT 'warning', 'duplicates', true, dup > 0.05 FROM card UNION ALL
  SELECT 'warning', 'data_quality', true, bad > 0.05 FROM card UNION ALL
  SELECT 'suggestion', 'more_data', false, total_count < 10000 FROM card UNION ALL
  SELECT 'suggestion', 'add_rules', false, uncovered_secrets_count > 0 FROM card)
SELECT level, code, fixable FROM advice WHERE holds""",
    "repair_dataset": f"WITH {_SAMPLES}, {_COVERED}, {_REPAIR} SELECT * FROM repaired",
    "repair_dataset_covered": f"WITH {_COVERED_SAMPLES}, {_REPAIR} SELECT * FROM repaired",
    "repair_report": f"WITH {_SAMPLES}, {_COVERED}, {_REPAIR} {_REPAIR_REPORT}",
    "repair_report_covered": f"WITH {_COVERED_SAMPLES}, {_REPAIR} {_REPAIR_REPORT}",
    "quality_report_before_after": f"""WITH {_COVERED_SAMPLES}, {_metrics()}, {_REPAIR},
covered_after AS (
  SELECT text, label AS n_pos, 1 - label AS n_neg, 1 AS w, first_rule
  FROM repaired JOIN (SELECT text, first_rule FROM covered) USING (text)),
{_metrics("_after")}, {_entropy_row("", "covered")}, {_entropy_row("_after", "covered_after")}
{_tidy("", "before")} UNION ALL {_tidy("_after", "after")}""",
    "ngram_frequencies": f"""WITH words AS (
  SELECT conv_id, turn, role, text,
    concat(' ', unnest(string_split(trim(regexp_replace(lower(text), '[{fx.SPACES}]+', ' ', 'g')),
                                    ' ')), ' ') AS word FROM conversations),
grams AS (
  SELECT conv_id, turn, role, text, substr(word, k, n) AS ngram
  FROM (SELECT *, unnest(generate_series(1, length(word) - n + 1)) AS k
        FROM (SELECT *, unnest([3, 4, 5]) AS n FROM words WHERE word <> '  ')))
SELECT ngram, count(*) AS occurrences,
       count(DISTINCT concat(conv_id, '/', turn, '/', role)) AS texts
FROM grams GROUP BY ngram""",
    "idf_weights": f"""WITH {_grams("conversations", "conv_id, turn, role")}
SELECT ngram, count(*) AS texts,
       round(ln((1 + (SELECT count(*) FROM conversations)) / (1 + count(*))) + 1, 6) AS idf
FROM (SELECT DISTINCT conv_id, turn, role, ngram FROM grams) GROUP BY ngram""",
    "tfidf_features": f"""WITH {_grams("benchmark", "item_id")},
terms AS (SELECT item_id, ngram, count(*) AS tf FROM grams GROUP BY ALL),
idfs AS (SELECT ngram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf
         FROM terms GROUP BY ngram)
SELECT item_id, ngram, round(tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)), 6)
       AS weight
FROM terms JOIN idfs USING (ngram)""",
    "blend_severity": f"""WITH {_PROBABILITIES},
blended AS (
  SELECT *, CASE WHEN c IS NULL THEN p ELSE (p * 1.0::DOUBLE + c * 0.8::DOUBLE) / 1.8::DOUBLE END
         AS final FROM probabilities)
SELECT l_orderkey, l_linenumber, type,
  CASE WHEN type = 'Token' AND final > 0.7::DOUBLE THEN 'High' ELSE 'Potential' END AS severity,
  CASE WHEN type = 'Token' THEN round_even(final, 2) ELSE 0.5 END AS confidence,
  round_even(p, 3) AS secret_confidence, p > 0.5::DOUBLE AS secret_prediction,
  round_even(c, 3) AS context_confidence, c > 0.5::DOUBLE AS context_prediction,
  c IS NOT NULL AS confidence_averaged FROM blended""",
    "confusion_metrics": f"""WITH {_PROBABILITIES},
g AS (SELECT label = 1 AS a, p > 0.5::DOUBLE AS b FROM probabilities),
n AS (
  SELECT count(*) AS total, count(*) FILTER (a) AS secrets, count(*) FILTER (NOT a) AS non_secrets,
    count(*) FILTER (a AND b) AS true_positives, count(*) FILTER (NOT a AND b) AS false_positives,
    count(*) FILTER (a AND NOT b) AS false_negatives,
    count(*) FILTER (NOT a AND NOT b) AS true_negatives FROM g)
SELECT *, true_positives + true_negatives AS correct,
  round((true_positives + true_negatives) / total, 6) AS accuracy,
  round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round(coalesce(2 * true_positives /
    nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1 FROM n""",
    "small_evaluate": f"""WITH RECURSIVE {_optimum()},
g AS (SELECT label = 1 AS a, p > 0.5::DOUBLE AS b FROM small JOIN known USING (text)),
n AS (
  SELECT count(*) AS total, count(*) FILTER (a) AS secrets, count(*) FILTER (NOT a) AS non_secrets,
    count(*) FILTER (a AND b) AS true_positives, count(*) FILTER (NOT a AND b) AS false_positives,
    count(*) FILTER (a AND NOT b) AS false_negatives,
    count(*) FILTER (NOT a AND NOT b) AS true_negatives FROM g)
SELECT *, true_positives + true_negatives AS correct,
  round((true_positives + true_negatives) / total, 6) AS accuracy,
  round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round(coalesce(2 * true_positives /
    nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1 FROM n""",
    "small_model": f"WITH RECURSIVE {_optimum()} SELECT text, round(p, 4) AS p_secret FROM known",
    "sharded_model": f"WITH RECURSIVE {_optimum()} SELECT text, round(p, 4) AS p_secret FROM known",
    "small_findings": f"""WITH RECURSIVE {_optimum()}, {_RATED}
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '{settings.TYPE_TOO_MANY}' ELSE 'Token' END AS type, text AS secret, context,
  CASE WHEN doc_id % 9 <> 0 AND final > 0.7::DOUBLE THEN 'High' ELSE 'Potential' END AS severity,
  CASE WHEN doc_id % 9 <> 0 THEN round_even(final, 2) ELSE 0.5 END AS confidence,
  round_even(p, 3) AS secret_confidence, p > 0.5::DOUBLE AS secret_prediction,
  round_even(c, 3) AS context_confidence, c > 0.5::DOUBLE AS context_prediction,
  c IS NOT NULL AS confidence_averaged FROM rated""",
    "small_pairs": f"""WITH RECURSIVE {_optimum()}, {_RATED}
SELECT doc_id, text, context, final > 0.5::DOUBLE AS is_secret, round_even(final, 3) AS confidence,
  CASE WHEN final > 0.7::DOUBLE THEN 'High' ELSE 'Potential' END AS severity,
  round_even(p, 3) AS text_confidence, p > 0.5::DOUBLE AS text_prediction,
  round_even(c, 3) AS context_confidence, c > 0.5::DOUBLE AS context_prediction,
  c IS NOT NULL AS averaged_confidence FROM rated""",
    "csv_evaluation": f"""WITH {_PROBABILITIES},
g AS (SELECT label = 1 AS a, p > 0.5::DOUBLE AS b FROM probabilities),
n AS (
  SELECT count(*) AS total, count(*) FILTER (a) AS secrets, count(*) FILTER (NOT a) AS non_secrets,
    count(*) FILTER (a AND b) AS true_positives, count(*) FILTER (NOT a AND b) AS false_positives,
    count(*) FILTER (a AND NOT b) AS false_negatives,
    count(*) FILTER (NOT a AND NOT b) AS true_negatives FROM g)
SELECT *, true_positives + true_negatives AS correct,
  round((true_positives + true_negatives) / total, 6) AS accuracy,
  round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round(coalesce(2 * true_positives /
    nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1,
  false_positives + false_negatives AS written FROM n""",
    "mask_all_matches": _masked_all(),
    "tree_files": _TREE_LINES,
    "archive_ranges": f"""WITH {_TREE}, members AS (
  SELECT concat(project, '-', length(path) % 8) AS project, path, strlen(content)::INTEGER AS bytes FROM rows_)
SELECT project, path, bytes, NULL::VARCHAR AS problem FROM members
UNION ALL SELECT DISTINCT project, '../outside', NULL::INTEGER, 'unsafe path' FROM members""",
    "stream_tree_files": _TREE_LINES,
    "report_results": f"""WITH {_FINDINGS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY path, line, rule_ord) - 1 AS spot FROM findings)
SELECT project, (spot // {catalog.RESULTS_CAP})::INTEGER AS part, (spot % {catalog.RESULTS_CAP})::INTEGER AS place, path, line, type,
  CASE WHEN type IN {_listed(settings.SPECIAL_TYPES)} THEN secret ELSE {_starred("secret")} END AS secret FROM placed""",
    "wrong_predictions": f"""WITH {_PROBABILITIES}
SELECT concat(l_orderkey, '-', l_linenumber) AS secret,
  CASE WHEN label = 1 THEN 'Secret' ELSE 'NotSecret' END AS expected,
  CASE WHEN p > 0.5::DOUBLE THEN 'Secret' ELSE 'NotSecret' END AS prediction,
  round_even(p, 3) AS confidence
FROM probabilities WHERE (label = 1) <> (p > 0.5::DOUBLE)""",
    "evaluation_samples": f"""SELECT md5({fx.sql_strip("text")}) AS text_hash,
  CASE WHEN doc_id % 5 < 2 THEN 1 ELSE 0 END AS label,
  ['Secret', 'secret', 'NotSecret'][doc_id % 5 + 1] AS expected
FROM documents WHERE doc_id % 5 < 3 AND {fx.sql_strip("text")} <> ''""",
    "model_info": f"""WITH {fx.SQL_SAMPLES},
words AS (
  SELECT concat(' ', unnest(string_split(trim(
    regexp_replace(lower(text), '[{fx.SPACES}]+', ' ', 'g')), ' ')), ' ') AS word
  FROM samples WHERE {_TRAINING}),
sized AS (SELECT word, unnest([3, 4, 5]) AS n FROM (SELECT DISTINCT word FROM words) WHERE word <> '  '),
grams AS (
  SELECT DISTINCT substr(word, k, n) AS gram
  FROM (SELECT word, n, unnest(generate_series(1, length(word) - n + 1)) AS k FROM sized))
SELECT 'secrets_dataset_size' AS name, CAST(count(*) FILTER (label = 1) AS VARCHAR) AS value
FROM samples UNION ALL
SELECT 'non_secrets_dataset_size', CAST(count(*) FILTER (label = 0) AS VARCHAR) FROM samples
UNION ALL SELECT 'total_dataset_size', CAST(count(*) AS VARCHAR) FROM samples
UNION ALL SELECT 'vocabulary_size', CAST(count(*) AS VARCHAR) FROM grams
UNION ALL VALUES ('model_type', 'LogisticRegressionModel'), ('max_iterations', '1000'),
  ('vectorizer_type', 'CountVectorizerModel'), ('analyzer', 'char_wb'), ('ngram_range', '3-5')""",
    "training_split": f"""WITH {fx.SQL_SAMPLES}
SELECT CASE WHEN {_TRAINING} THEN 'training' ELSE 'test' END AS part, label, count(*) AS rows
FROM samples GROUP BY ALL""",
    "request_check": f"""WITH {fx.SQL_REQUESTS}, {_REQUEST_CHECK}
SELECT ProjectName, RefType, Ref,
  CASE WHEN problem IS NULL THEN commit ELSE 'not_found' END AS commit, problem FROM checked""",
    "request_validation": f"""WITH {fx.SQL_REQUESTS}, {_REQUEST_CHECK},
n AS (
  SELECT count(*) FILTER (problem IS NULL) AS resolved,
    count(*) FILTER (problem IS NOT NULL) AS failed,
    arg_min(problem, ProjectName) FILTER (problem IS NOT NULL) AS first_problem FROM checked)
SELECT CASE WHEN failed = 0 THEN 'accepted' ELSE 'validation_failed' END AS status,
  CASE WHEN failed = 0 THEN 'All requests resolved'
       ELSE concat('Not all requests resolve: ', first_problem) END AS message, resolved, failed
FROM n""",
    "repo_url_parts": """WITH urls AS (
  SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN k < 3 THEN host END AS server,
  CASE k WHEN 0 THEN 'coll' WHEN 1 THEN 'a/b' WHEN 2 THEN '' END AS collection,
  CASE WHEN k < 3 THEN 'proj' END AS project,
  CASE k WHEN 0 THEN 'repo' WHEN 1 THEN 'repo' WHEN 2 THEN 'r' END AS repository,
  CASE k WHEN 3 THEN 'no project before _git' WHEN 4 THEN 'no repository name after _git'
         WHEN 5 THEN 'no _git in the URL' END AS problem FROM urls""",
    "scan_report": f"""WITH {_FINDINGS}, {_EXCLUSIONS}, {fx.SQL_REQUESTS.replace("names AS", "req_names AS")
      .replace("FROM names", "FROM req_names")},
{_languages(settings.LANGUAGES)}, {_framework_rows()}
SELECT CASE WHEN e.all_files IS NULL THEN 'Error' ELSE 'completed' END AS status,
  CASE WHEN e.all_files IS NULL THEN 'Process Error: the project has no readable files'
       ELSE 'Scanned Successfully' END AS message,
  r.project, r.url AS repo_url, r.ref AS commit,
  coalesce(e.files_excluded, 0) AS files_excluded, coalesce(e.all_files, 0) AS all_files,
  coalesce(e.skipped_files, '') AS skipped_files,
  CAST((SELECT count(*) FROM findings f WHERE f.project = r.project) AS INTEGER) AS n_results,
  CAST((SELECT count(*) FROM language_rows l WHERE l.project = r.project) AS INTEGER)
    AS n_languages,
  CAST((SELECT count(DISTINCT (framework, kind)) FROM evidence_rows v WHERE v.project = r.project)
    AS INTEGER) AS n_frameworks
FROM requests r LEFT JOIN exclusions e ON e.project = r.project""",
    "archive_members": f"""WITH {fx.SQL_FILES}
SELECT project, path, CAST(strlen(content) AS INTEGER) AS bytes, CAST(NULL AS VARCHAR) AS problem
FROM files UNION ALL
SELECT project, unnest([concat('../evil/', path), concat('/abs/', path)]), NULL, 'unsafe path'
FROM files""",
    "archive_inventory": f"""WITH {fx.SQL_FILES}, {_EXCLUSIONS}, {_languages(settings.LANGUAGES)},
{_framework_rows()}
SELECT project, all_files, files_excluded, skipped_files,
  (SELECT count(*) FROM language_rows l WHERE l.project = e.project) AS n_languages,
  (SELECT count(DISTINCT (framework, kind)) FROM evidence_rows v WHERE v.project = e.project)
    AS n_frameworks
FROM exclusions e""",
    "archive_report": f"""WITH {_FINDINGS}, {_EXCLUSIONS}, {fx.SQL_REQUESTS.replace("names AS", "req_names AS")
      .replace("FROM names", "FROM req_names")}
SELECT CASE WHEN e.all_files IS NULL OR broken THEN 'Error' ELSE 'completed' END AS status,
  CASE WHEN broken AND e.all_files IS NOT NULL
         THEN 'Process Error: unreadable archive: File is not a zip file'
       WHEN e.all_files IS NULL THEN 'Process Error: the project has no readable files'
       ELSE 'Scanned Successfully' END AS message,
  r.project, CASE WHEN broken THEN 0 ELSE coalesce(e.all_files, 0) END AS all_files,
  CAST(CASE WHEN broken THEN 0
            ELSE (SELECT count(*) FROM findings f WHERE f.project = r.project) END AS INTEGER)
    AS n_results
FROM (SELECT *, project = '{catalog.BROKEN_PROJECT}' AS broken FROM requests) r
LEFT JOIN exclusions e ON e.project = r.project""",
    "archive_scan": f"WITH {_FINDINGS} SELECT * FROM findings",
    "stream_report": f"""WITH {_DOC_FILES}, {_findings("SELECT * FROM docs_as_files")},
{_capped(settings.MAX_SECRETS_PER_FILE)}, {fx.SQL_REQUESTS.replace("names AS", "req_names AS")
      .replace("FROM names", "FROM req_names")}
SELECT 'completed' AS status, r.project, count(*) AS all_files, 0::BIGINT AS files_excluded,
  CAST((SELECT count(*) FROM findings f WHERE f.project = r.project) AS INTEGER) AS n_results
FROM requests r JOIN docs_as_files d ON d.project = r.project GROUP BY r.project""",
    "stream_scan": f"""WITH {_DOC_FILES}, {_findings("SELECT * FROM docs_as_files")},
{_capped(settings.MAX_SECRETS_PER_FILE)} SELECT * FROM findings""",
}

ORACLES |= {
    "single_scan": f"""SELECT status, message, project, all_files, files_excluded, n_results
FROM ({ORACLES["scan_report"]}) WHERE project = '{catalog.SINGLE_PROJECT}'""",
    "opened_envelopes": f"""SELECT project, status, message, repo_url, commit, files_excluded, all_files,
  n_results, true AS whole FROM ({ORACLES["scan_report"]})""",
    "quality_export": f"""SELECT section, metric, value
FROM ({ORACLES["quality_report_before_after"]}) WHERE stage = 'before'""",
    "repaired_files": ORACLES["repair_dataset"],
    "sample_files": f"""WITH {fx.SQL_SAMPLES},
pieces AS (
  SELECT 'quality' AS mode, label, {fx.sql_strip("text")} AS text FROM samples
  WHERE label IN (0, 1) AND {fx.sql_strip("text")} <> ''
  UNION ALL
  SELECT 'training', label, unnest(string_split_regex(text, '[\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'))
  FROM samples WHERE label IN (0, 1))
SELECT mode, label, text, count(*) AS n_rows FROM pieces GROUP BY ALL""",
}
