"""Inputs derived from the given tables, for Spark and for the SQL check.

Each expression reads the same in both dialects, apart from the name of the string type, so both
sides build the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions import text as tx
from credsieve.sources.files import spread, with_names

# One line per document that hits one rule, several or none, by doc_id.
_LINE = """CASE doc_id % 16
 WHEN 0 THEN concat('xoxb-123456789012-123456789012-123456789012-', h)
 WHEN 1 THEN '-----BEGIN RSA PRIVATE KEY-----'
 WHEN 2 THEN concat('url = "postgres://admin:', substr(h,1,12), '@db.internal/main"')
 WHEN 3 THEN concat('password = "Aa1!', substr(h,1,10), '"')
 WHEN 4 THEN concat('access_token: ', h)
 WHEN 5 THEN concat('api_key=', h)
 WHEN 6 THEN concat('keystore.file=/etc/', substr(h,1,8), '.jks')
 WHEN 7 THEN concat('Authorization: Bearer ', substr(h,1,8), '-', substr(h,9,4), '-',
                    substr(h,13,4), '-', substr(h,17,4), '-', substr(h,21,12))
 WHEN 8 THEN concat('bot 123456789:', h, 'abc')
 WHEN 9 THEN concat('eyJhbGci', substr(h,1,6), '.eyJz', substr(h,7,6), '.', substr(h,13,16))
 WHEN 10 THEN concat('"private_key_id": "', h, '"')
 WHEN 11 THEN concat('password = "', substr(h,1,10), '" # sha256 digest')
 WHEN 12 THEN concat('api_key = integrity-', h)
 WHEN 13 THEN concat('secret=', substr(h,1,3))
 WHEN 14 THEN concat('nothing to see ', h)
 ELSE concat('token=', h, ' api_key=', h, ' pwd=', substr(h,1,12)) END"""

_FILE_NAME = """CASE CAST(floor(doc_id / 20) AS BIGINT) % 20
 WHEN 0 THEN 'package.json' WHEN 1 THEN 'angular.json' WHEN 2 THEN '.env'
 WHEN 3 THEN 'Dockerfile' WHEN 4 THEN 'requirements.txt'
 WHEN 5 THEN concat('lib', doc_id, '.tar.gz') WHEN 6 THEN concat('types', doc_id, '.d.ts')
 WHEN 7 THEN concat('IMG', doc_id, '.PNG') WHEN 8 THEN 'yarn.lock'
 WHEN 9 THEN concat('app', doc_id, '.py') WHEN 10 THEN concat('main', doc_id, '.ts')
 WHEN 11 THEN concat('view', doc_id, '.vue') WHEN 12 THEN concat('page', doc_id, '.html')
 WHEN 13 THEN concat('conf', doc_id, '.yml') WHEN 14 THEN concat('core', doc_id, '.c')
 WHEN 15 THEN concat('notes', doc_id, '.xyz') WHEN 16 THEN 'Pipfile.lock'
 WHEN 17 THEN concat('old', doc_id, '.java~') WHEN 18 THEN concat('data', doc_id, '.zip')
 ELSE 'README' END"""

# Evidence a file of some kinds holds besides the text of its document.
_SNIPPET = """CASE CAST(floor(doc_id / 20) AS BIGINT) % 20
 WHEN 0 THEN '{"dependencies":{"@angular/core":"1","vue":"3"}}'
 WHEN 4 THEN 'flask'
 WHEN 10 THEN 'import { X } from ''@nestjs/common'''
 WHEN 11 THEN '<template></template>'
 WHEN 12 THEN 'IMPORT x FROM "@Angular/core"'
 ELSE '' END"""


def _sql_quotes(expression: str) -> str:
    """Doubled quotes inside literals as Spark writes them."""
    return expression.replace("''@nestjs/common''", "\\'@nestjs/common\\'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``h``, the hash the templates use, and ``template``, the line of F-1."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.withColumn("h", F.expr("md5(CAST(doc_id AS STRING))")).withColumn(
        "template", F.expr(_LINE)
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source file: its whole text, a snippet and a templated line."""
    docs = documents(spark, sf_dir)
    name, snippet = F.expr(_FILE_NAME), F.expr(_sql_quotes(_SNIPPET))
    return with_names(
        docs.select(
            F.col("source").alias("project"),
            F.concat(F.lit("d"), "doc_id", F.lit("/"), name).alias("path"),
            F.concat("text", F.lit("\n"), snippet, F.lit("\n"), "template").alias("content"),
        )
    )


def class_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed lines of the labelled documents; the label is the quality mark."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    lines = docs.join(labels, "doc_id").select(F.explode(F.split("text", "\n")).alias("line"), "label")
    return lines.select(tx.strip(F.col("line")).alias("text"), "label").filter(F.col("text") != "")


def templated_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(
        F.col("doc_id") % 16 == 14, F.concat(F.lit("x"), F.lit("\x01"), "h")
    ).otherwise(F.col("template"))
    return documents(spark, sf_dir).select(text.alias("text"), F.lit(1).alias("label"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of both classes plus one templated positive per document."""
    return class_lines(spark, sf_dir).unionByName(templated_positives(spark, sf_dir))


def covered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated positives, most of them covered by a rule, and the negative lines."""
    negatives = class_lines(spark, sf_dir).filter(F.col("label") == 0)
    return templated_positives(spark, sf_dir).unionByName(negatives)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per source and two for projects without files; one URL lacks ``_git``."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    missing = sources.select(F.explode(F.array(F.lit("src98"), F.lit("src99"))).alias("name"))
    names = sources.union(missing.distinct())
    number = F.substring("name", 4, 9).cast("bigint")
    step = F.when(F.col("name") == "src7", "repos").otherwise("_git")
    return names.select(
        F.col("name").alias("ProjectName"),
        F.concat(
            F.lit("https://dev.example.com/coll/team/"), "name", F.lit("/"), step,
            F.lit("/repo_"), "name",
        ).alias("RepoUrl"),
        F.element_at(F.array(F.lit("Branch"), F.lit("Tag"), F.lit("Commit")),
                     (number % 3 + 1).cast("int")).alias("RefType"),
        F.concat(F.lit("ref"), number).alias("Ref"),
        F.lit("https://callback.example.com").alias("CallbackUrl"),
    )


# --- the same rows in SQL --------------------------------------------------------------------

# White space of any Unicode kind, as RE2 writes it.
SPACES = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


SQL_DOCUMENTS = f"""docs AS (
  SELECT *, {_LINE} AS template
  FROM (SELECT doc_id, source, text, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents))"""

SQL_FILES = f"""{SQL_DOCUMENTS},
names AS (
  SELECT source AS project, doc_id, {_FILE_NAME} AS file_name,
         concat(text, chr(10), {_SNIPPET}, chr(10), template) AS content
  FROM docs),
files AS (
  SELECT project, concat('d', doc_id, '/', file_name) AS path, file_name, content,
         lower(regexp_extract(file_name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext
  FROM names)"""

SQL_LINES = """pieces AS (
  SELECT project, path, string_split(content, chr(10)) AS parts FROM scanned),
numbered AS (
  SELECT project, path, len(parts) AS n, unnest(parts) AS piece,
         generate_subscripts(parts, 1) AS line FROM pieces),
lines AS (
  SELECT project, path, CAST(line AS INTEGER) AS line,
         CASE WHEN line < n THEN concat(piece, chr(10)) ELSE piece END AS text
  FROM numbered WHERE NOT (line = n AND piece = ''))"""

SQL_CLASS_LINES = f"""class_lines AS (
  SELECT text, label FROM (
    SELECT {sql_strip("line")} AS text, label FROM (
      SELECT unnest(string_split(d.text, chr(10))) AS line, l.quality AS label
      FROM documents d JOIN labels l USING (doc_id)))
  WHERE text <> ''),
templated AS (
  SELECT CASE WHEN doc_id % 16 = 14 THEN concat('x', chr(1), h) ELSE template END AS text,
         1 AS label
  FROM docs)"""

SQL_SAMPLES = f"""{SQL_DOCUMENTS}, {SQL_CLASS_LINES},
samples AS (SELECT * FROM class_lines UNION ALL SELECT * FROM templated)"""

SQL_COVERED_SAMPLES = f"""{SQL_DOCUMENTS}, {SQL_CLASS_LINES},
samples AS (
  SELECT * FROM templated UNION ALL SELECT * FROM class_lines WHERE label = 0)"""

SQL_REQUESTS = """names AS (
  SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'src98' UNION ALL SELECT 'src99'),
requests AS (
  SELECT name AS project,
         concat('https://dev.example.com/coll/team/', name, '/',
                CASE WHEN name = 'src7' THEN 'repos' ELSE '_git' END, '/repo_', name) AS url,
         ['Branch', 'Tag', 'Commit'][CAST(substr(name, 4) AS BIGINT) % 3 + 1] AS ref_type,
         concat('ref', CAST(substr(name, 4) AS BIGINT)) AS ref
  FROM names)"""


# Texts of a few one-letter words: a model of five terms, small enough to be fitted in SQL. Both dialects read it.
_FIRST = "CASE WHEN coalesce(n_chars, 0) % 2 = 0 THEN 'a' ELSE 'b' END"
_SECOND = "CASE doc_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'e' END"
_SMALL = {
    "text": f"CASE WHEN doc_id % 7 = 0 THEN {_FIRST} ELSE concat({_FIRST}, ' ', {_SECOND}) END",
    "context": f"CASE WHEN doc_id % 4 > 0 THEN concat({_SECOND}, ' ', {_FIRST}, ' ', {_FIRST}) END",
    "label": "CASE WHEN (coalesce(n_chars, 0) % 2 = 0 AND doc_id % 11 < 7) OR doc_id % 15 = 0 THEN 1 ELSE 0 END",
}
SMALL_TERMS = "abcde"
SQL_SMALL = "small AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _SMALL.items()) + " FROM documents)"


def small_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, context, label) of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "n_chars"))
    return docs.select("doc_id", *[F.expr(v).alias(k) for k, v in _SMALL.items()])
