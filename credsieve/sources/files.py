"""Source files and their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions import text as tx
from credsieve.sources import tree

# How many bytes of content a Python task holds before it hands them on.
BATCH_BYTES = 16 << 20
# The largest content of one row.
LARGEST_CONTENT = (1 << 31) - (1 << 20)


_GENUINE, _GUARD = "\ufffd", "\ue000"


def decode(content: Column) -> Column:
    """Text of a binary column; bytes that are not UTF-8 are dropped.

    Spark marks such bytes with U+FFFD. Genuine ones are written as a guard and a digit meanwhile,
    as is the guard itself.
    """
    plain = content.cast("string")
    guarded = F.replace(plain, F.lit(_GUARD), F.lit(f"{_GUARD}0"))
    guarded = F.replace(guarded, F.lit(_GENUINE), F.lit(f"{_GUARD}1"))
    cleared = F.replace(F.make_valid_utf8(guarded), F.lit(_GENUINE), F.lit(""))
    restored = F.replace(cleared, F.lit(f"{_GUARD}1"), F.lit(_GENUINE))
    restored = F.replace(restored, F.lit(f"{_GUARD}0"), F.lit(_GUARD))
    return F.when(F.is_valid_utf8(plain), plain).otherwise(restored)


def spread(files: DataFrame) -> DataFrame:
    """Files over all cores when the source itself is too small to be read by that many tasks.

    A large source has more partitions than cores and is left as it is: content is not shuffled.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def with_names(files: DataFrame) -> DataFrame:
    """Add ``file_name`` and ``ext``, both derived from ``path``."""
    return files.withColumn("file_name", tx.base_name(F.col("path"))).withColumn(
        "ext", tx.extension(F.col("file_name"))
    )


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<project>/``: (project, path, file_name, ext, location, length, problem).

    All files of any storage, hidden and empty ones too, listed by many tasks (see ``sources.tree``). Nothing is
    opened: the operators call ``with_content`` on the files whose content they look at.
    """
    listed = spark.read.format(_registered(spark)).option("root", root).load()
    folders = F.coalesce(F.col("problem").startswith(tree.FOLDER_PROBLEM), F.lit(False))
    return with_names(listed.filter(~folders).drop("modified"))


def folder_problems(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, problem) of folders that cannot be listed; what lies below them is not in ``read_tree``."""
    listed = spark.read.format(_registered(spark)).option("root", root).load()
    return listed.filter(F.col("problem").startswith(tree.FOLDER_PROBLEM)).select("project", "path", "problem")


def _registered(spark: SparkSession) -> str:
    spark.dataSource.register(tree.TreeSource)
    return tree.NAME


def stream_files(spark: SparkSession, root: str, settle: float = tree.SETTLE) -> DataFrame:
    """The same of the files arriving below ``root/<project>/``, see ``sources.tree.TreeStream``."""
    arriving = spark.readStream.format(_registered(spark)).option("root", root).option("settle", settle)
    return with_names(arriving.load().drop("modified"))


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of listed files, handed on in batches of bounded size; a problem where one cannot be read."""
    systems: dict = {}

    def content(location: str, problem: str | None) -> tuple[bytes | None, str | None]:
        if problem is not None:
            return None, problem
        prefix = location[: location.find("/") + 1]
        if prefix not in systems:
            systems[prefix] = tree.storage(location)[0]
        path = tree.storage(location)[1] if prefix != "/" else location
        try:
            with systems[prefix].open_input_file(path) as source:
                if source.size() > LARGEST_CONTENT:
                    return None, f"unreadable file: more than {LARGEST_CONTENT} bytes"
                return source.read(), None
        except (OSError, pa.ArrowException) as error:
            return None, f"unreadable file: {type(error).__name__}"

    for batch in batches:
        names = batch.schema.names
        places, problems = batch.column(names.index("location")), batch.column(names.index("problem"))
        first, held, found = 0, 0, []
        for i, (place, problem) in enumerate(zip(places.to_pylist(), problems.to_pylist())):
            found.append(content(place, problem))
            held += len(found[-1][0] or b"")
            if held >= BATCH_BYTES or i + 1 == len(batch):
                rows = batch.slice(first, i + 1 - first)
                columns = [c for c, name in zip(rows.columns, names) if name != "problem"]
                columns += [pa.array([p for _, p in found], pa.string()), pa.array([c for c, _ in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    columns, names=[*[n for n in names if n != "problem"], "problem", "raw"]
                )
                first, held, found = i + 1, 0, []


def with_content(files: DataFrame) -> DataFrame:
    """Listed files with their ``content``; files that have one are left as they are.

    The rows of the listing, not the contents, are dealt over all tasks first, so a folder of very many files
    is read by many. A file that cannot be read has a null content and its problem, gives no lines, and
    leaves the others be.
    """
    if "content" in files.columns or "location" not in files.columns:
        return files
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [f for f in files.schema.fields if f.name != "problem"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    read = files.repartition(tasks, "location").mapInArrow(_read_contents, f"{schema}, problem string, raw binary")
    return read.withColumn("content", decode(F.col("raw"))).drop("raw")


def file_problems(files: DataFrame) -> DataFrame:
    """(project, path, problem) of listed files that cannot be read."""
    return with_content(files).filter(F.col("problem").isNotNull()).select("project", "path", "problem")


def read_visible_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<project>/`` with their content, by Spark's own file source: it opens storage that only
    Spark is set up for, but passes over empty files and names that start with ``.`` or ``_``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return visible_files(found, root)


# File system and host in front of a path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def visible_files(found: DataFrame, root: str) -> DataFrame:
    """Shape the rows of a ``binaryFile`` source, batch or streaming, as source files."""
    below = tx.relative_path(F.regexp_replace("path", _SCHEME, ""), re.sub(_SCHEME, "", root))
    shaped = found.select(
        F.substring_index(below, "/", 1).alias("project"),
        F.regexp_replace(below, r"^[^/]*/", "").alias("path"),
        decode(F.col("content")).alias("content"),
    )
    return with_names(shaped)


def to_lines(files: DataFrame) -> DataFrame:
    """Numbered lines (project, path, line, text) that keep their newline.

    ``\\r\\n`` and ``\\r`` count as newlines and read as ``\\n``; no other character ends a line.
    The content itself goes no further than this projection.
    """
    files = with_content(files)
    content = F.when(
        F.contains("content", F.lit("\r")), F.regexp_replace("content", r"\r\n?", "\n")
    ).otherwise(F.col("content"))
    split = files.select("project", "path", F.split(content, "\n").alias("pieces")).withColumn(
        "n", F.size("pieces")
    )
    # The condition always holds. It keeps the optimizer from filtering by the size of the pieces,
    # for which it would split twice.
    pieces = split.select(
        "project", "path", "n", F.posexplode(F.when(F.col("n") > 0, F.col("pieces")))
    )
    last = F.col("pos") == F.col("n") - 1
    return pieces.filter(~(last & (F.col("col") == ""))).select(
        "project",
        "path",
        (F.col("pos") + 1).alias("line"),
        F.when(last, F.col("col")).otherwise(F.concat("col", F.lit("\n"))).alias("text"),
    )
