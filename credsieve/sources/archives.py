"""ZIP archives as a source of files.

Archives come as listed files (``list_archives``), of which only the directory at their end and then runs of members
are read by range, or as rows with their content.
"""

from __future__ import annotations

import io
import lzma
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions import text as tx
from credsieve.sources import tree
from credsieve.sources.files import BATCH_BYTES, LARGEST_CONTENT, decode, read_tree, with_names

#: Packed bytes of the members that one task reads in a row; a member counts for its unpacked size over the ratio.
RUN_BYTES, RUN_RATIO = 64 << 20, 8

_MEMBERS = "project string, path string, raw binary, problem string"
_COLUMNS = ["project", "path", "raw", "problem"]
_INDEX_COLUMNS = ["project", "location", "path", "run", "at", "packed", "size", "method", "crc", "flags", "problem"]
_INDEX = ("project string, location string, path string, run bigint, at bigint, packed bigint, size bigint, "
          "method int, crc bigint, flags int, problem string")  # fmt: skip
_INDEX_ROWS, _PIECE = 10_000, 1 << 20
# The start of a member: mark, and sizes of its name and extra field.
_HEADER = struct.Struct("<4s22xHH")
#: What a damaged archive or member raises.
_BROKEN = (
    zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError,
    RuntimeError, ValueError,
)
_UNSAFE = re.compile(r"^[/\\]|^[A-Za-z]:|\.\.")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of archives, handed on in batches of bounded size.

    Unsafe paths are told by the name, before anything is decompressed. A member that cannot be
    read leaves the others be. One archive and one batch of members are in memory besides the rows that came.
    """
    rows, held = [], 0
    for batch in batches:
        for project, content in zip(batch.column("project"), batch.column("content")):
            for row in _members_of(project.as_py(), content.as_py()):
                rows.append(row)
                held += len(row[2] or b"")
                if held >= BATCH_BYTES or len(rows) == _INDEX_ROWS:
                    yield _batch_of(rows)
                    rows, held = [], 0
    if rows:
        yield _batch_of(rows)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_COLUMNS)


def _members_of(project: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.infolist():
                path = member.filename
                if member.is_dir():
                    continue
                if _UNSAFE.search(path):
                    yield project, path, None, "unsafe path"
                    continue
                try:
                    raw = archive.read(member)
                except _BROKEN as error:
                    yield project, path, None, f"unreadable member: {error}"
                    continue
                yield project, path, raw, None
    except _BROKEN as error:
        yield project, None, None, f"unreadable archive: {error}"


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """Archives (project, location, problem) of any storage below a path, none of them opened; the project is the
    name of the ZIP file."""
    listed = read_tree(spark, root).filter(F.lower("ext") == ".zip")
    return listed.select(_project(F.col("path")).alias("project"), "location", "problem")


class _Range(io.RawIOBase):
    """An open file of any storage as Python's own kind of file."""

    def __init__(self, location: str) -> None:
        system, path, _ = tree.storage(location)
        self.source = system.open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        base = {os.SEEK_SET: 0, os.SEEK_CUR: self.source.tell(), os.SEEK_END: self.source.size()}[whence]
        if base + offset < 0:
            raise OSError("before the start of the file")
        self.source.seek(min(base + offset, self.source.size()))
        return self.source.tell()

    def readinto(self, buffer) -> int:
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.source.close()
        super().close()


def _opened(location: str) -> io.BufferedReader:
    return io.BufferedReader(_Range(location), _PIECE)


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The directories of archives: a row per member, or per archive that has a problem."""
    for batch in batches:
        for project, location, problem in batch[["project", "location", "problem"]].itertuples(index=False):
            rows, packed = [], 0
            lost = (project, location, None, None, None, None, None, None, None, None)
            if problem is not None:
                yield pd.DataFrame([(*lost, f"unreadable archive: {problem}")], columns=_INDEX_COLUMNS)
                continue
            try:
                with _opened(location) as source, zipfile.ZipFile(source) as archive:
                    for m in archive.infolist():
                        if m.is_dir():
                            continue
                        problem = None
                        if _UNSAFE.search(m.filename):
                            problem = "unsafe path"
                        elif m.flag_bits & 1:
                            problem = "unreadable member: it is encrypted"
                        elif m.file_size > LARGEST_CONTENT:
                            problem = f"unreadable member: more than {LARGEST_CONTENT} bytes"
                        # A run is read by one task: members that lie together, of bounded size on both sides.
                        packed += max(m.compress_size, m.file_size // RUN_RATIO)
                        place = (m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, m.flag_bits)
                        rows.append((project, location, m.filename, packed // RUN_BYTES, *place, problem))
                        if len(rows) == _INDEX_ROWS:
                            yield pd.DataFrame(rows, columns=_INDEX_COLUMNS)
                            rows = []
            except (*_BROKEN, pa.ArrowException) as error:
                rows.append((*lost, f"unreadable archive: {error}"))
            if rows:
                yield pd.DataFrame(rows, columns=_INDEX_COLUMNS)


def archive_index(archives: DataFrame) -> DataFrame:
    """Where the members of listed archives lie: (project, location, path, run, at, packed, size, method, crc, flags,
    problem). Only the directory of an archive is read."""
    return archives.select("project", "location", "problem").mapInPandas(_list_members, _INDEX)


def _member(source, row) -> bytes:
    """One member, read from its place in an open archive and unpacked piece by piece."""
    source.seek(int(row.at))
    header = source.read(_HEADER.size)
    if len(header) < _HEADER.size:
        raise zipfile.BadZipFile("it lies beyond the end")
    mark, name_size, extra_size = _HEADER.unpack(header)
    if mark != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member begins where the directory says")
    name = source.read(name_size)
    source.seek(extra_size, os.SEEK_CUR)
    info = zipfile.ZipInfo(row.path)
    known = name.decode("utf-8" if int(row.flags) & 0x800 else "cp437", "replace")
    if known.replace("\\", "/") != row.path.replace("\\", "/"):
        raise zipfile.BadZipFile("its name is not that of the directory")
    info.compress_type, info.CRC, info.flag_bits = int(row.method), int(row.crc), int(row.flags)
    info.compress_size, info.file_size = int(row.packed), int(row.size)
    out = bytearray()
    with zipfile.ZipExtFile(source, "r", info, None, False) as member:
        while piece := member.read(_PIECE):
            out += piece
    if len(out) != info.file_size:
        raise zipfile.BadZipFile("it ends too soon")
    return bytes(out)


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of members, handed on in batches of bounded size. Rows come by archive and place."""
    opened, source, failed = None, None, None
    for batch in batches:
        rows, held = [], 0
        for row in batch.itertuples(index=False):
            raw, problem = None, row.problem
            if problem is None:
                if row.location != opened:
                    opened, source, failed = row.location, None, None
                    try:
                        source = _opened(row.location)
                    except (OSError, pa.ArrowException) as error:
                        failed = f"unreadable member: {error}"
                problem = failed
                if source is not None:
                    try:
                        raw = _member(source, row)
                    except (*_BROKEN, pa.ArrowException) as error:
                        problem = f"unreadable member: {error}"
            rows.append((row.project, row.path, raw, problem))
            held += len(raw or b"")
            if held >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)


def read_members(index: DataFrame) -> DataFrame:
    """Members (project, path, raw, problem) of an index, the runs of an archive by as many tasks as there are."""
    spark = index.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = index.repartition(tasks, "location", "run").sortWithinPartitions("location", "at")
    return placed.mapInPandas(_read_members, _MEMBERS)


def expand_archives(archives: DataFrame) -> DataFrame:
    """Members (project, path, raw, problem) of archives: listed ones (project, location, problem), or rows that
    hold their content (project, content).

    What cannot or must not be read has its problem instead of its content: an archive (without a
    path), a member, or a path that is absolute or climbs up. A listed archive may be of any size: its members, not
    the archive, pass through the tasks' memory.
    """
    if "location" in archives.columns:
        return read_members(archive_index(archives))
    return archives.select("project", "content").mapInArrow(_expand, _MEMBERS)


def member_files(members: DataFrame) -> DataFrame:
    """Files (project, path, file_name, ext, content) of the members that could be read."""
    sound = members.filter(F.col("problem").isNull())
    return with_names(sound.select("project", "path", decode(F.col("raw")).alias("content")))


def archive_problems(members: DataFrame) -> DataFrame:
    """(project, path, problem) of what could not be read. Unsafe paths are left out on purpose."""
    broken = F.col("problem").isNotNull() & (F.col("problem") != "unsafe path")
    return members.filter(broken).select("project", "path", "problem")


def archive_files(archives: DataFrame) -> DataFrame:
    """Files of archives (project, content); exclusion is left to the scan."""
    return member_files(expand_archives(archives))


def _project(path: Column) -> Column:
    return F.regexp_replace(tx.base_name(path), r"(?i)\.zip$", "")


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """Archives (project, content) below a path, each read whole, by Spark's own file source."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", True)
        .load(pattern)
        .select(
            _project(F.col("path")).alias("project"),
            "content",
        )
    )
