"""File trees of any storage as a data source, batch and streaming: every file, also hidden and empty ones.

The source lists names, sizes and times and never opens a file. Folders are the unit of work: the planner
walks down from the root until there are enough of them, the tasks list what lies below. Storage is reached through
Arrow's file systems: a local or mounted path, or any URI they know (``hdfs://``, ``s3://``, ``gs://``, ...).
``sources.files.with_content`` reads the contents of listed files, for those rows that are still there.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "source_tree"
SCHEMA = "project string, path string, location string, length bigint, modified timestamp, problem string"
#: Folders that the planner looks for, partitions they are dealt to, and rows of a batch.
FOLDERS, PARTITIONS, BATCH_ROWS = 1024, 4096, 10_000
#: Seconds a file must have lain still before a stream takes it.
SETTLE = 5.0

FOLDER_PROBLEM = "unreadable folder"

_ARROW = pa.schema(
    [("project", pa.string()), ("path", pa.string()), ("location", pa.string()), ("length", pa.int64()),
     ("modified", pa.timestamp("us", tz="UTC")), ("problem", pa.string())]
)
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:")


def storage(location: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a location, its path there, and what stands before the path."""
    if not _SCHEME.match(location):
        return fs.LocalFileSystem(), os.path.abspath(location), ""
    system, path = fs.FileSystem.from_uri(location)
    if isinstance(system, fs.LocalFileSystem):
        return system, path, ""
    at = location.rfind(path.rstrip("/"))
    return system, path, location[:at] if at > 0 else ""


class Folder(InputPartition):
    """Folders to list, each with or without what lies below its own files."""

    def __init__(self, folders: list[tuple[str, bool]], after: int | None = None, until: int | None = None) -> None:
        super().__init__(folders)
        self.folders, self.after, self.until = folders, after, until


class _Tree:
    """The folders below a root."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"]
        self.wanted = int(options.get("folders", FOLDERS))

    def _connect(self) -> None:
        self.system, self.path, self.prefix = storage(self.root)
        self.local = isinstance(self.system, fs.LocalFileSystem)

    def _entries(self, folder: str) -> tuple[list[fs.FileInfo], list[fs.FileInfo], str | None]:
        """The files and the folders of a folder, and why it cannot be listed."""
        try:
            found = self.system.get_file_info(fs.FileSelector(folder))
        except (OSError, pa.ArrowException) as error:
            return [], [], f"{FOLDER_PROBLEM}: {type(error).__name__}"
        if self.local:  # links that lead nowhere are left out there
            seen = {e.path for e in found}
            lost = [os.path.join(folder, n) for n in os.listdir(folder)]
            found += [fs.FileInfo(p, fs.FileType.NotFound) for p in lost if p not in seen]
        folders, files = [], []
        for entry in sorted(found, key=lambda e: e.path):
            if entry.type == fs.FileType.Directory:
                # A link to a folder is not followed: it may lead back up.
                if not (self.local and os.path.islink(entry.path)):
                    folders.append(entry)
            else:
                files.append(entry)
        return files, folders, None

    def plan(self) -> list[tuple[str, bool]]:
        """Folders that together hold the tree: widened level by level until there are enough."""
        self._connect()
        level, done = [self.path], []
        while level and len(level) + len(done) < self.wanted:
            below = []
            for folder in level:
                _, folders, _ = self._entries(folder)
                done.append((folder, False))
                below += [f.path for f in folders]
            level = below
        return [*done, *[(folder, True) for folder in level]]

    def dealt(self, after: int | None = None, until: int | None = None) -> Sequence[Folder]:
        folders = self.plan()
        parts = min(len(folders), PARTITIONS)
        return [Folder(folders[i::parts], after, until) for i in range(parts)]

    def _row(self, path: str, length: int | None, modified: int | None, problem: str | None) -> tuple:
        below = path[len(self.path) :].strip("/") if path.startswith(self.path) else path.strip("/")
        project, _, rest = below.partition("/")
        when = None if modified is None else datetime.fromtimestamp(modified / 1e9, timezone.utc)
        return project, rest or project, self.prefix + path, length, when, problem

    def rows(self, partition: Folder) -> Iterator[tuple]:
        """Files whose time lies within the partition's bounds, and folders that cannot be listed."""
        self._connect()
        after, until = partition.after, partition.until
        for first, deep in partition.folders:
            stack = [first]
            while stack:
                folder = stack.pop()
                files, folders, problem = self._entries(folder)
                if problem is not None and after is None:
                    yield self._row(folder, None, None, problem)
                if deep:
                    stack += [f.path for f in reversed(folders)]
                for entry in files:
                    if entry.type == fs.FileType.NotFound:
                        if after is None:
                            yield self._row(entry.path, None, None, "unreadable file: it leads nowhere")
                        continue
                    at = entry.mtime_ns
                    if after is not None and not (at is not None and after < at <= until):
                        continue
                    yield self._row(entry.path, entry.size, at, None)

    def batches(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(partition):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class TreeReader(_Tree, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.dealt()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class TreeStream(_Tree, DataSourceStreamReader):
    """Files as they arrive. An offset is a modification time: a batch holds the files changed after the last
    offset and up to its own, so it holds the same files when it is replayed, and none comes twice.

    The newest file sets the offset, once it has lain still for ``settle`` seconds: others of the same moment are
    there by then. Without newer files the offset stays and no batch is made. A file that is moved in with a time
    before the offset is not seen, one that is changed is seen again. Finding the newest file lists all folders, as
    Spark's own file streams do, but holds one folder at a time.
    """

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.settle = float(options.get("settle", SETTLE))
        self.newest = -1

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        self._connect()
        limit = time.time_ns() - int(self.settle * 1e9)
        stack = [self.path]
        while stack:
            files, folders, _ = self._entries(stack.pop())
            stack += [f.path for f in folders]
            for entry in files:
                if entry.mtime_ns is not None and self.newest < entry.mtime_ns <= limit:
                    self.newest = entry.mtime_ns
        return {"modified": self.newest}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # After a restart the files that set the offset may be gone; it must not fall behind.
        self.newest = max(self.newest, end["modified"])
        return self.dealt(start["modified"], end["modified"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("root", ...)``: (project, path, location, length, modified,
    problem) of all files below ``root/<project>/``. Options: ``root``; ``folders``, how many the planner
    looks for; ``settle``, see ``TreeStream``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)
