"""Stores of files of any kind as Spark data sources: what a store must be able to do, and reading and writing by it.

``register(spark, name, make)`` makes ``spark.read.format(name)`` and ``df.write.format(name)`` work over the adapter that
``make(options)`` gives. Tasks list subtrees, read files, or read ranges of bytes; they write to a stage, and what they
wrote takes its place once all of them are done, or goes without a trace.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from abc import ABC, abstractmethod
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.paths import ancestors, in_control_dir, sort_key
from ..schema import CONTROL_DIR
from .storage import resolve

#: Bytes that a task reads or hashes at once.
BLOCK = 1 << 20
#: Bytes of a range by default.
RANGE = 64 << 20
#: Bytes and ranges that a task has at most, where small ranges are gathered.
TASK_BYTES, TASK_RANGES = 16 << 20, 1000
SCHEMA = "path string, kind string, size bigint, mtime bigint, native string, start bigint, content binary"


@dataclass(frozen=True)
class Entry:
    """One thing in a store; times are in milliseconds."""

    path: str
    kind: str
    size: int = 0
    mtime: int | None = None


class Adapter(ABC):
    """A store of files. Paths are relative, with '/', and the root is ''. Adapters travel to tasks, so they hold no open handles."""

    @abstractmethod
    def list(self, path: str) -> list[Entry]:
        """What stands right in a directory; a missing one has nothing."""

    @abstractmethod
    def stat(self, path: str) -> Entry | None:
        """Null where nothing is."""

    @abstractmethod
    def open(self, path: str) -> BinaryIO:
        """A file to read from any place on; an error where there is none."""

    @abstractmethod
    def create(self, path: str) -> BinaryIO:
        """A file to write, in place of what is there, with the directories above it."""

    @abstractmethod
    def rename(self, path: str, to: str) -> None:
        """A file or directory with all below it, in place of a file that is there, at once."""

    @abstractmethod
    def delete(self, path: str) -> None:
        """A path and all below it; nothing where nothing is."""

    def mkdir(self, path: str) -> None:
        """An empty directory, if the store can have one; else it is made with its first file."""

    def file_id(self, path: str) -> str | None:
        """An id that outlives renames, where the store has one."""
        return None

    def read(self, path: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """A half-open range in blocks, clamped to the file."""
        with self.open(path) as f:
            f.seek(start)
            left = None if end is None else max(0, end - start)
            while left is None or left > 0:
                data = f.read(BLOCK if left is None else min(BLOCK, left))
                if not data:
                    break
                left = None if left is None else left - len(data)
                yield data


class FolderAdapter(Adapter):
    """A folder of any store that Arrow's file systems know."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _at(self, path: str) -> tuple[fs.FileSystem, str]:
        if ".." in path.split("/"):
            raise ValueError(f"not below the root: {path!r}")
        system, base = resolve(self.root)
        return system, f"{base}/{path}" if path else base

    @staticmethod
    def _entry(path: str, info: fs.FileInfo) -> Entry:
        file = info.type == fs.FileType.File
        return Entry(path, "file" if file else "directory", info.size if file else 0, info.mtime_ns // 1_000_000 if info.mtime_ns is not None else None)

    def list(self, path: str) -> list[Entry]:
        system, at = self._at(path)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return [self._entry(f"{path}/{i.base_name}" if path else i.base_name, i) for i in found]

    def stat(self, path: str) -> Entry | None:
        system, at = self._at(path)
        info = system.get_file_info(at)
        return None if info.type == fs.FileType.NotFound else self._entry(path, info)

    def open(self, path: str) -> BinaryIO:
        system, at = self._at(path)
        return system.open_input_file(at)

    def create(self, path: str) -> BinaryIO:
        system, at = self._at(path)
        return self._above(system, at, lambda: system.open_output_stream(at, compression=None))

    def rename(self, path: str, to: str) -> None:
        (system, old), (_, new) = self._at(path), self._at(to)
        self._above(system, new, lambda: system.move(old, new))

    @staticmethod
    def _above(system: fs.FileSystem, at: str, step: Callable):
        """A step that may need the directories above a path, which are mostly there."""
        try:
            return step()
        except OSError:
            system.create_dir(at.rpartition("/")[0], recursive=True)
            return step()

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        kind = system.get_file_info(at).type
        if kind == fs.FileType.Directory:
            system.delete_dir(at)
        elif kind != fs.FileType.NotFound:
            system.delete_file(at)

    def mkdir(self, path: str) -> None:
        system, at = self._at(path)
        system.create_dir(at, recursive=True)


def _in(path: str) -> bool:
    return path == CONTROL_DIR or path.startswith(CONTROL_DIR + "/")


def _meets(path: str, prefix: str) -> bool:
    """Whether a directory can hold what begins with the prefix, or lies within it."""
    return not path or (path + "/").startswith(prefix) or prefix.startswith(path + "/")


@dataclass
class Subtree(InputPartition):
    """A directory with all below it, or only what stands right in it."""

    path: str
    deep: bool


@dataclass
class Range:
    """A range of one file, or all of a small one."""

    path: str
    size: int
    mtime: int | None
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges that follow each other, read by one task."""

    ranges: list[Range]


def dealt(ranges: Iterator[Range], most: int = TASK_BYTES) -> list[Ranges]:
    """Ranges in order, gathered into tasks of at most so many bytes; 0: a task each."""
    out: list[Ranges] = []
    held = 0
    for r in ranges:
        n = r.end - r.start
        if not out or not most or held + n > most or len(out[-1].ranges) >= TASK_RANGES:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += n
    return out


def subtrees(adapter: Adapter, prefix: str, least: int) -> list[Subtree]:
    """Directories to walk apart: levels are opened until there are ``least``, those that hold nothing of the prefix left out."""
    out, level = [], [""]
    while level and len(level) < least:
        out += [Subtree(d, False) for d in level]
        level = [e.path for d in level for e in adapter.list(d) if e.kind == "directory" and not _in(e.path) and _meets(e.path, prefix)]
    return out + [Subtree(d, True) for d in level]


class _Reader(DataSourceReader):
    def __init__(self, adapter: Adapter, options: dict[str, str]) -> None:
        self.adapter, self.options = adapter, options
        self.prefix = options.get("prefix", "")
        self.content = options.get("content", "none")
        if self.content not in ("none", "whole", "ranges"):
            raise ValueError("content is none, whole or ranges")

    def partitions(self) -> list[InputPartition]:
        found = subtrees(self.adapter, self.prefix, int(self.options.get("subtrees", 64)))
        if self.content != "ranges":
            return found
        size = int(self.options.get("size", RANGE))
        if size < 1:
            raise ValueError("a range has a byte at least")
        files = [e for p in found for e in self._walk(p) if e.kind == "file"]
        cut = (Range(e.path, e.size, e.mtime, at, min(e.size, at + size)) for e in files for at in range(0, max(1, e.size), size))
        # what starts and ends a task costs more than reading a small range
        return dealt(cut, int(self.options.get("gather", TASK_BYTES if size < BLOCK else 0))) or [Subtree("", False)]

    def _walk(self, part: Subtree) -> Iterator[Entry]:
        todo = [part.path]
        while todo:
            for e in self.adapter.list(todo.pop()):
                if _in(e.path):
                    continue
                if e.path.startswith(self.prefix):
                    yield e
                if part.deep and e.kind == "directory" and _meets(e.path, self.prefix):
                    todo.append(e.path)

    def read(self, part: InputPartition) -> Iterator[tuple]:
        a = self.adapter
        if isinstance(part, Ranges):
            for r in part.ranges:
                at = r.start
                for data in a.read(r.path, r.start, r.end):
                    yield (r.path, "file", r.size, r.mtime, a.file_id(r.path), at, data)
                    at += len(data)
                if r.size == 0:
                    yield (r.path, "file", 0, r.mtime, a.file_id(r.path), 0, b"")
            return
        for e in self._walk(part):
            whole = self.content == "whole" and e.kind == "file"
            yield (e.path, e.kind, e.size, e.mtime, a.file_id(e.path), 0, b"".join(a.read(e.path)) if whole else None)


@dataclass
class Staged(WriterCommitMessage):
    """A task's directory in the stage, with its files by number and beside it a list of where they belong; null where it wrote none."""

    task: str | None


def repeated(paths: Callable[[], Iterator[str]]) -> int:
    """How many of the paths, which can be gone through again, were there before; held are 8 bytes a path."""
    hashes, n = np.unique(np.frombuffer(array("q", map(hash, paths())), dtype=np.int64), return_counts=True)
    several = set(hashes[n > 1].tolist())
    return sum(n - 1 for n in Counter(p for p in paths() if hash(p) in several).values()) if several else 0


class _Writer(DataSourceArrowWriter):
    """Rows ``path, content`` (and others): those of one path that follow each other in a task are its parts, in order, unless each row is a whole file."""

    def __init__(self, adapter: Adapter, columns: list[str], whole: bool = False) -> None:
        missing = {"path", "content"} - set(columns)
        if missing:
            raise ValueError(f"columns that are missing: {sorted(missing)}")
        self.adapter, self.stage, self.whole = adapter, f"{CONTROL_DIR}/stage/{uuid.uuid4().hex}", whole

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        path, sink, listed, n, task = None, None, None, 0, uuid.uuid4().hex
        try:
            for to, content in (row for b in batches for row in zip(b.column("path").to_pylist(), b.column("content"), strict=True)):
                if sink is None or to != path or self.whole:
                    if sink is not None:
                        sink.close()
                    path = to
                    if not path or _in(path) or path.startswith("/") or ".." in path.split("/"):
                        raise ValueError(f"not a path to write: {path!r}")
                    if listed is None:
                        listed = self.adapter.create(f"{self.stage}/{task}.paths")
                    listed.write(json.dumps(path).encode() + b"\n")
                    sink = self.adapter.create(f"{self.stage}/{task}/{n}")  # tasks that share a directory wait for each other
                    n += 1
                if content.is_valid:
                    sink.write(content.as_buffer())
        finally:
            for f in (sink, listed):
                if f is not None:
                    f.close()
        return Staged(task if n else None)

    def _paths(self, task: str) -> Iterator[str]:
        """Where a task's files belong, in order."""
        rest = b""
        for data in self.adapter.read(f"{self.stage}/{task}.paths"):
            *lines, rest = (rest + data).split(b"\n")
            yield from map(json.loads, lines)

    def commit(self, messages: list[Staged | None]) -> None:
        # lists of paths are read from the stage as they are needed: the driver holds no more of them than a block
        written = [m.task for m in messages if m is not None and m.task is not None]
        twice = repeated(lambda: (p for t in written for p in self._paths(t)))
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} paths were written by two tasks, or two rows of whole files; deal rows out by path")
        for task in written:
            for i, to in enumerate(self._paths(task)):
                self.adapter.rename(f"{self.stage}/{task}/{i}", to)
        self.adapter.delete(self.stage)

    def abort(self, messages: list[Staged | None]) -> None:
        self.adapter.delete(self.stage)


def register(spark: SparkSession, name: str, make: Callable[[dict[str, str]], Adapter]) -> None:
    """Make an adapter a format of the session.

    Options of reading: ``content`` (none; whole; ranges of ``size`` bytes, a task each, as rows of at most a megabyte;
    ranges under a megabyte share tasks of 16 MB, or of the bytes that ``gather`` says), ``prefix`` (only paths that begin
    so; only directories that can hold them are listed) and ``subtrees`` (how many directories are walked apart at least).
    The control folder is never listed. All options reach ``make``. The prefix is an option and not a condition that Spark
    hands down, as Spark 4.1 keeps what it has handed down for all later reads of the same DataFrame, without the condition,
    too.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(make(dict(self.options)), dict(self.options))

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if overwrite:
                raise ValueError("files are put in place one by one: use mode('append')")
            return _Writer(make(dict(self.options)), schema.fieldNames(), self.options.get("whole") == "true")

    spark.dataSource.register(Source)


def register_folders(spark: SparkSession, name: str = "folder") -> None:
    """Folders by their URI, given as the path to load or save."""
    register(spark, name, lambda options: FolderAdapter(options["path"]))


def tasks(spark: SparkSession) -> int:
    """Tasks for work on files, whose rows are too small to tell how long it takes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_files(parts: DataFrame, name: str, path: str | None = None, **options: str) -> None:
    """Files from rows ``path, start, content``: parts of one file go to one task, in order of start, and are streamed there.

    Without ``start`` each row is a whole file, and is written where it is.
    """
    if "start" not in parts.columns:
        parts.select("path", "content").write.format(name).options(**options, whole="true").mode("append").save(path)
        return
    dealt = parts.select("path", "start", "content").repartition("path").sortWithinPartitions("path", "start")
    dealt.write.format(name).options(**options).mode("append").save(path)


def walk_store(spark: SparkSession, name: str, path: str | None = None, ignore: Column | None = None, directories: bool = False, **options: str) -> DataFrame:
    """A recursive listing in order of paths: ``path, kind, size, mtime, native``, with empty directories where asked for.

    ``ignore`` is a condition on the column path; with an ignored directory goes all below it.
    """
    found = spark.read.format(name).options(**options).load(path).select("path", "kind", "size", "mtime", "native").filter(~in_control_dir(F.col("path")))
    if not directories:
        found = found.filter("kind = 'file'") if ignore is None else found
    if ignore is not None:
        gone = found.filter(ignore).select(F.col("path").alias("above"))
        up = found.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("above")).join(gone, "above", "left_semi")
        found = found.join(up.select("path").distinct(), "path", "left_anti")
        found = found if directories else found.filter("kind = 'file'")
    return found.orderBy(sort_key(F.col("path")))


def range_digests(ranges: DataFrame, size: int = RANGE) -> DataFrame:
    """``path, start, end, digest`` of the ranges of ``size`` bytes that rows of content="ranges" belong to: SHA-256 in each range's task.

    Rows of one range follow each other there; nothing is shuffled.
    """
    names, types = ["path", "start", "end", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, end = None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for path, start, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = (path, start // size * size)
                if own != key:
                    if key is not None:
                        out.append((*key, end, sha.hexdigest()))
                    key, sha, end = own, hashlib.sha256(), start
                sha.update(content)
                end += len(content)
        if key is not None:
            out.append((*key, end, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return ranges.select("path", "start", "content").mapInArrow(run, "path string, start bigint, end bigint, digest string")


def tree_digests(digests: DataFrame) -> DataFrame:
    """``path, size, digest`` of files from their ranges' digests, which were worked out apart: SHA-256 of all of them in order.

    It tells contents apart as well as a hash of the whole, for files that no one task should read; sizes of ranges must agree.
    """
    parts = F.array_sort(F.collect_list(F.struct("start", "digest")))
    return digests.groupBy("path").agg(F.max("end").alias("size"), F.sha2(F.array_join(F.transform(parts, lambda p: p["digest"]), ""), 256).alias("digest"))


def file_digests(files: DataFrame, adapter: Adapter) -> DataFrame:
    """``files`` (path and others) with ``hash``, SHA-256 of the content: each file is streamed by one task, whatever its length; rows, which do not tell how long that takes, are dealt out by number."""
    schema = files.select("*", F.lit("").alias("hash")).schema
    place = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(place).to_pylist():
                sha = hashlib.sha256()
                for data in adapter.read(path):
                    sha.update(data)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "hash"])

    return files.repartition(tasks(files.sparkSession)).mapInArrow(run, schema)
