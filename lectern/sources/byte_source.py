"""Files as byte ranges: a data source whose partitions are ranges, read where they are asked for.

    register(spark)
    spark.read.format("byteranges").option("rangeBytes", 1 << 20).load("/books")             # all ranges of all files
    spark.read.format("byteranges").option("head", True).load("/books/*.pdf")                # their first 256 KiB
    spark.read.format("byteranges").schema("path string, size long, start long").load(..)    # no byte is read

Columns: path, size (of the file), start, data. A range is a partition of its own, or some of them if they are small, so a
large file is read by many tasks and no task reads more than taskBytes or one range. A schema without data reads none of
it; conditions on start that Spark hands down leave ranges out before anything is opened. Files are found and opened
through pyarrow.fs, by their URI: local and shared folders, HDFS and object stores that it knows.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Fixed value: bytes of a file's head.
HEAD = 262_144
#: Bytes of a range unless said otherwise; of the ranges of one task.
RANGE, TASK_BYTES = 1 << 20, 8 << 20
SCHEMA = "path string, size long, start long, data binary"
#: What a condition `start <op> value` asks of a range.
HOLDS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


def ranges(size: int, length: int, head: bool = False) -> list[tuple[int, int]]:
    """(start, bytes) of a file's ranges; an empty file has one of no bytes."""
    if head:
        return [(0, min(size, HEAD))]
    return [(a, min(length, size - a)) for a in range(0, size, length)] or [(0, 0)]


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, int, int, int]]  # path, size, start, bytes


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder, or of those that a pattern in the last part of the path names."""
    from pyarrow import fs

    scheme, mark, rest = pattern.partition("://")
    folder, name = posixpath.split(rest if mark else pattern)
    wild = any(c in name for c in "*?[")
    system, at = _opened((scheme + mark if mark else "") + folder if wild else pattern)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(pattern)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=not wild))
    prefix = f"{scheme}://" if mark else ""
    kept = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (not wild or fnmatch.fnmatchcase(f.base_name, name))]
    return sorted((prefix + f.path, f.size) for f in kept)


class Reader(DataSourceReader):
    def __init__(self, pattern: str, schema: StructType, length: int, head: bool, task: int):
        self.pattern, self.names, self.length, self.head, self.task, self.conditions = pattern, schema.names, length, head, task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in HOLDS and f.attribute == ("start",) and f.value is not None:
                self.conditions.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        out, held = [Ranges([])], 0
        for path, size in files(self.pattern):
            for start, n in ranges(size, self.length, self.head):
                if all(HOLDS[kind](start, value) for kind, value in self.conditions):
                    if out[-1].parts and held + n > self.task:
                        out.append(Ranges([]))
                        held = 0
                    out[-1].parts.append((path, size, start, n))
                    held += n
        return out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        last, file = None, None
        for path, size, start, n in partition.parts:
            data = None
            if "data" in self.names:
                if path != last:
                    system, at = _opened(path)
                    last, file = path, system.open_input_file(at)
                data = file.read_at(n, start)
                if len(data) != n:
                    raise OSError(f"{path} has changed: {len(data)} of {n} bytes at {start}")
            row = {"path": path, "size": size, "start": start, "data": data}
            yield tuple(row[c] for c in self.names)


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if unknown := [c for c in schema.names if c not in ("path", "size", "start", "data")]:
            raise ValueError(f"no such columns: {unknown}")
        length = int(self.options.get("rangeBytes", RANGE))
        if length < 1:
            raise ValueError("rangeBytes must be 1 or more")
        return Reader(self.options["path"], schema, length, self.options.get("head", "false").lower() == "true", int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ByteRanges)


def byte_ranges(spark: SparkSession, path: str, length: int = RANGE, head: bool = False, columns: str = SCHEMA, task: int = TASK_BYTES):
    """The ranges of the files under a path, as a DataFrame."""
    register(spark)
    return spark.read.format("byteranges").schema(columns).option("rangeBytes", length).option("head", head).option("taskBytes", task).load(path)
