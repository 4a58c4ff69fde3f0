"""The first bytes of files, read alone: a Python data source whose partitions are batches of files.

    spark.dataSource.register(HeadSource)
    spark.read.format("file_heads").option("head_bytes", 512).load("/landing")

A partition opens each of its files, reads ``head_bytes`` and closes it, so
memory and time depend on the number of files, not on their sizes.  Empty files
are listed too, with an empty head; a file that can't be opened has a null head
and the reason in ``problem``.  Files are reached through pyarrow's file
systems (local, HDFS, S3, GCS); ``scans.read_heads`` tells what happens elsewhere.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEAD_BYTES = 1 << 20
#: Files of a partition at most, and partitions at least where there are as many files.
BATCH, SPREAD = 1000, 8
SCHEMA = "path string, size bigint, mtime timestamp, head binary, problem string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int, float | None]]:
    """(path, size, mtime in seconds) of a file, of all files below a folder, or of what a local glob pattern meets.

    As in Spark's readers, names that begin with a dot or an underscore are left out below folders."""
    system, inside = opened(path)
    if isinstance(system, fs.LocalFileSystem) and any(c in inside for c in "*?["):
        return sorted({x for p in glob.glob(inside) for x in listed(p)})
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    root = path[: len(path) - len(inside.rstrip("/"))] if "://" in path else "file://"
    below = len(inside.rstrip("/"))
    seen = [i for i in found if i.type == fs.FileType.File and not any(part[:1] in (".", "_") for part in i.path[below:].split("/") if part)]
    return sorted((root + i.path, i.size, None if i.mtime is None else i.mtime.timestamp()) for i in seen)


class Batch(InputPartition):
    def __init__(self, files: list[tuple[str, int, float | None]]):
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        paths = options.get("paths")
        self.paths = json.loads(paths) if paths else [options["path"]]
        self.head_bytes = int(options.get("head_bytes", HEAD_BYTES))

    def partitions(self) -> list[Batch]:
        files = sorted({x for path in self.paths for x in listed(path)})
        size = max(1, min(BATCH, -(-len(files) // SPREAD)))
        return [Batch(files[i : i + size]) for i in range(0, len(files), size)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        systems: dict[str, fs.FileSystem] = {}
        for path, size, mtime in partition.files:
            head, problem = None, None
            try:
                scheme = path.split("://", 1)[0]
                system, inside = opened(path) if scheme not in systems else (systems[scheme], opened(path)[1])
                systems[scheme] = system
                with system.open_input_stream(inside) as stream:
                    head = stream.read(self.head_bytes)
            except (OSError, pa.ArrowException) as error:
                problem = f"{type(error).__name__}: {error}"
            yield path, size, None if mtime is None else datetime.fromtimestamp(mtime, UTC), head, problem


class HeadSource(DataSource):
    """Options: path or paths (a JSON list), head_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeadReader:
        return HeadReader(dict(self.options))
