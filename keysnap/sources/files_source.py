"""Directories as a Spark data source: ``spark.read.format("keysnap_files")``.

A reader lists directories in as many partitions as there are directories, or ``partitions`` of them:
the levels of the tree are listed on the driver only until there are that many directories, and each
of these is walked by the task that reads it. Dot names, underscore names and empty files are listed.

The options ``name_prefix``, ``min_start`` (of a log's start, the number after the last dot of its name)
and ``files_only`` are evaluated while listing, so that what they rule out is never made a row. They are
options, and filters are not pushed down: in Spark 4.1 a Python reader keeps the filters of one query for
the next on the same DataFrame, which loses rows there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keysnap.sources.storage import children, utc

NAME = "keysnap_files"
PARTITIONS = 256
SCHEMA = "root string, path string, rel_path string, name string, length bigint, is_dir boolean, modified timestamp, start_ms bigint"
# Fixed value: the greatest number that the start of a log can be.
_MOST = (1 << 63) - 1


def start_of(name: str) -> int | None:
    """The number after the last dot; None if there is none."""
    _, dot, digits = name.rpartition(".")
    bare = digits.removeprefix("-")
    if not dot or not (bare.isascii() and bare.isdigit()):
        return None
    number = int(digits)
    return number if -_MOST - 1 <= number <= _MOST else None


@dataclass
class Directory(InputPartition):
    """A directory to list; with all that is below it if ``deep``."""

    root: str
    path: str
    deep: bool


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [r.rstrip("/") or "/" for r in json.loads(options["roots"])]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.missing = options.get("missing", "fail").lower()
        self.wanted = int(options.get("partitions", PARTITIONS))
        self.prefix = options.get("name_prefix", "")
        self.min_start = int(options["min_start"]) if "min_start" in options else None
        self.files_only = options.get("files_only", "false").lower() == "true"

    def _passes(self, name: str, is_dir: bool, start: int | None) -> bool:
        if self.files_only and is_dir or not name.startswith(self.prefix):
            return False
        return self.min_start is None or (start is not None and start >= self.min_start)

    def _listed(self, path: str) -> list[tuple]:
        try:
            return list(children(path))
        except OSError:
            if self.missing == "skip":
                return []
            raise

    def partitions(self) -> list[InputPartition]:
        """Levels are opened here while there are fewer directories than partitions wanted."""
        done: list[Directory] = []
        level = [Directory(r, r, self.recursive) for r in self.roots]
        while self.recursive and level and len(done) + len(level) < self.wanted:
            below = [
                Directory(d.root, path, True) for d in level for path, _, _, is_dir, _ in self._listed(d.path) if is_dir
            ]
            done += [Directory(d.root, d.path, False) for d in level]
            level = below
        return done + level

    def read(self, partition: Directory | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition where there is none
            return
        todo = [partition.path]
        while todo:
            for path, name, length, is_dir, changed in self._listed(todo.pop()):
                start = start_of(name)
                if self._passes(name, is_dir, start):
                    rel = path[len(partition.root.rstrip("/")) :]
                    yield partition.root, path, rel, name, length, is_dir, utc(changed), start
                if is_dir and partition.deep:
                    todo.append(path)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


def read_files(
    spark: SparkSession, roots: Iterable[str], recursive: bool = False, on_missing: str = "fail",
    name_prefix: str = "", min_start: int | None = None, files_only: bool = False, partitions: int = PARTITIONS,
) -> DataFrame:
    """What lies in the directories, lazily: each use lists anew."""
    spark.dataSource.register(FilesSource)
    reader = spark.read.format(NAME).option("roots", json.dumps(list(roots))).option("partitions", partitions)
    reader = reader.option("recursive", str(recursive).lower()).option("missing", on_missing)
    reader = reader.option("name_prefix", name_prefix).option("files_only", str(files_only).lower())
    return (reader if min_start is None else reader.option("min_start", min_start)).load()
