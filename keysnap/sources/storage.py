"""File-system access: pyarrow inside tasks, Hadoop's API for single steps on the driver."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache
from collections.abc import Iterator
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


# Schemes under which Hadoop knows stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(path: str):
    """The pyarrow file system of a path or URI, the path within it, and the URI's front part."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        inner = "/" + path[len("file:"):].lstrip("/")
        return fs.LocalFileSystem(), inner, "file:"
    scheme, _, rest = path.partition("://")
    authority, slash, key = rest.partition("/")
    filesystem, base = _connect(SCHEMES.get(scheme, scheme), authority)
    inner = f"{base.rstrip('/')}/{key}" if slash else base
    return filesystem, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


@lru_cache(maxsize=64)
def _connect(scheme: str, authority: str):
    """One handle for each store and process. What pyarrow cannot open is an error of the file
    system, like any other: callers make it a row."""
    from pyarrow import ArrowException, fs

    try:
        return fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    except ArrowException as e:
        raise OSError(f"{scheme}://{authority}: {e}") from e


def children(path: str) -> Iterator[tuple[str, str, int, bool, datetime | None]]:
    """Direct children: path, name, length, whether a directory, time of change. Dot names,
    underscore names, empty files and empty directories are all listed."""
    from pyarrow import fs

    filesystem, inner, front = open_fs(path)
    for info in filesystem.get_file_info(fs.FileSelector(inner)):
        is_dir = info.type == fs.FileType.Directory
        size = 0 if is_dir or info.size is None else info.size
        yield front + info.path, info.base_name, size, is_dir, info.mtime


def parent(path: str) -> str:
    return os.path.dirname(path)


def utc(moment: datetime | None) -> datetime | None:
    return None if moment is None else moment.astimezone(timezone.utc)


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, jvm_path = _hadoop(spark, path)
    return filesystem.exists(jvm_path)


def create_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Creates a small file; False where there is one already. Of several callers one creates it.

    A local file appears with all its content, by a link. Other stores are asked not to overwrite,
    and object stores that know conditional writes to check that when the file is closed.
    """
    filesystem, jvm_path = _hadoop(spark, path)
    filesystem.mkdirs(jvm_path.getParent())
    if filesystem.getScheme() == "file":
        inner = jvm_path.toUri().getPath()
        partial = f"{inner}.{uuid.uuid4().hex}.partial"
        with open(partial, "wb") as out:
            out.write(data)
        try:
            os.link(partial, inner)
        except FileExistsError:
            return False
        finally:
            os.unlink(partial)
        return True
    if filesystem.exists(jvm_path):
        return False
    try:
        builder = filesystem.createFile(jvm_path).overwrite(False)
        out = builder.opt("fs.option.create.conditional.overwrite", "true").build()
        out.write(bytearray(data))
        out.close()
    except Py4JJavaError as e:
        if filesystem.exists(jvm_path):
            return False
        raise OSError(f"cannot create {path}: {e.java_exception}") from e
    return read_bytes(spark, path) == data


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of a small file."""
    filesystem, jvm_path = _hadoop(spark, path)
    stream = filesystem.open(jvm_path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a directory of few entries; none if it does not exist."""
    filesystem, jvm_path = _hadoop(spark, path)
    if not filesystem.exists(jvm_path):
        return []
    return sorted(s.getPath().getName() for s in filesystem.listStatus(jvm_path))


def remove_empty(spark: SparkSession, path: str) -> None:
    """Deletes a directory that holds nothing, or only empty directories."""
    filesystem, jvm_path = _hadoop(spark, path)
    if filesystem.exists(jvm_path) and filesystem.getContentSummary(jvm_path).getFileCount() == 0:
        filesystem.delete(jvm_path, True)


def remove_tree(spark: SparkSession, path: str) -> None:
    filesystem, jvm_path = _hadoop(spark, path)
    filesystem.delete(jvm_path, True)
