"""Copying and deleting opaque files in Spark tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysnap.schema import COPY_OUTCOME
from keysnap.session import tasks
from keysnap.sources.storage import open_fs, parent

CHUNK_BYTES = 8 << 20
PARTIAL_PREFIX = ".copying-"


def _copy_bytes(source: str, dest: str) -> int:
    """Copies to a name of its own, checks the length, then renames: a reader never sees half a
    file, and a second attempt of the task does no harm."""
    source_fs, source_path, _ = open_fs(source)
    dest_fs, dest_path, _ = open_fs(dest)
    info = source_fs.get_file_info(source_path)
    if not info.is_file:
        raise FileNotFoundError(source)
    dest_fs.create_dir(parent(dest_path), recursive=True)
    partial = f"{parent(dest_path)}/{PARTIAL_PREFIX}{uuid.uuid4().hex}"
    done = 0
    try:
        with source_fs.open_input_stream(source_path) as reader:
            with dest_fs.open_output_stream(partial) as writer:
                while block := reader.read(CHUNK_BYTES):
                    writer.write(block)
                    done += len(block)
        written = dest_fs.get_file_info(partial).size
        if not written == done >= info.size:
            raise OSError(f"copied {written} of {info.size} bytes")
        dest_fs.move(partial, dest_path)
    except BaseException:
        if dest_fs.get_file_info(partial).is_file:
            dest_fs.delete_file(partial)
        raise
    return done


def _make_dir(dest: str) -> None:
    filesystem, inner, _ = open_fs(dest)
    filesystem.create_dir(inner, recursive=True)


def _copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            error = None
            for used in [row.source_path, *row.fallbacks]:
                try:
                    if row.is_dir:
                        size = 0
                        _make_dir(row.dest_path)
                    else:
                        size = _copy_bytes(used, row.dest_path)
                    rows.append((row.source_path, row.dest_path, used, "copied", size, None))
                    break
                except OSError as e:
                    error = error or f"{type(e).__name__}: {e}"
            else:
                rows.append((row.source_path, row.dest_path, None, "failed", 0, error))
        yield pd.DataFrame(rows, columns=COPY_OUTCOME.names)


def copy_files(plan: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Copies files; one outcome row each, in a plan without a shuffle beyond dealing them out.

    ``plan``: ``source_path``, ``dest_path`` and optionally ``is_dir`` (make a directory),
    ``fallbacks`` (array of other paths to try in order) and ``unit``, the number of the task (0 to
    ``parallelism`` - 1) that copies the row; without it rows are dealt out by their number. Copying happens when the result is
    computed, and again whenever it is recomputed: checkpoint or write the result. Files are
    streamed in blocks, so memory does not grow with their size.
    """
    cols = set(plan.columns)
    if "is_dir" not in cols:
        plan = plan.withColumn("is_dir", F.lit(False))
    if "fallbacks" not in cols:
        plan = plan.withColumn("fallbacks", F.array().cast("array<string>"))
    n = tasks(plan.sparkSession, parallelism)
    dealt = plan.repartitionById(n, F.col("unit")) if "unit" in cols else plan.repartition(n)
    own = dealt.select("source_path", "dest_path", "is_dir", "fallbacks")
    return own.mapInPandas(_copy_batches, COPY_OUTCOME)


def _delete_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                filesystem, inner, _ = open_fs(path)
                info = filesystem.get_file_info(inner)
                if info.is_file:
                    filesystem.delete_file(inner)
                elif info.type.name == "Directory":
                    filesystem.delete_dir(inner)
                rows.append((path, True, None))
            except OSError as e:
                rows.append((path, False, str(e)))
        yield pd.DataFrame(rows, columns=["path", "deleted", "error"])


def delete_paths(paths: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Deletes files, or directories with all they hold; what is gone already counts as
    deleted. Deleting happens when the result is computed."""
    return (
        paths.select("path")
        .repartition(tasks(paths.sparkSession, parallelism))
        .mapInPandas(_delete_batches, "path string, deleted boolean, error string")
    )
