"""Distributed listing of directories, and choosing among the files found."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.schema import DESCRIPTOR_PREFIX, FILES, SLICE_COLS, SLICE_MANIFEST
from keysnap.session import cut, local_frame, tasks
from keysnap.sources.descriptors import is_descriptor, read_families
from keysnap.sources.storage import children, open_fs, utc

BATCH = 10_000
_NAMES = FILES.names


def _list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for root, path in zip(batch["root"], batch["path"]):
            try:
                for child, name, length, is_dir, changed in children(path):
                    rel = child[len(root.rstrip("/")):]
                    rows.append((root, child, rel, name, length, is_dir, utc(changed), None))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows = []
            except (FileNotFoundError, NotADirectoryError, OSError) as e:
                rows.append((root, path, None, None, None, None, None, f"cannot list: {e}"))
    if rows:
        yield pd.DataFrame(rows, columns=_NAMES)


def _as_dirs(spark: SparkSession, dirs: DataFrame | Iterable[str]) -> DataFrame:
    if isinstance(dirs, DataFrame):
        paths = dirs.select("path")
    else:
        paths = local_frame(spark, [(d,) for d in dirs], "path string")
    return paths.select(F.col("path").alias("root"), "path").distinct()


def list_dirs(dirs: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Direct children of each directory (``root``, ``path``), one task per share of the
    directories. A directory that cannot be listed gives one row with ``error`` set."""
    n = tasks(dirs.sparkSession, parallelism)
    return dirs.repartition(n, "path").mapInPandas(_list_batches, FILES)


class ListingError(RuntimeError):
    """A directory that had to be there could not be listed."""


def list_files(
    spark: SparkSession,
    dirs: DataFrame | Iterable[str],
    recursive: bool = False,
    on_missing: str = "fail",
    parallelism: int | None = None,
) -> DataFrame:
    """Lists directories with everything in them, dot names and empty files included.

    Recursion goes one level at a time, so that the directories of each level are shared out
    over all tasks again. Levels are checkpointed: listing is not repeated when the result is
    used more than once, and a listing stays what it was. Runs one job per level. With
    ``on_missing='skip'`` directories that cannot be listed are kept out of the result.
    """
    frontier = _as_dirs(spark, dirs)
    levels: list[DataFrame] = []
    while True:
        level = cut(list_dirs(frontier, parallelism))
        found = level.agg(F.max("error").alias("error"), F.bool_or("is_dir").alias("deeper")).head()
        if found.error and on_missing == "fail":
            raise ListingError(found.error)
        level = level.where("error is null")
        levels.append(level)
        if not (recursive and found.deeper):
            break
        frontier = level.where("is_dir").select("root", "path")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("error")


def list_slice_files(
    slices: DataFrame,
    root: str,
    on_missing: str = "fail",
    descriptor_prefix: str = DESCRIPTOR_PREFIX,
    manifest_name: str = SLICE_MANIFEST,
    parallelism: int | None = None,
) -> DataFrame:
    """Files of each slice in a ``root/table/slice/family/file`` tree, problems as rows.

    Which families a table has is read from its newest descriptor. Each slice gives its manifest,
    each family directory (also an empty one) and the files directly in it. What is missing —
    descriptor, slice directory, manifest, family directory — gives a row with ``error`` set: a
    slice with such a row is to be treated as failed. With ``on_missing='skip'`` a missing manifest
    or family gives no row, but a missing or unreadable descriptor still gives an error.
    """
    base = root.rstrip("/")
    own = [*SLICE_COLS, "path", "name", "length", "is_dir", "error"]
    tables = slices.select("table_name").distinct()
    table_dirs = tables.select(
        F.lit(base).alias("root"), F.concat_ws("/", F.lit(base), "table_name").alias("path")
    )
    in_tables = list_dirs(table_dirs, parallelism).where(is_descriptor(descriptor_prefix)).withColumn(
        "table_name", F.element_at(F.split("path", "/"), -2)
    )
    # Kept, so that all slices are judged by one reading of the descriptors.
    newest = cut(latest_descriptor(in_tables, descriptor_prefix))
    families = cut(read_families(newest, parallelism))
    unreadable = families.where("error is not null").select("table_name", "error")
    families = families.where("error is null").select("table_name", "family")
    no_descriptor = slices.join(newest, "table_name", "left_anti").select(
        *SLICE_COLS, F.lit("descriptor missing").alias("error")
    ).unionByName(slices.join(unreadable, "table_name").select(*SLICE_COLS, "error"))

    at = F.concat_ws("/", F.lit(base), "table_name", "slice_id")
    dirs = slices.select(*SLICE_COLS, at.alias("slice_dir"))
    wanted = dirs.join(families, "table_name").withColumn(
        "dir", F.concat_ws("/", "slice_dir", "family")
    )
    listed = list_dirs(
        dirs.select(F.lit(base).alias("root"), F.col("slice_dir").alias("path")), parallelism
    )
    found = listed.select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("slice_dir"), "path", "name", "length",
        "is_dir", "error",
    )
    manifest = dirs.join(
        found.where((F.col("name") == manifest_name) & ~F.col("is_dir")), "slice_dir", "left"
    ).withColumn("error", F.when(F.col("path").isNull(), "manifest missing"))
    family_dirs = wanted.join(
        found.where("is_dir").select(F.col("path").alias("dir"), "name", "length", "is_dir"),
        "dir", "left",
    ).withColumns(
        {
            "path": F.col("dir"),
            "error": F.when(F.col("name").isNull(), F.concat(F.lit("family missing: "), "family")),
        }
    )
    inner = list_dirs(
        family_dirs.where("error is null").select(F.lit(base).alias("root"), "path"), parallelism
    ).select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), "path", "name", "length", "is_dir"
    )
    files = wanted.join(inner.where(~F.col("is_dir")), "dir").withColumn(
        "error", F.lit(None).cast("string")
    )
    parts = [manifest.select(*own), family_dirs.select(*own), files.select(*own)]
    if on_missing == "skip":
        parts = [p.where("error is null") for p in parts]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.unionByName(no_descriptor, allowMissingColumns=True).select(*own)


def latest_descriptor(files: DataFrame, prefix: str = DESCRIPTOR_PREFIX) -> DataFrame:
    """The newest descriptor of each table: of the names with the prefix, the last in order.

    An aggregate, not a window: partial results are reduced before the shuffle. Older versions
    are left where they are.
    """
    named = files.where(F.col("name").startswith(prefix))
    return named.groupBy("table_name").agg(F.max("path").alias("path"))


def older_descriptors(files: DataFrame, prefix: str = DESCRIPTOR_PREFIX) -> DataFrame:
    """Descriptors that a newer one has replaced. Nothing is deleted here: give the result to
    :func:`~keysnap.sources.files.delete_paths` to prune them."""
    named = files.where(F.col("name").startswith(prefix)).select("table_name", "path")
    newest = latest_descriptor(files, prefix)
    return named.join(newest, ["table_name", "path"], "left_anti")


def missing_descriptors(tables: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Selected tables without any descriptor."""
    return tables.select("table_name").join(descriptors, "table_name", "left_anti")


def trash_candidates(files: DataFrame, trash_roots: Sequence[str], parallelism: int | None = None) -> DataFrame:
    """Where else files (``path``) may lie: ``rel_path, path, priority`` of those that do.

    Each trash root has checkpoints, directories that repeat deleted files' whole paths below
    them. The last checkpoint of the last root, by name, has the highest priority. ``rel_path`` is the
    file's path without scheme and store. The few checkpoints are listed once; whether a file is in
    one is asked in tasks.
    """
    spark = files.sparkSession
    rank = {r.rstrip("/"): i for i, r in enumerate(trash_roots)}
    listed = list_files(spark, list(rank), on_missing="skip").where("is_dir").select("root", "path", "name").collect()
    places = [r.path for r in sorted(listed, key=lambda r: (rank[r.root], r.name))]
    kind = "rel_path string, path string, priority int"
    if not places:
        return local_frame(spark, [], kind)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                rel = re.sub("^([a-z0-9]+://[^/]*|file:/*(?=/))", "", path)
                for priority, place in enumerate(places):
                    try:
                        filesystem, inner, _ = open_fs(place + rel)
                        if filesystem.get_file_info(inner).is_file:
                            rows.append((rel, place + rel, priority))
                    except OSError:
                        pass  # as if it were not there
            yield pd.DataFrame(rows, columns=["rel_path", "path", "priority"])

    n = tasks(spark, parallelism)
    return files.select("path").distinct().repartition(n).mapInPandas(look, kind)


def without_store(path: Column) -> Column:
    """A path without scheme and store."""
    return F.regexp_replace(path, "^([a-z0-9]+://[^/]*|file:/*(?=/))", "")


def resolve_source(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where to read each file from: its own path where ``present``, else the candidate with the
    highest ``priority``; null when nothing is left.

    ``files``: ``rel_path, path, present``; ``candidates``: ``rel_path, path, priority``.
    """
    best = candidates.groupBy("rel_path").agg(
        F.max(F.struct("priority", "path")).alias("best")
    )
    source = F.when(F.col("present"), F.col("path")).otherwise(F.col("best.path"))
    return files.join(best, "rel_path", "left").select(
        *files.columns, source.alias("source_path")
    )
