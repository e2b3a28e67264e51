"""Copying the files of slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysnap.operators.ordered import Order
from keysnap.operators.rounds import byte_units
from keysnap.schema import SLICE_COLS
from keysnap.session import cut, tasks
from keysnap.sources.files import copy_files, delete_paths
from keysnap.sources.listing import resolve_source, trash_candidates, without_store
from keysnap.sources.ranges import copy_all


def _with_trash(copied: DataFrame, plan: DataFrame, trash_roots: Sequence[str], n: int) -> DataFrame:
    """``copied``, after a second attempt at what failed, from the trash."""
    failed = copied.where("status = 'failed'").select("source_path", "dest_path").join(
        plan.where("not is_dir").select("source_path"), "source_path", "left_semi"
    )
    if not trash_roots or failed.isEmpty():
        return copied
    lost = failed.select(
        "source_path", "dest_path", without_store(F.col("source_path")).alias("rel_path"),
        F.col("source_path").alias("path"), F.lit(False).alias("present"),
    )
    found = cut(trash_candidates(lost, trash_roots, n))
    resolved = resolve_source(lost.withColumnRenamed("source_path", "listed_path"), found).where("source_path is not null")
    # What is in the trash may be longer or shorter than it was when listed: it is copied whole.
    again = cut(copy_files(resolved.select("source_path", "dest_path"), n))
    mended = resolved.select("listed_path", "dest_path").join(again.where("status = 'copied'").drop("source_path"), "dest_path")
    rest = copied.join(mended.select("dest_path"), "dest_path", "left_anti")
    return cut(rest.unionByName(mended.withColumnRenamed("listed_path", "source_path")))


def copy_slice_files(
    listed: DataFrame, root: str, dest: str, attempt: int = 1,
    fallback_roots: Sequence[str] = (), parallelism: int | None = None,
    files_out: str | None = None, trash_roots: Sequence[str] = (),
) -> DataFrame:
    """Copies the files of slices; a slice counts only if all of its files arrived.

    ``listed`` comes from :func:`~keysnap.sources.listing.list_slice_files`. Work is dealt out by
    the files' bytes: each task copies a run of files, in order of path, of about the same size, so
    a slice with very many files is copied by many tasks. Earlier copies of the slices
    are deleted first, and those of failed slices afterwards. Runs jobs; returns OUTCOME rows, and
    appends a FILE_ENTRY row for each file copied to ``files_out``. A file that is gone when its turn
    comes is looked for below ``fallback_roots``, then in the checkpoints of ``trash_roots``, of which the
    last one that has it counts.
    """
    base, target = root.rstrip("/"), dest.rstrip("/")
    listed = cut(listed)
    folder = F.concat_ws("/", F.lit(target), "table_name", "slice_id")
    cut(delete_paths(listed.select(folder.alias("path")).distinct(), parallelism))
    broken = listed.groupBy(*SLICE_COLS).agg(F.max("error").alias("list_error"))
    rel = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    plan = (
        listed.where("path is not null")
        .join(broken.where("list_error is null"), SLICE_COLS, "left_semi")
        .select(
            *SLICE_COLS,
            F.col("path").alias("source_path"),
            F.concat(F.lit(target), rel).alias("dest_path"),
            "is_dir",
            "length",
            F.array(*[F.concat(F.lit(r.rstrip("/")), rel) for r in fallback_roots])
            .cast("array<string>")
            .alias("fallbacks"),
        )
    )
    n = tasks(plan.sparkSession, parallelism)
    units = byte_units(plan, n, "length", Order((), ("source_path",)))
    copied = _with_trash(cut(copy_all(units, n)), plan, trash_roots, n)
    arrived = plan.select(*SLICE_COLS, "source_path", "dest_path", "is_dir").join(
        copied.drop("dest_path"), "source_path"
    )
    if files_out:
        # Paths within the table's directory, as a restore lists them.
        skipped = F.length("table_name") + F.lit(len(target) + 2)
        arrived.where("status = 'copied'").select(
            "table_name", "slice_id", F.lit(attempt).alias("attempt"),
            F.substring(F.col("dest_path"), skipped, F.length("dest_path")).alias("rel_path"),
            F.col("bytes").alias("length"), "is_dir",
        ).write.mode("append").parquet(files_out)
    per_slice = (
        arrived.groupBy(*SLICE_COLS)
        .agg(
            F.count_if((F.col("status") == "copied") & ~F.col("is_dir")).alias("files"),
            F.sum("bytes").alias("bytes"),
            F.max("error").alias("copy_error"),
        )
    )
    error = F.coalesce("list_error", "copy_error")
    outcomes = cut(
        broken.join(per_slice, SLICE_COLS, "left")
        .select(
            *SLICE_COLS,
            F.lit(attempt).alias("attempt"),
            F.when(error.isNull(), "copied").otherwise("failed").alias("status"),
            F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
            F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
            F.lit(None).cast("bigint").alias("rows"),
            F.lit(None).cast("decimal(38,0)").alias("checksum"),
            error.alias("error"),
        )
    )
    failed = outcomes.where("status = 'failed'").select(folder.alias("path"))
    cut(delete_paths(failed, parallelism))
    return outcomes
