"""Checks and bookkeeping of a restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysnap.schema import CATALOG_COLS, COMPACTION_DIR, SLICE, SLICE_COLS, SYSTEM_TABLES


def snapshot_tables(manifest: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Tables that can be restored: present, described, and not a system table."""
    return (
        manifest.select("table_name")
        .distinct()
        .where(~F.col("table_name").isin(*SYSTEM_TABLES))
        .join(descriptors.select("table_name").distinct(), "table_name", "left_semi")
    )


def restore_checks(requested: DataFrame, available: DataFrame, existing: DataFrame) -> DataFrame:
    """Problems that forbid a restore, found for all requested tables before anything is
    written. A table that exists already is reported as that, whatever the snapshot holds."""

    def flagged(df: DataFrame, flag: str) -> DataFrame:
        return df.select("table_name").distinct().withColumn(flag, F.lit(True))

    problem = F.when(F.col("there"), "exists").when(F.col("stored").isNull(), "not found")
    return (
        requested.select("table_name")
        .distinct()
        .join(flagged(existing, "there"), "table_name", "left")
        .join(flagged(available, "stored"), "table_name", "left")
        .select("table_name", problem.alias("problem"))
        .where("problem is not null")
    )


def slice_dirs(listing: DataFrame) -> DataFrame:
    """Directories of slices among a table directory's children: no files, no dot or underscore
    names, not the compaction directory."""
    name = F.col("name")
    return listing.where(
        F.col("is_dir")
        & ~name.startswith(".")
        & ~name.startswith("_")
        & (name != COMPACTION_DIR)
    )


def restore_manifest_check(dirs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Slice directories that no manifest entry describes. A table with any such row must not be
    restored. ``dirs``: ``table_name, slice_id, name, is_dir``."""
    return slice_dirs(dirs).select("table_name", "slice_id").join(
        manifest, ["table_name", "slice_id"], "left_anti"
    )


def missing_slices(dirs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries with rows whose directory is gone."""
    held = manifest.where("rows > 0").select("table_name", "slice_id")
    return held.join(
        slice_dirs(dirs).select("table_name", "slice_id"), ["table_name", "slice_id"], "left_anti"
    )


def restore_files_check(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of a snapshot's slices that are ``missing``, of another ``length``, or ``unknown``.

    ``files``: ``table_name, slice_id, rel_path, length, is_dir`` of what was copied; ``listing``:
    ``table_name, rel_path, length, is_dir`` of what is there, with paths within the table's
    directory. What lies outside of the slices (descriptors) is not judged. One shuffle of both
    sides by path; a slice with very many files is spread over all tasks.
    """
    had = files.select(
        "table_name", "rel_path", "slice_id", F.col("length").alias("had"), F.col("is_dir").alias("was_dir")
    ).distinct()
    slice_id = F.split("rel_path", "/").getItem(1)
    has = listing.select("table_name", "rel_path", F.col("length").alias("has"), "is_dir")
    both = had.join(has, ["table_name", "rel_path"], "full").withColumn(
        "slice_id", F.coalesce("slice_id", slice_id)
    )
    known = files.select("table_name", "slice_id").distinct()
    problem = (
        F.when(F.col("is_dir").isNull(), "missing")
        .when(F.col("was_dir").isNull(), F.when(~F.col("is_dir"), "unknown"))
        .when(F.col("was_dir") != F.col("is_dir"), "missing")
        .when(~F.col("is_dir") & (F.col("had") != F.col("has")), "length")
    )
    return (
        both.withColumn("problem", problem).where("problem is not null")
        .join(known, ["table_name", "slice_id"], "left_semi")
        .select("table_name", "slice_id", "rel_path", "problem")
    )


def restore_catalog_rows(manifest: DataFrame) -> DataFrame:
    """Catalog rows of restored slices: online and not split, whatever they were when copied, as
    a split parent's data was copied from the parent. No server holds them yet."""
    cols = {c: F.col(c) for c in SLICE_COLS}
    cols |= {
        "row_key": F.concat_ws(",", "table_name", "start_key", F.col("region_id").cast("string")),
        "server": F.lit(None).cast("string"),
        "host": F.lit(None).cast("string"),
        "port": F.lit(None).cast("int"),
        "server_start_code": F.lit(None).cast("bigint"),
        "is_split": F.lit(False),
        "is_offline": F.lit(False),
        "split_a": F.lit(None).cast(SLICE),
        "split_b": F.lit(None).cast(SLICE),
    }
    return manifest.select(*[cols[c].alias(c) for c in CATALOG_COLS])


def restore_summary(outcomes: DataFrame) -> DataFrame:
    """One row: tables restored, tables failed, and ``ok``, ``partial`` or ``failed``."""
    tally = outcomes.agg(
        F.count_if(F.col("status") == "restored").alias("restored"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    status = F.when(F.col("failed") == 0, "ok").when(F.col("restored") > 0, "partial")
    return tally.withColumn("status", F.coalesce(status, F.lit("failed")))
