"""Restoring tables from a sealed snapshot."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.functions.checksum import combine_pieces, hash_pieces, row_hash, sum_pieces
from keysnap.functions.names import parse_snapshot_names
from keysnap.operators.restore import (
    missing_slices, restore_catalog_rows, restore_checks, restore_files_check, restore_manifest_check,
    snapshot_tables,
)
from keysnap.operators.ordered import Order
from keysnap.operators.rounds import byte_units
from keysnap.plans.together import LIMIT, run_together
from keysnap.session import cut, local_frame, tasks
from keysnap.sources.commits import CommitLog
from keysnap.sources.listing import list_dirs, list_files
from keysnap.sources.manifest import Snapshot
from keysnap.sources.ranges import copy_all
from keysnap.sources.rows import SLICE_DIR, checked_columns, read_slices
from keysnap.sources.storage import exists, names_in, remove_empty, remove_tree


class RestoreError(RuntimeError):
    """The restore was refused; nothing was written."""


RESTORE_OUTCOME = "table_name string, status string, rows bigint, error string"
LOG_DIR = "versions"


class ConflictError(RuntimeError):
    """Another restore has published a version of the table meanwhile."""


def table_log(spark: SparkSession, target: str, table: str) -> CommitLog:
    """The versions of a restored table: the newest entry names the directory that holds it."""
    return CommitLog(spark, f"{target.rstrip('/')}/{table}/{LOG_DIR}")


def restored_path(spark: SparkSession, target: str, table: str) -> str:
    """The directory with the newest version's rows or files."""
    entry = table_log(spark, target, table).latest()
    if entry is None:
        raise FileNotFoundError(f"{target}/{table} holds no restored table")
    return f"{target.rstrip('/')}/{table}/{entry['data']}"


def read_restored(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The rows of a table that was restored from a snapshot of rows."""
    entry = table_log(spark, target, table).latest()
    path = restored_path(spark, target, table)
    if not entry["schema"]:
        raise ValueError(f"{table} was restored as files: read {path}")
    return spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(path)


def read_restored_catalog(spark: SparkSession, target: str, tables: Sequence[str]) -> DataFrame:
    """The catalog rows that the newest versions of the tables register."""
    base = target.rstrip("/")
    entries = [(t, table_log(spark, base, t).latest()) for t in tables]
    return spark.read.parquet(*[f"{base}/{t}/{e['catalog']}" for t, e in entries if e])


def delete_old_versions(spark: SparkSession, target: str, table: str, keep: int = 1) -> list[str]:
    """Deletes all but the newest ``keep`` versions of a table, and what restores that never ended
    have left. Not to be run while a restore of the table is running. Returns the directories."""
    base = f"{target.rstrip('/')}/{table}"
    held = table_log(spark, target, table).entries()[-keep:]
    wanted = {LOG_DIR} | {e[c] for e in held for c in ("data", "catalog")}
    gone = [n for n in names_in(spark, base) if n not in wanted]
    for name in gone:
        remove_tree(spark, f"{base}/{name}")
    return gone


def open_snapshot(spark: SparkSession, path: str, ignore_bad_name: bool = False) -> Snapshot:
    """A sealed snapshot with a valid name and directory."""
    snapshot = Snapshot(spark, path.rstrip("/"))
    if not exists(spark, path):
        raise RestoreError(f"{path} does not exist")
    if not snapshot.is_sealed():
        raise RestoreError(f"{path} is not sealed: it was not finished")
    if not ignore_bad_name and parse_snapshot_names(snapshot.seal().select("name")).isEmpty():
        raise RestoreError(f"{path} has no valid snapshot name")
    return snapshot


def table_totals(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row with the row count and checksum of all rows."""
    return (
        df.select(row_hash(schema).alias("h"))
        .select(*[c.alias(n) for n, c in hash_pieces(F.col("h")).items()])
        .agg(F.count(F.lit(1)).alias("rows"), *sum_pieces())
        .select("rows", combine_pieces().alias("checksum"))
    )


def _slice_listing(snapshot: Snapshot, table: str) -> DataFrame:
    """Children of the table's directory; slices appear as ``slice_id=<id>`` or ``<id>``."""
    path = f"{snapshot.data}/{table}"
    dirs = local_frame(snapshot.spark, [(path, path)], "root string, path string")
    return list_dirs(dirs, 1).where("error is null").select(
        F.lit(table).alias("table_name"),
        F.regexp_replace("name", f"^{SLICE_DIR}=", "").alias("slice_id"),
        "name",
        "is_dir",
    )


def _restore_rows(
    snapshot: Snapshot, table: str, place: str, schema: T.StructType, content_checked: bool
) -> int:
    """Writes the table's rows to their place, map-only, and checks them against the manifest. A
    snapshot that was checked by count alone has no checksums to compare with."""
    spark = snapshot.spark
    rows = read_slices(spark, f"{snapshot.data}/{table}", schema).drop(SLICE_DIR)
    rows.write.parquet(place)
    want = snapshot.table_stats().where(F.col("table_name") == table).head()
    checked = checked_columns(schema, "content" if content_checked else "count")
    have = table_totals(spark.read.schema(schema).parquet(place), checked).head()
    if have.rows != want.rows or have.checksum != want.checksum:
        raise ValueError(f"{have.rows} rows written, {want.rows} expected, or content differs")
    return have.rows


def _restore_files(snapshot: Snapshot, table: str, place: str, parallelism: int | None) -> None:
    """Copies the table's files and directories, once all are there with the lengths copied."""
    if not exists(snapshot.spark, snapshot.files_path):
        raise ValueError("the snapshot has no list of its files")
    listed = cut(list_files(snapshot.spark, [f"{snapshot.data}/{table}"], recursive=True))
    wanted = snapshot.files().where(F.col("table_name") == table)
    there = listed.withColumn("table_name", F.lit(table))
    wrong = restore_files_check(wanted, there).orderBy("rel_path").head()
    if wrong:
        raise ValueError(f"slice {wrong.slice_id}: {wrong.rel_path} is {wrong.problem}")
    plan = listed.select(
        F.col("path").alias("source_path"),
        F.concat(F.lit(place), "rel_path").alias("dest_path"),
        "is_dir",
        "length",
    )
    n = tasks(snapshot.spark, parallelism)
    units = byte_units(plan, n, "length", Order((), ("source_path",)))
    bad = cut(copy_all(units, n)).where("status = 'failed'").select("error").head()
    if bad:
        raise OSError(bad.error)


def _restore_one(
    snapshot: Snapshot, table: str, target: str, descriptor, retain_original: bool,
    parallelism: int | None, number: int,
) -> tuple:
    """Writes, checks and publishes one table. Nothing is moved: data and catalog rows are written
    where they stay, and a commit entry, written last, makes them the table's newest version. A
    failure or a lost race leaves the earlier version, or no table."""
    spark = snapshot.spark
    log = table_log(spark, target, table)
    version = uuid.uuid4().hex
    names = {"data": f"data-{version}", "catalog": f"catalog-{version}"}
    places = {k: f"{target}/{table}/{n}" for k, n in names.items()}
    manifest = snapshot.manifest().where(F.col("table_name") == table)
    try:
        listing = cut(_slice_listing(snapshot, table))
        unknown = restore_manifest_check(listing, manifest).head()
        if unknown:
            raise ValueError(f"slice {unknown.slice_id} has no manifest entry")
        rows = None
        if descriptor.schema_json:
            lost = missing_slices(listing, manifest).head()
            if lost:
                raise ValueError(f"slice {lost.slice_id} has no data")
            schema = T.StructType.fromJson(json.loads(descriptor.schema_json))
            rows = _restore_rows(snapshot, table, places["data"], schema, descriptor.content_checked)
        else:
            _restore_files(snapshot, table, places["data"], parallelism)
        restore_catalog_rows(manifest).write.parquet(places["catalog"])
        entry = {**names, "table": table, "schema": descriptor.schema_json, "rows": rows, "snapshot": snapshot.path}
        if not log.commit(number, entry):
            raise ConflictError(f"another restore has published version {number}")
    except Exception as e:  # other tables go on
        for place in places.values():
            remove_tree(spark, place)
        if not names_in(spark, log.path):
            remove_empty(spark, f"{target}/{table}")
        return (table, "failed", None, f"{type(e).__name__}: {e}")
    if not retain_original:
        try:
            remove_tree(spark, f"{snapshot.data}/{table}")
        except Exception as e:  # the table is in place all the same
            return (table, "restored", rows, f"original not deleted: {type(e).__name__}: {e}")
    return (table, "restored", rows, None)


def _is_free(spark: SparkSession, target: str, table: str) -> bool:
    return table_log(spark, target, table).latest() is None


def _is_foreign(spark: SparkSession, target: str, table: str) -> bool:
    """Whether the table's directory holds anything that no restore has written."""
    own = (LOG_DIR, "data-", "catalog-")
    return any(not n.startswith(own) for n in names_in(spark, f"{target}/{table}"))


def restore_tables(
    spark: SparkSession,
    path: str,
    target: str,
    tables: Sequence[str] | None = None,
    retain_original: bool = True,
    ignore_bad_name: bool = False,
    allow_unverified: bool = False,
    parallelism: int | None = None,
    replace: bool = False,
    at_once: int = LIMIT,
) -> DataFrame:
    """Restores tables (all when None) below ``target/<table>``; one outcome row per table.

    Nothing is written unless every requested table is in the snapshot and none exists at the
    target; with ``replace`` existing ones get a new version instead, and readers see the old one
    until the new one is complete. After that each table succeeds or fails by itself, ``at_once`` of
    them side by side. Of two restores of a table at a time one fails. Read the tables with
    :func:`read_restored`, files at :func:`restored_path`. With ``retain_original=False`` a
    table's data is deleted from the snapshot once it is in place. A snapshot whose slices did
    not tile the key space is refused unless ``allow_unverified``.
    """
    target = target.rstrip("/")
    snapshot = open_snapshot(spark, path, ignore_bad_name)
    if not allow_unverified and not snapshot.seal().head().verified:
        raise RestoreError(f"{path} was not verified; see its issues")
    available = snapshot_tables(snapshot.manifest(), snapshot.descriptors())
    if tables is None:
        tables = sorted(r.table_name for r in available.collect())
    requested = local_frame(spark, [(t,) for t in tables], "table_name string")
    # A version's number is settled here: one that is published from now on is a conflict.
    numbers = {t: table_log(spark, target, t).next_number() for t in tables}
    there = [(t,) for t in tables if not (replace or _is_free(spark, target, t)) or _is_foreign(spark, target, t)]
    existing = local_frame(spark, there, "table_name string")
    problems = restore_checks(requested, available, existing).orderBy("table_name").collect()
    if problems:
        raise RestoreError("; ".join(f"{r.table_name}: {r.problem}" for r in problems))
    # One row per requested table.
    wanted = snapshot.descriptors().where(F.col("table_name").isin(list(tables)))
    descriptors = {r.table_name: r for r in wanted.collect()}
    work = {
        t: partial(_restore_one, snapshot, t, target, descriptors[t], retain_original, parallelism, numbers[t])
        for t in tables
    }
    results = run_together(spark, "restore", work, at_once)
    outcomes = [
        (t, "failed", None, f"{type(r).__name__}: {r}") if isinstance(r, Exception) else r
        for t, r in results.items()
    ]
    return local_frame(spark, outcomes, RESTORE_OUTCOME)
