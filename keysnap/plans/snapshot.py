"""Taking a snapshot: copy, retry what failed against a fresh catalog, verify, seal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import partial
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.functions.names import format_snapshot_name
from keysnap.functions.text import slice_path
from keysnap.operators.catalog import select_slices
from keysnap.operators.cover import coverage_issues
from keysnap.operators.rounds import remaining_slices, work_units
from keysnap.plans.together import LIMIT, run_together
from keysnap.schema import DESCRIPTOR, IDENTITY, ISSUE, OUTCOME, SLICE_COLS, SNAPSHOT_PREFIX, STAMP_FORMAT
from keysnap.session import cut, local_frame, tasks
from keysnap.sources.files import copy_files, delete_paths
from keysnap.sources.descriptors import is_descriptor
from keysnap.sources.listing import latest_descriptor, list_dirs, list_slice_files
from keysnap.sources.manifest import Snapshot
from keysnap.sources.rows import KeyedTable, OverlapError, copy_slices, rows_without_key
from keysnap.sources.slice_files import copy_slice_files
from keysnap.sources.storage import exists


# Slice ids name directories, so they hold nothing that a path would need to escape.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


class SnapshotError(RuntimeError):
    """The snapshot could not be started or carried on."""


class Copier(Protocol):
    """How the slices of one round are copied."""

    names: list[str]

    def prepare(self, snapshot: Snapshot) -> None:
        """Keeps what describes the tables; runs before any data is copied."""

    def copy(self, work: DataFrame, snapshot: Snapshot, attempt: int) -> None:
        """Copies the slices of ``work`` and appends their outcomes."""

    def extra_issues(self, snapshot: Snapshot) -> list[tuple]:
        """Problems that the key ranges alone do not show."""


class RowCopier:
    """Copies the rows of tables that Spark can read (see :class:`KeyedTable`)."""

    def __init__(self, tables: Sequence[KeyedTable], fault: Callable | None = None, at_once: int = LIMIT):
        self.tables = list(tables)
        self.names = [t.name for t in self.tables]
        self.fault, self.at_once = fault, at_once

    def prepare(self, snapshot: Snapshot) -> None:
        rows = [
            (t.name, t.open(snapshot.spark).schema.json(), t.key, t.width, t.check == "content")
            for t in self.tables
        ]
        frame = local_frame(snapshot.spark, rows, DESCRIPTOR)
        frame.write.mode("overwrite").parquet(f"{snapshot.path}/descriptors")

    def copy(self, work: DataFrame, snapshot: Snapshot, attempt: int) -> None:
        """Tables are copied side by side. A job that fails makes the slices of its table failed
        ones and leaves the others alone; what no retry can mend is raised in the end."""
        own = {t.name: partial(self._copy_one, work, t, snapshot, attempt) for t in self.tables}
        results = run_together(snapshot.spark, "snapshot", own, self.at_once)
        errors = {name: e for name, e in results.items() if isinstance(e, Exception)}
        for error in errors.values():
            if isinstance(error, (OverlapError, ValueError)):
                raise error
        for name, error in errors.items():
            _fail_table(work.where(F.col("table_name") == name), snapshot, attempt, error)

    def _copy_one(self, work: DataFrame, table: KeyedTable, snapshot: Snapshot, attempt: int) -> None:
        copy_slices(work, table, snapshot.data, attempt, snapshot.new_outcomes_path(), self.fault)

    def extra_issues(self, snapshot: Snapshot) -> list[tuple]:
        return [
            (t.name, None, None, None, "rows without key")
            for t in self.tables
            if rows_without_key(snapshot.spark, t)
        ]


class FileCopier:
    """Copies the files of a ``root/table/slice/family/file`` tree without looking into them."""

    def __init__(
        self, root: str, tables: Sequence[str], fallback_roots: Sequence[str] = (),
        parallelism: int | None = None, trash_roots: Sequence[str] = (),
    ):
        self.root, self.names = root, list(tables)
        self.fallback_roots, self.parallelism, self.trash_roots = fallback_roots, parallelism, trash_roots

    def prepare(self, snapshot: Snapshot) -> None:
        spark, base = snapshot.spark, self.root.rstrip("/")
        dirs = local_frame(
            spark, [(base, f"{base}/{t}") for t in self.names], "root string, path string"
        )
        # A directory that bears the name of a descriptor is none.
        found = list_dirs(dirs, self.parallelism).where("error is null").where(is_descriptor())
        listed = found.withColumn("table_name", F.element_at(F.split("path", "/"), -2))
        newest = cut(latest_descriptor(listed))
        name = F.substring_index("path", "/", -1)
        plan = newest.select(
            F.col("path").alias("source_path"),
            F.concat_ws("/", F.lit(snapshot.data), "table_name", name).alias("dest_path"),
        )
        failed = cut(copy_files(plan, self.parallelism)).where("status = 'failed'").head()
        if failed:
            raise SnapshotError(f"descriptor {failed.source_path}: {failed.error}")
        # Files are opaque here: the descriptor is copied as it is, and names no columns.
        newest.select(
            "table_name",
            *[
                F.lit(None).cast(f.dataType).alias(f.name)
                for f in DESCRIPTOR.fields
                if f.name != "table_name"
            ],
        ).write.mode("overwrite").parquet(f"{snapshot.path}/descriptors")

    def copy(self, work: DataFrame, snapshot: Snapshot, attempt: int) -> None:
        # As many tasks as the work has units, unless the copier was given a number.
        n = self.parallelism or work.select("unit").distinct().count()
        listed = list_slice_files(work, self.root, parallelism=n)
        outcomes = copy_slice_files(
            listed, self.root, snapshot.data, attempt, self.fallback_roots, n, snapshot.files_path,
            self.trash_roots,
        )
        outcomes.write.parquet(snapshot.new_outcomes_path())

    def extra_issues(self, snapshot: Snapshot) -> list[tuple]:
        return []


def _fail_table(work: DataFrame, snapshot: Snapshot, attempt: int, error: Exception) -> None:
    """Outcomes of the slices that a failed job has left without one."""
    message = f"{type(error).__name__}: {error}"[:2000]
    had = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OUTCOME.fields}
    had |= {c: F.col(c) for c in SLICE_COLS}
    had |= {"attempt": F.lit(attempt).alias("attempt"), "status": F.lit("failed").alias("status")}
    had |= {"error": F.lit(message).alias("error")}
    zeros = {c: F.lit(0).cast("bigint").alias(c) for c in ("files", "bytes", "rows")}
    left = work.select(*SLICE_COLS)
    if snapshot.has_outcomes():
        done = snapshot.outcomes().where(F.col("attempt") == attempt).select(*IDENTITY)
        left = left.join(done, IDENTITY, "left_anti")
    left.select(*[(had | zeros)[c] for c in OUTCOME.names]).write.parquet(snapshot.new_outcomes_path())


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _name(spark: SparkSession, started: datetime, ended: datetime | None = None) -> str:
    row = spark.range(1).select(
        format_snapshot_name(F.lit(started), None if ended is None else F.lit(ended)).alias("n")
    )
    return row.head().n


def take_snapshot(
    spark: SparkSession,
    copier: Copier,
    catalog: Callable[[int], DataFrame],
    dest: str,
    max_tries: int = 5,
    n: int | None = None,
) -> Snapshot:
    """Takes a snapshot of the copier's tables below ``dest`` and returns it, sealed.

    ``catalog(attempt)`` gives the current catalog of slices; it is asked again in each round,
    since slices split while copying goes on. Rounds end when nothing is left or after
    ``max_tries`` (0: no limit). The seal says whether the copied slices tile the key space of
    every table (``verified``); breaches are kept in ``issues``. A run that ends before, by an error
    or because its driver is lost, leaves the snapshot unsealed: :func:`resume_snapshot` goes on.
    """
    started = _now()
    snapshot = Snapshot(spark, f"{dest.rstrip('/')}/{_name(spark, started)}")
    return _carry_on(snapshot, copier, catalog, started, max_tries, n)


def resume_snapshot(
    spark: SparkSession,
    copier: Copier,
    catalog: Callable[[int], DataFrame],
    path: str,
    max_tries: int = 5,
    n: int | None = None,
) -> Snapshot:
    """Goes on with the unsealed snapshot at ``path`` and seals it.

    Slices with an outcome ``copied`` stay as they are. All others of a fresh catalog are copied in
    further rounds (at most ``max_tries`` more), among them those that the lost run was copying:
    without an outcome nothing is known of them. What it left of slices that are not copied again,
    because they have split meanwhile, is deleted before sealing.
    """
    snapshot = Snapshot(spark, path.rstrip("/"))
    if not exists(spark, snapshot.path):
        raise SnapshotError(f"{path} does not exist")
    if snapshot.is_sealed():
        raise SnapshotError(f"{path} is sealed already")
    stamp = snapshot.path.rsplit("/", 1)[1].removeprefix(f"{SNAPSHOT_PREFIX}-")
    started = spark.range(1).select(
        F.try_to_timestamp(F.lit(stamp), F.lit(STAMP_FORMAT)).alias("t")
    ).head().t
    if started is None:
        raise SnapshotError(f"{path} has no name of a running snapshot")
    return _carry_on(snapshot, copier, catalog, started.astimezone(timezone.utc), max_tries, n)


def _carry_on(
    snapshot: Snapshot, copier: Copier, catalog: Callable[[int], DataFrame], started: datetime,
    max_tries: int, n: int | None,
) -> Snapshot:
    """Rounds until nothing is left, from whatever state the snapshot is in, then the seal."""
    spark, names = snapshot.spark, copier.names
    if not snapshot.is_prepared():
        copier.prepare(snapshot)
    tries, attempt, complete, failures = 0, 0, False, False
    while max_tries == 0 or tries < max_tries:
        tries += 1
        claimed = snapshot.claim_round()
        if claimed is None or (attempt and claimed != attempt + 1):
            raise SnapshotError(f"another run copies into {snapshot.path}")
        attempt = claimed
        # One look at the catalog per round, however often the plans below use it.
        current = cut(catalog(attempt))
        started_before = snapshot.has_outcomes()
        if started_before:
            selected = remaining_slices(current, snapshot.copied(), names)
        else:
            selected = select_slices(current, names)
        work_units(selected, tasks(spark, n), attempt).write.parquet(snapshot.work_path(attempt))
        work = spark.read.parquet(snapshot.work_path(attempt))
        found = _check_work(work)
        if not started_before and set(names) - found:
            missing = ", ".join(sorted(set(names) - found))
            raise SnapshotError(f"no slices in the catalog for: {missing}")
        if not found:
            complete = True
            break
        copier.copy(work, snapshot, attempt)
        last = snapshot.outcomes().where(F.col("attempt") == attempt)
        if last.where("status = 'failed'").isEmpty():
            complete = True
            break
        failures = True
    # Rounds before this run's own were cut off.
    return _seal(snapshot, copier, started, complete, failures or attempt > tries)


def _check_work(work: DataFrame) -> set[str]:
    """Tables with slices to copy (among the copier's own, so few)."""
    bad_id = F.max(F.when(~F.col("slice_id").rlike(SAFE_ID), F.col("slice_id")))
    tables = work.groupBy("table_name").agg(bad_id.alias("bad")).collect()
    bad = [r.bad for r in tables if r.bad is not None]
    if bad:
        raise SnapshotError(f"slice ids may hold only letters, digits, dots, - and _: {bad}")
    return {r.table_name for r in tables}


def _delete_leftovers(snapshot: Snapshot, names: Sequence[str]) -> None:
    """What a failed slice left behind must not be taken for data."""
    path = slice_path(snapshot.data, F.col("table_name"), F.col("slice_id"))
    row_path = slice_path(
        snapshot.data, F.col("table_name"), F.concat(F.lit("slice_id="), "slice_id")
    )
    own = ["table_name", "slice_id"]
    begun = snapshot.work()
    if begun is not None:
        leftover = begun.select(*own).distinct().join(snapshot.copied(), own, "left_anti")
        cut(delete_paths(leftover.select(F.explode(F.array(path, row_path)).alias("path"))))
    # Working directories of jobs that were cut off.
    tables = local_frame(
        snapshot.spark, [(snapshot.data, f"{snapshot.data}/{t}") for t in names], "root string, path string"
    )
    staging = F.col("name").startswith(".spark-staging") | F.col("name").startswith("_temporary")
    cut(delete_paths(list_dirs(tables, 1).where("is_dir").where(staging)))


def _seal(
    snapshot: Snapshot, copier: Copier, started: datetime, complete: bool, failures: bool
) -> Snapshot:
    spark, names = snapshot.spark, sorted(copier.names)
    copied = snapshot.copied()
    tables = local_frame(spark, [(t,) for t in names], "table_name string")
    uncopied = tables.join(copied.select("table_name").distinct(), "table_name", "left_anti")
    extra = local_frame(spark, copier.extra_issues(snapshot), ISSUE)
    none = F.lit(None).cast("string")
    issues = (
        coverage_issues(copied)
        .unionByName(
            uncopied.select(
                "table_name", none.alias("start_key"), none.alias("end_key"),
                none.alias("prev_end_key"), F.lit("no slice copied").alias("issue"),
            )
        )
        .unionByName(extra)
    )
    issues.write.mode("overwrite").parquet(f"{snapshot.path}/issues")
    if failures:
        _delete_leftovers(snapshot, names)
    ended = _now()
    verified = complete and snapshot.issues().isEmpty()
    if not snapshot.put_seal(_name(spark, started, ended), started, ended, names, verified):
        raise SnapshotError(f"another run has sealed {snapshot.path}")
    return snapshot
