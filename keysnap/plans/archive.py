"""One run of the log archive over real directories."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.operators.logs import (
    empty_days, expired_logs, expiry_mark, list_logs, new_logs, stale_logs, unexpired_logs,
    with_start,
)
from keysnap.schema import RUN_STATS
from keysnap.session import cut, local_frame
from keysnap.sources.files import PARTIAL_PREFIX, delete_paths
from keysnap.sources.listing import list_files
from keysnap.sources.ranges import copy_all
from keysnap.sources.storage import exists


def scan_sources(spark: SparkSession, sources: Sequence[str], parallelism: int | None) -> DataFrame:
    """Files below the source directories; ``priority`` is the directory's place in the list."""
    there = [s.rstrip("/") for s in sources if exists(spark, s)]
    places = {s: i for i, s in enumerate(there)}
    listed = list_files(spark, there, recursive=True, parallelism=parallelism)
    rank = F.create_map(*[F.lit(v) for kv in places.items() for v in kv]) if places else None
    priority = F.lit(0) if rank is None else rank[F.col("root")]
    return listed.where(~F.col("is_dir")).withColumn("priority", priority)


def scan_archive(spark: SparkSession, archive: str, parallelism: int | None) -> DataFrame:
    """Everything in the archive; ``day`` is the directory directly below it."""
    if not exists(spark, archive):
        dirs: list[str] = []
    else:
        dirs = [archive]
    listed = list_files(spark, dirs, recursive=True, parallelism=parallelism)
    return listed.withColumn("day", F.split("rel_path", "/").getItem(1))


def archive_once(
    spark: SparkSession,
    sources: Sequence[str],
    archive: str,
    run_start: datetime | None = None,
    days: int = 0,
    run: int = 0,
    fallback_roots: Sequence[str] = (),
    parallelism: int | None = None,
) -> DataFrame:
    """Copies new and grown logs into ``archive/<day of the run>`` and returns one RUN_STATS row.

    ``sources`` go from old logs to live ones: of two files with one name the earlier source's
    is taken. A log that is gone when its turn comes is looked for by name in the other sources,
    then in ``fallback_roots``. Archived files older than ``days`` are deleted (0: kept for
    ever), as are day directories left empty. The archive's own listing is the only state, so a
    run that is repeated, or was cut short, does what is still missing. A replaced copy is
    deleted only once the new one is in place.
    """
    began = datetime.now(timezone.utc)
    moment = run_start or began
    run_ms = int(moment.timestamp() * 1000)
    archive = archive.rstrip("/")
    mark = expiry_mark(run_ms, days)

    logs = cut(list_logs(scan_sources(spark, sources, parallelism)))
    held = with_start(scan_archive(spark, archive, parallelism))
    files = held.where(~F.col("is_dir"))
    # Half-written files of a run that was cut short.
    partial = F.col("name").startswith(PARTIAL_PREFIX)
    cut(delete_paths(files.where(partial), parallelism))
    files = files.where(~partial)
    archived = files.where("start_ms is not null")
    new = cut(new_logs(logs, archived, mark))

    expired = expired_logs(archived, run_ms, days).select("path")
    removed = cut(delete_paths(expired, parallelism))
    gone = removed.where("deleted")
    n_expired = gone.count()

    day_dirs = held.where("is_dir and rel_path = concat('/', name)").select("path", "day")
    left = files.join(gone.select("path"), "path", "left_anti")
    n_days = cut(delete_paths(empty_days(day_dirs, left, mark), parallelism)).where(
        "deleted"
    ).count()

    day = moment.astimezone(timezone.utc).strftime("%Y-%m-%d")
    elsewhere = [s.rstrip("/") for s in (*sources, *fallback_roots)]
    plan = new.select(
        F.col("path").alias("source_path"),
        F.concat_ws("/", F.lit(archive), F.lit(day), "name").alias("dest_path"),
        F.array(*[F.concat_ws("/", F.lit(r), "name") for r in elsewhere]).alias("fallbacks"),
        "length",
    )
    outcomes = cut(copy_all(plan, parallelism))
    counts = outcomes.agg(
        F.count_if(F.col("status") == "copied").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("bad"),
    ).head()

    arrived = outcomes.where("status = 'copied'").select(
        F.col("dest_path").alias("path"), F.substring_index("dest_path", "/", -1).alias("name")
    )
    stale = cut(stale_logs(arrived, unexpired_logs(archived, run_ms, days)))
    # A copy of the same day was replaced by the rename already.
    others = stale.join(arrived.select("path"), "path", "left_anti")
    cut(delete_paths(others, parallelism))

    row = (
        run, moment, datetime.now(timezone.utc), counts.ok, counts.bad, stale.count(),
        n_expired, n_days,
    )
    return local_frame(spark, [row], RUN_STATS)
