"""Comparing log files with their archive. Every step is a join, an aggregate or a filter.

Logs have ``name``, ``length``, ``start_ms`` and ``path``; archive rows also have ``day``, the
day of the run that copied them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysnap.functions.text import duration_text, log_start_ms
from keysnap.operators.ordered import Order, with_running_sum
from keysnap.schema import DAY_FORMAT

DAY_MS = 86_400_000
MAX_LONG = 9223372036854775807


def with_start(files: DataFrame) -> DataFrame:
    """Adds the start time in each name; null marks a file that is not a log."""
    return files.withColumn("start_ms", log_start_ms(F.col("name")))


def list_logs(files: DataFrame, min_start: int | None = None) -> DataFrame:
    """Logs among listed files, one row per name.

    ``files`` has ``priority``: where a log is in several places, the lowest number is taken
    (old logs before live ones), then the first path.
    """
    logs = with_start(files).where("start_ms is not null")
    if min_start is not None:
        logs = logs.where(F.col("start_ms") >= min_start)
    others = [c for c in logs.columns if c != "name"]
    first = F.min_by(F.struct(*others), F.struct("priority", "path"))
    return logs.groupBy("name").agg(first.alias("pick")).select("name", "pick.*").select(
        *logs.columns
    )


def invalid_logs(files: DataFrame) -> DataFrame:
    """Files whose name does not end in a number after its last dot."""
    return with_start(files).where("start_ms is null").drop("start_ms")


def colliding_logs(files: DataFrame) -> DataFrame:
    """Names found in more than one place, with how often."""
    logs = with_start(files).where("start_ms is not null")
    return logs.groupBy("name").agg(F.count(F.lit(1)).alias("places")).where("places > 1")


def oldest_start(logs: DataFrame) -> DataFrame:
    """One row with the smallest start time, or the largest long when there are no logs."""
    return logs.agg(F.coalesce(F.min("start_ms"), F.lit(MAX_LONG)).alias("oldest_start_ms"))


def expiry_mark(run_start_ms: int, days: int) -> int | None:
    """Logs that started at or before the mark are too old; None when nothing expires."""
    return run_start_ms - days * DAY_MS if days > 0 else None


def new_logs(logs: DataFrame, archive: DataFrame, mark: int | None = None) -> DataFrame:
    """Logs with content that the archive lacks or holds with another length.

    Logs past the mark are left out: they would be deleted from the archive in the next run and
    copied again in the one after.
    """
    wanted = logs.where("length > 0")
    if mark is not None:
        wanted = wanted.where(F.col("start_ms") > mark)
    held = archive.select("name", "length").distinct()
    return wanted.join(held, ["name", "length"], "left_anti").select(*logs.columns)


def stale_logs(new: DataFrame, archive: DataFrame) -> DataFrame:
    """Archived files that a new log of the same name replaces."""
    return archive.join(new.select("name").distinct(), "name", "left_semi").select(
        *archive.columns
    )


def expired_logs(archive: DataFrame, run_start_ms: int, days: int) -> DataFrame:
    mark = expiry_mark(run_start_ms, days)
    return archive.where(F.lit(False) if mark is None else F.col("start_ms") <= mark)


def unexpired_logs(archive: DataFrame, run_start_ms: int, days: int) -> DataFrame:
    """The others, among them files that are not logs."""
    mark = expiry_mark(run_start_ms, days)
    if mark is None:
        return archive
    return archive.where(F.col("start_ms").isNull() | (F.col("start_ms") > mark))


def retained_logs(
    archive: DataFrame, new: DataFrame, run_start_ms: int, days: int
) -> DataFrame:
    """What stays in the archive: neither expired nor replaced."""
    kept = unexpired_logs(archive, run_start_ms, days)
    return kept.join(new.select("name").distinct(), "name", "left_anti").select(*archive.columns)


def day_millis(day: Column) -> Column:
    """Start of the day named by a directory, in epoch millis; null when it names no day."""
    moment = F.when(
        day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit(DAY_FORMAT))
    )
    return F.unix_millis(moment)


def empty_days(days: DataFrame, files: DataFrame, mark: int | None) -> DataFrame:
    """Day directories at or before the mark that hold no file."""
    if mark is None:
        return days.where(F.lit(False))
    old = days.where(day_millis(F.col("day")) <= mark)
    return old.join(files.select("day").distinct(), "day", "left_anti").select(*days.columns)


def archive_plan(
    logs: DataFrame, archive: DataFrame, run_start_ms: int, days: int
) -> DataFrame:
    """What one run does: ``name, length, start_ms, action``, where the action is ``copy``,
    ``replace`` (an old copy goes), ``expire`` or ``keep``.

    New logs are found against the archive before expiry, old copies against the archive after
    it, so a file is not both expired and replaced.
    """
    cols = ["name", "length", "start_ms"]
    mark = expiry_mark(run_start_ms, days)
    new = new_logs(logs, archive, mark)
    alive = unexpired_logs(archive, run_start_ms, days)
    parts = {
        "copy": new,
        "replace": stale_logs(new, alive),
        "expire": expired_logs(archive, run_start_ms, days),
        "keep": retained_logs(archive, new, run_start_ms, days),
    }
    frames = [df.select(*cols, F.lit(action).alias("action")) for action, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def archive_stats(runs: DataFrame) -> DataFrame:
    """Each run with the totals so far and its duration as text."""
    order = Order((), ("run",))
    out = runs
    for name in ("copied", "failed"):
        out = with_running_sum(out, order, F.col(name), f"total_{name}")
    ended, started = (F.unix_millis(F.col(c).cast("timestamp")) for c in ("ended", "started"))
    millis = ended - started
    return out.withColumn("duration", duration_text(millis))
