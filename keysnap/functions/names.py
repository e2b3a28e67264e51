"""Snapshot names: ``bak-<start>`` while running and ``bak-<start>-<end>`` once sealed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysnap.schema import SNAPSHOT_PREFIX, STAMP_FORMAT


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def format_snapshot_name(start: Column, end: Column | None = None) -> Column:
    parts = [F.lit(SNAPSHOT_PREFIX), stamp(start)]
    return F.concat_ws("-", *parts, *([] if end is None else [stamp(end)]))


def parse_snapshot_names(names: DataFrame, ignore_bad_name: bool = False) -> DataFrame:
    """Adds ``started`` and ``ended``; rows whose name is not valid are left out.

    A valid name has exactly three parts, the prefix and two times, the first strictly before
    the second. With ``ignore_bad_name`` every row is kept, and times that cannot be read are
    null.
    """
    parts = F.split("name", "-")
    well_formed = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == SNAPSHOT_PREFIX)
    started, ended = (
        F.when(well_formed, F.try_to_timestamp(F.get(parts, F.lit(i)), F.lit(STAMP_FORMAT)))
        for i in (1, 2)
    )
    both = started.isNotNull() & ended.isNotNull()
    parsed = names.withColumns(
        {"started": F.when(both, started), "ended": F.when(both, ended)}
    )
    return parsed if ignore_bad_name else parsed.where("started < ended")
