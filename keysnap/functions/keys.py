"""Key order. Keys compare as unsigned bytes; an empty end key means "no upper bound"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_key(value: Column | str, width: int = 12) -> Column:
    """Zero-padded text of a non-negative integral key, so that byte order is numeric order."""
    col = F.col(value) if isinstance(value, str) else value
    return F.lpad(col.cast("string"), width, "0")


def is_empty(key: Column) -> Column:
    return F.length(key) == 0


def end_order(end: Column | str) -> Column:
    """A sortable form of an end key in which the empty key comes after every other key."""
    col = F.col(end) if isinstance(end, str) else end
    return F.struct(is_empty(col).alias("inf"), col.alias("end"))


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """True when ``[start, end)`` lies within ``[outer_start, outer_end)``; reflexive."""
    return (outer_start <= start) & (end_order(end) <= end_order(outer_end))
