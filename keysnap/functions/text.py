"""Parsing of server names, paths and log file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysnap.schema import DEFAULT_PORT


def server_host(server: Column) -> Column:
    """Text before the first colon."""
    return F.split(server, ":").getItem(0)


def server_port(server: Column, default: int = DEFAULT_PORT) -> Column:
    """Number between the first and the second colon, or ``default`` when there is none."""
    text = F.get(F.split(server, ":"), F.lit(1))
    return F.coalesce(
        F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")), F.lit(default)
    )


def endpoint_host(endpoint: Column) -> Column:
    """Text before the last colon of ``host:port`` (the whole text when there is no colon)."""
    return F.regexp_replace(endpoint, r":[^:]*$", "")


def endpoint_port(endpoint: Column) -> Column:
    """Number after the last colon of ``host:port``; null when it is not a number."""
    text = F.substring_index(endpoint, ":", -1)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def relative_path(path: Column, root: str | Column) -> Column:
    """The part of ``path`` after ``root``; null when the path is not below the root."""
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return F.when(
        path.startswith(F.concat(base, F.lit("/"))), path.substr(F.length(base) + 1, F.length(path))
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slice_path(root: str | Column, table: Column, slice_id: Column) -> Column:
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return F.concat_ws("/", base, table, slice_id)


def log_start_ms(name: Column) -> Column:
    """Start time written after the last dot of a log's name; null when it is not a number."""
    text = F.substring_index(name, ".", -1)
    return F.when(name.contains(".") & text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))


def duration_text(millis: Column) -> Column:
    """``"<minutes>m, <seconds>s"``"""
    seconds = F.floor(millis / F.lit(1000)).cast("bigint")
    return F.format_string(
        "%dm, %ds", F.floor(seconds / F.lit(60)).cast("bigint"), F.pmod(seconds, F.lit(60))
    )
