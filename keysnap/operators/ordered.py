"""Ordered computations (previous row, running maximum, row number) over large groups.

A window partitioned by table alone would put a table with a third of all rows into one task.
Here rows are dealt out by ranges of the order, and each range is a chunk: a window partition of
its own. What a chunk needs to know about the ones before it comes from a summary with one row
per (group, chunk). The plan is the same for inputs of every size; keys and groups may be null.

The dealt rows are kept in the shared folder, so windows and summary see the same chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysnap.session import cut

CHUNK = "order_chunk"


@dataclass(frozen=True)
class Order:
    """``group`` columns first, then ``by``; ``ends`` names the columns of ``by`` holding end
    keys, where the empty key sorts last. Few rows may share all of these columns, as such rows
    cannot be parted into different chunks."""

    group: tuple[str, ...]
    by: tuple[str, ...]
    ends: tuple[str, ...] = ()

    def sort_columns(self, names: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for name in names:
            if name in self.ends:
                out.append(F.length(name) == 0)
            out.append(F.col(name))
        return out

    def within(self) -> Column:
        cols = self.sort_columns(self.by)
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def with_chunks(df: DataFrame, order: Order, chunks: int | None = None) -> DataFrame:
    """Adds the number of the range that a row's key lies in, counted in key order.

    As many ranges as shuffle partitions, unless ``chunks`` says otherwise.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = order.sort_columns(order.group + order.by)
    return cut(df.repartitionByRange(n, *keys).withColumn(CHUNK, F.spark_partition_id()))


def _windows(order: Order):
    local = Window.partitionBy(*order.group, CHUNK).orderBy(*order.sort_columns(order.by))
    across = Window.partitionBy(*order.group).orderBy(CHUNK)
    return local, across


def _join_carry(rows: DataFrame, carry: DataFrame, order: Order) -> DataFrame:
    """Adds the columns of ``carry``, one row per (group, chunk); groups may be null."""
    keys = [*order.group, CHUNK]
    own = [f"carry_{k}" for k in keys]
    renamed = carry.withColumnsRenamed(dict(zip(keys, own)))
    same = F.lit(True)
    for key, name in zip(keys, own):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return rows.join(renamed, same).drop(*own)


def with_previous(df: DataFrame, order: Order, column: str, out: str, **sizes: int) -> DataFrame:
    """Adds ``column`` of the previous row of the same group; null in the first row."""
    chunked = with_chunks(df, order, **sizes)
    local, across = _windows(order)
    first = F.row_number().over(local) == 1
    carry = (
        chunked.groupBy(*order.group, CHUNK)
        .agg(F.max_by(column, order.within()).alias("last"))
        .withColumn("carry", F.lag("last").over(across))
        .drop("last")
    )
    placed = chunked.withColumns({"here": F.lag(column).over(local), "first": first})
    joined = _join_carry(placed, carry, order)
    # The previous value itself may be null: only a chunk's first row asks the chunk before.
    value = F.when(F.col("first"), F.col("carry")).otherwise(F.col("here"))
    return joined.withColumn(out, value).drop("here", "first", "carry", CHUNK)


def _running(df, order, value, out, aggregate, merge, sizes) -> DataFrame:
    chunked = with_chunks(df, order, **sizes)
    local, across = _windows(order)
    here = aggregate(value).over(local.rowsBetween(Window.unboundedPreceding, 0))
    carry = (
        chunked.groupBy(*order.group, CHUNK)
        .agg(aggregate(value).alias("whole"))
        .withColumn(
            "carry",
            aggregate(F.col("whole")).over(across.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("whole")
    )
    joined = _join_carry(chunked.withColumn("here", here), carry, order)
    return joined.withColumn(out, merge(F.col("here"), F.col("carry"))).drop("here", "carry", CHUNK)


def with_running_max(df: DataFrame, order: Order, value: Column, out: str, **sizes: int):
    """Adds the maximum of ``value`` over the rows up to and including this one."""
    return _running(df, order, value, out, F.max, F.greatest, sizes)


def with_running_sum(df: DataFrame, order: Order, value: Column, out: str, **sizes: int):
    """Adds the sum of ``value`` over the rows up to and including this one."""

    def merge(here: Column, carry: Column) -> Column:
        return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))

    return _running(df, order, value, out, F.sum, merge, sizes)


def with_row_number(df: DataFrame, order: Order, out: str, **sizes: int) -> DataFrame:
    """Adds the 0-based position within the group (over everything when there is none)."""
    numbered = with_running_sum(df, order, F.lit(1).cast("bigint"), out, **sizes)
    return numbered.withColumn(out, F.col(out) - 1)
