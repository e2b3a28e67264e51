"""Containment between key ranges, and gaps or overlaps among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysnap.functions.keys import end_order, is_empty
from keysnap.operators.ordered import Order, with_previous, with_running_max

RANGE = ["table_name", "start_key", "end_key"]


def _contained_ranges(candidates: DataFrame, covers: DataFrame, **sizes: int) -> DataFrame:
    """Distinct candidate ranges that lie within one covering range.

    A range is contained exactly when, among the covers starting at or before it, the largest
    end reaches its own end. That is a running maximum in start order: no join of ranges and so
    no quadratic step. Covers with one start are first reduced to the one with the largest end.
    """
    best = covers.groupBy("table_name", "start_key").agg(
        F.max(end_order("end_key")).alias("cover_end")
    )
    asked = candidates.select(*RANGE).distinct()
    no_end = F.lit("").cast(asked.schema["end_key"].dataType)
    rows = best.select(
        "table_name", "start_key", F.lit(0).alias("kind"), no_end.alias("end_key"), "cover_end"
    ).unionByName(
        asked.select("table_name", "start_key", F.lit(1).alias("kind"), "end_key"),
        allowMissingColumns=True,
    )
    # At equal starts covers come before candidates.
    order = Order(("table_name",), ("start_key", "kind", "end_key"), ends=("end_key",))
    reach = with_running_max(rows, order, F.col("cover_end"), "reach", **sizes)
    return reach.where((F.col("kind") == 1) & (F.col("reach") >= end_order("end_key"))).select(
        *RANGE
    )


def contained_slices(candidates: DataFrame, covers: DataFrame, **sizes: int) -> DataFrame:
    """Candidates whose key range lies within the range of one cover of the same table."""
    ranges = _contained_ranges(candidates, covers, **sizes)
    return candidates.join(ranges, RANGE, "left_semi").select(*candidates.columns)


def not_contained_slices(candidates: DataFrame, covers: DataFrame, **sizes: int) -> DataFrame:
    """The other candidates: whole ranges still to be covered."""
    ranges = _contained_ranges(candidates, covers, **sizes)
    return candidates.join(ranges, RANGE, "left_anti").select(*candidates.columns)


def coverage_issues(slices: DataFrame, **sizes: int) -> DataFrame:
    """Where the slices of a table fail to tile its key space, one row per breach.

    ``single``: the only slice is bounded; ``first_start``/``last_end``: the first start or last
    end is not open; ``gap``/``overlap``: a slice does not start where the one before it ends.
    One slice can breach two rules. No rows means that the slices tile every table present.
    """
    ranges = slices.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("copies"))
    none = F.lit(None).cast(ranges.schema["end_key"].dataType)

    place = F.struct("start_key", end_order("end_key").alias("end_order"))
    tables = ranges.groupBy("table_name").agg(
        F.sum("copies").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    first_start, first_end = F.col("first.start_key"), F.col("first.end_order.end")
    last_start, last_end = F.col("last.start_key"), F.col("last.end_order.end")
    single = F.col("n") == 1

    def edge(condition, start, end, issue):
        row = F.struct(
            start.alias("start_key"), end.alias("end_key"), none.alias("prev_end_key"),
            F.lit(issue).alias("issue"),
        )
        return F.when(condition, row)

    edges = tables.select(
        "table_name",
        F.explode(
            F.filter(
                F.array(
                    edge(single & ~(is_empty(first_start) & is_empty(first_end)),
                         first_start, first_end, "single"),
                    edge(~single & ~is_empty(first_start), first_start, first_end, "first_start"),
                    edge(~single & ~is_empty(last_end), last_start, last_end, "last_end"),
                ),
                lambda r: r.isNotNull(),
            )
        ).alias("row"),
    ).select("table_name", "row.*")

    order = Order(("table_name",), ("start_key", "end_key"), ends=("end_key",))
    prev = F.col("prev_end_key")
    start = F.col("start_key")
    issue = F.when(is_empty(prev) | (start < prev), "overlap").when(start > prev, "gap")
    neighbours = with_previous(ranges, order, "end_key", "prev_end_key", **sizes)
    adjacent = neighbours.select(*RANGE, "prev_end_key", issue.alias("issue"))
    # A further copy of the same range follows the first one.
    repeats = (
        ranges.where("copies > 1 and (length(end_key) = 0 or start_key <> end_key)")
        .withColumn("prev_end_key", F.col("end_key"))
        .withColumn("issue", F.lit("overlap"))
        .withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies"))))
        .select(*RANGE, "prev_end_key", "issue")
    )
    return edges.unionByName(adjacent.where("issue is not null")).unionByName(repeats)
