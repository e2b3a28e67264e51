"""Copying the rows of keyed tables, slice by slice, and checking every slice."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.functions.checksum import combine_pieces, hash_pieces, row_hash, sum_pieces
from keysnap.functions.keys import end_order, padded_key
from keysnap.operators.ordered import with_row_number
from keysnap.operators.rounds import KEY_ORDER
from keysnap.schema import OUTCOME, SLICE_COLS
from keysnap.session import cut, local_frame

# Slice boundaries of one pass are broadcast; more slices than this are copied in several passes.
MAX_SLICES_PER_PASS = 100_000
# A pass asks the scan for at most this many key ranges, which together hold its slices.
MAX_SCAN_RANGES = 32
SLICE_DIR = "slice_id"
_EXACT_DOUBLE = 1 << 53


@dataclass(frozen=True)
class KeyedTable:
    """A table to copy by key.

    ``source`` is a parquet path or a function that opens the table; it is opened again in each
    round. ``width`` gives the zero padding of an integral key in the catalog, for keys of at
    least 0; leave it out for a string key, or a binary one, which the catalog writes as hex
    text (upper case, as byte order is kept by it). ``clustered`` says that rows already lie in
    key order in the source files: they are then written without a shuffle. With
    ``check='count'`` a slice is checked by its number of rows only, which reads just the key
    from the source; ``'content'`` compares checksums over all columns.
    """

    name: str
    source: str | Callable[[SparkSession], DataFrame]
    key: str
    width: int | None = None
    clustered: bool = False
    check: str = "content"

    def open(self, spark: SparkSession) -> DataFrame:
        if callable(self.source):
            return self.source(spark)
        return spark.read.parquet(self.source)


def check_key(df: DataFrame, table: KeyedTable) -> None:
    kind = df.schema[table.key].dataType
    integral = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if integral != bool(table.width) or not (
        integral or isinstance(kind, (T.StringType, T.BinaryType))
    ):
        raise ValueError(
            f"{table.name}: key {table.key} is {kind.simpleString()}; it has to be integral, with "
            "a width, or string or binary, without one"
        )


def _is_binary(df: DataFrame, table: KeyedTable) -> bool:
    return isinstance(df.schema[table.key].dataType, T.BinaryType)


def key_column(df: DataFrame, table: KeyedTable):
    """The key as the catalog writes it."""
    if table.width:
        # Keys that do not fit come after all that do, negative ones before.
        text = F.col(table.key).cast("string")
        return (
            F.when(F.col(table.key) < 0, F.lit(""))
            .when(F.length(text) > table.width, F.concat(F.lit("~"), text))
            .otherwise(padded_key(table.key, table.width))
        )
    return F.hex(table.key) if _is_binary(df, table) else F.col(table.key)


def _key_range(df: DataFrame, table: KeyedTable, start: str, end: str):
    """Filter on the source column itself, which the scan can use to skip data."""

    def bound(key: str):
        if table.width:
            return int(key)
        return bytes.fromhex(key) if _is_binary(df, table) else key

    col = F.col(table.key)
    inside = col.isNotNull()
    if start:
        inside = inside & (col >= F.lit(bound(start)))
    if end:
        inside = inside & (col < F.lit(bound(end)))
    return inside


def pruning_filter(df: DataFrame, table: KeyedTable, slices: list[tuple[str, str, str]]):
    """Key ranges that hold the slices (in key order, apart): touching slices give one range,
    and where there are too many ranges, neighbours are put together."""
    ranges: list[tuple[str, str]] = []
    for start, end, _ in slices:
        if ranges and ranges[-1][1] == start != "":
            ranges[-1] = (ranges[-1][0], end)
        else:
            ranges.append((start, end))
    size = -(-len(ranges) // MAX_SCAN_RANGES)
    groups = [ranges[i : i + size] for i in range(0, len(ranges), size)]
    return reduce(or_, [_key_range(df, table, g[0][0], g[-1][1]) for g in groups])


def _edges(slices: list[tuple[str, str, str]]) -> tuple[list[str], list[str | None], bool]:
    """Sorted bounds, and the slice right of each bound; None where there is a hole."""
    edges: list[str] = []
    owners: list[str | None] = []
    open_end = False
    for start, end, slice_id in slices:
        if end and start >= end:
            continue  # an empty slice holds no row
        if edges and edges[-1] == start:
            owners[-1] = slice_id
        else:
            edges.append(start)
            owners.append(slice_id)
        open_end = not end
        if end:
            edges.append(end)
            owners.append(None)
    return edges, owners, open_end


def _segment(df: DataFrame, table: KeyedTable, edges: list[str]) -> DataFrame:
    """Adds the number of the edge at or before each row's key (-1 or null: before all)."""
    if table.width:
        numbers = [float("-inf") if e == "" else float(int(e)) for e in edges]
        if all(abs(n) <= _EXACT_DOUBLE for n in numbers if n != float("-inf")):
            # Binary search inside the JVM. Rounding a key to a double keeps its side of each
            # bound, as the bounds themselves are exact.
            finite = [n for n in numbers if n != float("-inf")]
            splits = [float("-inf"), *finite, float("inf")]
            if len(splits) < 3:
                return df.withColumn("segment", F.when(F.col(table.key).isNotNull(), F.lit(0)))
            found = Bucketizer(
                splits=splits, inputCol="key_number", outputCol="bucket", handleInvalid="keep"
            ).transform(df.withColumn("key_number", F.col(table.key).cast("double")))
            shift = 0 if len(finite) < len(numbers) else 1
            known = F.when(F.col(table.key).isNotNull(), F.col("bucket").cast("int") - shift)
            return found.withColumn("segment", known).drop("key_number", "bucket")

    # Keys of any length are compared as they are: an array of fixed width would pad them all to
    # the longest. Hex text keeps byte order.
    bounds = [_hex(e) for e in edges]

    @F.pandas_udf("int")
    def search(keys: pd.Series) -> pd.Series:
        places = [bisect_right(bounds, k) - 1 if isinstance(k, str) else None for k in keys]
        return pd.Series(places, dtype="Int32")

    return df.withColumn("segment", search(F.hex(key_column(df, table))))


def _hex(key: str) -> str:
    return key.encode("utf-8").hex().upper()


def tag_rows(df: DataFrame, table: KeyedTable, slices: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``slice_id``: the slice whose range holds the row's key; null when there is none.

    ``slices``: (start, end, slice_id) in key order, without overlaps, at most
    ``MAX_SLICES_PER_PASS`` of them; so the lookup table is small enough to broadcast.
    """
    edges, owners, _ = _edges(slices)
    spark = df.sparkSession
    if not edges:
        return df.withColumn(SLICE_DIR, F.lit(None).cast("string"))
    lookup = local_frame(
        spark,
        [(i, o) for i, o in enumerate(owners) if o is not None],
        f"segment int, {SLICE_DIR} string",
    )
    return (
        _segment(df, table, edges).join(F.broadcast(lookup), "segment", "left").drop("segment")
    )


def checked_columns(schema: T.StructType, check: str) -> T.StructType:
    """The columns whose content is compared: all of them, or none."""
    if check not in ("content", "count"):
        raise ValueError(f"check is content or count, not {check}")
    return schema if check == "content" else T.StructType([])


TOTALS = ["total_0", "total_1", "total_2"]


def in_slice(hashed: Column) -> Column:
    """A row's hash together with its slice: a row in the wrong slice changes the sum."""
    return F.xxhash64(hashed, F.col(SLICE_DIR))


def observed_totals(tagged: DataFrame, schema: T.StructType, seen: Observation) -> DataFrame:
    """``tagged``, whose rows are counted and summed up in ``seen`` on their way to the writer."""
    name = "row_hash_"
    while name in tagged.columns:
        name += "_"
    pieces = hash_pieces(F.col(name)).values()
    sums = [F.coalesce(F.sum(p), F.lit(0)).alias(t) for p, t in zip(pieces, TOTALS)]
    hashed = tagged.withColumn(name, in_slice(row_hash(schema)))
    return hashed.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).drop(name)


def slice_stats(tagged: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows and checksum pieces per slice over the columns of ``schema``; partial sums are built
    before the shuffle."""
    return (
        tagged.select(SLICE_DIR, row_hash(schema).alias("h"))
        .select(SLICE_DIR, *[c.alias(n) for n, c in hash_pieces(F.col("h")).items()])
        .groupBy(SLICE_DIR)
        .agg(F.count(F.lit(1)).alias("rows"), *sum_pieces())
    )


def stored_stats(stored: DataFrame, schema: T.StructType) -> DataFrame:
    """As :func:`slice_stats` for slices on disk, with their files and bytes, and the sums that
    :func:`observed_totals` gives over all rows."""
    totals = [F.sum(t).alias(t) for t in TOTALS]
    return (
        stored.select(
            SLICE_DIR,
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            row_hash(schema).alias("h"),
        )
        .select(
            SLICE_DIR, "file", "size",
            *[c.alias(n) for n, c in hash_pieces(F.col("h")).items()],
            *[c.alias(t) for t, c in zip(TOTALS, hash_pieces(in_slice(F.col("h"))).values())],
        )
        .groupBy(SLICE_DIR, "file")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"), *sum_pieces(), *totals)
        .groupBy(SLICE_DIR)
        .agg(
            F.sum("rows").alias("rows"),
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("bytes"),
            *sum_pieces(),
            *totals,
        )
    )


def stored_schema(schema: T.StructType) -> T.StructType:
    """Slice ids are read as text, whatever they look like."""
    return T.StructType([*schema.fields, T.StructField(SLICE_DIR, T.StringType())])


def read_slices(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(stored_schema(schema)).parquet(path)


def write_slices(tagged: DataFrame, path: str, clustered: bool) -> None:
    """Writes one directory per slice, replacing earlier copies of just these slices.

    Unless the rows lie in key order already, those of a slice are brought together first, or
    every task would write a file for every slice. The rebalance hint lets adaptive execution
    split a slice with very many rows over several tasks, and merge small ones.
    """
    rows = tagged.where(F.col(SLICE_DIR).isNotNull())
    if not clustered:
        rows = rows.hint("rebalance", SLICE_DIR)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(SLICE_DIR)
        .parquet(path)
    )


class OverlapError(RuntimeError):
    """Slices to copy overlap: their rows would be stored twice."""


def check_apart(
    name: str, slices: list[tuple[str, str, str]], reached: str | None
) -> str | None:
    """Raises if slices (in key order) overlap. ``reached`` is where those before them end (None:
    there were none); returns where these end."""
    for start, end, slice_id in slices:
        if end and start >= end:
            continue
        if reached is not None and (reached == "" or start < reached):
            raise OverlapError(f"{name}: slice {slice_id} overlaps the one before it")
        reached = end
    return reached


def _passes(work: DataFrame, table: str, limit: int):
    """The table's work in runs of at most ``limit`` consecutive slices; also says whether a run
    is all of it."""
    own = work.where(F.col("table_name") == table)
    total = own.count()
    if total <= limit:
        if total:
            yield own, True
        return
    numbered = with_row_number(own, KEY_ORDER, "position")
    for start in range(0, total, limit):
        inside = F.col("position").between(start, start + limit - 1)
        yield numbered.where(inside).drop("position"), False


def copy_slices(
    work: DataFrame,
    table: KeyedTable,
    root: str,
    attempt: int,
    out: str,
    fault: Callable[[DataFrame, str, int], DataFrame] | None = None,
    max_slices: int = MAX_SLICES_PER_PASS,
) -> None:
    """Copies the table's slices in ``work`` below ``root`` and appends OUTCOME rows to ``out``.

    A slice counts as copied when what was stored has the row count and checksum of the source. The
    source is read once: its rows are summed up (each hash together with the slice) on their way to
    the writer, and compared with the sums of what was stored. Only if those differ is the source
    read again, to tell which slices are wrong. An error of the job as a whole is raised. Rows without a key belong to no slice; they are
    reported by :func:`rows_without_key`. ``fault`` is for tests: it changes the rows on their
    way to the writer.
    """
    spark = work.sparkSession
    path = f"{root}/{table.name}"
    reached: str | None = None
    for chosen, whole in _passes(work, table.name, max_slices):
        ordered = chosen.orderBy("start_key", end_order("end_key"))
        # At most max_slices rows.
        slices = [
            (r.start_key, r.end_key, r.slice_id)
            for r in ordered.select("start_key", "end_key", "slice_id").collect()
        ]
        reached = check_apart(table.name, slices, reached)
        source = table.open(spark)
        schema = source.schema
        check_key(source, table)
        if SLICE_DIR in schema.names:
            raise ValueError(f"{table.name}: column name {SLICE_DIR} is taken")
        source = source.where(pruning_filter(source, table, slices))
        tagged = tag_rows(source, table, slices)
        checked = checked_columns(schema, table.check)
        inside = tagged.where(F.col(SLICE_DIR).isNotNull())
        seen = Observation()
        watched = observed_totals(inside, checked, seen)
        write_slices(fault(watched, table.name, attempt) if fault else watched, path,
                     table.clustered)
        stored = read_slices(spark, path, schema)
        if attempt > 1 or not whole:
            # Other slices are there as well; their directories are not read.
            stored = stored.where(F.col(SLICE_DIR).isin([s[2] for s in slices]))
        found = cut(stored_stats(stored, checked))  # a row for each slice
        expected = found if same_totals(seen, found) else slice_stats(inside, checked)
        outcomes = compare_stats(chosen, expected, found, attempt)
        outcomes.write.mode("append").parquet(out)


def same_totals(seen: Observation, found: DataFrame) -> bool:
    """Whether the rows on their way to the writer and those in the store sum up to the same."""
    names = ["rows", *TOTALS]
    have = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).head()
    want = seen.get
    return all(int(want[c]) == int(have[c]) for c in names)


def compare_stats(
    work: DataFrame, expected: DataFrame, found: DataFrame, attempt: int
) -> DataFrame:
    """OUTCOME rows: each slice of ``work`` with what was expected and what was found."""
    want = expected.select(
        SLICE_DIR, F.col("rows").alias("want_rows"), combine_pieces().alias("want_sum")
    )
    have = found.select(
        SLICE_DIR, F.col("rows").alias("have_rows"), combine_pieces().alias("have_sum"),
        "files", "bytes",
    )
    zero = F.lit(0).cast("bigint")
    zero_sum = F.lit(0).cast("decimal(38,0)")
    joined = (
        work.select(*SLICE_COLS)
        .join(want, SLICE_DIR, "left")
        .join(have, SLICE_DIR, "left")
        .fillna(0, ["want_rows", "have_rows", "files", "bytes"])
        .withColumns(
            {
                "want_sum": F.coalesce("want_sum", zero_sum),
                "have_sum": F.coalesce("have_sum", zero_sum),
            }
        )
    )
    error = F.when(
        F.col("want_rows") != F.col("have_rows"),
        F.format_string("%d of %d rows stored", "have_rows", "want_rows"),
    ).when(F.col("want_sum") != F.col("have_sum"), F.lit("content differs"))
    return joined.select(
        *SLICE_COLS,
        F.lit(attempt).alias("attempt"),
        F.when(error.isNull(), "copied").otherwise("failed").alias("status"),
        F.coalesce("files", zero).alias("files"),
        F.coalesce("bytes", zero).alias("bytes"),
        F.col("have_rows").alias("rows"),
        F.col("have_sum").alias("checksum"),
        error.alias("error"),
    ).to(OUTCOME)


def rows_without_key(spark: SparkSession, table: KeyedTable) -> int:
    """Rows with a null key; only the key column is read, and often only its statistics."""
    return table.open(spark).where(F.col(table.key).isNull()).count()
