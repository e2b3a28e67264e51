"""What the corpus operators share: reading tables, keeping intermediate tables, row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.session import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again.

    Cuts the lineage: a lost executor costs a reread, and plans on the result share its work.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join in which both are dealt out by key and sorted, whatever their size.

    The planner takes a table for as large as its compressed files, and what an explode makes of it for
    no larger, so by itself it broadcasts tables that the driver cannot hold.
    """
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_text(
    df: DataFrame,
    text: str,
    fields: T.StructType,
    each: Callable[[], Callable[[str | None], tuple]],
    keep: list[str],
    rows: int | None = None,
) -> DataFrame:
    """The columns ``keep`` and, for each row, the fields that a function makes of its text.

    ``each`` is called once for each task and returns that function. Rows stream through in Arrow
    batches; the text itself goes no further unless it is among ``keep``. With ``rows`` results go
    back in batches of so many rows, so that both sides hold little at a time where texts are kept.
    """
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([source.schema[c] for c in keep] + fields.fields)
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        make = each()
        whole = batches
        if rows:
            whole = (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        for batch in whole:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at)
            # A few rows at a time: whole batches of long texts are never held as Python objects.
            made: list[tuple] = []
            for i in range(0, batch.num_rows, 256):
                made.extend(make(t) for t in texts.slice(i, 256).to_pylist())
            columns = list(zip(*made)) if made else [() for _ in names]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(v, f.type) for v, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return source.mapInArrow(run, schema)


def numbered(df: DataFrame, order: list[str], label: str, name: str = "rank") -> DataFrame:
    """``df`` with gapless positions from 0 in the given order, without a window over all rows.

    Rows are dealt out by range and sorted within each partition; one count for each partition
    makes its rows' numbers global. ``order`` should end in a column without ties, so that no
    value, however frequent, keeps a partition from being split.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = stored(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(name, F.monotonically_increasing_id()),
        label,
    )
    part, row = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    # One row for each partition: at most a few thousand, whatever the size of the table.
    sizes = sorted((r["part"], r["n"]) for r in tag.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if not starts:
        return tag
    offset = F.broadcast(spark.createDataFrame(starts, f"{name}_part long, {name}_start long"))
    return (
        tag.join(offset, part == F.col(f"{name}_part"))
        .withColumn(name, F.col(f"{name}_start") + row)
        .drop(f"{name}_part", f"{name}_start")
    )


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
