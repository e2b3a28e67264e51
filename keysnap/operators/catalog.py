"""Catalog of slices: scan, decode, selection and grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.functions.keys import end_order
from keysnap.functions.text import server_host, server_port, slice_path
from keysnap.schema import CATALOG_COLS, DEFAULT_PORT, IDENTITY, SLICE_BLOB, SLICE_COLS

RAW_COLS = ["row_key", "blob", "server", "server_start_code", "split_a", "split_b"]


def scan_catalog(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Raw catalog rows from a parquet path, a table name or a DataFrame; only the six columns
    that decoding needs are read."""
    if isinstance(source, DataFrame):
        raw = source
    elif "/" in source:
        raw = spark.read.parquet(source)
    else:
        raw = spark.read.table(source)
    return raw.select(*RAW_COLS)


def _blob(name: str) -> Column:
    """The slice in a JSON blob; null when the blob is absent or holds no slice."""
    parsed = F.from_json(name, SLICE_BLOB)
    whole = F.lit(True)
    for field in ("table_name", "start_key", "end_key", "region_id"):
        whole = whole & parsed[field].isNotNull()
    return F.when(whole, parsed)


def _split_child(name: str) -> Column:
    parsed = F.col(name)
    return F.when(parsed.isNotNull(), F.struct(*[parsed[c].alias(c) for c in SLICE_COLS]))


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {"slice": _blob("blob"), "child_a": _blob("split_a"), "child_b": _blob("split_b")}
    )


def decode_catalog(raw: DataFrame, default_port: int = DEFAULT_PORT) -> DataFrame:
    """Typed catalog rows. Rows without a readable slice or a server go to
    :func:`catalog_rejects` instead."""
    server = F.col("server")
    return (
        _parsed(raw)
        .where("slice is not null and server is not null")
        .select(
            *[F.col(f"slice.{c}").alias(c) for c in SLICE_COLS],
            "row_key",
            "server",
            server_host(server).alias("host"),
            server_port(server, default_port).alias("port"),
            "server_start_code",
            F.coalesce("slice.is_split", F.lit(False)).alias("is_split"),
            F.coalesce("slice.is_offline", F.lit(False)).alias("is_offline"),
            _split_child("child_a").alias("split_a"),
            _split_child("child_b").alias("split_b"),
        )
    )


def catalog_rejects(raw: DataFrame) -> DataFrame:
    """Rows that cannot be decoded, with the reason."""
    reason = F.when(F.col("slice").isNull(), "unreadable slice").when(
        F.col("server").isNull(), "no server"
    )
    return _parsed(raw).select("row_key", reason.alias("reason")).where("reason is not null")


def encode_catalog(catalog: DataFrame) -> DataFrame:
    """The raw form of typed rows; the opposite of :func:`decode_catalog`."""
    own = F.struct(*SLICE_COLS, "is_split", "is_offline")
    return catalog.select(
        "row_key",
        F.to_json(own).alias("blob"),
        "server",
        "server_start_code",
        F.when(F.col("split_a").isNotNull(), F.to_json("split_a")).alias("split_a"),
        F.when(F.col("split_b").isNotNull(), F.to_json("split_b")).alias("split_b"),
    )


def split_daughters(catalog: DataFrame) -> DataFrame:
    """The slices that split parents in this listing were split into."""
    children = F.filter(F.array("split_a", "split_b"), lambda c: c.isNotNull())
    return (
        catalog.where("is_split").select(F.explode(children).alias("child")).select("child.*")
    )


def split_not_offline(catalog: DataFrame) -> DataFrame:
    """Split parents still marked online: worth a warning."""
    return catalog.where("is_split and not is_offline").select(*SLICE_COLS)


def select_slices(catalog: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """Slices to copy: those of ``tables`` (all when None), without the daughters of any split
    parent in the same listing. The parent still holds the data; daughters only refer to it."""
    if tables is not None:
        catalog = catalog.where(F.col("table_name").isin(list(tables)))
    daughters = split_daughters(catalog).select(*IDENTITY).distinct()
    return catalog.join(daughters, IDENTITY, "left_anti").select(*CATALOG_COLS)


def slices_by_table(slices: DataFrame) -> DataFrame:
    """One row per table: how many slices, and the first and last in key order.

    The slices themselves stay flat (see :func:`slices_sorted`): a list per table would have to
    fit into one row of one task.
    """
    place = F.struct("start_key", end_order("end_key").alias("end_order"), "region_id")
    return (
        slices.groupBy("table_name")
        .agg(
            F.count(F.lit(1)).alias("n_slices"),
            F.min(place).alias("first"),
            F.max(place).alias("last"),
        )
        .select(
            "table_name",
            "n_slices",
            F.col("first.start_key").alias("first_start_key"),
            F.col("first.end_order.end").alias("first_end_key"),
            F.col("last.start_key").alias("last_start_key"),
            F.col("last.end_order.end").alias("last_end_key"),
        )
        .orderBy("table_name")
    )


def slices_sorted(slices: DataFrame) -> DataFrame:
    """All slices in key order: table, start, end (unbounded last), region id."""
    return slices.orderBy("table_name", "start_key", end_order("end_key"), "region_id")


def slice_paths(slices: DataFrame, root: str) -> DataFrame:
    """Where each slice is kept below ``root``."""
    return slices.select(
        *SLICE_COLS, slice_path(root, F.col("table_name"), F.col("slice_id")).alias("path")
    )
