"""Schemas shared by the operators, the plans and the stored metadata."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "decimal(38,0)": T.DecimalType(38, 0),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from ``"name type, ..."``; needs no session, unlike Spark's own parser."""
    pairs = (c.strip().split(" ") for c in columns.replace("(38,0)", "(38;0)").split(","))
    return T.StructType(
        [T.StructField(name, _TYPES[kind.replace(";", ",")]) for name, kind in pairs]
    )


# A slice is identified by these columns; ``slice_id`` names its directory.
IDENTITY = ["table_name", "start_key", "end_key", "region_id"]
SLICE_COLS = ["table_name", "slice_id", "start_key", "end_key", "region_id"]

SLICE = _struct(
    "table_name string, slice_id string, start_key string, end_key string, region_id bigint"
)

# What a catalog blob (JSON) holds for one slice.
SLICE_BLOB = T.StructType(
    SLICE.fields + _struct("is_split boolean, is_offline boolean").fields
)

CATALOG_COLS = SLICE_COLS + [
    "row_key", "server", "host", "port", "server_start_code",
    "is_split", "is_offline", "split_a", "split_b",
]

OUTCOME = _struct(
    "table_name string, slice_id string, start_key string, end_key string, region_id bigint,"
    "attempt int, status string, files bigint, bytes bigint, rows bigint,"
    "checksum decimal(38,0), error string"
)

FILES = _struct(
    "root string, path string, rel_path string, name string, length bigint,"
    "is_dir boolean, modified timestamp, error string"
)

COPY_OUTCOME = _struct(
    "source_path string, dest_path string, used_path string, status string,"
    "bytes bigint, error string"
)

# One row for each file (or empty directory) of a slice that was copied as files.
FILE_ENTRY = _struct(
    "table_name string, slice_id string, attempt int, rel_path string, length bigint, is_dir boolean"
)

# ``content_checked``: whether the manifest's checksums cover the rows' content, or nothing.
DESCRIPTOR = _struct(
    "table_name string, schema_json string, key_column string, key_width int,"
    "content_checked boolean"
)

SNAPSHOT = _struct(
    "name string, started timestamp, ended timestamp, tables array<string>, verified boolean"
)

ISSUE = _struct(
    "table_name string, start_key string, end_key string, prev_end_key string, issue string"
)

RUN_STATS = _struct(
    "run bigint, started timestamp, ended timestamp, copied bigint, failed bigint,"
    "replaced bigint, expired bigint, days_removed bigint"
)

# Names used by the store layouts this library reads.
SNAPSHOT_PREFIX = "bak"
DESCRIPTOR_PREFIX = ".tableinfo"
SLICE_MANIFEST = ".regioninfo"
COMPACTION_DIR = "compaction.dir"
SYSTEM_TABLES = ("-ROOT-", ".META.")
DEFAULT_PORT = 80
STAMP_FORMAT = "yyyyMMdd.kkmmss.SSS"
DAY_FORMAT = "yyyy-MM-dd"
