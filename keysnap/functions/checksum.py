"""Order-independent content checksums that add up over any split of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A row hash is summed in three pieces, so that the sums stay in 64-bit integers (and in
# generated code) for up to 2**41 rows; a decimal sum per row would be far slower.
_BITS = (21, 21, 22)
PIECES = ["hash_0", "hash_1", "hash_2"]


def _canonical(value: Column, dtype: T.DataType) -> Column:
    """A form of the value that can be hashed: maps become sorted arrays of their entries, and
    each value inside an array, struct or map is preceded by whether it is null."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                _canonical(e["key"], dtype.keyType).alias("key"),
                e["value"].isNull().alias("null"),
                _canonical(e["value"], dtype.valueType).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(
            value,
            lambda x: F.struct(
                x.isNull().alias("null"), _canonical(x, dtype.elementType).alias("value")
            ),
        )
    if isinstance(dtype, T.StructType):
        parts = []
        for i, field in enumerate(dtype.fields):
            inner = value.getField(field.name)
            parts.append(inner.isNull().alias(f"n{i}"))
            parts.append(_canonical(inner, field.dataType).alias(f"v{i}"))
        return F.struct(*parts) if parts else value.isNull()
    return value


def row_hash(schema: T.StructType) -> Column:
    """Hash of all columns. Hashing skips nulls, so a flag before each value says whether there
    is one: values that change places with nulls, at any depth, change the hash."""
    if not schema.fields:
        return F.lit(0).cast("bigint")
    parts: list[Column] = []
    for field in schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        parts += [column.isNull(), _canonical(column, field.dataType)]
    return F.xxhash64(*parts)


def hash_pieces(hashed: Column) -> dict[str, Column]:
    out, shift = {}, 0
    for name, bits in zip(PIECES, _BITS):
        piece = F.shiftrightunsigned(hashed, shift) if shift else hashed
        out[name] = piece.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        shift += bits
    return out


def sum_pieces() -> list[Column]:
    return [F.sum(name).alias(name) for name in PIECES]


def combine_pieces() -> Column:
    total, shift = F.lit(0).cast("decimal(38,0)"), 0
    for name, bits in zip(PIECES, _BITS):
        piece = F.coalesce(F.col(name), F.lit(0)).cast("decimal(20,0)")
        total = total + piece * F.lit(1 << shift).cast("decimal(14,0)")
        shift += bits
    return total.cast("decimal(38,0)")
