"""Reading table descriptors: which column families a table has.

Two formats are known. A text descriptor is JSON, ``{"name": ..., "families": [...]}`` with families
as names or as objects with a ``name``. A binary one is the serialised form that stores of key ranges
write: big-endian numbers, byte strings with a variable-length or a four-byte length, the table's
properties, then each family with its properties.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysnap.schema import DESCRIPTOR_PREFIX
from keysnap.session import tasks
from keysnap.sources.storage import open_fs

# Versions of the binary form that hold families as read here.
TABLE_VERSIONS = (3, 4)
FAMILY_VERSIONS = (6, 7, 8, 9)
# Descriptors are a few kilobytes; what is larger is something else.
MAX_BYTES = 64 << 20
FAMILIES = "table_name string, path string, family string, error string"


class DescriptorError(ValueError):
    """The bytes are no descriptor."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DescriptorError("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def variable(self) -> int:
        """One byte from -112 to 127, or a byte that tells the sign and how many bytes follow."""
        first = self.number(">b")
        if first >= -112:
            return first
        value = int.from_bytes(self.take(-112 - first if first >= -120 else -120 - first), "big")
        return value if first >= -120 else ~value

    def name(self) -> str:
        return self.take(self.variable()).decode("utf-8")

    def skip_properties(self) -> None:
        for _ in range(2 * self.number(">i")):
            self.take(self.number(">i"))


def _binary(data: bytes) -> tuple[str, list[str]]:
    reader = _Reader(data)
    version = reader.number(">i")
    if version not in TABLE_VERSIONS:
        raise DescriptorError(f"table version {version} is not known")
    table = reader.name()
    reader.take(2)  # whether it is one of the catalog's own tables
    reader.skip_properties()
    families = []
    for _ in range(reader.number(">i")):
        version = reader.number(">b")
        if version not in FAMILY_VERSIONS:
            raise DescriptorError(f"family version {version} is not known")
        families.append(reader.name())
        reader.skip_properties()
    return table, families


def parse_descriptor(data: bytes) -> tuple[str, list[str]]:
    """The table's name and its families, in the descriptor's order."""
    try:
        if data.lstrip()[:1] != b"{":
            return _binary(data)
        found = json.loads(data)
        names = [f["name"] if isinstance(f, dict) else f for f in found["families"]]
        if not isinstance(found["name"], str) or not all(isinstance(n, str) and n for n in names):
            raise DescriptorError("names are missing")
        return found["name"], names
    except DescriptorError:
        raise
    except (ValueError, KeyError, TypeError) as e:
        raise DescriptorError(f"{type(e).__name__}: {e}") from e


def format_descriptor(table: str, families: list[str]) -> bytes:
    """A text descriptor."""
    return json.dumps({"name": table, "families": families}).encode()


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for table, path in zip(batch["table_name"], batch["path"]):
            try:
                filesystem, inner, _ = open_fs(path)
                if (filesystem.get_file_info(inner).size or 0) > MAX_BYTES:
                    raise DescriptorError("too large")
                with filesystem.open_input_stream(inner) as stream:
                    families = parse_descriptor(stream.read())[1]
                rows += [(table, path, f, None) for f in dict.fromkeys(families)]
                if any("/" in f or f in ("", ".", "..") for f in families):
                    raise DescriptorError("a family's name is no directory name")
            except (OSError, ValueError) as e:
                rows = [r for r in rows if r[1] != path]
                rows.append((table, path, None, f"descriptor unreadable: {e}"))
        yield pd.DataFrame(rows, columns=["table_name", "path", "family", "error"])


def read_families(descriptors: DataFrame, parallelism: int | None = None) -> DataFrame:
    """One row for each family of each descriptor (``table_name, path``), read in tasks.

    A descriptor that cannot be read gives one row with ``error``; one without families none.
    """
    n = tasks(descriptors.sparkSession, parallelism)
    return descriptors.select("table_name", "path").repartition(n, "path").mapInPandas(_read_batches, FAMILIES)


def is_descriptor(prefix: str = DESCRIPTOR_PREFIX):
    """Of a listing's rows those that are descriptors: a directory of such a name is none."""
    return F.col("name").startswith(prefix) & ~F.col("is_dir")
