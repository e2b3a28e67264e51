"""Copying and checking large files by byte ranges, so that one file keeps many tasks busy.

Each range is copied by a row of its own to its place in one hidden partial file, which a last step
renames once all ranges have arrived. That needs a store that can be written at any place: local and
mounted file systems. Checksums of ranges are put together algebraically: appending ``n`` bytes to a
text multiplies its CRC, a polynomial over two elements, by ``x ** (8 * n)``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysnap.schema import COPY_OUTCOME
from keysnap.session import cut, tasks
from keysnap.sources.files import CHUNK_BYTES, PARTIAL_PREFIX, copy_files
from keysnap.sources.storage import open_fs, parent

PART_BYTES = 256 << 20
# Fixed value: the polynomial of CRC-32, lowest power in the highest bit.
_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Two polynomials multiplied, modulo the checksum's own."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=64)
def _power(k: int) -> int:
    """``x ** (2 ** k)``."""
    return 1 << 30 if k == 0 else _product(_power(k - 1), _power(k - 1))


@lru_cache(maxsize=1024)
def _shift(n: int) -> int:
    """``x ** (8 * n)``."""
    out, k, bits = 1 << 31, 0, 8 * n
    while bits:
        if bits & 1:
            out = _product(out, _power(k))
        bits, k = bits >> 1, k + 1
    return out


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of texts put together, from the (length, CRC-32) of each in order."""
    crc = 0
    for length, own in parts:
        crc = _product(_shift(length), crc) ^ own
    return crc


def _blocks(path: str, start: int, size: int) -> Iterator[bytes]:
    filesystem, inner, _ = open_fs(path)
    with filesystem.open_input_file(inner) as source:
        source.seek(start)
        left = size
        while left:
            block = source.read(min(CHUNK_BYTES, left))
            if not block:
                raise OSError(f"{path} ends {left} bytes early")
            left -= len(block)
            yield block


def _copy_range(source: str, partial: str, start: int, size: int) -> int:
    filesystem, inner, _ = open_fs(partial)
    filesystem.create_dir(parent(inner), recursive=True)
    crc, at = 0, start
    target = os.open(inner, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        for block in _blocks(source, start, size):
            crc = zlib.crc32(block, crc)
            view = memoryview(block)
            while view:
                done = os.pwrite(target, view, at)
                at, view = at + done, view[done:]
    finally:
        os.close(target)
    return crc


RANGE = "source_path string, dest_path string, partial string, start bigint, size bigint, used_path string, crc bigint, error string"


def _copy_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            crc, error = 0, None
            for used in [row.source_path, *row.fallbacks]:
                try:
                    crc = _copy_range(used, row.partial, row.start, row.size)
                    break
                except OSError as e:
                    error = error or f"{type(e).__name__}: {e}"
            else:
                used = None
            rows.append((row.source_path, row.dest_path, row.partial, row.start, row.size, used, crc, error if used is None else None))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RANGE.split(", ")])


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            error, crc = row.error if isinstance(row.error, str) else None, None
            filesystem, partial, _ = open_fs(row.partial)
            _, dest, _ = open_fs(row.dest_path)
            try:
                if error is None and row.sources > 1:
                    error = "its ranges come from different places"
                if error is None:
                    crc = combined_crc([(p["size"], p["crc"]) for p in row.parts])
                    # A second attempt finds the file in place already.
                    held = filesystem.get_file_info([partial, dest])
                    if held[0].is_file:
                        if held[0].size != row.bytes:
                            raise OSError(f"copied {held[0].size} of {row.bytes} bytes")
                        filesystem.move(partial, dest)
                    elif not (held[1].is_file and held[1].size == row.bytes):
                        raise OSError("the copied ranges are gone")
                elif filesystem.get_file_info(partial).is_file:
                    filesystem.delete_file(partial)
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
            good = error is None
            rows.append((row.source_path, row.dest_path, row.used_path if good else None, "copied" if good else "failed",
                         row.bytes if good else 0, error, crc if good else None))
        yield pd.DataFrame(rows, columns=[*COPY_OUTCOME.names, "crc32"]).astype({"crc32": "Int64"})


def _ranges(files: DataFrame, part_bytes: int) -> DataFrame:
    """A row for each range: ``start`` and ``size``."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / F.lit(part_bytes)))
    start = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(part_bytes).cast("bigint")))
    rows = files.withColumn("start", start)
    return rows.withColumn("size", F.least(F.lit(part_bytes).cast("bigint"), F.col("length") - F.col("start")))


def writes_anywhere(path: Column) -> Column:
    """Whether a destination's store can be written at any place."""
    return ~path.contains("://") | path.startswith("file:")


def copy_by_ranges(plan: DataFrame, parallelism: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Copies files (``source_path, dest_path, length`` and optionally ``fallbacks``) by ranges of at most
    ``part_bytes``, each range by whichever task is free. Returns COPY_OUTCOME rows and ``crc32``.

    Copied are the first ``length`` bytes, as they were listed. Runs a job: the ranges are done, and
    known to be, before any file gets its name.
    """
    if "fallbacks" not in plan.columns:
        plan = plan.withColumn("fallbacks", F.array().cast("array<string>"))
    n = tasks(plan.sparkSession, parallelism)
    folder, name = F.regexp_replace("dest_path", "/[^/]*$", ""), F.md5(F.concat("source_path", F.lit("\n"), "dest_path"))
    files = plan.select(
        "source_path", "dest_path", "fallbacks", "length", F.concat(folder, F.lit(f"/{PARTIAL_PREFIX}"), name).alias("partial")
    )
    ranges = _ranges(files, part_bytes).drop("length")
    # Many more ranges than tasks; a task is done with few of them at a time.
    done = cut(ranges.repartition(n, "source_path", "start").mapInPandas(_copy_ranges, RANGE))
    whole = done.groupBy("source_path", "dest_path", "partial").agg(
        F.sum("size").alias("bytes"), F.max("error").alias("error"), F.max("used_path").alias("used_path"),
        F.count_distinct("used_path").alias("sources"),
        F.array_sort(F.collect_list(F.struct("start", "size", "crc"))).alias("parts"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COPY_OUTCOME.fields)
    return whole.mapInPandas(_finish, f"{kinds}, crc32 bigint")


def copy_all(plan: DataFrame, parallelism: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """As :func:`copy_files` for a plan with ``length``, with files of more than ``part_bytes`` copied by
    ranges where the destination's store allows it."""
    large = F.coalesce(F.col("length") > part_bytes, F.lit(False)) & writes_anywhere(F.col("dest_path"))
    if "is_dir" in plan.columns:
        large = large & ~F.col("is_dir")
    rest = copy_files(plan.where(~large), parallelism)
    if plan.where(large).isEmpty():
        return rest
    return rest.unionByName(copy_by_ranges(plan.where(large), parallelism, part_bytes).drop("crc32"))


def _range_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums, errors = [], []
        for row in batch.itertuples(index=False):
            crc, error = 0, None
            try:
                for block in _blocks(row.path, row.start, row.size):
                    crc = zlib.crc32(block, crc)
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
            sums.append(crc)
            errors.append(error)
        yield batch[["path", "start", "size"]].assign(crc=sums, error=errors)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        crc = [None if isinstance(e, str) else combined_crc([(p["size"], p["crc"]) for p in parts]) for e, parts in zip(batch["error"], batch["parts"])]
        yield batch[["path", "length", "error"]].assign(crc32=pd.array(crc, dtype="Int64"))


def file_checksums(files: DataFrame, parallelism: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``path, length, error, crc32`` of files (``path, length``), read by ranges in many tasks."""
    n = tasks(files.sparkSession, parallelism)
    ranges = _ranges(files.select("path", "length"), part_bytes).repartition(n, "path", "start")
    sums = ranges.select("path", "start", "size").mapInPandas(_range_sums, "path string, start bigint, size bigint, crc bigint, error string")
    whole = sums.groupBy("path").agg(
        F.sum("size").alias("length"), F.max("error").alias("error"),
        F.array_sort(F.collect_list(F.struct("start", "size", "crc"))).alias("parts"),
    )
    return whole.mapInPandas(_combine, "path string, length bigint, error string, crc32 bigint")
