"""Large files copied and checked by byte ranges."""

import os
import random
import zlib

import pytest

from keysnap.sources.files import PARTIAL_PREFIX
from keysnap.sources.ranges import combined_crc, copy_all, copy_by_ranges, file_checksums
from test_files_archive import put, tree


def test_checksums_are_put_together():
    rng = random.Random(1)
    for _ in range(50):
        data = rng.randbytes(rng.choice([0, 1, 2, 100, 5000]))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(6)))
        edges = [0, *cuts, len(data)]
        parts = [(b - a, zlib.crc32(data[a:b])) for a, b in zip(edges, edges[1:])]
        assert combined_crc(parts) == zlib.crc32(data)
    assert combined_crc([(1, zlib.crc32(b"a")), (10**6, zlib.crc32(bytes(10**6)))]) == zlib.crc32(b"a" + bytes(10**6))


def test_one_file_by_many_tasks(spark, tmp_path):
    data = os.urandom((40 << 20) + 123)
    put(tmp_path / "s/big", data)
    put(tmp_path / "s/zero", b"")
    put(tmp_path / "d/big", b"old")
    s, d = str(tmp_path / "s"), str(tmp_path / "d")
    plan = spark.createDataFrame([(f"{s}/big", f"{d}/big", len(data)), (f"{s}/zero", f"{d}/x/zero", 0)], "source_path string, dest_path string, length long")
    rows = {os.path.basename(r.dest_path): r for r in copy_by_ranges(plan, part_bytes=1 << 20).collect()}
    assert rows["big"].status == "copied" and rows["big"].bytes == len(data) and rows["big"].crc32 == zlib.crc32(data)
    assert rows["zero"].status == "copied" and tree(tmp_path / "d") == {"big": data, "x/zero": b""}
    files = spark.createDataFrame([(f"{d}/big", len(data)), (f"{d}/x/zero", 0), (f"{d}/none", 5)], "path string, length long")
    sums = {os.path.basename(r.path): r for r in file_checksums(files, part_bytes=3_000_001).collect()}
    assert sums["big"].crc32 == zlib.crc32(data) and sums["zero"].crc32 == 0
    assert sums["none"].crc32 is None and "none" in sums["none"].error


def test_fallbacks_and_failures(spark, tmp_path):
    """A source that is gone, one that is shorter than listed, ranges found in different places."""
    data = os.urandom(10_000)
    put(tmp_path / "s/short", data[:9000])
    put(tmp_path / "s/half", data[:5000])
    put(tmp_path / "trash/half", data)
    put(tmp_path / "trash/gone", data)
    s, d, t = (str(tmp_path / "s"), str(tmp_path / "d"), str(tmp_path / "trash"))
    plan = spark.createDataFrame(
        [(f"{s}/{n}", f"{d}/{n}", 10_000, [f"{t}/{n}"]) for n in ("short", "half", "gone")],
        "source_path string, dest_path string, length long, fallbacks array<string>",
    )
    rows = {os.path.basename(r.dest_path): r for r in copy_by_ranges(plan, part_bytes=1000).collect()}
    assert {n: r.status for n, r in rows.items()} == {"short": "failed", "half": "failed", "gone": "copied"}
    assert rows["gone"].used_path == f"{t}/gone" and "different places" in rows["half"].error
    assert tree(tmp_path / "d") == {"gone": data}
    assert not [p for p in (tmp_path / "d").iterdir() if p.name.startswith(PARTIAL_PREFIX)]


def test_a_second_attempt_does_no_harm(spark, tmp_path):
    """The last step run again, as after a lost task, finds its file in place."""
    data = os.urandom(10_000)
    put(tmp_path / "s/a", data)
    plan = spark.createDataFrame([(str(tmp_path / "s/a"), str(tmp_path / "d/a"), 10_000)], "source_path string, dest_path string, length long")
    outcome = copy_by_ranges(plan, part_bytes=999)
    assert [outcome.head().status for _ in range(2)] == ["copied", "copied"] and tree(tmp_path / "d") == {"a": data}


@pytest.mark.parametrize("part", [1000, 1 << 20])
def test_sizes_choose_the_way(spark, tmp_path, part):
    sizes = {"none": 0, "small": 10, "edge": 1000, "large": 5001}
    for n, size in sizes.items():
        put(tmp_path / "s" / n, os.urandom(size))
    s, d = str(tmp_path / "s"), str(tmp_path / "d")
    plan = spark.createDataFrame(
        [(f"{s}/{n}", f"{d}/{n}", size, False) for n, size in sizes.items()] + [(s, f"{d}/dir", 0, True), (f"{s}/x", "nostore://h/x", 9999, False)],
        "source_path string, dest_path string, length long, is_dir boolean",
    )
    rows = copy_all(plan, part_bytes=part).collect()
    assert len(rows) == 6 and sorted(r.status for r in rows) == ["copied"] * 5 + ["failed"]
    assert tree(tmp_path / "d") == tree(tmp_path / "s") and (tmp_path / "d/dir").is_dir()
    assert copy_all(plan.limit(0), part_bytes=part).count() == 0
