"""Directories as a data source."""

import pytest

from keysnap.sources.files_source import FilesReader, read_files, start_of
from keysnap.sources.listing import list_files
from test_files_archive import put


def tree_of(tmp_path):
    for day in ("a", "b", "b/c", "b/c/d", ".hidden", "_under"):
        for name in ("wal-1.100", "wal-1.-5", "wal-2.2000", "note", "x.1y", ".dot.7", "zero.0"):
            put(tmp_path / "live" / day / name, b"" if name == "zero.0" else name.encode())
    (tmp_path / "live/none").mkdir()
    return str(tmp_path / "live")


@pytest.mark.parametrize("partitions", [1, 3, 100])
@pytest.mark.parametrize("recursive", [False, True])
def test_lists_what_the_listing_lists(spark, tmp_path, partitions, recursive):
    root = tree_of(tmp_path)
    columns = ["root", "path", "rel_path", "name", "length", "is_dir", "modified"]
    want = sorted(map(tuple, list_files(spark, [root], recursive=recursive).select(columns).collect()))
    found = read_files(spark, [root], recursive, partitions=partitions)
    assert sorted(map(tuple, found.select(columns).collect())) == want
    assert {r.name: r.start_ms for r in found.where("not is_dir").collect()} == (
        {"wal-1.100": 100, "wal-1.-5": -5, "wal-2.2000": 2000, "note": None, "x.1y": None, ".dot.7": 7, "zero.0": 0} if recursive else {}
    )


def test_options_are_evaluated_while_listing(spark, tmp_path):
    root = tree_of(tmp_path)
    found = read_files(spark, [root], True, name_prefix="wal", min_start=100, files_only=True)
    assert sorted(r.name for r in found.collect()) == ["wal-1.100"] * 6 + ["wal-2.2000"] * 6
    reader = FilesReader({"roots": f'["{root}"]', "recursive": "true", "partitions": "2", "min_start": "-5"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[3] for r in rows} == {"wal-1.100", "wal-1.-5", "wal-2.2000", ".dot.7", "zero.0"}


def test_filters_of_one_use_leave_the_next_alone(spark, tmp_path):
    found = read_files(spark, [tree_of(tmp_path)], True)
    every = found.count()
    assert found.where("name = 'note'").count() == 6 and found.where("start_ms < 0 or name = 'note'").count() == 12
    assert found.where("start_ms >= 100 and name like 'wal-1%' and not is_dir").count() == 6
    assert found.count() == every == 49


def test_missing_directories(spark, tmp_path):
    root = tree_of(tmp_path)
    gone = str(tmp_path / "gone")
    assert read_files(spark, [root, gone], on_missing="skip").count() == 5
    with pytest.raises(Exception, match="gone"):
        read_files(spark, [root, gone]).count()
    assert read_files(spark, []).count() == 0


def test_starts():
    most = (1 << 63) - 1
    names = {"a.1": 1, "a.b.-3": -3, "a": None, "a.": None, ".5": 5, "a.+1": None, "a.1 ": None, f"a.{most}": most, f"a.{most + 1}": None, "a.٣": None}
    assert {n: start_of(n) for n in names} == names
