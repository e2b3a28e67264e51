"""Listing, copying and archiving on real directories."""

import os
import shutil
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keysnap import archive_once, archive_stream, restore_tables, take_snapshot
from keysnap.operators.logs import archive_stats, empty_days, invalid_logs, list_logs
from keysnap.plans.restore import restored_path
from keysnap.plans.snapshot import FileCopier
from keysnap.sources.descriptors import format_descriptor, parse_descriptor
from keysnap.sources.files import copy_files, delete_paths
from keysnap.sources.listing import (
    ListingError, latest_descriptor, list_files, list_slice_files, resolve_source,
)
from keysnap.sources.slice_files import copy_slice_files
from keysnap.streaming.archive_stream import read_stats
from test_snapshot_restore import catalog, row


def put(path: Path, data: bytes = b"data"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def tree(root: Path) -> dict[str, bytes]:
    return {
        str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file()
    }


def test_listing_sees_everything(spark, tmp_path):
    put(tmp_path / "a/.dot", b"1")
    put(tmp_path / "a/_under", b"22")
    put(tmp_path / "a/zero", b"")
    put(tmp_path / "a/b/c/deep", b"333")
    (tmp_path / "a/none").mkdir()
    got = {r.rel_path: r for r in list_files(spark, [str(tmp_path / "a")], recursive=True).collect()}
    assert set(got) == {"/.dot", "/_under", "/zero", "/b", "/b/c", "/b/c/deep", "/none"}
    assert got["/none"].is_dir and got["/zero"].length == 0 and got["/b/c/deep"].length == 3
    assert got["/b/c/deep"].modified is not None
    flat = list_files(spark, ["file:" + str(tmp_path / "a")]).collect()
    assert {r.name for r in flat} == {".dot", "_under", "zero", "b", "none"}
    assert all(r.path.startswith("file:") for r in flat)


def test_missing_directories(spark, tmp_path):
    put(tmp_path / "a/x")
    dirs = [str(tmp_path / "a"), str(tmp_path / "nowhere")]
    with pytest.raises(ListingError, match="nowhere"):
        list_files(spark, dirs)
    assert [r.name for r in list_files(spark, dirs, on_missing="skip").collect()] == ["x"]


def test_copy_files(spark, tmp_path):
    big = os.urandom((8 << 20) + 12345)
    put(tmp_path / "s/big", big)
    put(tmp_path / "s/zero", b"")
    put(tmp_path / "trash/gone", b"found again")
    put(tmp_path / "d/big", b"old")
    s, d, t = (
        str(tmp_path / "s"), str(tmp_path / "d"), str(tmp_path / "trash"))
    plan = spark.createDataFrame(
        [
            (f"{s}/big", f"{d}/big", False, []),
            (f"{s}/zero", f"{d}/x/y/zero", False, []),
            (f"{s}/gone", f"{d}/gone", False, [f"{t}/nope", f"{t}/gone"]),
            (f"{s}/lost", f"{d}/lost", False, []),
            (f"{s}", f"{d}/empty", True, []),
        ],
        "source_path string, dest_path string, is_dir boolean, fallbacks array<string>",
    )
    got = {r.dest_path.split("/")[-1]: r for r in copy_files(plan).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "big": "copied", "zero": "copied", "gone": "copied", "lost": "failed", "empty": "copied"
    }
    assert got["gone"].used_path == f"{t}/gone" and "FileNotFoundError" in got["lost"].error
    assert tree(tmp_path / "d") == {"big": big, "x/y/zero": b"", "gone": b"found again"}
    assert (tmp_path / "d/empty").is_dir()


def test_delete(spark, tmp_path):
    put(tmp_path / "a/x")
    put(tmp_path / "b/y")
    paths = spark.createDataFrame(
        [(str(tmp_path / "a"),), (str(tmp_path / "b/y"),), (str(tmp_path / "no"),)], "path string"
    )
    assert delete_paths(paths).where("deleted").count() == 3
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()


def store(root: Path):
    """Two tables; slice s1 of t lacks a family, s2 its manifest."""
    put(root / "t/.tableinfo.0000000001", format_descriptor("t", ["gone"]))
    put(root / "t/.tableinfo.0000000002", format_descriptor("t", ["f1", "f2"]))
    for sid in ("s0", "s1", "s2"):
        put(root / f"t/{sid}/.regioninfo", sid.encode())
        put(root / f"t/{sid}/f1/file", sid.encode() * 3)
        (root / f"t/{sid}/f2").mkdir()
        put(root / f"t/{sid}/f1/sub/ignored")
    (root / "t/s1/f2").rmdir()
    (root / "t/s2/.regioninfo").unlink()
    put(root / "u/s0/.regioninfo")
    put(root / "u/s0/f1/file")


def slices(spark, *names):
    return catalog(spark, [row(t, s, "", "") for t, s in (n.split("/") for n in names)])


def test_slice_files(spark, tmp_path):
    root = tmp_path / "store"
    store(root)
    every = slices(spark, "t/s0", "t/s1", "t/s2", "t/s3", "u/s0")
    listed = list_slice_files(every, str(root)).collect()
    ok = {r.path[len(str(root)):] for r in listed if r.slice_id == "s0" and r.table_name == "t"}
    assert ok == {"/t/s0/.regioninfo", "/t/s0/f1", "/t/s0/f2", "/t/s0/f1/file"}
    errors = {(r.table_name, r.slice_id, r.error) for r in listed if r.error}
    assert errors == {
        ("t", "s1", "family missing: f2"), ("t", "s2", "manifest missing"),
        ("t", "s3", "manifest missing"), ("t", "s3", "family missing: f1"),
        ("t", "s3", "family missing: f2"), ("u", "s0", "descriptor missing"),
    }
    lenient = list_slice_files(every, str(root), on_missing="skip").collect()
    assert {(r.table_name, r.error) for r in lenient if r.error} == {("u", "descriptor missing")}
    outcomes = copy_slice_files(
        list_slice_files(every, str(root)), str(root), str(tmp_path / "copy")
    ).collect()
    assert {(r.table_name, r.slice_id): (r.status, r.files) for r in outcomes} == {
        ("t", "s0"): ("copied", 2), ("t", "s1"): ("failed", 0), ("t", "s2"): ("failed", 0),
        ("t", "s3"): ("failed", 0), ("u", "s0"): ("failed", 0),
    }
    assert set(tree(tmp_path / "copy")) == {"t/s0/.regioninfo", "t/s0/f1/file"}
    assert (tmp_path / "copy/t/s0/f2").is_dir()


def test_file_snapshot_and_restore(spark, tmp_path):
    """A slice that lacks a family fails; once the family is there, the next round copies it."""
    root = tmp_path / "store"
    store(root)
    put(root / "t/s2/.regioninfo", b"s2")
    edges = [("s0", "", "g"), ("s1", "g", "p"), ("s2", "p", "")]
    cat = catalog(spark, [row("t", *e) for e in edges])

    def fresh(attempt):
        if attempt == 2:
            (root / "t/s1/f2").mkdir(exist_ok=True)
        return cat

    copier = FileCopier(str(root), ["t"])
    snap = take_snapshot(spark, copier, fresh, str(tmp_path / "snaps"))
    assert snap.seal().head().verified
    got = sorted((r.slice_id, r.attempt, r.status) for r in snap.outcomes().collect())
    assert got == [("s0", 1, "copied"), ("s1", 1, "failed"), ("s1", 2, "copied"), ("s2", 1, "copied")]
    out = restore_tables(spark, snap.path, str(tmp_path / "back")).head()
    assert out.status == "restored", out.error
    place = Path(restored_path(spark, str(tmp_path / "back"), "t"))
    back = tree(place)
    assert parse_descriptor(back[".tableinfo.0000000002"]) == ("t", ["f1", "f2"]) and ".tableinfo.0000000001" not in back
    assert back["s1/f1/file"] == b"s1s1s1" and (place / "s1/f2").is_dir()


def test_files_found_in_the_trash(spark, tmp_path):
    """Of several checkpoints the last that has the file counts; a file that none has fails its slice."""
    root = tmp_path / "store"
    store(root)
    put(root / "t/s2/.regioninfo", b"s2")
    (root / "t/s1/f2").mkdir()
    listed = list_slice_files(slices(spark, "t/s0", "t/s1", "t/s2"), str(root)).cache()
    assert listed.where("error is not null").isEmpty()
    for sid in ("s0", "s1"):
        (root / f"t/{sid}/f1/file").unlink()
    inner = str(root / "t/s0/f1/file")
    for checkpoint, data in (("1", b"old"), ("2", b"newer"), ("10", b"oldest")):
        put(Path(f"{tmp_path}/trash/{checkpoint}{inner}"), data)
    (tmp_path / "trash/3").mkdir()
    outcomes = copy_slice_files(listed, str(root), str(tmp_path / "copy"), trash_roots=[str(tmp_path / "trash"), str(tmp_path / "no")])
    assert {r.slice_id: (r.status, r.files) for r in outcomes.collect()} == {"s0": ("copied", 2), "s1": ("failed", 1), "s2": ("copied", 2)}
    assert tree(tmp_path / "copy")["t/s0/f1/file"] == b"newer" and "t/s1/f1/file" not in tree(tmp_path / "copy")


def test_latest_descriptor_and_source(spark, tmp_path):
    files = spark.createDataFrame(
        [("t", ".tableinfo.2", "/t/.tableinfo.2"), ("t", ".tableinfo.1", "/t/.tableinfo.1"),
         ("t", "z", "/t/z"), ("u", "part", "/u/part")],
        "table_name string, name string, path string",
    )
    assert list(map(tuple, latest_descriptor(files).collect())) == [("t", "/t/.tableinfo.2")]
    placed = spark.createDataFrame(
        [("/a", "/l/a", True), ("/b", "/l/b", False), ("/c", "/l/c", False)],
        "rel_path string, path string, present boolean",
    )
    found = spark.createDataFrame(
        [("/a", "/t1/a", 1), ("/b", "/t1/b", 1), ("/b", "/t2/b", 2)],
        "rel_path string, path string, priority int",
    )
    got = {r.rel_path: r.source_path for r in resolve_source(placed, found).collect()}
    assert got == {"/a": "/l/a", "/b": "/t2/b", "/c": None}


# Archive


def ms(day: datetime) -> int:
    return int(day.timestamp() * 1000)


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(spark, base, day, **kw):
    moment = T0 + timedelta(days=day)
    sources = [str(base / "old"), str(base / "live")]
    row_ = archive_once(spark, sources, str(base / "archive"), moment, **kw).head()
    return row_.copied, row_.failed, row_.replaced, row_.expired, row_.days_removed


def test_archive_runs(spark, tmp_path):
    live, old, arch = (tmp_path / d for d in ("live", "old", "archive"))
    first, second = ms(T0), ms(T0 + timedelta(days=1))
    put(live / f"rs1/w.{first}", b"abc")
    put(arch / "2024-01-02/.copying-0123", b"left by a run that was cut short")
    put(live / f"rs1/v1.2/empty.{first}", b"")
    put(live / "rs1/v1.2/nosuffix", b"x")
    put(old / f"w.{second}", b"old one")
    put(live / f"rs2/w.{second}", b"live one, longer")
    assert run(spark, tmp_path, 1) == (2, 0, 0, 0, 0)
    assert tree(arch) == {f"2024-01-02/w.{first}": b"abc", f"2024-01-02/w.{second}": b"old one"}
    # Nothing changed: nothing is copied.
    assert run(spark, tmp_path, 2) == (0, 0, 0, 0, 0)
    # A log has grown: its copy moves to the day of the run.
    put(live / f"rs1/w.{first}", b"abcdef")
    assert run(spark, tmp_path, 3) == (1, 0, 1, 0, 0)
    assert tree(arch) == {f"2024-01-04/w.{first}": b"abcdef", f"2024-01-02/w.{second}": b"old one"}
    # Grown again on the same day: replaced in place.
    put(live / f"rs1/w.{first}", b"abcdefgh")
    assert run(spark, tmp_path, 3) == (1, 0, 1, 0, 0)
    assert tree(arch)[f"2024-01-04/w.{first}"] == b"abcdefgh"
    # Ten days to live: the first log has expired, and is not copied again although it is there.
    assert run(spark, tmp_path, 10, days=10) == (0, 0, 0, 1, 0)
    assert run(spark, tmp_path, 10, days=10) == (0, 0, 0, 0, 0)
    # Its day is empty, and goes once it is old enough itself.
    assert (arch / "2024-01-04").is_dir()
    assert run(spark, tmp_path, 13, days=10) == (0, 0, 0, 1, 2)
    assert list(arch.iterdir()) == []


def test_archive_keeps_other_files(spark, tmp_path):
    put(tmp_path / "live" / f"w.{ms(T0)}")
    put(tmp_path / "archive/2024-01-01/README", b"keep")
    put(tmp_path / "archive/notes/x.y", b"keep")
    assert run(spark, tmp_path, 5, days=1) == (0, 0, 0, 0, 0)
    assert set(tree(tmp_path / "archive")) == {"2024-01-01/README", "notes/x.y"}


def test_archive_stream(spark, tmp_path):
    put(tmp_path / "live" / f"w.{ms(T0)}", b"abc")
    kw = dict(
        sources=[str(tmp_path / "old"), str(tmp_path / "live")], archive=str(tmp_path / "archive"),
        checkpoint=str(tmp_path / "check"), stats=str(tmp_path / "stats"),
    )
    query = archive_stream(spark, once=True, **kw)
    assert query.awaitTermination(120)
    put(tmp_path / "live" / f"w.{ms(T0)}", b"abcdef")
    assert archive_stream(spark, once=True, **kw).awaitTermination(120)
    assert list(tree(tmp_path / "archive").values()) == [b"abcdef"]
    stats = archive_stats(read_stats(spark, str(tmp_path / "stats"))).orderBy("run").collect()
    assert [(r.copied, r.replaced, r.total_copied) for r in stats] == [(1, 0, 1), (1, 1, 2)]


def test_log_lists(spark):
    files = spark.createDataFrame(
        [("/live/a.5", "a.5", 2, 1), ("/old/a.5", "a.5", 1, 0), ("/live/b.x", "b.x", 1, 1)],
        "path string, name string, length bigint, priority int",
    )
    assert [(r.path, r.start_ms) for r in list_logs(files).collect()] == [("/old/a.5", 5)]
    assert list_logs(files, min_start=6).isEmpty() and list_logs(files, min_start=5).count() == 1
    assert [r.name for r in invalid_logs(files).collect()] == ["b.x"]
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("x",)], "day string")
    held = spark.createDataFrame([("2024-01-01",)], "day string")
    got = empty_days(days, held, ms(T0 + timedelta(days=1)))
    assert [r.day for r in got.collect()] == ["2024-01-02"]
    assert empty_days(days, held, None).isEmpty()


@pytest.mark.parametrize("harm", ["slice gone", "file cut", "file gone", "file added", "none"])
def test_file_restore_proves_completeness(spark, tmp_path, harm):
    """A restore of files compares every path and length with what was copied."""
    root = tmp_path / "root"
    for s in ("s0", "s1"):
        put(root / "t" / s / ".regioninfo", b"m")
        for i in range(3):
            put(root / "t" / s / "f" / f"file{i}", b"x" * 500)
        (root / "t" / s / "g").mkdir()
    put(root / "t" / ".tableinfo.1", format_descriptor("t", ["f", "g"]))
    (root / "t" / ".tableinfo.9").mkdir()  # bears the name of a newer descriptor, but is none
    slices = catalog(spark, [row("t", "s0", "", "m"), row("t", "s1", "m", "")])
    copier = FileCopier(str(root), ["t"])
    snapshot = take_snapshot(spark, copier, lambda _: slices, str(tmp_path / "dest"))
    assert snapshot.seal().head().verified
    place = os.path.join(snapshot.data, "t")
    assert os.path.isfile(os.path.join(place, ".tableinfo.1"))
    assert snapshot.files().where("not is_dir").count() == 8
    if harm == "slice gone":
        shutil.rmtree(os.path.join(place, "s1"))
    elif harm == "file cut":
        with open(os.path.join(place, "s0", "f", "file1"), "wb") as f:
            f.write(b"x")
    elif harm == "file gone":
        os.remove(os.path.join(place, "s0", "f", "file1"))
    elif harm == "file added":
        with open(os.path.join(place, "s0", "f", "other"), "wb") as f:
            f.write(b"x")
    outcome = restore_tables(spark, snapshot.path, str(tmp_path / "target")).head()
    assert outcome.status == ("restored" if harm == "none" else "failed")
    assert (tmp_path / "target" / "t").exists() == (harm == "none")


def test_a_descriptor_that_cannot_be_copied_stops_the_snapshot(spark, tmp_path, monkeypatch):
    from keysnap.plans import snapshot as plans

    root = tmp_path / "root"
    put(root / "t" / "s0" / ".regioninfo", b"m")
    put(root / "t" / ".tableinfo.1", format_descriptor("t", []))

    def failing(plan, parallelism=None):
        return copy_files(plan.withColumn("source_path", F.concat("source_path", F.lit("-gone"))), parallelism)

    monkeypatch.setattr(plans, "copy_files", failing)
    slices = catalog(spark, [row("t", "s0", "", "")])
    copier = FileCopier(str(root), ["t"])
    with pytest.raises(plans.SnapshotError, match="descriptor"):
        take_snapshot(spark, copier, lambda _: slices, str(tmp_path / "dest"))


def test_an_unknown_store_gives_failed_rows(spark, tmp_path):
    put(tmp_path / "a")
    plan = spark.createDataFrame(
        [("nostore://host/a/b", str(tmp_path / "x")), (str(tmp_path / "a"), "nostore://host/c"), (str(tmp_path / "a"), str(tmp_path / "y"))],
        "source_path string, dest_path string",
    )
    rows = {r.source_path + " " + r.dest_path: (r.status, r.error) for r in copy_files(plan).collect()}
    assert sorted(s for s, _ in rows.values()) == ["copied", "failed", "failed"]
    assert all("nostore" in e for s, e in rows.values() if s == "failed")


def test_uris_of_local_files(tmp_path):
    from keysnap.sources.storage import open_fs

    fs, inner, front = open_fs(f"file://{tmp_path}/x")
    assert inner == f"{tmp_path}/x" and front == "file:"
