"""Commit entries, resumed snapshots, tables side by side, one read of the source, units by bytes."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from keysnap import KeyedTable, read_restored, restore_tables, resume_snapshot, take_snapshot
from keysnap.operators.ordered import Order
from keysnap.operators.rounds import byte_units
from keysnap.plans import restore as restore_plan
from keysnap.plans.restore import delete_old_versions, restored_path, table_log
from keysnap.plans.snapshot import RowCopier, SnapshotError
from keysnap.plans.together import run_together
from keysnap.sources.commits import CommitLog
from keysnap.sources.manifest import Snapshot
from keysnap.sources.rows import read_slices
from test_snapshot_restore import catalog, pad, row, same, tiles


class Lost(BaseException):
    """A driver that is gone: nothing catches it."""


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source") / "t")
    spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v")).write.parquet(path)
    return path


def table(path, name="t", **kw):
    return KeyedTable(name, path, "k", 6, **kw)


# Commit log


def test_one_writer_gets_a_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() is None and log.next_number() == 1
    won = []
    threads = [threading.Thread(target=lambda i=i: log.commit(1, {"by": i}) and won.append(i)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.latest()["by"] == won[0] and log.numbers() == [1]
    assert not [p for p in (tmp_path / "log").iterdir() if "partial" in p.name]


def test_an_entry_that_was_cut_off_is_passed_over(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.commit(1, {"a": 1}) and log.commit(2, {"a": 2})
    newest = tmp_path / "log" / f"{2:020d}.json"
    whole = newest.read_bytes()
    for harm in (whole[:-5], b"", whole.replace(b'"a": 2', b'"a": 3')):
        newest.write_bytes(harm)
        assert log.latest()["a"] == 1 and log.next_number() == 3
    assert not log.commit(2, {"a": 9}) and log.commit(3, {"a": 4}) and log.latest()["a"] == 4


def test_restore_publishes_by_an_entry(spark, source, tmp_path, monkeypatch):
    cat = catalog(spark, tiles("t", [pad(900)]))
    first = take_snapshot(spark, RowCopier([table(source)]), lambda _: cat, str(tmp_path / "s"))
    half = KeyedTable("t", lambda s: s.read.parquet(source).where("k % 2 = 0"), "k", 6)
    second = take_snapshot(spark, RowCopier([half]), lambda _: cat, str(tmp_path / "s"))
    target = str(tmp_path / "out")
    assert restore_tables(spark, first.path, target).head().status == "restored"
    old = restored_path(spark, target, "t")
    # Killed before its entry is written: readers see the old version.
    real = CommitLog.commit

    def gone(self, number, entry):
        raise Lost

    monkeypatch.setattr(CommitLog, "commit", gone)
    with pytest.raises(Lost):
        restore_plan._restore_one(second, "t", target, second.descriptors().head(), True, None, 2)
    monkeypatch.setattr(CommitLog, "commit", real)
    assert restored_path(spark, target, "t") == old and read_restored(spark, target, "t").count() == 2000
    # Two at once: one publishes, the other fails and leaves nothing.
    results = run_together(spark, "both", {n: lambda: restore_tables(spark, second.path, target, replace=True).head() for n in "ab"})
    assert sorted(r.status for r in results.values()) == ["failed", "restored"]
    assert "ConflictError" in next(r.error for r in results.values() if r.status == "failed")
    assert read_restored(spark, target, "t").count() == 1000 and table_log(spark, target, "t").latest()["number"] == 2
    assert spark.read.parquet(old).count() == 2000  # whoever reads the old version still can
    gone_dirs = delete_old_versions(spark, target, "t")
    assert len(gone_dirs) == 4 and read_restored(spark, target, "t").count() == 1000


def test_a_directory_of_someone_else_is_left_alone(spark, source, tmp_path):
    cat = catalog(spark, tiles("t", []))
    snap = take_snapshot(spark, RowCopier([table(source)]), lambda _: cat, str(tmp_path / "s"))
    (tmp_path / "out/t").mkdir(parents=True)
    (tmp_path / "out/t/mine").write_text("x")
    for replace in (False, True):
        with pytest.raises(restore_plan.RestoreError, match="t: exists"):
            restore_tables(spark, snap.path, str(tmp_path / "out"), replace=replace)


def test_an_original_that_cannot_be_deleted_is_reported(spark, source, tmp_path, monkeypatch):
    cat = catalog(spark, tiles("t", []))
    snap = take_snapshot(spark, RowCopier([table(source)]), lambda _: cat, str(tmp_path / "s"))
    real = restore_plan.remove_tree

    def failing(spark, path):
        if path.startswith(snap.data):
            raise OSError("read only")
        real(spark, path)

    monkeypatch.setattr(restore_plan, "remove_tree", failing)
    out = restore_tables(spark, snap.path, str(tmp_path / "out"), retain_original=False).head()
    assert out.status == "restored" and "original not deleted" in out.error


# Resuming


def unsealed(dest):
    return str(next(dest.iterdir()))


def test_a_run_killed_in_round_two_goes_on(spark, source, tmp_path):
    """s1 fails in round 1. Round 2 is cut off after one table; meanwhile the other's slice splits."""
    kids = (("t", "s1a", pad(500), pad(700), 2), ("t", "s1b", pad(700), "", 2))
    before = catalog(spark, [row("t", "s0", "", pad(500)), row("t", "s1", pad(500), "")] + tiles("u", [pad(800)]))
    after = catalog(spark, [row("t", "s0", "", pad(500)), *[row(*k) for k in kids]] + tiles("u", [pad(800)]))

    class Killed(RowCopier):
        def copy(self, work, snapshot, attempt):
            if attempt < 2:
                return super().copy(work, snapshot, attempt)
            self._copy_one(work, self.tables[1], snapshot, attempt)
            # The rows of t's slice are there, but no outcome says so.
            path = f"{snapshot.data}/t/slice_id=s1"
            spark.read.parquet(source).where("k >= 500").write.mode("overwrite").parquet(path)
            (tmp_path / "s" / snapshot.path.rsplit("/", 1)[1] / "data/t/.spark-staging-x").mkdir()
            raise Lost

    def fault(df, name, attempt):
        return df.where("slice_id <> 's1'") if attempt == 1 else df

    tables = [table(source), table(source, "u")]
    with pytest.raises(Lost):
        take_snapshot(spark, Killed(tables, fault), lambda _: before, str(tmp_path / "s"))
    path = unsealed(tmp_path / "s")
    with pytest.raises(restore_plan.RestoreError, match="not sealed"):
        restore_tables(spark, path, str(tmp_path / "out"))
    snap = resume_snapshot(spark, RowCopier(tables, fault), lambda _: after, path)
    assert snap.seal().head().verified
    got = sorted((r.table_name, r.slice_id, r.attempt) for r in snap.manifest().collect())
    assert got == [("t", "s0", 1), ("t", "s1a", 3), ("t", "s1b", 3), ("u", "s0", 1), ("u", "s1", 2)]
    assert {r.slice_id for r in snap.outcomes().where("attempt = 3").collect()} == {"s1a", "s1b"}
    whole = spark.read.parquet(source)
    for name in "tu":
        assert same(read_slices(spark, f"{snap.data}/{name}", whole.schema).drop("slice_id"), whole)
    out = restore_tables(spark, snap.path, str(tmp_path / "out")).collect()
    assert {r.status for r in out} == {"restored"} and same(read_restored(spark, str(tmp_path / "out"), "t"), whole)
    with pytest.raises(SnapshotError, match="sealed already"):
        resume_snapshot(spark, RowCopier(tables), lambda _: after, path)


@pytest.mark.parametrize("moment", ["preparing", "first round", "sealing"])
def test_runs_killed_early_and_late(spark, source, tmp_path, monkeypatch, moment):
    cat = catalog(spark, tiles("t", [pad(500)]))

    class Killed(RowCopier):
        def prepare(self, snapshot):
            if moment == "preparing":
                snapshot.spark.range(1).write.parquet(f"{snapshot.path}/other")
                raise Lost
            super().prepare(snapshot)

        def copy(self, work, snapshot, attempt):
            if moment == "first round":
                raise Lost
            super().copy(work, snapshot, attempt)

    def lost(*a):
        raise Lost

    if moment == "sealing":
        monkeypatch.setattr(Snapshot, "put_seal", lost)
    with pytest.raises(Lost):
        take_snapshot(spark, Killed([table(source)]), lambda _: cat, str(tmp_path / "s"))
    monkeypatch.undo()
    snap = resume_snapshot(spark, RowCopier([table(source)]), lambda _: cat, unsealed(tmp_path / "s"))
    assert snap.seal().head().verified and snap.outcomes().count() == 2
    last = {"preparing": 1, "first round": 2, "sealing": 1}[moment]
    assert {r.attempt for r in snap.manifest().collect()} == {last}


def test_two_runs_do_not_share_a_round(spark, source, tmp_path):
    cat = catalog(spark, tiles("t", [pad(500)]))

    def fresh(attempt):
        if attempt == 1:
            CommitLog(spark, f"{unsealed(tmp_path / 's')}/rounds").commit(2, {"round": 2})
        return cat

    copier = RowCopier([table(source)], lambda df, n, a: df.where("k < 600"))
    with pytest.raises(SnapshotError, match="another run"):
        take_snapshot(spark, copier, fresh, str(tmp_path / "s"))


# Tables side by side


def test_a_failing_table_leaves_seven(spark, source, tmp_path):
    names = [f"t{i}" for i in range(8)]
    cat = catalog(spark, [r for n in names for r in tiles(n, [pad(500)])])

    def fault(df, name, attempt):
        if name == "t3":
            raise RuntimeError("no space left")
        return df

    snap = take_snapshot(spark, RowCopier([table(source, n) for n in names], fault), lambda _: cat, str(tmp_path / "s"), max_tries=2)
    found = {(r.table_name, r.attempt, r.status): r.n for r in snap.outcomes().groupBy("table_name", "attempt", "status").agg(F.count("*").alias("n")).collect()}
    assert found == {(n, 1, "copied"): 2 for n in names if n != "t3"} | {("t3", a, "failed"): 2 for a in (1, 2)}
    assert not snap.seal().head().verified
    out = restore_tables(spark, snap.path, str(tmp_path / "out"), [n for n in names if n != "t3"], allow_unverified=True)
    assert {r.status for r in out.collect()} == {"restored"}


def test_jobs_run_side_by_side(spark):
    """Eight jobs that mostly wait take clearly less than eight times one; groups and pools are their own."""

    def job():
        def wait(batches):
            time.sleep(1)
            yield from batches

        spark.range(1).repartition(1).mapInPandas(wait, "id long").count()
        context = spark.sparkContext
        return context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.scheduler.pool")

    job()
    began = time.monotonic()
    found = run_together(spark, "test", {f"t{i}": job for i in range(8)})
    assert time.monotonic() - began < 5
    assert found == {f"t{i}": (f"test: t{i}", f"test-t{i}") for i in range(8)}
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


# One read of the source


@pytest.mark.parametrize("harm", [None, "lost", "moved", "changed"])
def test_the_source_is_read_once(spark, source, tmp_path, harm):
    """Counted by the source itself; only when something is wrong it is read again."""
    cat = catalog(spark, tiles("t", [pad(500)]))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    def opened(session):
        frame = session.read.parquet(source)
        return frame.mapInPandas(count, frame.schema)

    def fault(df, name, attempt):
        if attempt > 1 or not harm:
            return df
        if harm == "lost":
            return df.where("k <> 900")
        if harm == "moved":  # same rows, one of them in the wrong slice
            return df.withColumn("slice_id", F.when(F.col("k") == 900, "s0").otherwise(F.col("slice_id")))
        return df.withColumn("v", F.when(F.col("k") == 900, "x").otherwise(F.col("v")))

    copier = RowCopier([KeyedTable("t", opened, "k", 6)], fault)
    copier.extra_issues = lambda snapshot: []  # it reads the keys for rows without one
    snap = take_snapshot(spark, copier, lambda _: cat, str(tmp_path / "s"))
    assert snap.seal().head().verified
    failed = {r.slice_id for r in snap.outcomes().where("status = 'failed'").collect()}
    assert failed == {None: set(), "lost": {"s1"}, "moved": {"s0", "s1"}, "changed": {"s1"}}[harm]
    assert read.value == 2000 if harm is None else read.value > 4000
    stored = read_slices(spark, f"{snap.data}/t", spark.read.parquet(source).schema).drop("slice_id")
    assert same(stored, spark.read.parquet(source))


# Units by bytes


@pytest.mark.parametrize("n", [1, 4, 50])
def test_units_hold_the_mean_and_one_more(spark, n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 10, 1000, None]) for _ in range(300)] + [50_000]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i long, size long").repartition(5)
    order = Order((), ("i",))
    found = byte_units(frame, n, "size", order).orderBy("i").collect()
    units = [r.unit for r in found]
    assert units == sorted(units) and min(units) == 0 and max(units) <= n - 1
    weights = [(s or 0) + 1 for s in sizes]
    for u in set(units):
        own = [w for w, x in zip(weights, units) if x == u]
        assert sum(own) <= sum(weights) / n + max(own)
    dealt = byte_units(frame, n, "size", order).repartitionById(n, F.col("unit")).withColumn("task", F.spark_partition_id())
    assert dealt.where("task <> unit").isEmpty()
    assert byte_units(frame.limit(0), n, "size", order).count() == 0
