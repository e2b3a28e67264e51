"""Snapshots and restores from end to end, with faults."""

import random

import pytest
from pyspark.sql import functions as F

from keysnap import KeyedTable, read_restored, restore_tables, take_snapshot
from keysnap.operators.restore import restore_summary
from keysnap.plans.restore import RestoreError, open_snapshot, read_restored_catalog
from keysnap.plans.snapshot import RowCopier, SnapshotError
from keysnap.schema import CATALOG_COLS
from keysnap.sources import rows as rows_module
from keysnap.sources.rows import OverlapError, read_slices, tag_rows

CHILD = "struct<table_name:string,slice_id:string,start_key:string,end_key:string,region_id:bigint>"
CATALOG = (
    "table_name string, slice_id string, start_key string, end_key string, region_id bigint,"
    "row_key string, server string, host string, port int, server_start_code bigint,"
    f"is_split boolean, is_offline boolean, split_a {CHILD}, split_b {CHILD}"
)


def row(table, sid, start, end, region=1, split=None):
    kids = split or (None, None)
    return (table, sid, start, end, region, f"{table},{start},{region}", "h:1", "h", 1, 1,
            bool(split), bool(split), *kids)


def catalog(spark, rows):
    return spark.createDataFrame(rows, CATALOG).select(*CATALOG_COLS)


def tiles(table, cuts):
    edges = ["", *cuts, ""]
    return [row(table, f"s{i}", a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def pad(k, width=6):
    return str(k).zfill(width)


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    """A table in which one key holds a third of the rows, with exact copies among them."""
    path = str(tmp_path_factory.mktemp("numbers"))
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(777)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 7)).alias("v"),
        F.array(F.col("id").cast("float")).alias("a"),
    )
    df = df.withColumn("a", F.when(F.col("k") == 777, None).otherwise(F.col("a")))
    df.repartition(4).write.mode("overwrite").parquet(path)
    return path


def numbers_table(path, **kw):
    return KeyedTable("numbers", path, "k", 6, **kw)


@pytest.mark.parametrize("clustered", [False, True])
def test_roundtrip(spark, numbers, tmp_path, clustered):
    cat = catalog(spark, tiles("numbers", [pad(500), pad(777), pad(778), pad(5000)]))
    copier = RowCopier([numbers_table(numbers, clustered=clustered)])
    snap = take_snapshot(spark, copier, lambda _: cat, str(tmp_path / "s"))
    seal = snap.seal().head()
    assert seal.verified and seal.tables == ["numbers"] and seal.name.startswith("bak-")
    assert snap.path.endswith(seal.name.rsplit("-", 1)[0])
    manifest = {r.slice_id: r for r in snap.manifest().collect()}
    assert set(manifest) == {"s0", "s1", "s2", "s3", "s4"}
    assert manifest["s2"].rows == 1000 and manifest["s4"].rows == 0
    assert manifest["s0"].files >= 1 and manifest["s0"].bytes > 0
    out = restore_tables(spark, snap.path, str(tmp_path / "t")).collect()
    assert [(r.table_name, r.status, r.rows) for r in out] == [("numbers", "restored", 3000)]
    restored = read_restored(spark, str(tmp_path / "t"), "numbers")
    source = spark.read.parquet(numbers)
    assert restored.schema == source.schema and same(restored, source)
    back = read_restored_catalog(spark, str(tmp_path / "t"), ["numbers"])
    assert back.count() == 5 and back.where("is_split or is_offline").isEmpty()
    # The target exists now; nothing is overwritten.
    with pytest.raises(RestoreError, match="numbers: exists"):
        restore_tables(spark, snap.path, str(tmp_path / "t"))


def test_retry_copies_only_what_failed(spark, numbers, tmp_path):
    cat = catalog(spark, tiles("numbers", [pad(500), pad(1000), pad(2000)]))

    def fault(df, table, attempt):
        if attempt == 1:  # rows lost in s1, content changed in s2
            df = df.where("slice_id <> 's1' or k % 2 = 0")
            return df.withColumn("v", F.when(F.col("slice_id") == "s2", None).otherwise(F.col("v")))
        if attempt == 2:
            return df.where("slice_id <> 's2'")
        return df

    copier = RowCopier([numbers_table(numbers)], fault)
    snap = take_snapshot(spark, copier, lambda _: cat, str(tmp_path / "s"))
    got = {(r.slice_id, r.attempt): r.status for r in snap.outcomes().collect()}
    assert got == {
        ("s0", 1): "copied", ("s1", 1): "failed", ("s2", 1): "failed", ("s3", 1): "copied",
        ("s1", 2): "copied", ("s2", 2): "failed", ("s2", 3): "copied",
    }
    errors = {r.slice_id: r.error for r in snap.outcomes().where("attempt = 1").collect()}
    assert "rows stored" in errors["s1"] and errors["s2"] == "content differs"
    assert snap.seal().head().verified
    source = spark.read.parquet(numbers)
    stored = read_slices(spark, f"{snap.data}/numbers", source.schema).drop("slice_id")
    assert same(stored, source)


def test_rounds_end_and_unverified_snapshots_are_refused(spark, numbers, tmp_path):
    cat = catalog(spark, tiles("numbers", [pad(500), pad(1000)]))
    copier = RowCopier([numbers_table(numbers)], lambda df, t, a: df.where("slice_id <> 's1' or k < 600"))
    snap = take_snapshot(spark, copier, lambda _: cat, str(tmp_path / "s"), max_tries=2)
    assert not snap.seal().head().verified
    assert [(r.start_key, r.issue) for r in snap.issues().collect()] == [(pad(1000), "gap")]
    # What the failed slice left behind is gone.
    stored = read_slices(spark, f"{snap.data}/numbers", spark.read.parquet(numbers).schema)
    assert {r.slice_id for r in stored.select("slice_id").distinct().collect()} == {"s0", "s2"}
    with pytest.raises(RestoreError, match="not verified"):
        restore_tables(spark, snap.path, str(tmp_path / "t"))
    out = restore_tables(spark, snap.path, str(tmp_path / "t"), allow_unverified=True).head()
    assert out.status == "restored" and out.rows < 3000


def test_split_between_rounds(spark, numbers, tmp_path):
    """A parent fails and is gone afterwards: its daughters are copied. The daughters of a
    parent that was copied are not."""

    def daughters(sid, start, mid, end):
        return (("numbers", f"{sid}a", start, mid, 2), ("numbers", f"{sid}b", mid, end, 2))

    first_kids = daughters("s0", "", pad(100), pad(500))
    last_kids = daughters("s2", pad(1000), pad(1500), "")
    parents = [
        row("numbers", "s0", "", pad(500), split=first_kids),
        row("numbers", "s1", pad(500), pad(1000)),
        row("numbers", "s2", pad(1000), "", split=last_kids),
    ]
    kids = [row(*k) for k in (*first_kids, *last_kids)]
    before = catalog(spark, parents + kids)
    after = catalog(spark, [parents[1], *kids])
    copier = RowCopier(
        [numbers_table(numbers)],
        lambda df, t, a: df.where("slice_id <> 's2'") if a == 1 else df,
    )
    snap = take_snapshot(spark, copier, lambda a: before if a == 1 else after, str(tmp_path / "s"))
    got = sorted((r.slice_id, r.attempt) for r in snap.manifest().collect())
    assert got == [("s0", 1), ("s1", 1), ("s2a", 2), ("s2b", 2)]
    assert snap.seal().head().verified
    source = spark.read.parquet(numbers)
    stored = read_slices(spark, f"{snap.data}/numbers", source.schema).drop("slice_id")
    assert same(stored, source)


def test_refusals(spark, numbers, tmp_path):
    copier = RowCopier([numbers_table(numbers)])
    other = catalog(spark, tiles("other", []))
    with pytest.raises(SnapshotError, match="numbers"):
        take_snapshot(spark, copier, lambda _: other, str(tmp_path / "a"))
    crossing = catalog(
        spark, [row("numbers", "x", "", pad(9)), row("numbers", "y", pad(5), "")]
    )
    with pytest.raises(OverlapError, match="slice y overlaps"):
        take_snapshot(spark, copier, lambda _: crossing, str(tmp_path / "b"))
    bad = catalog(spark, [row("numbers", "../x", "", "")])
    with pytest.raises(SnapshotError, match="slice ids"):
        take_snapshot(spark, copier, lambda _: bad, str(tmp_path / "c"))


def test_rows_without_key_are_reported(spark, tmp_path):
    path = str(tmp_path / "src")
    spark.createDataFrame([(1,), (None,)], "k bigint").write.parquet(path)
    cat = catalog(spark, tiles("n", []))
    snap = take_snapshot(
        spark, RowCopier([KeyedTable("n", path, "k", 6)]), lambda _: cat, str(tmp_path / "s")
    )
    assert [r.issue for r in snap.issues().collect()] == ["rows without key"]
    assert not snap.seal().head().verified


def test_restore_gates(spark, numbers, tmp_path):
    cat = catalog(spark, tiles("numbers", [pad(500)]))
    snap = take_snapshot(
        spark, RowCopier([numbers_table(numbers)]), lambda _: cat, str(tmp_path / "s")
    )
    with pytest.raises(RestoreError, match="nothing: not found"):
        restore_tables(spark, snap.path, str(tmp_path / "t"), ["numbers", "nothing"])
    assert not (tmp_path / "t").exists()
    with pytest.raises(RestoreError, match="does not exist"):
        open_snapshot(spark, str(tmp_path / "none"))
    # An unknown slice directory makes the table fail, and leaves no trace.
    data = tmp_path / "s" / snap.path.rsplit("/", 1)[1] / "data" / "numbers"
    (data / "slice_id=zz").mkdir()
    out = restore_tables(spark, snap.path, str(tmp_path / "t"))
    assert out.head().status == "failed" and "zz" in out.head().error
    assert restore_summary(out).head().status == "failed"
    assert not (tmp_path / "t" / "numbers").exists()
    (data / "slice_id=zz").rmdir()
    # So does a lost file.
    part = next((data / "slice_id=s1").glob("*.parquet"))
    kept = part.read_bytes()
    part.unlink()
    assert restore_tables(spark, snap.path, str(tmp_path / "t")).head().status == "failed"
    part.write_bytes(kept)
    out = restore_tables(spark, snap.path, str(tmp_path / "t"), retain_original=False)
    assert restore_summary(out).head().status == "ok"
    assert not data.exists()


def test_other_tables_go_on(spark, numbers, tmp_path):
    cat = catalog(spark, tiles("numbers", [pad(500)]) + tiles("again", [pad(9)]))
    tables = [numbers_table(numbers), KeyedTable("again", numbers, "k", 6)]
    snap = take_snapshot(spark, RowCopier(tables), lambda _: cat, str(tmp_path / "s"))
    data = tmp_path / "s" / snap.path.rsplit("/", 1)[1] / "data" / "again"
    next((data / "slice_id=s1").glob("*.parquet")).unlink()
    out = restore_tables(spark, snap.path, str(tmp_path / "t"))
    assert {r.table_name: r.status for r in out.collect()} == {
        "again": "failed", "numbers": "restored"
    }
    assert restore_summary(out).head().status == "partial"


KEYS = ["", "a", "a\x00", "a\x00b", "ab", "é", "éa", "z", "日本", "😀", "~"]


def test_text_keys(spark):
    """Unicode and zero characters keep Spark's own order."""
    cuts = sorted(["a\x00", "b", "é", "日"], key=lambda s: s.encode())
    edges = ["", *cuts, ""]
    slices = [(a, b, f"s{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    df = spark.createDataFrame([(k,) for k in KEYS] + [(None,)], "k string")
    got = {r.k: r.slice_id for r in tag_rows(df, KeyedTable("t", "", "k"), slices).collect()}
    assert got.pop(None) is None
    for k, sid in got.items():
        b = k.encode()
        want = [s for a, e, s in slices if a.encode() <= b and (not e or b < e.encode())]
        assert [sid] == want


@pytest.mark.parametrize("width", [6, 20])
def test_number_keys_and_holes(spark, width):
    rng = random.Random(4)
    base = 0 if width == 6 else 2**60  # beyond what a double holds exactly
    cuts = sorted(base + c for c in rng.sample(range(1, 900), 9))
    slices = [
        (pad(a, width), pad(b, width), f"s{i}")
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        if i % 3  # leaves holes
    ]
    keys = [base + i for i in range(900)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k bigint")
    table = KeyedTable("t", "", "k", width)
    got = {r.k: r.slice_id for r in tag_rows(df, table, slices).collect()}
    assert got.pop(None) is None and len(got) == 900
    for k, sid in got.items():
        want = [s for a, b, s in slices if int(a) <= k < int(b)]
        assert [sid] == (want or [None])


def test_many_slices_take_several_passes(spark, numbers, tmp_path, monkeypatch):
    monkeypatch.setattr(rows_module, "MAX_SCAN_RANGES", 2)
    cat = catalog(spark, tiles("numbers", [pad(k) for k in range(300, 3000, 300)]))
    original = rows_module.copy_slices

    def limited(*args):
        return original(*args, max_slices=4)

    monkeypatch.setattr("keysnap.plans.snapshot.copy_slices", limited)
    snap = take_snapshot(
        spark, RowCopier([numbers_table(numbers)]), lambda _: cat, str(tmp_path / "s")
    )
    assert snap.seal().head().verified and snap.manifest().count() == 10
    source = spark.read.parquet(numbers)
    stored = read_slices(spark, f"{snap.data}/numbers", source.schema).drop("slice_id")
    assert same(stored, source)


def test_copying_again_needs_no_shuffle_when_clustered(spark, numbers):
    table = numbers_table(numbers)
    tagged = tag_rows(table.open(spark), table, [("", pad(500), "a"), (pad(500), "", "b")])
    plan = tagged.where("slice_id is not null")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_hot_slice_is_written_by_many_tasks(spark, tmp_path):
    """Adaptive execution splits a slice that holds most of the rows."""
    path = str(tmp_path / "hot")
    spark.range(0, 400_000, 1, 16).select(
        F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    ).write.parquet(path)
    table = KeyedTable("hot", path, "k", 6)
    slices = [("", pad(7), "a"), (pad(7), pad(8), "b"), (pad(8), "", "c")]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 << 20))
    try:
        rows_module.write_slices(
            tag_rows(table.open(spark), table, slices), str(tmp_path / "out"), False
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {s: len(list((tmp_path / "out" / f"slice_id={s}").glob("*.parquet"))) for s in "abc"}
    assert files["b"] >= 4 and files["c"] >= 1


def test_binary_keys(spark, tmp_path):
    path = str(tmp_path / "bin")
    keys = [bytes([a, b]) for a in range(0, 256, 5) for b in (0, 127, 255)] + [b"", b"\x00"]
    spark.createDataFrame([(bytearray(k), len(k)) for k in keys], "k binary, n int").write.parquet(path)
    cuts = [b"\x00\x7f", b"\x7f", b"\xc8"]
    cat = catalog(spark, tiles("bin", [c.hex().upper() for c in cuts]))
    copier = RowCopier([KeyedTable("bin", path, "k")])
    snap = take_snapshot(spark, copier, lambda _: cat, str(tmp_path / "s"))
    assert snap.seal().head().verified
    edges = [b"", *cuts, b"\xff\xff\xff"]
    want = {f"s{i}": sum(a <= k < b for k in keys) for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    assert {r.slice_id: r.rows for r in snap.manifest().collect()} == want


def test_check_by_count(spark, numbers, tmp_path):
    cat = catalog(spark, tiles("numbers", [pad(500)]))
    copier = RowCopier(
        [numbers_table(numbers, check="count")],
        lambda df, t, a: df.where("slice_id <> 's1' or k < 600") if a == 1 else df,
    )
    snap = take_snapshot(spark, copier, lambda _: cat, str(tmp_path / "s"))
    assert sorted((r.slice_id, r.attempt) for r in snap.manifest().collect()) == [("s0", 1), ("s1", 2)]
    assert restore_tables(spark, snap.path, str(tmp_path / "t")).head().rows == 3000


def test_scan_asks_for_few_key_ranges(spark, numbers):
    """A retry of a few slices reads their key ranges only; many are put together."""
    table = numbers_table(numbers)
    df = table.open(spark)
    slices = [(pad(k), pad(k + 10), f"s{k}") for k in range(0, 2000, 20)]
    kept = df.where(rows_module.pruning_filter(df, table, slices))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Or(Or(" in plan.split("PushedFilters: ")[1]
    inside = F.floor(F.col("k") / 10) % 2 == 0
    lost = df.where(inside & (F.col("k") < 2000)).exceptAll(kept)
    assert lost.isEmpty() and kept.where("k >= 2000").isEmpty()
    few = df.where(rows_module.pruning_filter(df, table, slices[3:5]))
    assert {r.k for r in few.collect()} <= set(range(60, 70)) | set(range(80, 90))
    touching = [("", pad(9), "a"), (pad(9), "", "b")]
    assert df.where(rows_module.pruning_filter(df, table, touching)).count() == 3000


def test_keys_out_of_range(spark):
    """Negative keys and keys wider than the padding go to the first and the last slice."""
    slices = [("", pad(5, 18), "a"), (pad(5, 18), str(2**53 + 9).zfill(18), "b"),
              (str(2**53 + 9).zfill(18), "", "c")]
    keys = [-7, 0, 4, 5, 2**53, 2**53 + 8, 2**53 + 9, 10**18 + 1]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.slice_id for r in tag_rows(df, KeyedTable("t", "", "k", 18), slices).collect()}
    assert [got[k] for k in keys] == ["a", "a", "a", "b", "b", "b", "c", "c"]


def test_key_types(spark, tmp_path):
    df = spark.range(3)
    for frame, table in [
        (df, KeyedTable("t", "", "id")),
        (df.select(F.col("id").cast("string")), KeyedTable("t", "", "id", 6)),
        (df.select(F.col("id").cast("double")), KeyedTable("t", "", "id")),
    ]:
        with pytest.raises(ValueError, match="has to be integral"):
            rows_module.check_key(frame, table)


def test_catalog_scan_reads_what_it_needs(spark, tmp_path):
    from keysnap.operators.catalog import decode_catalog, encode_catalog, scan_catalog

    path = str(tmp_path / "catalog")
    cat = catalog(spark, tiles("t", ["b", "d"]))
    encode_catalog(cat).withColumn("other", F.lit("x")).write.parquet(path)
    raw = scan_catalog(spark, path)
    plan = raw.select("row_key")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_key:string>" in plan and "other" not in raw.columns
    assert same(decode_catalog(raw).select(*CATALOG_COLS), cat)
