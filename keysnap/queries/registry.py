"""The registered queries. Each takes a session and a directory of parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.functions.names import format_snapshot_name, parse_snapshot_names
from keysnap.functions.text import endpoint_host, endpoint_port, relative_path
from keysnap.operators import catalog as cat
from keysnap.operators import cover, logs, restore, rounds
from keysnap.plans.archive import archive_once
from keysnap.operators.ordered import Order
from keysnap.plans.restore import (
    read_restored, read_restored_catalog, restore_tables, restored_path, table_log,
)
from keysnap.plans.snapshot import FileCopier, RowCopier, resume_snapshot, take_snapshot
from keysnap.queries.fixtures import N_SLICES, WIDTH, fixture, table
from keysnap.schema import CATALOG_COLS, SLICE, SLICE_COLS
from keysnap.session import cut, fresh_dir, local_frame
from keysnap.sources import listing
from keysnap.sources.descriptors import format_descriptor, is_descriptor, read_families
from keysnap.sources.files import copy_files as copy_files_job
from keysnap.sources.files_source import read_files
from keysnap.sources.ranges import copy_by_ranges, file_checksums
from keysnap.sources.files import delete_paths as delete_paths_job
from keysnap.sources.rows import KeyedTable, read_slices
from keysnap.sources.slice_files import copy_slice_files
from keysnap.sources.storage import names_in, open_fs, parent
from keysnap.streaming.archive_stream import archive_stream
from keysnap.streaming.grown_files import grown_files_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
BACKED_UP = ["orders", "customer"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


# Catalog


def typed_catalog(flat: DataFrame) -> DataFrame:
    """CATALOG rows from a catalog fixture."""

    def child(suffix: str, start: str, end: str):
        return F.when(
            F.col("mid_key").isNotNull(),
            F.struct(
                "table_name",
                F.concat("slice_id", F.lit(suffix)).alias("slice_id"),
                F.col(start).alias("start_key"),
                F.col(end).alias("end_key"),
                F.lit(2).cast("bigint").alias("region_id"),
            ),
        )

    return flat.select(
        *SLICE_COLS,
        F.concat_ws(",", "table_name", "start_key", F.col("region_id").cast("string")).alias(
            "row_key"
        ),
        "server",
        F.split("server", ":")[0].alias("host"),
        F.coalesce(F.get(F.split("server", ":"), F.lit(1)).cast("int"), F.lit(80)).alias("port"),
        (F.lit(1_700_000_000_000) + F.col("slice_no")).alias("server_start_code"),
        "is_split",
        "is_offline",
        child("a", "start_key", "mid_key").alias("split_a"),
        child("b", "mid_key", "end_key").alias("split_b"),
    ).select(*CATALOG_COLS)


def catalog1(spark: SparkSession, sf: str) -> DataFrame:
    return typed_catalog(fixture(spark, sf, "catalog1"))


def raw_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows; some blobs are broken and some servers unknown."""
    raw = cat.encode_catalog(catalog1(spark, sf)).withColumn("note", F.lit("not decoded"))
    broken = F.col("row_key").startswith("supplier") & F.col("row_key").endswith(",2")
    homeless = F.col("row_key").startswith("part,,")
    return raw.withColumns(
        {
            "blob": F.when(broken, F.lit("{broken")).otherwise(F.col("blob")),
            "server": F.when(~homeless, F.col("server")),
        }
    )


@query
def catalog_scan(spark, sf):
    raw = cat.scan_catalog(spark, raw_catalog(spark, sf))
    return raw.select(
        "row_key", "server", "server_start_code", F.col("split_a").isNotNull().alias("has_split")
    )


@query
def catalog_decode(spark, sf):
    decoded = cat.decode_catalog(cat.scan_catalog(spark, raw_catalog(spark, sf)))
    return decoded.select(
        *SLICE_COLS, "row_key", "host", "port", "is_split", "is_offline",
        F.col("split_a.end_key").alias("split_a_end"),
        F.col("split_b.slice_id").alias("split_b_id"),
    )


@query
def catalog_rejects(spark, sf):
    return cat.catalog_rejects(cat.scan_catalog(spark, raw_catalog(spark, sf)))


@query
def split_daughters(spark, sf):
    return cat.split_daughters(catalog1(spark, sf))


@query
def split_not_offline(spark, sf):
    return cat.split_not_offline(catalog1(spark, sf))


@query
def select_slices(spark, sf):
    chosen = cat.select_slices(catalog1(spark, sf), [*BACKED_UP, "no such table"])
    return chosen.select(*SLICE_COLS, "server", "is_split")


@query
def slices_by_table(spark, sf):
    return cat.slices_by_table(cat.select_slices(catalog1(spark, sf)))


@query
def slices_sorted(spark, sf):
    return cat.slices_sorted(catalog1(spark, sf)).select(*SLICE_COLS)


@query
def work_units(spark, sf):
    return rounds.work_units(cat.select_slices(catalog1(spark, sf), BACKED_UP), 5)


@query
def work_units_many(spark, sf):
    ranges = fixture(spark, sf, "ranges").withColumn("server", F.concat(F.lit("rs"), "status"))
    return rounds.work_units(ranges, 64)


@query
def work_units_bytes(spark, sf):
    """Orders as files of very different sizes, dealt out over 64 tasks by bytes: each task's files
    and bytes, counted by the task itself."""
    files = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 97 * F.col("o_custkey") % 1009 * F.col("o_custkey")).alias("length")
    )
    dealt = rounds.byte_units(files, 64, "length", Order((), ("o_orderkey",))).repartitionById(64, F.col("unit"))
    return dealt.withColumn("task", F.spark_partition_id()).groupBy("task", "unit").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )


@query
def slice_paths(spark, sf):
    return cat.slice_paths(catalog1(spark, sf), "/store/")


@query
def relative_path_of(spark, sf):
    paths = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return paths.select(
        "page_id", relative_path(F.col("path"), "http://ththre.example.com").alias("rel_path")
    )


@query
def server_endpoints(spark, sf):
    servers = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_nationkey") < 5, F.col("s_name"))
        .otherwise(F.concat(F.lit("a:b:"), F.col("s_nationkey").cast("string")))
        .alias("endpoint"),
    )
    return servers.select(
        "s_suppkey",
        endpoint_host(F.col("endpoint")).alias("host"),
        endpoint_port(F.col("endpoint")).alias("port"),
    )


# Rounds


def outcomes1(spark, sf):
    return fixture(spark, sf, "outcomes1")


@query
def failed_slices(spark, sf):
    return rounds.failed_slices(outcomes1(spark, sf), 1)


@query
def copied_slices(spark, sf):
    done = outcomes1(spark, sf)
    return rounds.copied_slices(fixture(spark, sf, "work1"), rounds.failed_slices(done, 1))


@query
def contained_slices(spark, sf):
    flat = fixture(spark, sf, "catalog1").select(*SLICE_COLS)
    return cover.contained_slices(flat, fixture(spark, sf, "copied1"))


@query
def contained_slices_many(spark, sf):
    ranges = fixture(spark, sf, "ranges")
    covers = ranges.where("status = 'F'")
    return cover.contained_slices(ranges.where("status <> 'F'"), covers).select(*SLICE_COLS)


def remaining1(spark, sf):
    catalog2 = cut(typed_catalog(fixture(spark, sf, "catalog2")))
    return rounds.remaining_slices(catalog2, cut(fixture(spark, sf, "copied1")), BACKED_UP)


@query
def remaining_slices(spark, sf):
    return remaining1(spark, sf).select(*SLICE_COLS, "server")


@query
def copy_counters(spark, sf):
    return rounds.copy_counters(outcomes1(spark, sf))


@query
def coverage_issues(spark, sf):
    return cover.coverage_issues(fixture(spark, sf, "copied1"))


@query
def coverage_issues_many(spark, sf):
    return cover.coverage_issues(fixture(spark, sf, "near_tiles"))


@query
def coverage_after_retry(spark, sf):
    """Tables whose copied and remaining slices together still fail to tile: none."""
    copied = fixture(spark, sf, "copied1").select(*SLICE_COLS)
    both = copied.unionByName(remaining1(spark, sf).select(*SLICE_COLS))
    return cover.coverage_issues(cut(both)).groupBy("table_name").agg(F.count("*").alias("n_issues"))


# Snapshots


def keyed(sf: str, name: str, key: str, width: int | None = WIDTH) -> KeyedTable:
    return KeyedTable(name, f"{sf}/{name}.parquet", key, width)


def slices_of(spark, sf, fixture_name: str = "slices") -> DataFrame:
    """A plain catalog of one of the slice fixtures: nothing split."""
    flat = fixture(spark, sf, fixture_name)
    return flat.select(
        "table_name", "slice_id", "start_key", "end_key",
        F.lit(1).cast("bigint").alias("region_id"),
        F.concat_ws(",", "table_name", "start_key").alias("row_key"),
        F.lit("rs0:60020").alias("server"),
        F.lit("rs0").alias("host"),
        F.lit(60020).alias("port"),
        F.lit(1).cast("bigint").alias("server_start_code"),
        F.lit(False).alias("is_split"),
        F.lit(False).alias("is_offline"),
        F.lit(None).cast(SLICE).alias("split_a"),
        F.lit(None).cast(SLICE).alias("split_b"),
    )


def snapshot_of(spark, sf, tables, fixture_name="slices", n_slices=N_SLICES, fault=None):
    catalog = slices_of(spark, sf, fixture_name)
    return take_snapshot(
        spark, RowCopier(tables, fault), lambda attempt: catalog,
        fresh_dir(spark, "snapshot"), n=n_slices,
    )


@query
def snapshot_roundtrip(spark, sf):
    """Orders as the snapshot holds them, each row with its slice."""
    snapshot = snapshot_of(spark, sf, [keyed(sf, "orders", "o_orderkey")])
    return read_slices(spark, f"{snapshot.data}/orders", table(spark, sf, "orders").schema)


@query
def slice_manifest(spark, sf):
    """The manifest, with the sum of the keys that each slice really holds."""
    tables = [keyed(sf, "part", "p_partkey"), keyed(sf, "supplier", "s_suppkey")]
    snapshot = snapshot_of(spark, sf, tables)
    sums = [
        read_slices(spark, f"{snapshot.data}/{t.name}", t.open(spark).schema)
        .groupBy("slice_id")
        .agg(F.sum(t.key).alias("key_sum"))
        .withColumn("table_name", F.lit(t.name))
        for t in tables
    ]
    return snapshot.manifest().select(*SLICE_COLS, "attempt", "rows").join(
        sums[0].unionByName(sums[1]), ["table_name", "slice_id"], "left"
    )


class Lost(RuntimeError):
    """Stands for a driver that is lost."""


class LosingCopier(RowCopier):
    """Copies one table in the second round, then is gone."""

    def copy(self, work, snapshot, attempt):
        if attempt != 2:
            return super().copy(work, snapshot, attempt)
        self._copy_one(work, self.tables[1], snapshot, attempt)
        raise Lost


@query
def snapshot_retry_roundtrip(spark, sf):
    """Some slices lose rows in the first attempt, and one split parent is gone in the second;
    every row is stored once, in the slice and attempt that copied it."""
    return retried_snapshot(spark, sf, RowCopier)


@query
def snapshot_resume_roundtrip(spark, sf):
    """The same, with a run that is lost in the second round, when it has copied customers only; the
    run that resumes it copies just what is left of orders, in a third."""
    return retried_snapshot(spark, sf, LosingCopier)


def retried_snapshot(spark, sf, kind) -> DataFrame:
    flat = cut(fixture(spark, sf, "catalog1"))
    losing = {t: [] for t in BACKED_UP}
    for r in fixture(spark, sf, "att1").where("is_failed").collect():  # at most 16 slices
        losing[r.table_name].append(r.slice_id)

    def fault(rows, name, attempt):
        return rows if attempt > 1 else rows.where(~F.col("slice_id").isin(losing[name]))

    def fresh(attempt):
        gone = F.col("is_split") & (F.col("slice_no") == 2)
        return typed_catalog(flat if attempt == 1 else flat.where(~gone))

    tables = [keyed(sf, "orders", "o_orderkey"), keyed(sf, "customer", "c_custkey")]
    dest = fresh_dir(spark, "snapshot")
    try:
        snapshot = take_snapshot(spark, kind(tables, fault), fresh, dest, n=4)
    except Lost:
        unsealed = names_in(spark, dest)[0]
        snapshot = resume_snapshot(spark, RowCopier(tables, fault), fresh, f"{dest}/{unsealed}", n=4)
    stored = [
        read_slices(spark, f"{snapshot.data}/{t.name}", t.open(spark).schema).select(
            F.lit(t.name).alias("table_name"), F.col(t.key).alias("row_id"), "slice_id"
        )
        for t in tables
    ]
    attempts = snapshot.manifest().select("table_name", "slice_id", "attempt")
    return stored[0].unionByName(stored[1]).join(attempts, ["table_name", "slice_id"])


@query
def snapshot_failing_table(spark, sf):
    """Slices and rows by table, round and outcome, of four tables copied side by side; the first job
    of one of them fails as a whole, which its own slices alone are retried for."""

    def fault(rows, name, attempt):
        if name == "part" and attempt == 1:
            raise RuntimeError("no space left")
        return rows

    keys = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
    snapshot = snapshot_of(spark, sf, [keyed(sf, t, k) for t, k in keys.items()], fault=fault)
    return snapshot.outcomes().groupBy("table_name", "attempt", "status", "error").agg(
        F.count("*").alias("slices"), F.sum("rows").alias("rows")
    )


@query
def snapshot_name_format(spark, sf):
    times = fixture(spark, sf, "name_times")
    return times.select(
        "o_orderkey",
        format_snapshot_name(F.col("t1")).alias("running_name"),
        format_snapshot_name(F.col("t1"), F.col("t2")).alias("sealed_name"),
    )


@query
def latest_descriptor(spark, sf):
    return listing.latest_descriptor(fixture(spark, sf, "descriptor_files"))


@query
def older_descriptors(spark, sf):
    return listing.older_descriptors(fixture(spark, sf, "descriptor_files"))


@query
def missing_descriptors(spark, sf):
    users = table(spark, sf, "events").select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_name")
    )
    every = users.unionByName(
        table(spark, sf, "nation").select(F.col("n_name").alias("table_name"))
    ).distinct()
    return listing.missing_descriptors(
        every, listing.latest_descriptor(fixture(spark, sf, "descriptor_files"))
    )


# Restore


@query
def snapshot_name_parse(spark, sf):
    times = fixture(spark, sf, "name_times")
    good = format_snapshot_name(F.col("t1"), F.col("t2"))
    kind = F.col("o_orderpriority")
    name = (
        F.when(kind == "2-HIGH", format_snapshot_name(F.col("t1")))
        .when(kind == "3-MEDIUM", F.concat(F.lit("x"), good))
        .when(kind == "4-NOT SPECIFIED", format_snapshot_name(F.col("t2"), F.col("t1")))
        .otherwise(good)
    )
    parsed = parse_snapshot_names(times.select("o_orderkey", name.alias("name")))
    return parsed.select(
        "o_orderkey",
        F.col("started").cast("timestamp_ntz").alias("started"),
        F.col("ended").cast("timestamp_ntz").alias("ended"),
    )


@query
def snapshot_tables(spark, sf):
    manifest = fixture(spark, sf, "slices").select("table_name").unionByName(
        table(spark, sf, "region").select(F.lit(".META.").alias("table_name"))
    )
    described = table(spark, sf, "region").select(F.lit(".META.").alias("table_name"))
    for name in ("orders", "part"):
        rows = table(spark, sf, name).select(F.lit(name).alias("table_name"))
        described = described.unionByName(rows)
    return restore.snapshot_tables(manifest, described)


@query
def restore_checks(spark, sf):
    orders, events = table(spark, sf, "orders"), table(spark, sf, "events")
    priority = F.col("o_orderpriority").alias("table_name")
    kind = F.col("event_type").alias("table_name")
    requested = orders.select(priority).unionByName(events.select(kind))
    available = orders.select(priority).unionByName(events.where("event_type < 'e'").select(kind))
    existing = orders.where("o_orderpriority < '3'").select(priority).unionByName(
        events.where("event_type > 'v'").select(kind)
    )
    return restore.restore_checks(requested, available, existing)


@query
def restore_manifest_check(spark, sf):
    return restore.restore_manifest_check(
        fixture(spark, sf, "table_dirs"), fixture(spark, sf, "line_manifest")
    )


@query
def restore_catalog_rows(spark, sf):
    rows = restore.restore_catalog_rows(fixture(spark, sf, "work1"))
    return rows.select(*SLICE_COLS, "row_key", "is_split", "is_offline")


@query
def restore_roundtrip(spark, sf):
    """Line items after a snapshot and a restore: many rows per key, no unique key."""
    tables = [keyed(sf, "lineitem", "l_orderkey")]
    snapshot = snapshot_of(spark, sf, tables, "line_slices")
    target = fresh_dir(spark, "restored")
    cut(restore_tables(spark, snapshot.path, target))
    return read_restored(spark, target, "lineitem")


@query
def restore_roundtrip_text_keys(spark, sf):
    """Pages after a snapshot by URL and a restore."""
    tables = [keyed(sf, "pages", "url", None)]
    snapshot = snapshot_of(spark, sf, tables, "page_slices")
    target = fresh_dir(spark, "restored")
    cut(restore_tables(spark, snapshot.path, target))
    return read_restored(spark, target, "pages")


@query
def restore_versions(spark, sf):
    """Customers as readers see them after a restore of all, one of those with a balance that
    replaces it, one that was cut off before it could publish, and one that lost the race."""
    every = keyed(sf, "customer", "c_custkey")
    rich = KeyedTable("customer", lambda s: table(s, sf, "customer").where("c_acctbal > 0"), "c_custkey", WIDTH)
    first, second = snapshot_of(spark, sf, [every]), snapshot_of(spark, sf, [rich])
    target = fresh_dir(spark, "restored")
    cut(restore_tables(spark, first.path, target))
    cut(restore_tables(spark, second.path, target, replace=True))
    table(spark, sf, "customer").write.parquet(f"{target}/customer/data-cut-off")
    number = table_log(spark, target, "customer").next_number() - 1
    late = table_log(spark, target, "customer").commit(number, {"data": "data-cut-off"})
    return read_restored(spark, target, "customer").withColumn("late_one_won", F.lit(late))


@query
def restored_catalog(spark, sf):
    """The catalog rows that a restore of two of three tables registers."""
    tables = [
        keyed(sf, "part", "p_partkey"), keyed(sf, "supplier", "s_suppkey"),
        keyed(sf, "customer", "c_custkey"),
    ]
    snapshot = snapshot_of(spark, sf, tables)
    target = fresh_dir(spark, "restored")
    cut(restore_tables(spark, snapshot.path, target, ["part", "customer"]))
    return read_restored_catalog(spark, target, ["part", "customer"]).select(
        *SLICE_COLS, "is_split", "is_offline"
    )


@query
def restore_summary(spark, sf):
    status = F.when(F.col("status") == "copied", "restored").otherwise("failed")
    return restore.restore_summary(outcomes1(spark, sf).withColumn("status", status))


# Logs

RUN_MS = 1706659200000  # 2024-01-31
KEEP_DAYS = 7
EMPTY_DAY_MARK = 946684800000  # 2000-01-01


@query
def log_list(spark, sf):
    return logs.list_logs(fixture(spark, sf, "log_files"))


@query
def log_list_min_start(spark, sf):
    return logs.list_logs(fixture(spark, sf, "log_files"), RUN_MS - 10 * logs.DAY_MS)


@query
def log_oldest_start(spark, sf):
    return logs.oldest_start(logs.list_logs(fixture(spark, sf, "log_files")))


@query
def logs_invalid(spark, sf):
    return logs.invalid_logs(fixture(spark, sf, "log_files"))


@query
def logs_colliding(spark, sf):
    return logs.colliding_logs(fixture(spark, sf, "log_files"))


@query
def logs_new(spark, sf):
    return logs.new_logs(fixture(spark, sf, "logs"), fixture(spark, sf, "archive"))


@query
def logs_new_many(spark, sf):
    return logs.new_logs(fixture(spark, sf, "hour_logs"), fixture(spark, sf, "hour_archive"))


@query
def logs_stale(spark, sf):
    archive = fixture(spark, sf, "archive")
    return logs.stale_logs(logs.new_logs(fixture(spark, sf, "logs"), archive), archive)


@query
def logs_expired(spark, sf):
    return logs.expired_logs(fixture(spark, sf, "archive"), RUN_MS, KEEP_DAYS)


@query
def logs_retained(spark, sf):
    archive = fixture(spark, sf, "archive")
    new = logs.new_logs(fixture(spark, sf, "logs"), archive)
    return logs.retained_logs(archive, new, RUN_MS, KEEP_DAYS)


@query
def empty_days(spark, sf):
    """Directories named after the days thirty days before orders (and some that name no day),
    holding as files the line items shipped on that day; the earliest are empty."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    days = orders.select(F.date_format(F.date_sub("o_orderdate", 30), "yyyy-MM-dd").alias("day")).unionByName(
        orders.select(F.col("o_orderpriority").alias("day"))
    )
    files = lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey"
    )
    return logs.empty_days(days.distinct(), files, EMPTY_DAY_MARK)


@query
def resolve_source(spark, sf):
    return listing.resolve_source(
        fixture(spark, sf, "placed_files"), fixture(spark, sf, "trash_files")
    )


@query
def archive_plan(spark, sf):
    return logs.archive_plan(
        fixture(spark, sf, "logs"), fixture(spark, sf, "archive"), RUN_MS, KEEP_DAYS
    )


@query
def archive_plan_many(spark, sf):
    plan = logs.archive_plan(
        fixture(spark, sf, "hour_logs"), fixture(spark, sf, "hour_archive"), RUN_MS, 20
    )
    return plan


def put_files(plan: DataFrame) -> None:
    """Writes files of given lengths; ``plan``: ``path, length``."""

    def write(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                fs, path, _ = open_fs(row.path)
                fs.create_dir(parent(path), recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(b"x" * row.length)
            yield batch

    cut(plan.select("path", "length").mapInPandas(write, "path string, length bigint"))


@query
def archive_run_sequence(spark, sf):
    """The archive after three real runs ten days apart, keeping 15 days; logs of the last day
    before a run have half their length, and have grown by the next."""
    every = cut(fixture(spark, sf, "logs"))
    live, archive = fresh_dir(spark, "live"), fresh_dir(spark, "archive")
    for day in (11, 21, 31):
        moment = datetime(2024, 1, day, tzinfo=timezone.utc)
        ms = int(moment.timestamp() * 1000)
        young = F.col("start_ms") >= ms - logs.DAY_MS
        seen = every.where(F.col("start_ms") < ms).withColumn(
            "length",
            F.when(young, F.floor(F.col("length") / 2).cast("bigint")).otherwise(F.col("length")),
        )
        put_files(seen.withColumn("path", F.concat_ws("/", F.lit(live), "name")))
        archive_once(spark, [live], archive, moment, days=15)
    files = listing.list_files(spark, [archive], recursive=True).where("not is_dir")
    held = logs.with_start(files)
    return held.select("name", "length", "start_ms", F.split("rel_path", "/").getItem(1).alias("day"))


@query
def log_files_source(spark, sf):
    """Logs as the data source lists them, from a date on and with names that start alike, which is
    decided where directories are listed."""
    every = cut(fixture(spark, sf, "logs"))
    live = fresh_dir(spark, "live")
    folder = F.concat(F.lit("user"), F.regexp_extract("name", "^wal-([0-9]+)", 1))
    put_files(every.withColumn("path", F.concat_ws("/", F.lit(live), folder, "name")))
    found = read_files(
        spark, [live], True, name_prefix="wal-1", min_start=RUN_MS - 20 * logs.DAY_MS, files_only=True, partitions=8
    )
    return found.select("name", "length", "start_ms", F.split("rel_path", "/").getItem(1).alias("folder"))


@query
def archive_stats(spark, sf):
    stats = logs.archive_stats(fixture(spark, sf, "runs"))
    return stats.select("run", "copied", "failed", "total_copied", "total_failed", "duration")


def event_logs(spark, sf) -> tuple[str, DataFrame]:
    """Events as one file per user, and a plan that brings them to ``live/host<user>``."""
    events = table(spark, sf, "events")
    written, live = fresh_dir(spark, "written"), fresh_dir(spark, "live")
    (
        events.withColumn("log_user", F.col("user_id"))
        .repartition("log_user")
        .write.partitionBy("log_user")
        .parquet(written)
    )
    started = events.groupBy(F.col("user_id").cast("string").alias("log_user")).agg(
        F.unix_millis(F.min("ts").cast("timestamp")).cast("string").alias("ms")
    )
    parts = listing.list_files(spark, [written], recursive=True).where("name like 'part-%'")
    user = F.regexp_extract("path", "log_user=([0-9]+)/", 1)
    name = F.concat(F.lit(f"{live}/host"), "log_user", F.lit("/wal-"), "log_user", F.lit("."), "ms")
    plan = (
        parts.withColumn("log_user", user)
        .join(started, "log_user")
        .select("log_user", F.col("path").alias("source_path"), name.alias("dest_path"))
    )
    return live, plan


def read_events(spark, sf, path: str) -> DataFrame:
    reader = spark.read.schema(table(spark, sf, "events").schema)
    return reader.option("recursiveFileLookup", "true").parquet(path)


@query
def copy_fallback(spark, sf):
    """Events read from copies of log files; those of users with odd numbers are gone from where
    they were listed and are found in the second of two other places."""
    _, plan = event_logs(spark, sf)
    odd = F.col("log_user").cast("int") % 2 == 1
    place = fresh_dir(spark, "copied")
    gone = F.when(odd, F.concat("source_path", F.lit(".gone"))).otherwise(F.col("source_path"))
    outcomes = cut(
        copy_files_job(
            plan.select(
                gone.alias("source_path"),
                F.concat_ws("/", F.lit(place), F.substring_index("dest_path", "/", -1)).alias("dest_path"),
                F.array(F.concat("source_path", F.lit(".lost")), F.col("source_path")).alias("fallbacks"),
            )
        )
    )
    used = outcomes.groupBy(F.col("source_path").endswith(".gone").alias("was_gone")).agg(
        F.count_if(F.col("used_path") != F.col("source_path")).alias("by_fallback"), F.count("*").alias("files")
    )
    n = read_events(spark, sf, place).agg(F.count("*").alias("events"), F.sum("event_id").alias("id_sum"))
    return used.join(F.broadcast(n))


@query
def copy_from_trash(spark, sf):
    """Orders read from copied slices; the first slice's files are deleted between listing and copying.
    The trash has them twice, cut off in its older checkpoint and whole in the newer one."""
    root, slices = file_tree(spark, sf)
    first = slices.orderBy("start_key").head().slice_id
    listed = cut(listing.list_slice_files(slices, root))
    data = listed.where((F.col("slice_id") == first) & F.col("name").endswith(".parquet")).select("path", "length")
    trash, bare = fresh_dir(spark, "trash"), listing.without_store(F.col("path"))
    put_files(data.select(F.concat(F.lit(f"{trash}/240101"), bare).alias("path"), (F.col("length") - 1).alias("length")))
    cut(copy_files_job(data.select(F.col("path").alias("source_path"), F.concat(F.lit(f"{trash}/Current"), bare).alias("dest_path"))))
    cut(delete_paths_job(data))
    place = fresh_dir(spark, "copied")
    outcomes = copy_slice_files(listed, root, place, trash_roots=[trash])
    failed = outcomes.where("status <> 'copied'").agg(F.count("*").alias("failed"))
    reader = spark.read.schema(table(spark, sf, "orders").schema).option("recursiveFileLookup", "true")
    return reader.parquet(f"{place}/orders").crossJoin(F.broadcast(failed))  # one row


@query
def copy_ranges(spark, sf):
    """Events read from log files that were copied in ranges of 4 KB, and whether every copy has its
    original's checksum, put together from those of ranges of 1,000 bytes."""
    _, plan = event_logs(spark, sf)
    place = fresh_dir(spark, "copied")
    plan = cut(plan.drop("log_user").withColumn("dest_path", F.concat_ws("/", F.lit(place), F.substring_index("dest_path", "/", -1))))
    lengths = listing.list_files(spark, plan.select(F.regexp_replace("source_path", "/[^/]*$", "").alias("path")))
    plan = plan.join(lengths.select(F.col("path").alias("source_path"), "length"), "source_path")
    copied = cut(copy_by_ranges(plan, part_bytes=4096))
    sums = file_checksums(copied.select(F.col("dest_path").alias("path"), F.col("bytes").alias("length")), part_bytes=1000)
    both = copied.join(sums.select(F.col("path").alias("dest_path"), F.col("crc32").alias("again")), "dest_path", "left")
    equal = both.agg(F.bool_and(F.coalesce(F.col("crc32") == F.col("again"), F.lit(False))).alias("checksums_equal"))
    return read_events(spark, sf, place).crossJoin(F.broadcast(equal))  # one row


@query
def archive_stream_run(spark, sf):
    """Events read from an archive that one tick of the periodic job has filled."""
    live, plan = event_logs(spark, sf)
    cut(copy_files_job(plan.drop("log_user")))
    archive, state, stats = (fresh_dir(spark, d) for d in ("archive", "stream", "stats"))
    archive_stream(spark, [live], archive, state, stats, once=True).awaitTermination()
    return read_events(spark, sf, archive)


@query
def grown_files_run(spark, sf):
    """Events by the batch in which a stream gave their user's log. First there are only logs of users with
    even numbers, one byte long; then all logs whole; in a third batch nothing has changed. A
    batch that is cut short is run again."""
    live, plan = event_logs(spark, sf)
    plan = cut(plan)
    state, given = fresh_dir(spark, "stream"), fresh_dir(spark, "given")
    cut_short = [1]

    def each(files, batch):
        files.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{given}/batch={batch}")
        if batch in cut_short:
            cut_short.remove(batch)
            raise RuntimeError("cut short")

    def run():
        grown_files_stream(spark, [live], state, each, once=True).awaitTermination()

    even = plan.where(F.col("log_user").cast("int") % 2 == 0)
    put_files(even.select(F.col("dest_path").alias("path"), F.lit(1).cast("bigint").alias("length")))
    run()
    cut(copy_files_job(plan.drop("log_user")))
    try:
        run()
    except StreamingQueryException:
        pass  # as a lost driver would
    run()
    run()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(given)
    user = F.regexp_extract("rel_path", "/host([0-9]+)/", 1).cast("bigint")
    logs_given = rows.select(user.alias("log_user"), "batch", F.col("previous_length").isNull().alias("is_new"))
    events = read_events(spark, sf, live).groupBy(F.col("user_id").cast("bigint").alias("log_user")).agg(
        F.count("*").alias("events"), F.sum("event_id").alias("id_sum")
    )
    return logs_given.join(events, "log_user")


@query
def archive_files(spark, sf):
    """Events read from archived log files, one file per user: a run that copies all of them,
    then one that expires those of users first seen on the first day."""
    live, plan = event_logs(spark, sf)
    cut(copy_files_job(plan.drop("log_user")))
    archive = fresh_dir(spark, "archive")
    end = datetime(2024, 1, 31, tzinfo=timezone.utc)
    archive_once(spark, [f"{live}/gone", live], archive, end)
    archive_once(spark, [live], archive, end, days=29)
    return read_events(spark, sf, archive)


# Files


@query
def restore_files_check(spark, sf):
    """A snapshot of a file tree from which one slice is deleted and a file of another is cut:
    how many of each slice's files a restore finds missing or changed."""
    root, slices = file_tree(spark, sf)
    copier = FileCopier(root, ["orders"])
    snapshot = take_snapshot(spark, copier, lambda _: slices, fresh_dir(spark, "files"))
    place = f"{snapshot.data}/orders"
    gone, changed = [r.slice_id for r in slices.orderBy("start_key").limit(2).collect()]
    # The store's own marker file, which is empty, takes the place of one data file.
    files = snapshot.files().where(~F.col("is_dir"))
    victim = files.where((F.col("slice_id") == changed) & (F.col("length") > 0)).agg(F.min("rel_path").alias("p")).head().p
    cut(delete_paths_job(local_frame(spark, [(f"{place}/{gone}",), (f"{place}{victim}",)], "path string")))
    plan = [(f"{place}/.tableinfo.0000000001", f"{place}{victim}")]
    cut(copy_files_job(local_frame(spark, plan, "source_path string, dest_path string")))
    there = listing.list_files(spark, [place], recursive=True).withColumn("table_name", F.lit("orders"))
    found = restore.restore_files_check(files, there)
    return (
        files.join(found.drop("slice_id"), ["table_name", "rel_path"], "left").groupBy("table_name", "slice_id")
        .agg(
            (F.count_if(F.col("problem") == "missing") == F.count("*")).alias("all_missing"),
            F.count_if(F.col("problem") == "length").alias("changed"),
        )
    )


def file_tree(spark, sf) -> tuple[str, DataFrame]:
    """Orders as files, ``root/orders/slice/family/file``, with a family for each status: its root
    and slices."""
    root, written = fresh_dir(spark, "tree"), fresh_dir(spark, "written")
    catalog = cut(slices_of(spark, sf).where("table_name = 'orders'"))
    snapshot = take_snapshot(
        spark, RowCopier([keyed(sf, "orders", "o_orderkey")]), lambda _: catalog,
        fresh_dir(spark, "snapshot"),
    )
    orders = table(spark, sf, "orders")
    stored = read_slices(spark, f"{snapshot.data}/orders", orders.schema)
    by_family = stored.withColumn("family", F.col("o_orderstatus")).hint("rebalance", "slice_id")
    by_family.write.partitionBy("slice_id", "family").parquet(written)
    found = listing.list_files(spark, [written], recursive=True)
    rel = F.regexp_replace("rel_path", "/(slice_id|family)=", "/")
    data = found.where(F.col("name").endswith(".parquet") & ~F.col("name").startswith(".")).select(
        F.col("path").alias("source_path"),
        F.concat(F.lit(f"{root}/orders"), rel).alias("dest_path"),
    )
    # The writer's empty marker file serves as manifest of each slice.
    mark = F.lit(f"{written}/_SUCCESS").alias("source_path")
    base = F.lit(f"{root}/orders")
    manifests = catalog.select(
        mark, F.concat_ws("/", base, "slice_id", F.lit(".regioninfo")).alias("dest_path")
    )
    cut(copy_files_job(data.unionByName(manifests)))
    families = orders.agg(F.collect_set("o_orderstatus").alias("families"))
    put_descriptors(families.select(F.lit("orders").alias("name"), "families"), root, 1)
    return root, catalog


def put_descriptors(tables: DataFrame, root: str, version: int, binary: bool = False) -> None:
    """Writes a descriptor for each table (``name, families``) below its directory."""
    form = binary_descriptor if binary else format_descriptor

    def write(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                fs, path, _ = open_fs(f"{root}/{row.name}/.tableinfo.{version:010d}")
                fs.create_dir(parent(path), recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(form(row.name, list(row.families)))
            yield batch[["name"]]

    cut(tables.select("name", "families").mapInPandas(write, "name string"))


def binary_descriptor(table: str, families: list[str]) -> bytes:
    """The serialised form, each with a property."""

    def number(n: int) -> bytes:
        return n.to_bytes(4, "big")

    def name(text: str) -> bytes:
        data = text.encode()
        long = b"" if len(data) < 128 else bytes([256 - 112 - 2]) + len(data).to_bytes(2, "big")
        return (long or bytes([len(data)])) + data

    properties = number(1) + number(3) + b"key" + number(5) + b"value"
    out = number(4) + name(table) + b"\0\0" + properties + number(len(families))
    return out + b"".join(b"\x08" + name(f) + properties for f in families)


@query
def descriptor_families(spark, sf):
    """Families as read from the newest descriptors, text and binary ones; older versions name
    families that are gone."""
    root = fresh_dir(spark, "described")
    by_priority = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.collect_set("o_orderstatus").alias("families")
    )
    by_user = table(spark, sf, "events").groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name")).agg(
        F.collect_set("event_type").alias("families")
    )
    for tables, binary in ((by_priority, False), (by_user, True)):
        put_descriptors(tables.withColumn("families", F.array(F.lit("gone"))), root, 1, not binary)
        put_descriptors(tables, root, 2, binary)
    files = listing.list_files(spark, [root], recursive=True).withColumn("table_name", F.split("rel_path", "/").getItem(1))
    newest = listing.latest_descriptor(files.where(is_descriptor()))
    return read_families(newest).select("table_name", "family", "error")


@query
def slice_files_failed(spark, sf):
    """Outcomes of copying a tree in which the descriptor names a family that the first slice lacks."""
    root, slices = file_tree(spark, sf)
    first = slices.orderBy("start_key").head().slice_id
    cut(delete_paths_job(local_frame(spark, [(f"{root}/orders/{first}/F",)], "path string")))
    listed = listing.list_slice_files(slices, root)
    outcomes = copy_slice_files(listed, root, fresh_dir(spark, "copied"))
    return outcomes.select("table_name", "slice_id", "status", F.col("files") > 0, "error").toDF(
        "table_name", "slice_id", "status", "has_files", "error"
    )


@query
def slice_files(spark, sf):
    """Per slice: listed manifests, family directories, problems."""
    root, slices = file_tree(spark, sf)
    listed = cut(listing.list_slice_files(slices, root))
    is_manifest = F.col("name") == ".regioninfo"
    return listed.groupBy("table_name", "slice_id").agg(
        F.count_if(is_manifest).alias("manifests"),
        F.count_if("is_dir").alias("family_dirs"),
        F.count_if(F.col("name").endswith(".parquet")).cast("boolean").alias("has_data"),
        F.count("error").alias("problems"),
    )


@query
def slice_files_lenient(spark, sf):
    """The same where the first slice has lost its manifest and the second a family directory,
    which a lenient listing passes over."""
    root, slices = file_tree(spark, sf)
    first, second = [r.slice_id for r in slices.orderBy("start_key").limit(2).collect()]
    family = table(spark, sf, "orders").agg(F.min("o_orderstatus")).head()[0]
    lost = [(f"{root}/orders/{first}/.regioninfo",), (f"{root}/orders/{second}/{family}",)]
    cut(delete_paths_job(local_frame(spark, lost, "path string")))
    listed = cut(listing.list_slice_files(slices, root, on_missing="skip"))
    return listed.groupBy("table_name", "slice_id").agg(
        F.count_if(F.col("name") == ".regioninfo").alias("manifests"),
        F.count_if("is_dir").alias("family_dirs"),
        F.count("error").alias("problems"),
    )


@query
def copy_files(spark, sf):
    """Orders read from a restored copy of the file tree."""
    root, slices = file_tree(spark, sf)
    copier = FileCopier(root, ["orders"])
    snapshot = take_snapshot(spark, copier, lambda _: slices, fresh_dir(spark, "files"))
    target = fresh_dir(spark, "restored")
    cut(restore_tables(spark, snapshot.path, target))
    reader = spark.read.schema(table(spark, sf, "orders").schema)
    return reader.option("recursiveFileLookup", "true").parquet(restored_path(spark, target, "orders"))
