"""SQL for DuckDB with the same results as the queries in ``registry``."""

from __future__ import annotations

from keysnap.queries.fixtures import K, duckdb_sql

SLICE = "table_name, slice_id, start_key, end_key, region_id"


def contained(inner: str, outer: str) -> str:
    return (
        f"{outer}.table_name = {inner}.table_name and {outer}.start_key <= {inner}.start_key "
        f"and ({outer}.end_key = '' or ({inner}.end_key <> '' "
        f"and {inner}.end_key <= {outer}.end_key))"
    )


# Same catalog rows without the daughters of parents in the listing.
def without_daughters(catalog: str) -> str:
    return f"""
    select c.* from {catalog} c where not exists (
      select 1 from {catalog} p where p.is_split and p.table_name = c.table_name
        and c.region_id = 2
        and ((c.start_key = p.start_key and c.end_key = p.mid_key)
             or (c.start_key = p.mid_key and c.end_key = p.end_key)))"""


def issues(slices: str) -> str:
    """Breaches of a tiling; slices given as (table_name, start_key, end_key)."""
    return f"""
    with s as (select table_name, start_key, end_key,
             lag(end_key) over (partition by table_name
                                order by start_key, end_key = '', end_key) as prev_end_key,
             row_number() over (partition by table_name
                                order by start_key, end_key = '', end_key) as i,
             count(*) over (partition by table_name) as n from {slices})
    select table_name, start_key, end_key, cast(null as varchar) as prev_end_key,
           'single' as issue
    from s where n = 1 and (start_key <> '' or end_key <> '')
    union all
    select table_name, start_key, end_key, null, 'first_start'
    from s where n > 1 and i = 1 and start_key <> ''
    union all
    select table_name, start_key, end_key, null, 'last_end'
    from s where n > 1 and i = n and end_key <> ''
    union all
    select table_name, start_key, end_key, prev_end_key,
           case when prev_end_key = '' or start_key < prev_end_key then 'overlap' else 'gap' end
    from s where i > 1 and (prev_end_key = '' or start_key <> prev_end_key)"""


def units(slices: str, n: int) -> str:
    return f"""
    select {SLICE}, server,
           cast((row_number() over (order by table_name, start_key, end_key = '', end_key,
                                    region_id) - 1)
                % least({n}, count(*) over ()) as int) as unit,
           cast(1 as int) as attempt
    from {slices}"""


REMAINING = f"""
    select r.* from (
      select c.* from catalog2 c where c.table_name in ('orders', 'customer')
        and not exists (select 1 from copied1 p where {contained('c', 'p')})) r
    where not exists (
      select 1 from catalog2 p where p.is_split and p.table_name = r.table_name
        and not exists (select 1 from copied1 q where {contained('p', 'q')})
        and r.region_id = 2
        and ((r.start_key = p.start_key and r.end_key = p.mid_key)
             or (r.start_key = p.mid_key and r.end_key = p.end_key)))"""

SLICE_OF = "(s.start_key <= {k} and (s.end_key = '' or {k} < s.end_key))"


def sliced(table: str, key: str, slices: str = "slices") -> str:
    """Rows of a table with the slice that holds them."""
    k = K(key)
    return f"""select t.*, s.slice_id from {{{table}}} t join {slices} s
    on s.table_name = '{table}' and {SLICE_OF.format(k=k)}"""


def attempt_rows(table: str, key: str, retry: int = 2) -> str:
    """Which slice holds each row after the retry, and in which attempt it was copied."""
    k = K(key)
    return f"""
    select a.table_name, t.{key} as row_id,
           case when a.is_failed and a.slice_no = 2
                then concat(a.slice_id, case when {k} < a.mid_key then 'a' else 'b' end)
                else a.slice_id end as slice_id,
           cast(case when a.is_failed then {retry} else 1 end as int) as attempt
    from {{{table}}} t join att1 a on a.table_name = '{table}'
      and a.start_key <= {k} and (a.end_key = '' or {k} < a.end_key)"""


def stamp(t: str) -> str:
    """Times as snapshot names write them: midnight is hour 24."""
    return (
        f"concat(strftime({t}, '%Y%m%d.'), case when hour({t}) = 0 then '24' "
        f"else strftime({t}, '%H') end, strftime({t}, '%M%S.'), "
        f"lpad(cast(millisecond({t}) % 1000 as varchar), 3, '0'))"
    )


IS_LOG = r"regexp_matches(name, '\.-?[0-9]+$')"
LOGS = f"""
    select path, name, length, priority,
           cast(regexp_extract(name, '\\.(-?[0-9]+)$', 1) as bigint) as start_ms
    from (select *, row_number() over (partition by name order by priority, path) as i
          from log_files where {IS_LOG}) x where i = 1"""

RUN_MS, DAY_MS = 1706659200000, 86400000
MARK = RUN_MS - 7 * DAY_MS


def new(logs: str, archive: str) -> str:
    return f"""select l.* from {logs} l where l.length > 0 and not exists (
      select 1 from {archive} a where a.name = l.name and a.length = l.length)"""


def plan(logs: str, archive: str, mark: int) -> str:
    fresh = f"({new(logs, archive)} and l.start_ms > {mark})"
    cols = "name, length, start_ms"
    return f"""
    select {cols}, 'copy' as action from {fresh} n
    union all
    select {cols}, 'replace' from {archive} a where start_ms > {mark}
      and a.name in (select name from {fresh} n)
    union all
    select {cols}, 'expire' from {archive} where start_ms <= {mark}
    union all
    select {cols}, 'keep' from {archive} a where start_ms > {mark}
      and a.name not in (select name from {fresh} n)"""


ROW_KEY = "concat(table_name, ',', start_key, ',', cast(region_id as varchar))"

SQL: dict[str, str] = {
    "catalog_scan": f"""
    select {ROW_KEY} as row_key,
           case when not (table_name = 'part' and start_key = '') then server end as server,
           1700000000000 + slice_no as server_start_code, mid_key is not null as has_split
    from catalog1""",
    "catalog_decode": f"""
    select {SLICE}, {ROW_KEY} as row_key, split_part(server, ':', 1) as host,
           cast(case when server like '%:%' then split_part(server, ':', 2) else '80' end as int)
             as port,
           is_split, is_offline, mid_key as split_a_end,
           case when mid_key is not null then concat(slice_id, 'b') end as split_b_id
    from catalog1
    where not (table_name = 'supplier' and region_id = 2)
      and not (table_name = 'part' and start_key = '')""",
    "catalog_rejects": f"""
    select {ROW_KEY} as row_key,
           case when table_name = 'supplier' then 'unreadable slice' else 'no server' end as reason
    from catalog1
    where (table_name = 'supplier' and region_id = 2) or (table_name = 'part' and start_key = '')
    """,
    "split_daughters": """
    select table_name, slice_id, start_key, end_key, cast(2 as bigint) as region_id
    from daughters""",
    "split_not_offline": f"select {SLICE} from catalog1 where is_split and not is_offline",
    "select_slices": f"""
    select {SLICE}, server, is_split from ({without_daughters('catalog1')}) s
    where table_name in ('orders', 'customer')""",
    "slices_by_table": """
    select table_name, count(*) as n_slices, min(start_key) as first_start_key,
           min(case when slice_no = 0 then end_key end) as first_end_key,
           max(start_key) as last_start_key, min(case when slice_no = 7 then end_key end)
             as last_end_key
    from catalog1 where region_id = 1 group by table_name""",
    "slices_sorted": f"""
    select {SLICE} from catalog1
    order by table_name, start_key, end_key = '', end_key, region_id""",
    "work_units": units(
        "(select * from catalog1 where region_id = 1 and table_name in ('orders', 'customer')) w",
        5,
    ),
    "work_units_many": units("(select *, concat('rs', status) as server from ranges) w", 64),
    "slice_paths": f"""
    select {SLICE}, concat('/store/', table_name, '/', slice_id) as path from catalog1""",
    "relative_path_of": """
    select page_id, case when starts_with(url, 'http://ththre.example.com/')
                         then substr(url, length('http://ththre.example.com') + 1) end as rel_path
    from {pages}""",
    "server_endpoints": f"""
    select s_suppkey, case when s_nationkey < 5 then s_name else 'a:b' end as host,
           case when s_nationkey < 5 then null else s_nationkey end as port
    from {{supplier}}""",
    "failed_slices": f"select {SLICE} from outcomes1 where status = 'failed' and attempt = 1",
    "copied_slices": f"select {SLICE} from att1 where not is_failed",
    "contained_slices": f"""
    select c.table_name, c.slice_id, c.start_key, c.end_key, c.region_id from catalog1 c
    where exists (select 1 from copied1 p where {contained('c', 'p')})""",
    "contained_slices_many": f"""
    select c.table_name, c.slice_id, c.start_key, c.end_key, c.region_id from ranges c
    where c.status <> 'F'
      and exists (select 1 from ranges p where p.status = 'F' and {contained('c', 'p')})""",
    "remaining_slices": f"select {SLICE}, server from ({REMAINING}) r",
    "copy_counters": """
    select cast(coalesce(sum(files) filter (where status = 'copied'), 0) as bigint)
             as files_copied,
           count(*) filter (where status = 'copied') as slices_copied,
           count(*) filter (where status = 'failed') as slices_failed
    from outcomes1""",
    "coverage_issues": f"select * from ({issues('copied1')}) i",
    "coverage_issues_many": f"select * from ({issues('near_tiles')}) i",
    "coverage_after_retry": f"""
    select table_name, count(*) as n_issues from ({issues(
        "(select table_name, start_key, end_key from copied1 union all "
        f"select table_name, start_key, end_key from ({REMAINING}) r) both_parts"
    )}) i group by table_name""",
    "snapshot_roundtrip": sliced("orders", "o_orderkey"),
    "slice_manifest": """
    select table_name, slice_id, start_key, end_key, cast(1 as bigint) as region_id,
           cast(1 as int) as attempt, n_rows as rows, cast(key_sum as bigint) as key_sum
    from slices where table_name in ('part', 'supplier')""",
    "snapshot_retry_roundtrip": f"""
    {attempt_rows('orders', 'o_orderkey')} union all {attempt_rows('customer', 'c_custkey')}""",
    "snapshot_resume_roundtrip": f"""
    {attempt_rows('orders', 'o_orderkey', 3)} union all {attempt_rows('customer', 'c_custkey')}""",
    "snapshot_failing_table": """
    select table_name, cast(case when table_name = 'part' then 2 else 1 end as int) as attempt,
           'copied' as status, cast(null as varchar) as error, count(*) as slices, cast(sum(n_rows) as bigint) as rows
    from slices where table_name in ('orders', 'customer', 'part', 'supplier') group by table_name
    union all
    select table_name, cast(1 as int), 'failed', 'RuntimeError: no space left', count(*), cast(0 as bigint)
    from slices where table_name = 'part' group by table_name""",
    "restore_versions": "select *, false as late_one_won from {customer} where c_acctbal > 0",
    "work_units_bytes": """
    select unit as task, unit, count(*) as files, cast(sum(length) as bigint) as bytes
    from (select length, cast(least(63, floor((w - length - 1) * 64 // total)) as int) as unit
          from (select length, cast(sum(length + 1) over (order by o_orderkey) as hugeint) as w,
                       cast(sum(length + 1) over () as hugeint) as total
                from (select o_orderkey, o_orderkey % 97 * o_custkey % 1009 * o_custkey as length from {orders}) f) s) u
    group by unit""",
    "descriptor_families": """
    select distinct o_orderpriority as table_name, o_orderstatus as family, cast(null as varchar) as error from {orders}
    union all
    select distinct concat('user', cast(user_id as varchar)), event_type, null from {events}""",
    "slice_files_failed": """
    select table_name, slice_id, case when slice_no = 0 then 'failed' else 'copied' end as status,
           slice_no > 0 as has_files, case when slice_no = 0 then 'family missing: F' end as error
    from slices where table_name = 'orders'""",
    "snapshot_name_format": f"""
    select o_orderkey, concat('bak-', {stamp('t1')}) as running_name,
           concat('bak-', {stamp('t1')}, '-', {stamp('t2')}) as sealed_name
    from name_times""",
    "latest_descriptor": """
    select table_name, max(path) as path from descriptor_files
    where starts_with(name, '.tableinfo') group by table_name""",
    "older_descriptors": """
    select table_name, path from descriptor_files d where starts_with(name, '.tableinfo')
      and path < (select max(path) from descriptor_files m
                  where m.table_name = d.table_name and starts_with(m.name, '.tableinfo'))""",
    "missing_descriptors": """
    select distinct concat('t', cast(user_id as varchar)) as table_name from {events}
    where user_id not in (select user_id from {events} where event_type <> 'view')
    union select n_name from {nation}""",
    "snapshot_name_parse": """
    select o_orderkey, t1 as started, t2 as ended from name_times
    where o_orderpriority in ('1-URGENT', '5-LOW')""",
    "snapshot_tables": """
    select distinct table_name from slices where table_name in ('orders', 'part')""",
    "restore_checks": """
    select distinct o_orderpriority as table_name, 'exists' as problem from {orders}
    where o_orderpriority < '3'
    union
    select distinct event_type, case when event_type > 'v' then 'exists' else 'not found' end
    from {events} where event_type >= 'e'""",
    "restore_manifest_check": """
    select table_name, slice_id from table_dirs d
    where is_dir and not starts_with(name, '.') and name <> 'compaction.dir'
      and not exists (select 1 from line_manifest m
                      where m.table_name = d.table_name and m.slice_id = d.slice_id)""",
    "restore_catalog_rows": f"""
    select {SLICE}, {ROW_KEY} as row_key, false as is_split, false as is_offline from work1""",
    "restore_roundtrip": "select * from {lineitem}",
    "restore_roundtrip_text_keys": "select * from {pages}",
    "restored_catalog": """
    select table_name, slice_id, start_key, end_key, cast(1 as bigint) as region_id,
           false as is_split, false as is_offline
    from slices where table_name in ('part', 'customer')""",
    "restore_summary": """
    select count(*) filter (where status = 'copied') as restored,
           count(*) filter (where status = 'failed') as failed,
           case when count(*) filter (where status = 'failed') = 0 then 'ok'
                when count(*) filter (where status = 'copied') > 0 then 'partial'
                else 'failed' end as status
    from outcomes1""",
    "log_list": LOGS,
    "log_list_min_start": f"""
    select * from ({LOGS}) l where start_ms >= {RUN_MS - 10 * DAY_MS}""",
    "log_oldest_start": f"""
    select coalesce(min(start_ms), 9223372036854775807) as oldest_start_ms from ({LOGS}) l""",
    "logs_invalid": f"select * from log_files where not {IS_LOG}",
    "logs_colliding": f"""
    select name, count(*) as places from log_files where {IS_LOG}
    group by name having count(*) > 1""",
    "logs_new": new("logs", "archive"),
    "logs_new_many": new("hour_logs", "hour_archive"),
    "logs_stale": f"""
    select * from archive where name in (select name from ({new('logs', 'archive')}) n)""",
    "logs_expired": f"select * from archive where start_ms <= {MARK}",
    "logs_retained": f"""
    select * from archive where start_ms > {MARK}
      and name not in (select name from ({new('logs', 'archive')}) n)""",
    "empty_days": """
    select day from (select distinct strftime(o_orderdate - interval 30 day, '%Y-%m-%d') as day from {orders}) d
    where day <= '2000-01-01' and day not in (
      select strftime(l_shipdate, '%Y-%m-%d') from {lineitem})""",
    "resolve_source": """
    select f.rel_path, f.path, f.present,
           case when f.present then f.path else c.path end as source_path
    from placed_files f left join (
      select rel_path, path,
             row_number() over (partition by rel_path order by priority desc, path desc) as i
      from trash_files) c on c.rel_path = f.rel_path and c.i = 1""",
    "archive_plan": plan("logs", "archive", MARK),
    "archive_plan_many": plan("hour_logs", "hour_archive", RUN_MS - 20 * DAY_MS),
    "archive_run_sequence": f"""
    select name, case when start_ms >= {RUN_MS - DAY_MS} then length // 2 else length end
             as length,
           start_ms,
           case when start_ms >= {RUN_MS - 11 * DAY_MS} then '2024-01-31' else '2024-01-21' end
             as day
    from logs where start_ms > {RUN_MS - 15 * DAY_MS} and start_ms < {RUN_MS}""",
    "archive_files": f"""
    select * from {{events}} where user_id in (
      select user_id from {{events}} group by user_id
      having epoch_us(min(ts)) // 1000 > {RUN_MS - 29 * DAY_MS})""",
    "archive_stats": """
    select run, cast(copied as bigint) as copied, cast(failed as bigint) as failed,
           cast(sum(copied) over (order by run) as bigint) as total_copied,
           cast(sum(failed) over (order by run) as bigint) as total_failed,
           concat(cast(ms // 60000 as varchar), 'm, ', cast(ms // 1000 % 60 as varchar), 's')
             as duration
    from (select *, epoch_us(ended) // 1000 - epoch_us(started) // 1000 as ms from runs) r""",
    "slice_files": """
    select s.table_name, s.slice_id, cast(1 as bigint) as manifests,
           (select count(distinct o_orderstatus) from {orders}) as family_dirs,
           true as has_data, cast(0 as bigint) as problems
    from slices s where s.table_name = 'orders'""",
    "slice_files_lenient": """
    select s.table_name, s.slice_id,
           cast(case when slice_no = 0 then 0 else 1 end as bigint) as manifests,
           (select count(distinct o_orderstatus) from {orders})
             - case when slice_no = 1 then 1 else 0 end as family_dirs,
           cast(0 as bigint) as problems
    from slices s where s.table_name = 'orders'""",
    "copy_fallback": """
    select u.user_id % 2 = 1 as was_gone,
           cast(sum(case when u.user_id % 2 = 1 then 1 else 0 end) as bigint) as by_fallback,
           count(*) as files, any_value(e.events) as events, any_value(e.id_sum) as id_sum
    from (select distinct user_id from {events}) u,
         (select count(*) as events, cast(sum(event_id) as bigint) as id_sum from {events}) e
    group by 1""",
    "log_files_source": """
    select name, length, start_ms, concat('user', regexp_extract(name, '^wal-([0-9]+)', 1)) as folder
    from logs where start_ms >= 1706659200000 - 20 * 86400000 and starts_with(name, 'wal-1')""",
    "copy_from_trash": "select *, cast(0 as bigint) as failed from {orders}",
    "copy_ranges": "select *, true as checksums_equal from {events}",
    "archive_stream_run": "select * from {events}",
    "grown_files_run": """
    with by_user as (
        select cast(user_id as bigint) as log_user, count(*) as events, sum(event_id) as id_sum
        from {events} group by user_id
    )
    select log_user, cast(0 as integer) as batch, true as is_new, events, id_sum from by_user where log_user % 2 = 0
    union all
    select log_user, cast(1 as integer), log_user % 2 = 1, events, id_sum from by_user""",
    "copy_files": "select * from {orders}",
    "restore_files_check": """
    select table_name, slice_id, slice_no = 0 as all_missing,
           cast(case when slice_no = 1 then 1 else 0 end as bigint) as changed
    from slices where table_name = 'orders'""",
}


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_sql(sql) for name, sql in SQL.items()}


