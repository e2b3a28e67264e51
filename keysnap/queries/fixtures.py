"""Catalogs, outcomes, log listings and so on, derived from whole tables.

The SQL runs in Spark and in DuckDB. ``{orders}`` and so on stand for the tables. Where the two
differ there is one text for each; see ``DIALECT``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from keysnap.session import cut

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Number of key ranges per table, ranges that split, width of a padded key.
N_SLICES, SPLIT_SLICES, WIDTH = 8, "(2, 5)", 12


def K(x: str) -> str:
    return f"lpad(cast({x} as varchar(20)), {WIDTH}, '0')"


DIALECT = {
    "spark": {
        "MS": "(unix_micros(cast(min(ts) as timestamp)) div 1000)",
        "RUN_DAY": "date_format(ts, 'yyyy-MM-dd')",
        "SECONDS_LATER": "{0} + make_dt_interval(0, 0, 0, {1})",
    },
    "duckdb": {
        "MS": "(epoch_us(min(ts)) // 1000)",
        "RUN_DAY": "strftime(ts, '%Y-%m-%d')",
        "SECONDS_LATER": "{0} + to_seconds({1})",
    },
}


def uniform_slices(keys: str) -> str:
    """Key ranges of equal width for rows of (table_name, k)."""
    return f"""
    select table_name, slice_no, concat('s', cast(slice_no as varchar(20))) as slice_id, lo, hi,
           case when slice_no = 0 then '' else {K('lo')} end as start_key,
           case when slice_no = {N_SLICES - 1} then '' else {K('hi')} end as end_key,
           n_rows, key_sum
    from (select table_name, slice_no, min(k) as lo, max(k) + 1 as hi, count(*) as n_rows,
                 sum(k) as key_sum
          from (select /*+ broadcast(m) */ k.table_name, k.k,
                       cast(floor(k.k * {N_SLICES}.0 / m.n) as int) as slice_no
                from {keys} k
                join (select table_name, max(k) + 1 as n from {keys} group by table_name) m
                on k.table_name = m.table_name) b
          group by table_name, slice_no) g"""


CTES = {
    "key_rows": """
    select 'orders' as table_name, o_orderkey as k from {orders}
    union all select 'customer', c_custkey from {customer}
    union all select 'part', p_partkey from {part}
    union all select 'supplier', s_suppkey from {supplier}""",
    "slices": uniform_slices("key_rows"),
    "line_rows": "select 'lineitem' as table_name, l_orderkey as k from {lineitem}",
    "line_slices": uniform_slices("line_rows"),
    "page_slices": """
    select 'pages' as table_name, concat('p', cast(n as varchar(20))) as slice_id,
           case when n = 1 then '' else prefix end as start_key,
           coalesce(next_prefix, '') as end_key
    from (select prefix, row_number() over (order by prefix) as n,
                 lead(prefix) over (order by prefix) as next_prefix
          from (select distinct substring(url, 1, 12) as prefix from {pages}) d) p""",
    "splits": f"""
    select *, {K("cast((lo + hi) - floor((lo + hi) / 2.0) as bigint)")} as mid_key
    from slices where slice_no in {SPLIT_SLICES}""",
    "daughters": """
    select table_name, slice_no, concat(slice_id, 'a') as slice_id, start_key,
           mid_key as end_key, 'rs0:60020' as server from splits
    union all
    select table_name, slice_no, concat(slice_id, 'b'), mid_key, end_key, 'rs1:60021'
    from splits""",
    # mid_key is set for split parents only.
    "catalog1": f"""
    select s.table_name, s.slice_no, s.slice_id, s.start_key, s.end_key,
           cast(1 as bigint) as region_id,
           case when s.slice_no % 4 = 3 then concat('rs', cast(s.slice_no % 3 as varchar(20)))
                else concat('rs', cast(s.slice_no % 3 as varchar(20)), ':',
                            cast(60020 + s.slice_no % 3 as varchar(20))) end as server,
           s.slice_no in {SPLIT_SLICES} as is_split,
           s.slice_no in {SPLIT_SLICES} and not (s.table_name = 'orders' and s.slice_no = 5)
             as is_offline,
           p.mid_key, s.n_rows
    from slices s left join splits p
      on s.table_name = p.table_name and s.slice_no = p.slice_no
    union all
    select table_name, slice_no, slice_id, start_key, end_key, cast(2 as bigint), server,
           false, false, null, 0
    from daughters""",
    "catalog2": "select * from catalog1 where not (is_split and slice_no = 2)",
    "work1": """
    select * from catalog1 where region_id = 1 and table_name in ('orders', 'customer')""",
    # Failures injected into the first attempt.
    "att1": """
    select *, row_number() over (order by table_name, start_key) % 3 = 0 as is_failed
    from work1""",
    "outcomes1": """
    select table_name, slice_id, start_key, end_key, region_id, cast(1 as int) as attempt,
           case when is_failed then 'failed' else 'copied' end as status,
           n_rows % 7 + 1 as files, n_rows as n_rows
    from att1""",
    "copied1": """
    select table_name, slice_no, slice_id, start_key, end_key, region_id
    from att1 where not is_failed""",
    # Many ranges per table, nested, disjoint and overlapping.
    "ranges": f"""
    select o_orderpriority as table_name, o_orderstatus as status,
           cast(o_orderkey as varchar(20)) as slice_id, {K('o_orderkey')} as start_key,
           {K('o_orderkey + 1 + o_custkey % 50')} as end_key, o_custkey as region_id
    from {{orders}}""",
    "near_tiles": f"""
    select o_orderstatus as table_name, {K('o_orderkey')} as start_key,
           {K('o_orderkey + 1 + o_custkey % 4')} as end_key from {{orders}}""",
    "logs": """
    select concat('wal-', cast(user_id % 20 as varchar(20)), '.', cast([MS] as varchar(20)))
             as name,
           cast(sum(length(props)) as bigint) as length, [MS] as start_ms
    from {events} group by user_id % 20, date_trunc('day', ts)""",
    # One log per user and hour.
    "hour_logs": """
    select concat('wal-', cast(user_id as varchar(20)), '.', cast([MS] as varchar(20))) as name,
           cast(sum(length(props)) as bigint) as length, [MS] as start_ms
    from {events} group by user_id, date_trunc('hour', ts)""",
    # What earlier runs archived; some of it has grown since.
    "archive": """
    select name, case when start_ms % 5 = 0 then length - 1 else length end as length, start_ms
    from logs where start_ms % 3 <> 0""",
    # Archived until 2024-01-20; the logs of that day had half their length then.
    "hour_archive": """
    select name, start_ms,
           case when start_ms >= 1705708800000 then cast(floor(length / 2.0) as bigint)
                else length end as length
    from hour_logs where start_ms < 1705795200000""",
    # Old logs (0) and live ones (1), among them names in both places and files that are no logs.
    "log_files": """
    select concat('/old/', name) as path, name, length, 0 as priority from logs
    union all
    select concat('/live/', name), name, length + 1, 1 from logs where start_ms >= 1705795200000
    union all
    select concat('/live/empty-', cast(user_id as varchar(20)), '.', cast([MS] as varchar(20))),
           concat('empty-', cast(user_id as varchar(20)), '.', cast([MS] as varchar(20))),
           cast(0 as bigint), 1
    from {events} group by user_id
    union all
    select concat('/live/wal-', cast(user_id as varchar(20)), '.', event_type),
           concat('wal-', cast(user_id as varchar(20)), '.', event_type), count(*), 1
    from {events} group by user_id, event_type
    union all
    select concat('/old.5/note', cast(user_id as varchar(20))),
           concat('note', cast(user_id as varchar(20))), count(*), 0
    from {events} group by user_id""",
    "descriptor_files": """
    select concat('t', cast(user_id as varchar(20))) as table_name,
           concat('.tableinfo.', lpad(cast(event_id as varchar(20)), 10, '0')) as name,
           concat('/t', cast(user_id as varchar(20)), '/.tableinfo.',
                  lpad(cast(event_id as varchar(20)), 10, '0')) as path
    from {events} where event_type <> 'view'
    union all
    select concat('t', cast(user_id as varchar(20))), concat('part-', cast(event_id as varchar(20))),
           concat('/t', cast(user_id as varchar(20)), '/part-', cast(event_id as varchar(20)))
    from {events}""",
    "placed_files": f"""
    select concat('/', {K('o_orderkey')}) as rel_path, concat('/live/', {K('o_orderkey')}) as path,
           o_orderstatus <> 'F' as present from {{orders}}""",
    "trash_files": f"""
    select concat('/', {K('l_orderkey')}) as rel_path,
           concat('/trash/', cast(l_linenumber as varchar(20)), '/', {K('l_orderkey')}) as path,
           l_linenumber as priority from {{lineitem}}""",
    # Children of table directories: slices, plain files, hidden names.
    "table_dirs": f"""
    select o_orderpriority as table_name, {K('o_orderkey')} as slice_id,
           case when o_custkey % 10 = 3 then concat('.', {K('o_orderkey')})
                when o_custkey % 10 = 4 then 'compaction.dir'
                else {K('o_orderkey')} end as name,
           o_orderstatus <> 'P' as is_dir from {{orders}}""",
    "line_manifest": f"""
    select distinct o_orderpriority as table_name, {K('o_orderkey')} as slice_id
    from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey""",
    # Runs of the archive, one per day.
    "runs": """
    select cast(1 + date_diff_days as bigint) as run, min(ts) as started, max(ts) as ended,
           sum(case when event_type = 'error' then 0 else 1 end) as copied,
           sum(case when event_type = 'error' then 1 else 0 end) as failed
    from (select ts, event_type, cast(extract(day from ts) as int) - 1 as date_diff_days
          from {events}) e
    group by date_diff_days""",
    "name_times": """
    select o_orderkey, o_orderpriority, [SECONDS_LATER:o_orderdate|o_orderkey] as t1,
           [SECONDS_LATER:o_orderdate|o_orderkey + o_custkey + 1] as t2
    from {orders}""",
}


def _uses(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def _closure(sql: str, given: tuple[str, ...] = ()) -> list[str]:
    """Fixtures that the text needs, in order of definition."""
    found: set[str] = set()
    todo = _uses(sql)
    while todo:
        name = todo.pop()
        if name not in found and name not in given:
            found.add(name)
            todo += _uses(CTES[name])
    return [n for n in CTES if n in found]


def _translate(sql: str, dialect: str) -> str:
    words = DIALECT[dialect]

    def put(match: re.Match) -> str:
        name, _, args = match.group(1).partition(":")
        return words[name].format(*args.split("|")) if args else words[name]

    return re.sub(r"\[((?:MS|RUN_DAY|SECONDS_LATER)[^\]]*)\]", put, sql)


def with_fixtures(sql: str, dialect: str, given: tuple[str, ...] = ()) -> str:
    """The query text, preceded by the fixtures it uses, other than ``given`` ones."""
    parts = [f"{n} as ({CTES[n]})" for n in _closure(sql, given)]
    text = ("with " + ",\n".join(parts) + "\n" if parts else "") + sql
    for name in given:
        text = re.sub(rf"\b{name}\b", f"{{{name}}}", text)
    return _translate(text, dialect)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The fixture as a DataFrame.

    Others use the slices several times; those are worked out once, from the whole tables.
    """
    query = f"select * from {name}"
    used: dict[str, DataFrame] = {}
    given: tuple[str, ...] = ()
    if name != "slices" and "slices" in _closure(query):
        given = ("slices",)
        used["slices"] = cut(fixture(spark, sf, "slices"))
    sql = with_fixtures(query, "spark", given)
    used |= {t: table(spark, sf, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duckdb_sql(sql: str) -> str:
    return with_fixtures(sql, "duckdb").format(**{t: t for t in TABLES})
