"""Scalar expressions, names and checksums."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keysnap.functions import keys, names, text
from keysnap.functions.checksum import combine_pieces, hash_pieces, row_hash, sum_pieces


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r.v for r in df.select(column(F.col("x")).alias("v")).collect()]


def test_servers(spark):
    servers = ["h:1", "h", "h:x", "h: 5", "h:+7", "h:7:8", ""]
    assert values(spark, servers, text.server_port) == [1, 80, 80, 80, 7, 7, 80]
    assert values(spark, servers, text.server_host) == ["h", "h", "h", "h", "h", "h", ""]
    assert values(spark, ["a:b:9", "a", "a:"], text.endpoint_host) == ["a:b", "a", "a"]
    assert values(spark, ["a:b:9", "a", "a:"], text.endpoint_port) == [9, None, None]


def test_log_start(spark):
    logs = ["a.1", "a.b.22", "a.-3", "a", "1", "a.", "a.1x", "a. 5", "a.+5",
            "a.99999999999999999999"]
    assert values(spark, logs, text.log_start_ms) == [1, 22, -3] + [None] * 7


def test_relative_path(spark):
    got = values(spark, ["/a/b/c", "/a/b", "/a/bc/d"], lambda c: text.relative_path(c, "/a/b/"))
    assert got == ["/c", None, None]


def test_duration(spark):
    got = values(spark, [0, 59_999, 60_000, 3_725_001], text.duration_text, "bigint")
    assert got == ["0m, 0s", "0m, 59s", "1m, 0s", "62m, 5s"]


def test_end_order(spark):
    df = spark.createDataFrame([("",), ("a",), ("z",), ("aa",)], "e string")
    assert [r.e for r in df.orderBy(keys.end_order("e")).collect()] == ["a", "aa", "z", ""]
    raw = spark.createDataFrame(
        [(bytearray(b""),), (bytearray(b"\xff"),), (bytearray(b"\x01"),)], "e binary"
    )
    ends = [bytes(r.e) for r in raw.orderBy(keys.end_order("e")).collect()]
    assert ends == [b"\x01", b"\xff", b""]


@pytest.mark.parametrize(
    "name, ok",
    [
        ("bak-20120416.155126.421-20120416.155142.956", True),
        ("bak-20120416.245126.421-20120416.015142.956", True),
        ("bak-20120416.155142.956-20120416.155126.421", False),
        ("bak-20120416.155126.421-20120416.155126.421", False),
        ("bak-20120416.155126.421", False),
        ("bkp-20120416.155126.421-20120416.155142.956", False),
        ("bak-20120416.155126.421-20120416.155142.956-1", False),
        ("bak-x-y", False),
    ],
)
def test_snapshot_names(spark, name, ok):
    df = spark.createDataFrame([(name,)], "name string")
    assert names.parse_snapshot_names(df).count() == ok
    assert names.parse_snapshot_names(df, ignore_bad_name=True).count() == 1


def test_midnight_is_hour_24_and_reads_back(spark):
    start = datetime(2024, 1, 2, 0, 5, 6, 7000)
    end = datetime(2024, 1, 2, 1, 0, 0)
    df = spark.createDataFrame([(start, end)], "s timestamp_ntz, e timestamp_ntz")
    named = df.select(names.format_snapshot_name(F.col("s"), F.col("e")).alias("name"))
    assert named.head().name == "bak-20240102.240506.007-20240102.010000.000"
    row = names.parse_snapshot_names(named).select(F.col("started").cast("timestamp_ntz")).head()
    assert row[0] == start


def checksum(df):
    parts = df.select(row_hash(df.schema).alias("h")).select(
        *[c.alias(n) for n, c in hash_pieces(F.col("h")).items()]
    )
    return parts.agg(*sum_pieces()).select(combine_pieces()).head()[0]


def test_checksum(spark):
    ddl = "a int, b int, m map<string,int>, v array<float>"
    one = spark.createDataFrame([(1, None, {"x": 1}, [1.0]), (2, 3, None, None)], ddl)
    other = spark.createDataFrame([(2, 3, None, None), (1, None, {"x": 1}, [1.0])], ddl)
    moved = spark.createDataFrame([(None, 1, {"x": 1}, [1.0]), (2, 3, None, None)], ddl)
    assert checksum(one) == checksum(other) != checksum(moved)
    # Copies do not cancel out, and sums add up over any split of the rows.
    assert checksum(one.union(one)) == 2 * checksum(one)
    assert checksum(one.where("a = 1")) + checksum(one.where("a = 2")) == checksum(one)
    hashed = [r[0] % 2**64 for r in one.select(row_hash(one.schema)).collect()]
    assert checksum(one) == sum(hashed)


def test_nested_values_are_hashed_whole(spark):
    """Maps at any depth, and nulls that move inside arrays, structs and maps."""
    from keysnap.functions.checksum import row_hash

    ddl = "a array<map<string,int>>, b array<int>, c struct<x:int,y:array<string>>, d map<string,array<int>>"
    base = ([{"k": 1, "m": 2}, None], [1, None, 2], (1, ["u", None]), {"q": [1, None], "r": None})
    same = ([{"m": 2, "k": 1}, None], [1, None, 2], (1, ["u", None]), {"r": None, "q": [1, None]})
    others = [
        (base[0], [None, 1, 2], base[2], base[3]),
        (base[0], base[1], (1, [None, "u"]), base[3]),
        (base[0], base[1], (None, ["u", None]), base[3]),
        (base[0], base[1], base[2], {"q": [None, 1], "r": None}),
        ([None, {"k": 1, "m": 2}], base[1], base[2], base[3]),
        (None, base[1], base[2], base[3]),
    ]
    df = spark.createDataFrame([base, same, *others], ddl)
    got = [r.h for r in df.select(row_hash(df.schema).alias("h")).collect()]
    assert got[0] == got[1] and len(set(got)) == len(others) + 1
