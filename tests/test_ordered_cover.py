"""Chunked ordered computations and range algebra against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from keysnap.operators.cover import contained_slices, coverage_issues, not_contained_slices
from keysnap.operators.ordered import (
    CHUNK, Order, with_chunks, with_previous, with_row_number, with_running_max,
    with_running_sum,
)

SMALL = {"chunks": 8}
ONE = {"chunks": 1}


def inside(inner, outer):
    return outer[0] == inner[0] and outer[1] <= inner[1] and (
        outer[2] == "" or (inner[2] != "" and inner[2] <= outer[2])
    )


def order_key(r):
    return (r[0], r[1], r[2] == "", r[2])


def expected_issues(rows):
    out, tables = [], {}
    for r in sorted(rows, key=order_key):
        tables.setdefault(r[0], []).append(r)
    for t, rs in tables.items():
        if len(rs) == 1:
            if rs[0][1] or rs[0][2]:
                out.append((t, rs[0][1], rs[0][2], None, "single"))
            continue
        if rs[0][1]:
            out.append((t, rs[0][1], rs[0][2], None, "first_start"))
        if rs[-1][2]:
            out.append((t, rs[-1][1], rs[-1][2], None, "last_end"))
        for a, b in zip(rs, rs[1:]):
            if a[2] == "" or b[1] != a[2]:
                kind = "overlap" if a[2] == "" or b[1] < a[2] else "gap"
                out.append((t, b[1], b[2], a[2], kind))
    return sorted(out, key=repr)


def random_ranges(rng, n, tables="aaab"):
    out = []
    for _ in range(n):
        lo, hi = sorted(rng.sample(range(60), 2))
        start = "" if rng.random() < 0.1 else f"{lo:03d}"
        end = "" if rng.random() < 0.1 else f"{hi:03d}"
        out.append((rng.choice(tables), start, end))
    return out


DDL = "table_name string, start_key string, end_key string"


@pytest.mark.parametrize("sizes", [SMALL, ONE])
@pytest.mark.parametrize("seed", [1, 2])
def test_containment(spark, seed, sizes):
    rng = random.Random(seed)
    cand, covers = random_ranges(rng, 150), random_ranges(rng, 12)
    cdf, pdf = spark.createDataFrame(cand, DDL), spark.createDataFrame(covers, DDL)
    want = sorted(c for c in cand if any(inside(c, p) for p in covers))
    rest = sorted(c for c in cand if not any(inside(c, p) for p in covers))
    assert sorted(map(tuple, contained_slices(cdf, pdf, **sizes).collect())) == want
    assert sorted(map(tuple, not_contained_slices(cdf, pdf, **sizes).collect())) == rest
    assert want and rest


@pytest.mark.parametrize("sizes", [SMALL, ONE])
@pytest.mark.parametrize("seed", [3, 4])
def test_issues(spark, seed, sizes):
    rows = random_ranges(random.Random(seed), 150)
    found = coverage_issues(spark.createDataFrame(rows, DDL), **sizes).collect()
    assert sorted(map(tuple, found), key=repr) == expected_issues(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [("t", "", "")],
        [("t", "a", "")],
        [("t", "", ""), ("t", "", "")],
        [("t", "", "m"), ("t", "m", ""), ("u", "", "b")],
        [("t", "", "m"), ("t", "", "m"), ("t", "m", "")],
    ],
)
def test_small_tilings(spark, rows):
    found = coverage_issues(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(map(tuple, found), key=repr) == expected_issues(rows)


@pytest.mark.parametrize("sizes", [SMALL, ONE])
def test_a_tiling_has_no_issues_and_a_hole_shows(spark, sizes):
    cuts = sorted(random.Random(5).sample(range(10_000), 200))
    edges = ["", *[f"{c:05d}" for c in cuts], ""]
    tiles = [("t", a, b) for a, b in zip(edges, edges[1:])]
    assert coverage_issues(spark.createDataFrame(tiles, DDL), **sizes).isEmpty()
    holed = tiles[:77] + tiles[78:]
    found = coverage_issues(spark.createDataFrame(holed, DDL), **sizes).collect()
    assert [(r.prev_end_key, r.start_key, r.issue) for r in found] == [
        (tiles[76][2], tiles[78][1], "gap")
    ]


def test_hot_table_is_cut_into_chunks(spark):
    """One table with nearly all rows does not stay in one window partition."""
    rows = [("hot", f"{i:05d}", f"{i + 1:05d}") for i in range(2000)] + [("cold", "", "")]
    df = spark.createDataFrame(rows, DDL)
    order = Order(("table_name",), ("start_key", "end_key"), ends=("end_key",))
    chunked = with_chunks(df, order, 16)
    sizes = [r["count"] for r in chunked.groupBy("table_name", CHUNK).count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 400


def test_running_functions(spark):
    rng = random.Random(9)
    data = [(rng.choice("xxy"), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    order = Order(("g",), ("i",))
    for sizes in (SMALL, ONE):
        out = with_running_max(df, order, F.col("v"), "m", **sizes)
        out = with_running_sum(out, order, F.col("v"), "s", **sizes)
        out = with_previous(out, order, "v", "p", **sizes)
        out = with_row_number(out, order, "n", **sizes)
        got = {(r.g, r.i): (r.m, r.s, r.p, r.n) for r in out.collect()}
        assert len(got) == len(data)
        for g in "xy":
            seen = []
            for _, i, v in sorted(d for d in data if d[0] == g):
                seen.append(v)
                before = seen[-2] if len(seen) > 1 else None
                assert got[g, i] == (max(seen), sum(seen), before, len(seen) - 1)


def test_row_number_over_everything(spark):
    df = spark.range(500).withColumn("k", F.lpad(F.col("id").cast("string"), 5, "0"))
    out = with_row_number(df.orderBy(F.rand(1)), Order((), ("k",)), "n", **SMALL)
    assert all(r.id == r.n for r in out.collect())


@pytest.mark.parametrize("sizes", [SMALL, ONE])
def test_binary_keys(spark, sizes):
    """Keys may be binary: they compare as unsigned bytes, and the empty end is unbounded."""
    rng = random.Random(6)

    def some(n):
        out = []
        for _ in range(n):
            lo, hi = sorted(rng.sample(range(256), 2))
            start = b"" if rng.random() < 0.1 else bytes([lo])
            end = b"" if rng.random() < 0.1 else bytes([hi, 0])
            out.append(("t", start, end))
        return out

    ddl = "table_name string, start_key binary, end_key binary"
    cand, covers = some(120), some(5)
    cdf, pdf = spark.createDataFrame(cand, ddl), spark.createDataFrame(covers, ddl)

    def within(i, o):
        return o[1] <= i[1] and (o[2] == b"" or (i[2] != b"" and i[2] <= o[2]))

    got = [tuple(map(bytes, r[1:])) for r in contained_slices(cdf, pdf, **sizes).collect()]
    assert sorted(got) == sorted(c[1:] for c in cand if any(within(c, p) for p in covers))
    as_text = [(t, a.hex(), b.hex()) for t, a, b in cand]
    found = [
        (r[0], *[None if v is None else bytes(v).hex() for v in r[1:4]], r[4])
        for r in coverage_issues(cdf, **sizes).collect()
    ]
    assert sorted(found, key=repr) == expected_issues(as_text)


@pytest.mark.parametrize("sizes", [SMALL, ONE, {}])
def test_null_groups_and_keys(spark, sizes):
    """Nulls sort first and are a group of their own, whatever the number of chunks."""
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", None]), None if i % 50 == 0 else i, rng.choice([1, 2, None])) for i in range(2000)]
    data = list({(g, i): (g, i, v) for g, i, v in data}.values())
    df = spark.createDataFrame(data, "g string, i int, v int")
    order = Order(("g",), ("i",))
    out = with_row_number(with_previous(df, order, "v", "p", **sizes), order, "n", **sizes)
    got = {(r.g, r.i): (r.p, r.n) for r in out.collect()}
    assert len(got) == len(data)
    for g in ("a", "b", None):
        before = None
        rows = sorted((d for d in data if d[0] == g), key=lambda d: (d[1] is not None, d[1]))
        for n, (_, i, v) in enumerate(rows):
            assert got[g, i] == (before, n)
            before = v
