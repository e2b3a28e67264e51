"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysnap.llm.common import by_key, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node it can reach.

    Each round joins links with one minimum per node. Minima are stored first, so both sides of
    the join are plain scans and adaptive execution can split a hub with very many links. Only a
    count and a checksum of the links reach the driver. No links: no rows.
    """
    e = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = stored(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima"
        )
        large = stored(
            both.join(by_key(low), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            "links",
        )
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        joined = large.join(by_key(low), "u")
        e = stored(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v"), F.col("v")).distinct()
    )
