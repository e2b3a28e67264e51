"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Of two fingerprints within two differing bits, at least
one segment differs in one bit at most. So there is a table for each segment, in which a fingerprint
stands under the segment's value; every fingerprint looks up the members of the ball of radius 1
around each of its segments, fetches what stands there, and complete distances are verified. Of two
values one bit apart, the one that has the bit looks up the other.

Near copies may put very many fingerprints under one value. Where there are more than ``CROWDED``, the
bucket is split by the next segment: those in it stand under each member of the ball around their other
segment, those that differ in the first segment already look up their other one as it is, the rest
their ball. Such a part holds 33 fingerprints at most, so all that meet in it are linked to the
smallest. No bucket is capped, no group emits all its pairs, and the result is the same for any
``CROWDED``.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked
like any other. Equal texts share a fingerprint, so repeated rows share a component. A component
without any non-null document id has a null id. A very long text is hashed in blocks, whole, without
further memory for each shingle. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm import similar
from keysnap.llm.common import by_key, map_text, stored, unused
from keysnap.llm.components import components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
WIDTH = 32  # bits of a segment
CROWDED = 64
BROADCAST_ROWS = 1 << 16
_SALTS = 16
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash over shingles of three words, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    lasts = ends[SHINGLE - 1 :] or ends[-1:]
    ones, n = np.zeros((8, 8), np.int64), len(lasts)
    for at in range(0, n, _BLOCK):  # bounded memory for texts of any length
        block = zip(starts[at : at + _BLOCK], lasts[at : at + _BLOCK])
        hashes = np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in block), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8, 1), axis=2).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, axis=1).ravel().view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and each row's fingerprint as a signed long."""
    def each():
        last: dict = {}

        def make(t):
            # Copies often lie side by side.
            if last.get("text", "") != t or not last:
                last["text"], last["fp"] = t, fingerprint(t)
            return (last["fp"],)

        return make

    return map_text(
        df, text, T.StructType([T.StructField(name, T.LongType())]), each,
        df.columns if keep is None else keep,
    )


def _table(fingerprints: DataFrame) -> DataFrame:
    """(fp, segment, value, rest): each fingerprint under both of its segments."""
    high, low = F.shiftrightunsigned("fp", WIDTH), F.col("fp").bitwiseAND((1 << WIDTH) - 1)
    of = lambda i, value, rest: F.struct(F.lit(i).alias("segment"), value.alias("value"), rest.alias("rest"))
    return fingerprints.select("fp", F.inline(F.array(of(0, high, low), of(1, low, high))))


def _ball(value: str) -> Column:
    """The value and those one bit away."""
    flipped = f"transform(sequence(0, {WIDTH - 1}), i -> {value} ^ shiftleft(1L, i))"
    return F.expr(f"array_append({flipped}, {value})")


def candidates(fingerprints: DataFrame) -> DataFrame:
    """(fp, other) of distinct fingerprints that meet in a bucket of the segment tables, not verified.

    All links within two bits are covered by chains of those among these. ``fingerprints`` (``fp``)
    are read several times.
    """
    table = _table(fingerprints)
    probes = table.select("fp", "segment", "value", "rest", F.explode(_ball("value")).alias("member"))
    # A single bit more or less: only the value that has it looks up the other.
    probes = probes.where("member <= value").withColumn("salt", F.pmod(F.hash("fp"), F.lit(_SALTS)))
    sizes = table.groupBy("segment", "value").agg(F.count("*").alias("n"))
    crowded = stored(sizes.where(F.col("n") > CROWDED).select("segment", F.col("value").alias("member")), "crowded")
    at = ["segment", "member"]
    # Their number decides, not an estimate: so many at most are broadcast.
    if crowded.count() <= BROADCAST_ROWS:
        crowded, told, told_at = F.broadcast(crowded), F.broadcast(crowded), at
    else:
        # A value may be looked up by a large part of all rows, so it is told crowded in several places.
        salted = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        crowded, told, told_at = by_key(crowded), by_key(salted), [*at, "salt"]

    few = table.select("segment", F.col("value").alias("member"), F.col("fp").alias("other")).join(crowded, at, "left_anti")
    met = probes.join(told, told_at, "left_anti").join(by_key(few), at).select("fp", "other")

    split = table.withColumnRenamed("value", "member").join(crowded, at, "left_semi")
    split = split.select(*at, "fp", F.explode(_ball("rest")).alias("part"))
    least = split.groupBy(*at, "part").agg(F.min("fp").alias("other"))
    own = F.when(F.col("member") == F.col("value"), _ball("rest")).otherwise(F.array("rest"))
    asked = probes.join(told, told_at, "left_semi").select(*at, "fp", F.explode(own).alias("part"))
    return met.union(asked.join(by_key(least), [*at, "part"]).select("fp", "other")).where("fp <> other")


def links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, other) within two bits, of distinct fingerprints; chains of these cover all such links."""
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    return candidates(fingerprints.select(F.col(fp).alias("fp"))).where(apart <= MAX_DISTANCE).distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``documents`` (with fingerprints; read several times, so best stored) and ``component_id``."""
    distinct = stored(documents.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")), "fingerprints")
    root = components(links(distinct.select("fp")), "fp", "other")
    placed = stored(
        distinct.join(by_key(root.withColumnRenamed("node", "fp")), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first"),
        "roots",
    )
    ids = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    of = stored(placed.join(by_key(ids), "root").select("fp", "component_id"), "components")
    name, key = unused(documents, "component_id"), unused(documents, "component_fp")
    return documents.join(by_key(of.toDF(key, name)), documents[fp] == F.col(key)).drop(key)


def fingerprint_pairs(tagged: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the nodes' rows: each with the first of its fingerprint, and first ones within two bits."""
    prints = stored(tagged.select("row", "fp").join(nodes.hint("shuffle_hash"), "row", "left_semi"), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("row").alias("a")), "firsts")
    same = prints.join(by_key(firsts), "fp").where("row <> a").select("a", F.col("row").alias("b"))
    others = firsts.select(F.col("fp").alias("other"), F.col("a").alias("b"))
    linked = links(firsts.select("fp")).join(by_key(firsts), "fp").join(by_key(others), "other")
    return same.unionByName(linked.select("a", "b"))


def drop_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies stays: that of the smallest document id (nulls come last).

    Near copies share 0.8 of their five-word shingles. Fingerprints within two bits are candidates;
    those of near copies mostly differ in far more bits, so ``similar`` finds further ones, and decides
    all of them by their complete sets.
    """
    own = [f"c{i}" for i in range(len(documents.columns))]  # no name can clash
    place = dict(zip(documents.columns, own))
    plain = documents.toDF(*own).withColumn("row", F.monotonically_increasing_id())
    tagged = stored(similar.with_bands(plain, place[text], plain.columns, fingerprint, "fp"), "tagged")
    narrow = tagged.select(F.col(place[doc_id]).alias("id"), "row", "digest")
    distinct = stored(
        narrow.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
        .select("first", F.col("first.row").alias("node")), "sets",
    )
    nodes = distinct.select(F.col("node").alias("row"))
    root = similar.similar_components(tagged, nodes, place[text], fingerprint_pairs(tagged, nodes))
    stays = (
        distinct.join(by_key(root), "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    # The plan of every size: ids are hashed in each partition, and texts stream past them unsorted.
    ids = stored(stays, "stays").hint("shuffle_hash")
    return tagged.join(ids, "row", "left_semi").select(own).toDF(*documents.columns)
