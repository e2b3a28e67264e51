"""Near copies by the Jaccard similarity of their sets of five-word shingles.

A set has ``HASHES`` min-hashes. Each of ``BANDS`` bands is a fixed choice of ``ROWS`` of them, and
candidates share a band: a pair with similarity 0.8 does with a probability of about 0.9995, a closer
one nearly always, one with 0.45 in one case of twenty (``tests/llm/test_near_copies.py`` measures
both). Candidates whose min-hashes, of which four bits each are compared, agree in too few places
are dropped: at 0.8 that befalls about one pair in 2,000, closer ones hardly ever. No candidate counts as it is: a link
needs the similarity of the complete sets, which is counted from integers. (Fingerprints of such
pairs differ in 12 bits and more, and balls of that radius around segments of 64 bits hold too much
of a large table.)

Equal sets are one node from the start, so exact copies form no pairs. In a band's bucket all
members are first compared with one, the hub: the member that shares most buckets with most others,
as an original does with its copies. A large group of near copies is so joined up by few comparisons.

After that, only members of different components are left to compare, where a bucket has a member
that is in another one than the hub. They are compared by their changes, the shingles
that only one of a member and its hub has. With ``a`` shingles of the hub missing and ``e`` others added,
the weight ``w = 5a + 4e`` is at most the hub's size if the member is similar to the hub; and two members
are similar if, and only if, they share at least ``(w1 + w2 - size) / 9`` changes. So of two that are
not both similar to the hub, the lighter one shares more than a ninth of its weight and the heavier one
a fifth of what its weight is beyond the hub's size, at least. Changes are sorted by the number of members
that have them, rarest first, and members meet by the changes in which the first shared one must be,
if enough can follow it. Texts that were edited independently share few
of their changes, so a family around 0.8 forms few pairs, and still no pair in a common bucket is left
undecided.

Defined results: words are as in ``simhash`` (A-Z lower-cased, split at ASCII space); a text of
fewer than five words is one shingle; null and empty texts, and those without words, have the empty
set and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import by_key, map_text, stored
from keysnap.llm.components import components

SHINGLE = 5
SEED = 42
HASHES, BANDS, ROWS = 160, 64, 9
# Four bits of each min-hash, in so many longs. At a similarity of 0.8 about 30 of 160 differ, with a
# standard deviation of 4.9; at 0.6 about 60, at 0.45 about 83.
LANES, MAX_DIFFERENT = 10, 46
_BLOCK = 1024
_CODES = 1 << 17
_SOME = np.random.default_rng(SEED)
_PLACES = _SOME.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _SOME.integers(0, 1 << 63, (HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BAND = _SOME.integers(0, 1 << 63, (BANDS, ROWS + 1), np.uint64) * np.uint64(2) + np.uint64(1)
_CHOICE = np.array([_SOME.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordCodes(dict):
    """Hashes of words, the common ones remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        code = xxh64_intdigest(word, SEED)
        if len(word) <= 32:
            if len(self) >= _CODES:
                self.clear()
            self[word] = code
        return code


def shingle_set(text: str | None, codes: WordCodes) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(max(1, len(words) - SHINGLE + 1), np.uint64)
    for i in range(min(SHINGLE, len(words))):
        h += each[i : i + len(h)] * _PLACES[i]
    return np.unique(_mixed(h))


def bands(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key for each band, as signed longs, and four bits of each min-hash; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64), np.zeros(LANES, np.int64)
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(low, (hashes[at : at + _BLOCK] * _FACTORS).min(axis=1), out=low)
    low = _mixed(low)
    keys = (low[_CHOICE] * _OF_BAND[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _OF_BAND[:, ROWS]
    some = (low & np.uint64(15)).reshape(LANES, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return _mixed(keys).view(np.int64), np.bitwise_or.reduce(some, axis=1).view(np.int64)


def with_bands(
    df: DataFrame, text: str, keep: list[str], mark: Callable[[str | None], int], name: str
) -> DataFrame:
    """The columns ``keep``, a digest of each row's shingle set, its bands and the bits of its min-hashes,
    and a number that ``mark`` makes of the text."""
    longs = T.ArrayType(T.LongType())
    fields = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("bands", longs), T.StructField("lanes", longs),
        T.StructField(name, T.LongType()),
    ])

    def each():
        codes, last = WordCodes(), {}

        def make(t):
            # Copies often lie side by side.
            if last.get("text", "") != t or not last:
                found = shingle_set(t, codes)
                last["text"], last["made"] = t, (md5(found.tobytes()).digest(), *bands(found), mark(t))
            return last["made"]

        return make

    return map_text(df, text, fields, each, keep, rows=256)


def with_sets(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and each row's shingle hashes."""
    fields = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])

    def each():
        codes = WordCodes()
        return lambda t: (shingle_set(t, codes).view(np.int64),)

    return map_text(df, text, fields, each, keep, rows=256)


def promising(pairs: DataFrame, tagged: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose min-hashes agree in enough places."""
    of = lambda side: tagged.select(F.col("row").alias(side), F.col("lanes").alias(f"lanes_{side}"))
    apart = F.lit(0)
    for i in range(LANES):
        x = F.get("lanes_a", F.lit(i)).bitwiseXOR(F.get("lanes_b", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(either)
    both = pairs.join(by_key(of("b")), "b").join(by_key(of("a")), "a")
    return stored(both.where(apart <= MAX_DIFFERENT).select("a", "b"), "promising")


def verified(pairs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Of the pairs (a, b) those with a similarity of 0.8 at least; ``texts`` has ``row``, the text and
    ``lanes``."""
    pairs = promising(pairs, texts)
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "compared").hint("shuffle_hash")
    sets = stored(with_sets(texts.select("row", text).join(needed, "row", "left_semi"), text, ["row"]), "sets")
    of = lambda side: sets.toDF(side, f"set_{side}")
    both = F.size(F.array_intersect("set_a", "set_b"))
    n, m = F.size("set_a"), F.size("set_b")
    # both / (n + m - both) >= 4 / 5 in integers; sizes alone settle many pairs.
    near = F.when(5 * F.least(n, m) < 4 * F.greatest(n, m), False).otherwise(9 * both >= 4 * (n + m))
    return stored(pairs.join(by_key(of("b")), "b").join(by_key(of("a")), "a").where(near).select("a", "b"), "similar")


def changes(members: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """The columns of ``members`` (``low``: the hub, ``row``), ``changed``: the shingles that one of both has,
    ``weight`` and ``hub_size``."""
    needed = stored(members.select(F.explode(F.array("low", "row")).alias("row")).distinct(), "compared").hint("shuffle_hash")
    sets = stored(with_sets(texts.select("row", text).join(needed, "row", "left_semi"), text, ["row"]), "sets")
    both = members.join(by_key(sets.toDF("row", "own")), "row").join(by_key(sets.toDF("low", "hub")), "low")
    missing, added = F.array_except("hub", "own"), F.array_except("own", "hub")
    return stored(
        both.select(*members.columns, missing.alias("missing"), added.alias("added"), F.size("hub").alias("hub_size"))
        .select(
            *members.columns, F.concat("missing", "added").alias("changed"),
            (5 * F.size("missing") + 4 * F.size("added")).alias("weight"), "hub_size",
        ), "changes",
    )


def changed_alike(told: DataFrame) -> DataFrame:
    """(a, b) of all rows in different parts, not both similar to their hub, that share enough changes to be
    similar; some that share fewer are among them."""
    each = told.select("low", "row", "part", "weight", "hub_size", F.explode("changed").alias("change"))
    same = Window.partitionBy("low", "change")
    # What only one part has, no pair shares.
    known = each.select("*", F.count("*").over(same).alias("n"), (F.min("part").over(same) < F.max("part").over(same)).alias("some"))
    listed = stored(
        known.where("some").groupBy("low", "row", "part", "weight", "hub_size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "change"))).alias("shared")), "shared-changes",
    )
    size = F.size("shared")

    def first(least: Column) -> DataFrame:
        """The changes of which one is shared by any that share ``least``, and how many come after each."""
        some = F.slice("shared", F.lit(1), F.greatest(F.lit(0), size - least + 1))
        each = listed.select("low", "row", "part", "weight", "hub_size", size.alias("size"), F.posexplode(some).alias("at", "c"))
        return each.select("low", F.col("c.change").alias("change"), "row", "part", "weight", "hub_size", (F.col("size") - F.col("at")).alias("left"))

    light = first(F.expr("weight div 9 + 1").cast("int"))
    heavy = first(F.expr("(weight - hub_size + 4) div 5").cast("int")).where("weight > hub_size")
    x = heavy.drop("hub_size").toDF("low", "change", "x", "x_part", "x_weight", "x_left")
    enough = 9 * F.least("left", "x_left") >= F.col("weight") + F.col("x_weight") - F.col("hub_size")
    lighter = F.struct("weight", "row") < F.struct("x_weight", "x")
    return (
        light.join(by_key(x), ["low", "change"]).where((F.col("part") != F.col("x_part")) & lighter & enough)
        .select(F.least("row", "x").alias("a"), F.greatest("row", "x").alias("b")).distinct()
    )


def similar_components(tagged: DataFrame, nodes: DataFrame, text: str, near: DataFrame) -> DataFrame:
    """(node, root) of ``nodes`` (``row``: one of each set) that have a partner.

    ``tagged`` has row, text, bands and lanes of all rows; ``near`` (a, b) are candidates found before.
    """
    entries = stored(
        tagged.select("row", "bands").join(nodes.hint("shuffle_hash"), "row", "left_semi")
        .select("row", F.explode("bands").alias("key")), "bands",
    )
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    full = stored(entries.join(by_key(stored(sizes, "sizes")), "key"), "full-buckets")
    weight = full.groupBy("row").agg(F.sum("n").alias("weight"))
    hubs = full.join(by_key(weight), "row").groupBy("key").agg(F.max_by("row", F.struct("weight", -F.col("row"))).alias("low"))
    shared = stored(full.drop("n").join(by_key(stored(hubs, "hubs")), "key"), "buckets")
    banded = shared.where("row <> low").select(F.least("low", "row").alias("a"), F.greatest("low", "row").alias("b"))
    both = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = stored(banded.unionByName(both).distinct(), "pairs")
    links = verified(first, tagged, text)
    root = stored(components(links, "a", "b"), "roots")
    part = root.toDF("row", "part")
    placed = shared.where("row <> low").join(by_key(part), "row", "left").withColumn("part", F.coalesce("part", "row"))
    lows = part.toDF("low", "low_part")
    placed = stored(
        placed.join(by_key(lows), "low", "left").withColumn("low_part", F.coalesce("low_part", "low")), "placed"
    )
    apart = placed.where("part <> low_part").select("key").distinct()
    members = stored(
        placed.join(by_key(apart), "key", "left_semi").select("low", "low_part", "row", "part").distinct(), "members"
    )
    told = changes(members, tagged, text)
    joined = told.where("part <> low_part and weight <= hub_size").select(F.col("low").alias("a"), F.col("row").alias("b"))
    pairs = stored(changed_alike(told).join(by_key(first), ["a", "b"], "left_anti"), "pairs")
    return components(links.union(joined).union(verified(pairs, tagged, text)), "a", "b")
