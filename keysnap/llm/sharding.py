"""Sharding by balanced label propagation over equal texts.

Documents with equal texts are linked, each to all others of its group; a link between two shards
is a cut edge. Every document starts with a label, dealt out evenly. In each round a group's label
counts (map-side combined: a group of any size is 40 rows at most) give the label that most
neighbours hold, or for a group beyond a quota as many such labels as it needs; parts of the group
that hold another label join back to it and move there as far as the target's quota goes. What does not fit stays and tries again in the next round, with
the full targets left out. Rounds end when nothing moves, or, after ``ROUNDS``, when a round leaves the
groups in no fewer parts than the best before, which then counts: so they do end.

The law is ``rows``: numbers of documents per shard at most one apart. After the last round
documents are numbered in the order of their labels, groups side by side: linked ones keep their
label up to its quota, single ones and the rest fill what is left.

Quotas hold for whole shards at every size: a round's parts are numbered in the order in which a
shard takes them, running sums are taken in chunks of ``CHUNK`` numbers, and the sum of the chunks
before is carried. Numbering is by range partitions. No group, however large, meets in one task.

Defined results: a null text counts as an empty one. Repeated rows are documents of their own,
linked like other copies; null ids are kept. A text of any length
is one document of its size. Of labels that a group holds equally the smallest is liked best. An
empty table gives no rows. Fewer documents than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysnap.llm.common import numbered, stored

SHARDS = 40
OVERHEAD = 16
ROUNDS = 4
CHUNK = 1 << 16


def _propagate(parts: DataFrame, quota: int, rounds: int) -> DataFrame:
    """``parts`` (group, first, n) with the label that each part ends with."""
    state = stored(parts.withColumn("label", F.col("first")), "labels")
    best_state, fewest, done = state, state.count(), 0
    while True:
        held = state.groupBy("label").agg(F.sum("n").alias("held"))  # one row per shard
        room = F.broadcast(held.where(F.col("held") >= quota).select(F.col("label").alias("full")))
        counts = state.groupBy("group", "label").agg(F.sum("n").alias("n"))
        # A group's labels (as many as shards, at most) by what they hold; a full shard comes last.
        liked = F.struct(F.col("full").isNull(), "n", (-F.col("label")).alias("low"))
        best = stored(
            counts.join(room, counts["label"] == F.col("full"), "left")
            .groupBy("group").agg(F.sort_array(F.collect_list(liked), asc=False).alias("liked"), F.sum("n").alias("members"))
            .select("group", "members", F.transform("liked", lambda x: -x["low"]).alias("liked")),
            "targets",
        )
        # A group that exceeds a shard fills as many as it needs, the labels it likes best first.
        in_group = Window.partitionBy("group").orderBy(F.array_position("liked", F.col("label")), "first")
        before = F.sum("n").over(in_group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        wanted = (
            state.join(best, "group")
            .withColumn("target", F.get("liked", F.floor(before / quota).cast("int")))
            .withColumn("target", F.coalesce("target", "label"))
            .withColumn("moves", (F.col("label") != F.col("target")).cast("int"))
        )
        # Large groups first: what they crowd out finds its label full and leaves in the next round.
        taken = numbered(
            wanted.select(
                "group", "first", "n", "label", "target", "moves", (-F.col("members")).alias("by_members"), (-F.col("n")).alias("by_n")
            ),
            ["target", "by_members", "moves", "by_n", "group", "first"], "taken", "place",
        )
        taken = stored(taken.withColumn("chunk", F.floor(F.col("place") / CHUNK)), "taken")
        sums = taken.groupBy("target", "chunk").agg(F.sum("n").alias("sum"))
        over = Window.partitionBy("target").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
        # One row in CHUNK: the planner broadcasts it where its stored size allows, and joins by key beyond.
        carried = stored(sums.select("target", "chunk", (F.sum("sum").over(over) - F.col("sum")).alias("carried")), "carried")
        order = Window.partitionBy("target", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        filled = F.sum("n").over(order)
        fits = F.col("filled") + F.col("carried") <= quota
        moved = stored(
            taken.withColumn("filled", filled).join(carried, ["target", "chunk"]).withColumn("fits", fits).select(
                "group", "first", "n", F.when(F.col("fits"), F.col("target")).otherwise(F.col("label")).alias("label"),
                (F.col("fits") & (F.col("moves") == 1)).alias("moved"),
            ),
            "labels",
        )
        state, done = moved.drop("moved"), done + 1
        now = state.select("group", "label").distinct().count()
        if now < fewest:
            best_state, fewest = state, now
        elif done >= rounds:
            break
        if moved.where("moved").isEmpty():
            break
    return best_state


def _dealt(ranked: DataFrame, loads: dict[int, tuple[int, int]], total: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of rows numbered by label, linked ones first.

    ``loads`` has the rows and the linked rows of each label. Linked rows keep their label up to its
    quota; the others, in order, fill what is left. All tables here have one entry per shard.
    """
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    rows = [loads.get(s, (0, 0)) for s in range(shards)]
    keep = [min(linked, q) for (_, linked), q in zip(rows, quota)]
    starts, fillers, gaps = [0], [0], [0]
    for (n, _), k, q in zip(rows, keep, quota):
        starts.append(starts[-1] + n)
        fillers.append(fillers[-1] + n - k)
        gaps.append(gaps[-1] + q - k)
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i).cast("long")
    label = F.col("label")
    place = F.col("rank") - at(starts, label)
    stays = place < at(keep, label)
    filler = at(fillers, label) + place - at(keep, label)
    # The shard whose gap holds the filler: as many as have their gap's end before it.
    ends = F.array(*[F.lit(g).cast("long") for g in gaps[1:]])
    other = F.size(F.filter(ends, lambda end: end <= filler))
    shard = F.when(stays, label).otherwise(other).cast("int")
    slot = F.when(stays, place).otherwise(at(keep, other) + filler - at(gaps, other)).cast("long")
    return shard, slot


def assign_shards(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, label) for every document."""
    data = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(data) + OVERHEAD).cast("long")
    base = stored(
        documents.select(
            F.col(doc_id), size.alias("size"), F.crc32(F.encode(data, "utf-8")).alias("text_crc32"),
            F.unhex(F.md5(F.encode(data, "utf-8"))).alias("group"), F.monotonically_increasing_id().alias("row"),
        ).withColumn("first", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")),
        "sharding",
    )
    total = base.count()
    parts = base.groupBy("group", "first").agg(F.count("*").alias("n"))
    sums = parts.groupBy("group").agg(F.sum("n").alias("members")).where("members > 1").select("group")
    linked = stored(stored(parts, "parts").join(stored(sums, "groups"), "group"), "linked")
    labels = _propagate(linked, -(-total // shards), rounds)
    placed = (
        base.join(labels.select("group", "first", "label"), ["group", "first"], "left")
        .select(
            F.col(doc_id).alias("id"), "size", "text_crc32", F.coalesce("label", "first").alias("label"),
            F.col("label").isNull().alias("single"), "group", "row",
        )
    )
    rank = numbered(placed, ["label", "single", "group", "row"], "ranked")
    by_label = rank.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~F.col("single")).alias("linked")).collect()
    shard, slot = _dealt(rank, {r["label"]: (r["n"], r["linked"]) for r in by_label}, total, shards)
    return rank.select(
        F.col("id").alias(doc_id), "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
        slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "label",
    )
