"""Quotas hold for whole shards, however the running sums are split."""

from collections import Counter

from keysnap.llm import sharding


def test_a_hot_group_gathers_at_every_size(spark, monkeypatch):
    texts = {i: "hot" if i % 3 == 0 else f"pair {i // 2}" for i in range(1200)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(sharding, "GROUPS_IN_BUCKET", 2, raising=False)
    spread = []
    for chunk in (1 << 16, 3):
        monkeypatch.setattr(sharding, "CHUNK", chunk, raising=False)
        rows = sharding.assign_shards(frame).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
        spread.append(len({r["shard"] for r in rows if texts[r["doc_id"]] == "hot"}))
    assert spread[0] == spread[1] <= 20  # 14 at least
