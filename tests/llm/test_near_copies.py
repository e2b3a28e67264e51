"""The pipeline's near-duplicate stage against brute-force Jaccard over five-word shingles."""

import os
import random
from collections import Counter, defaultdict

import numpy as np

from keysnap.llm import simhash, similar
from keysnap.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(texts):
    """The smallest id of each component, over pairs with a similarity of 0.8 at least."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    of, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s or [()]:
            common.update((d, e) for e in of[g])
            of[g].append(d)
    for (a, b), n in common.items():
        if not sets[a] and not sets[b] or 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d for d in texts if find(d) == d}


def test_stage_equals_brute_force_on_the_table(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    assert set(kept) == brute_kept(texts) and len(kept) == len(set(kept))


def test_edits_chains_and_a_large_group(spark):
    """Copies on both sides of 0.8, chains of copies, and many copies of one text in common buckets."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = ["a b", "A  b", None, "", "a b c d e", "a b c d e f"]
    for n in (30, 100, 400):
        for share in (0.01, 0.02, 0.03, 0.05):
            seed = words(n)
            texts.append(" ".join(seed))
            for _ in range(3):  # each an edit of the one before
                for i in range(max(1, round(n * share))):
                    seed[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
                texts.append(" ".join(seed))
    seed = words(120)
    for _ in range(300):
        some = list(seed)
        for _ in range(rng.choice([1, 2, 3, 4])):
            some[rng.randrange(120)] = f"g{rng.randrange(10**6)}"
        texts.append(" ".join(some))
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame.repartition(5)).collect()}
    assert kept == brute_kept(dict(enumerate(texts)))


def sets_with_similarity(rng, share, n=400):
    """Two sets of hashes, of which ``share`` of the union is common."""
    common = round(n * share)
    rest = n - common
    hashes = np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)
    cut = common + rest // 2
    return np.unique(hashes[:cut]), np.unique(np.concatenate((hashes[:common], hashes[cut:])))


def agree(a, b):
    (keys_a, lanes_a), (keys_b, lanes_b) = similar.bands(a), similar.bands(b)
    x = (lanes_a ^ lanes_b).view(np.uint64)
    x = x | x >> np.uint64(1)
    apart = sum(bin(int(v)).count("1") for v in (x | x >> np.uint64(2)) & np.uint64(0x1111111111111111))
    return bool((keys_a == keys_b).any()), apart <= similar.MAX_DIFFERENT


def test_candidates_by_similarity():
    """Measured recall at 0.8, and how few pairs far below become candidates."""
    rng = random.Random(12)
    found = {s: [agree(*sets_with_similarity(rng, s)) for _ in range(400)] for s in (0.8, 0.9, 0.45)}
    share = {s: sum(all(f) for f in rows) / len(rows) for s, rows in found.items()}
    assert share[0.8] >= 0.99 and share[0.9] == 1.0 and share[0.45] <= 0.01
    assert sum(f[0] for f in found[0.45]) / 400 <= 0.15


def test_a_family_far_from_similar_forms_few_pairs(spark, monkeypatch):
    """800 texts, eight of 200 words changed in each: pairs lie near 0.45, and hardly any is compared."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(800):
        some = list(base)
        for i in rng.sample(range(200), 8):
            some[i] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(some))
    compared = []
    real = similar.promising

    def counted(pairs, tagged):
        out = real(pairs, tagged)
        compared.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(similar, "promising", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame).collect()}
    assert kept == brute_kept(dict(enumerate(texts)))
    candidates, checked = (sum(c) for c in zip(*compared))
    assert candidates < 60_000 and checked < 2_000  # of 319,600 pairs


def edited(rng, words, most):
    some = list(words)
    for i in rng.sample(range(len(words)), rng.randrange(1, most)):
        some[i] = f"e{rng.randrange(10**6)}"
    return some


def test_a_family_around_similar_forms_few_pairs(spark, monkeypatch):
    """600 texts, up to nine of 150 words changed in each: most pairs lie between 0.5 and 0.8."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, 10)) for _ in range(600)]
    compared = []
    real = similar.promising
    monkeypatch.setattr(similar, "promising", lambda pairs, tagged: compared.append(pairs.count()) or real(pairs, tagged))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame).collect()}
    assert kept == brute_kept(dict(enumerate(texts)))
    assert sum(compared) < 15_000  # of 179,700 pairs


def test_sets_are_not_broadcast(spark, nothing_broadcast):
    """Pairs, sets and changes that look small by their files are joined by key."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(edited(rng, base, 4)) for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame).collect()}
    assert kept == brute_kept(dict(enumerate(texts)))


def test_similar_members_far_from_their_hub(spark):
    """All similar pairs that the hub does not join up meet by shared changes, whatever the texts have in common."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = [base] + [edited(rng, base, 9) for _ in range(60)]
    for _ in range(12):  # texts near each other at all distances from the hub, some much longer or shorter
        center = edited(rng, base, 30)[: rng.choice([40, 80, 100])] + [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([0, 15, 60]))]
        texts += [center] + [edited(rng, center, 3) for _ in range(8)]
    sets = [shingles(" ".join(t)) for t in texts]
    near = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    n = len(texts)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string")
    members = spark.createDataFrame([(0, 0, i, i) for i in range(1, n)], "low long, low_part long, row long, part long")
    told = similar.changes(members, frame, "text")
    assert {r["row"] for r in told.collect() if r["weight"] <= r["hub_size"]} == {i for i in range(1, n) if near(0, i)}
    got = {(r["a"], r["b"]) for r in similar.changed_alike(told).collect()}
    pairs = {(a, b) for a in range(1, n) for b in range(a + 1, n) if not (near(0, a) and near(0, b))}
    expected = {(a, b) for a, b in pairs if near(a, b)}
    assert expected <= got <= pairs and len(expected) > 100 and len(got) < len(pairs) / 5
    # Pairs of one part are joined up already.
    same = members.withColumn("part", members["row"] % 2)
    got = {(r["a"], r["b"]) for r in similar.changed_alike(similar.changes(same, frame, "text")).collect()}
    assert {(a, b) for a, b in expected if (a + b) % 2} <= got and all((a + b) % 2 for a, b in got)
