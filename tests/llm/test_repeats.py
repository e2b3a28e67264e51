"""Repeat removal against a table of all windows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from keysnap.llm import queries as Q
from keysnap.llm import suffixes as S

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def brute(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        edges = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                edges[i] += 1
                edges[i + length] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def noisy_copies(seed, n, alphabet):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randrange(20, 200))) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(base) for _ in range(rng.randrange(1, 4)))
        cut = [rng.randrange(len(t)) for _ in range(rng.randrange(0, 4))]
        texts.append("".join(rng.choice(alphabet) if i in cut else c for i, c in enumerate(t)))
    return [*texts, "", None, "short", "ab" * 60, "a" * 90, base[0], base[0]]


@pytest.mark.parametrize("alphabet,most", [("abcdé", 20_000), ("ab", 20_000), ("abcdefgh ", 1), ("ab", 3)])
def test_small_texts(spark, alphabet, most):
    texts = noisy_copies(len(alphabet) + most, 60, alphabet)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, places long")
    got = S.remove_repeats(docs.repartition(5), length=24, gram=7, most=most).collect()
    want = brute(texts, 24)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == [
        (i, *w) for i, w in enumerate(want)
    ]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in Q.table(spark, SF, "documents").collect()}
    want = {
        i: (i, n, gone, spans, hashlib.sha256(kept).hexdigest())
        for i, (n, gone, spans, kept) in zip(docs, brute(docs.values(), 200))
    }
    got = Q.QUERIES["op5_repeats"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r["n_removed"] for r in got) > 0


def test_a_very_long_text(spark):
    """Repeats that lie across the seam of two chunks, within a text and between texts."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    once, twice = some(450), some(260)
    head = some(S._CHUNK - 200)
    long = head + once + some(3000) + twice + some(S._CHUNK - 5000) + twice + some(900)
    texts = [long, some(300) + once + some(10), some(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in S.remove_repeats(docs).collect()}
    want = dict(enumerate(brute(texts, 200)))
    assert got == want and want[0][1] >= 450 + 2 * 260 and want[0][2] == 3


def test_repeated_rows_and_no_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=500))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "z" + text[:300])], "doc_id long, text string")
    got = sorted(tuple(r)[1:3] for r in S.remove_repeats(docs, digest=True).collect())
    assert got == [(301, 300), (500, 500), (500, 500)]
    assert S.remove_repeats(docs.limit(0), digest=True).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(2)
    data = bytes(rng.choices(b"ab", k=3000))
    anchor, first, last = S.anchors(data, 50, 9)
    assert first[0] == 0 and last[-1] == 2950 and (first[1:] == last[:-1] + 1).all()
    for a, s, e in zip(anchor[::7], first[::7], last[::7]):
        for i in (s, e):
            alone = S.anchors(data[i : i + 50], 50, 9)[0]
            assert alone.tolist() == [a - i]


def test_merge_of_front_coded_runs():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 20):
        lists = [sorted({bytes(rng.choices(b"abc", k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 40))}) for _ in range(n)]
        runs = []
        for k, keys in enumerate(lists):
            shared, sizes, tails = S.front_code(keys)
            runs.append(S.Run(shared, sizes, tails, np.ones(len(keys), np.uint32), np.full(len(keys), k), np.arange(len(keys))))
        out = list(S.merge(runs))
        keys = [k for k, _, _ in out]
        assert keys == sorted(k for some in lists for k in some)
        for a, b, (_, shared, _) in zip(keys, keys[1:], out[1:]):
            assert shared == len(os.path.commonprefix([a, b]))
