"""Ranked search against a brute-force scoring of all documents, and its SQL."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from keysnap.llm import lexical
from keysnap.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """All (item, rank, doc, score), straight from the formula."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    found = got(lexical.search(docs, items))
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r)[:2] for r in items.select("item_id", "text").collect()])
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(db.execute(lexical.oracle_sql()).fetchall(), key=str) == found


@pytest.mark.parametrize("block,block_terms", [(1 << 20, 1 << 21), (50, 1 << 21), (300, 20)])
def test_ties_repeats_nulls_and_blocks(spark, block, block_terms):
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "été", "ß", "x1y", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(5, docs[5][1])] * 3 + [(None, docs[5][1]), (2000, None), (2001, ""), (2002, ".,-")]
    docs += [(2003, "w1 " * 30_000 + "W2;w3 w4")]
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for i in range(25)]
    items += [(3, "W7 w8"), (None, "w9"), (50, None), (51, ""), (52, "nowhere"), (53, docs[5][1])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    assert got(lexical.search(frame, asked, block=block, block_terms=block_terms)) == brute(docs, items)


def test_best_first_leaves_ranges_unopened():
    """A rare term's documents are found without opening the whole grid."""
    n = 1 << 16
    columns = np.concatenate([np.arange(n), [5000, 9000]])
    rows = np.concatenate([np.zeros(n, np.int64), [16, 16]])
    tree = lexical.Treap(rows, columns, np.concatenate([np.full(n, 10), [500, 900]]))
    best = lexical.Best.none(2)
    opened = lexical.search_block(tree, np.arange(n), np.array([0, 16]), np.array([1, 100]), best)
    assert best.docs.tolist() == [9000, 5000] and best.scores.tolist() == [90010, 50010]
    assert opened < 100  # of 1,024 at the ground alone


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(lexical.search(docs.limit(0), items)) == []
    assert got(lexical.search(docs, items.limit(0))) == []
    assert got(lexical.search(docs, items)) == brute([(1, "a b")], [(1, "a")])
