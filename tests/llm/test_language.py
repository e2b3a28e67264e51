"""Language models against a plain Kneser-Ney version, held-out accuracy, and edge cases."""

import math
import os
import re
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysnap.llm import language
from keysnap.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TEXTS = {
    "de": ["Der Hund und die Katze schlafen.", "Über den Fluss führt eine Brücke!", "Die Äpfel sind grün, die Birnen gelb."],
    "en": ["The dog and the cat sleep.", "A bridge leads over the river!", "The apples are green; the pears are yellow.", "Water"],
    "fr": ["Le chien et le chat dorment.", "Un pont mène de l'autre côté.", "Les pommes sont vertes, les poires jaunes."],
}


def plain(text):
    """The padded characters of a text, by a pattern over the whole string."""
    kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower())
    return "   " + re.sub(" +", " ", kept).strip(" ") + " "


class Plain:
    """Kneser-Ney by dictionaries of strings, straight from the formulas."""

    def __init__(self, texts, n_chars):
        self.n_chars = n_chars
        self.counts = {4: Counter(p[i - 3 : i + 1] for p in map(plain, texts) for i in range(3, len(p)))}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.after = {}, {}
        for k, c in self.counts.items():
            n1, n2 = (sum(v == n for v in c.values()) for n in (1, 2))
            self.d[k] = max(0.1, min(0.9, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
            self.after[k] = defaultdict(list)
            for g, n in c.items():
                self.after[k][g[:-1]].append(n)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.n_chars + 1)
        low, seen = self.p(gram[1:]), self.after[k].get(gram[:-1])
        if not seen:
            return low
        return (max(self.counts[k][gram] - self.d[k], 0) + self.d[k] * len(seen) * low) / sum(seen)

    def entropy(self, text):
        p = plain(text)
        return -sum(math.log(self.p(p[i - 3 : i + 1])) for i in range(3, len(p))) / (len(p) - 3)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, t, n) for i, (n, t) in enumerate((n, t) for n, ts in TEXTS.items() for t in ts)]
    rows += [(90, None, "en"), (91, "unbekannt", None), (92, "123 !", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_equals_plain_kneser_ney(spark, labelled):
    model = language.train(labelled, F.lit(False))
    assert model.langs == ["de", "en", "fr"] and model.calibration == (0.0, 1.0)
    everything = {c for ts in TEXTS.values() for t in ts for c in plain(t)}
    by_hand = {n: Plain(ts, len(everything)) for n, ts in TEXTS.items()}
    texts = ["The river is green", "Die Brücke führt", "côté vert", "z", "ЖЖ Ж", "a  b--c", "Katze et chat", "Ünder the Côté" * 40]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.score_texts(frame, model, "text", ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = {n: m.entropy(t) for n, m in by_hand.items()}
        low = sorted(want.values())
        assert rows[i]["chars"] == len(plain(t)) - 3
        assert math.isclose(rows[i]["entropy"], low[0], rel_tol=1e-4)
        assert math.isclose(rows[i]["margin"], low[1] - low[0], rel_tol=1e-3, abs_tol=1e-4)
        if low[1] - low[0] > 1e-4:
            assert model.langs[rows[i]["best"]] == min(want, key=want.get)


def test_probabilities_sum_to_one(labelled):
    """Over all known characters and one unknown, after seen and unseen prefixes alike."""
    model = language.train(labelled, F.lit(False))
    chars = [ord(c) for c in sorted({c for ts in TEXTS.values() for t in ts for c in plain(t)})] + [0x0436]
    for prefix in ("the", "   ", "üzq", "ch "):
        head = [ord(c) for c in prefix]
        keys = np.concatenate([language.grams(np.array([*head, c], np.uint64)) for c in chars])
        assert np.allclose(np.exp(model.log_p(4, keys)).sum(axis=0), 1, atol=1e-4)


def test_held_out_accuracy_and_rejection(spark):
    docs = table(spark, SF, "documents")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    apart = [r for r in rows if found[r["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in apart} == {r["doc_id"] for r in rows if crc32(str(r["doc_id"]).encode()) % 3 == 1}
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in apart]
    assert sum(right) >= 0.99 * len(right)
    assert all(0 <= f["score"] <= 1 for f in found.values())
    model = language.train(docs, F.col("doc_id") % 32 == 0)
    odd = [(0, "Ковшом зачерпнули холодной воды из глубокого старого колодца на краю села."), (1, rows[1]["text"])]
    judged = language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model)
    assert {r["doc_id"]: r["rejected"] for r in judged.collect()} == {0: True, 1: False}


def test_edge_cases(spark, labelled):
    model = language.train(labelled, F.lit(False))
    texts = [None, "", " \n", "12 34 -- !", "the the", "the the", "𝒜𝒷𝒸", "é", "the cat and " * 200_000, "1" * 3_000_000 + "the dog"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS lang_pred", "1 AS best", "2 AS chars")
    rows = {r["doc_id"]: r for r in language.predict(frame, model, keep=["doc_id"]).collect()}
    for i in range(4):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert rows[4][1:] == rows[5][1:] and rows[4]["lang_pred"] == "en"
    assert rows[8]["lang_pred"] == "en" and rows[9]["lang_pred"] == "en"
    assert rows[6]["lang_pred"] in model.langs
    assert language.predict(frame, model).columns[-4:] == ["lang_pred_", "score", "cross_entropy", "rejected"]
    nothing = language.train(labelled.where("lang is null"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(frame.drop("lang_pred"), nothing).collect()} == {"und"}
    assert language.predict(frame.limit(0).drop("lang_pred"), model).count() == 0
    assert language.identify(labelled.limit(0)).count() == 0


def test_pieces_do_not_matter(monkeypatch):
    text = "  Ab,c 12 dé́f!! " * 9
    whole = np.concatenate([language.grams(c) for c in language.streams(text)])
    for size in (1, 2, 5, 16):
        monkeypatch.setattr(language, "PIECE", size)
        assert (np.concatenate([language.grams(c) for c in language.streams(text)]) == whole).all()


def test_broadcast_has_a_bound():
    for n in (1, 4, 200, 4096):
        bits = language.hash_bits(n)
        assert bits == 8 or 2 * language.ORDER * 4 * (2 + n) << bits <= language.MODEL_BYTES
