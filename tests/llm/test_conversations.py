"""Conversation repair against a plain dynamic program over whole audit strings."""

import os
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from keysnap.llm import conversations as conv
from keysnap.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def step(state, initial):
    """The pattern ``(s?(ua)+)?`` read character by character; None where it cannot go on."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def brute_audit(rows):
    """The least (cost, audit, messages) of (role, text, fault) rows, by whole strings from the right."""
    best = {q: (0, "", []) for q in ("", "a")}
    for i in range(len(rows), -1, -1):
        here = {}
        for q in ("", "s", "u", "a"):
            options = [best[q]] if i == len(rows) and q in best else []
            if i < len(rows):
                role, text, fault = rows[i]
                late = 3 * (fault == "truncated")
                if q in best:
                    c, a, m = best[q]
                    options.append((c + 4, "D" + a, m))
                if fault not in ("blank", "duplicate"):
                    for name, letter, cost in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                        to = step(q, name[:1])
                        if to and to in best:
                            c, a, m = best[to]
                            options.append((c + cost + late, letter + a, [f"{name}:{text}", *m]))
            if options:
                here[q] = min(options)
        for _ in range(3):  # inserted turns
            for q in ("", "s", "u", "a"):
                for name in ("user", "assistant"):
                    to = step(q, name[:1])
                    if to in here:
                        c, a, m = here[to]
                        new = (c + 3, "I" + a, [f"{name}:", *m])
                        here[q] = min(here.get(q, new), new)
        best = here
    return best[""]


def brute(rows):
    """The contract's columns of a conversation's (turn, role, text), in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, messages = brute_audit([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    sha = sha256("\n".join(messages).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def brute_damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (c, turn)]
        code = crc32(":".join(said).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[c]
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[c] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: brute(r) for c, r in out.items()}


def got(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = conv.repair_damaged(table(spark, SF, "conversations"))
    assert found.columns[:2] == ["conv_id", "gaps"] and found.columns[-2:] == ["audit", "repaired_sha256"]
    assert got(found) == brute_damaged(rows)


def random_rows(rng, n_convs, most):
    rows = []
    for c in range(n_convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "", " \t", None, "é.", "a. b", "x" * 50 + "."])
            rows.append((rng.choice([c, c, c, None]), rng.choice([t, t, t, t // 2, None, t * 3]), role, text))
    return rows


@pytest.mark.parametrize("segment,chars", [(4096, 10**6), (3, 10**6), (4096, 300)])
def test_nulls_ties_repeats_and_segments(spark, segment, chars):
    rng = random.Random(segment + chars)
    rows = random_rows(rng, 40, 30)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, " " if r is None else r, " " if x is None else x))
    found = got(conv.repair(frame.withColumn("part", frame.turn), segment=segment, chars=chars))
    assert found == {c: brute(r) for c, r in want.items()}


def test_one_long_conversation(spark):
    """Most rows in one conversation, many equal: it lies in many tasks and segments."""
    rng = random.Random(5)
    rows = [(7, t if t % 5 else None, rng.choice(["user", "assistant"]), rng.choice(["Go.", f"{t}.", f"{t}"])) for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in range(20)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    found = got(conv.repair(frame, segment=100))
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, r, x))
    assert found == {c: brute(r) for c, r in own.items()}


def test_messages_are_what_the_digest_covers(spark):
    frame = spark.createDataFrame(random_rows(random.Random(9), 30, 12), "conv_id long, turn long, role string, text string")
    said = defaultdict(list)
    for r in conv.repaired_messages(frame, segment=4).orderBy("place").collect():
        assert r["place"] == len(said[r["conv_id"]]) and (r["edit"] != "I" or r["text"] == "")
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, row in got(conv.repair(frame)).items():
        assert sha256("\n".join(said[c]).encode()).hexdigest() == row[-1]
        initials = "".join(m[0] for m in said[c])
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_runs_cross_by_powers():
    """A run's costs equal those of its rows one after the other, whatever its length."""
    for sym in "suaxSUAX-":
        for n in (1, 2, 3, 7, 64, 1000):
            after = conv.AT_END
            for _ in range(n):
                after = conv.before_row(sym, after)
            assert conv.before_run(sym, n, conv.AT_END) == after
            edits = conv.repair_symbols([sym] * n)
            assert len(edits) == n


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair(frame).count() == 0 and conv.repair_damaged(frame).count() == 0
