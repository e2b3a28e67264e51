"""Quality rules: decision lists learned by sequential covering, as ordered Spark conditions.

Every whole text is reduced to statistics once. A list is learned from labelled rows: each rule
is a conjunction of thresholds, grown on two thirds of the rows by information gain, pruned on
the rest, and kept only if it is nearly always right there; the rows it covers are set aside and
the next rule is grown. The list becomes ``when(...).when(...).otherwise(...)``, evaluated in the
JVM. Rules reject; what no rule covers is kept.

Learning reads at most ``max_labels`` labelled rows, chosen by a hash of the id: a documented
bound, so the driver holds a small matrix whatever the size of the corpus.

Defined results: a null text counts as one without words; so does an empty one (all statistics
zero, base failed). Labels that are null or whose document is missing are ignored; several labels
of one document all count; without labels the list is empty. Repeated rows are judged alike; an empty table
gives no rows. Statistics are those of the whole text, however long. Of thresholds that gain the same the first
in the order of the statistics is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import map_text, stored

WINDOW = 5
MAX_LABELS = 20_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_punct", "n_top_word", "n_chars_all",
)
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8")
    words = data.split()  # bytes: exactly the ASCII spaces
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen = Counter(words)
    code = np.frombuffer(data, np.uint8)
    upper = int(np.count_nonzero((code >= 65) & (code <= 90)))
    digits = int(np.count_nonzero((code >= 48) & (code <= 57)))
    punct = sum(map(text.count, "!?.,;:"))
    return (
        n, chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines),
        len(seen), upper, digits, punct, max(seen.values(), default=0), len(text),
    )


def _repeated(words: list[bytes]) -> int:
    """Words in windows of five words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)][WINDOW - 1 :]
    grams = [line[s:e] for s, e in zip(starts, ends)]
    if len(set(grams)) == n:
        return 0
    times = Counter(grams)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.fromiter((i for i, g in enumerate(grams) if times[g] > 1), np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def with_stats(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, rows: int | None = None
) -> DataFrame:
    return map_text(df, text, STATS, lambda: lambda t: text_stats(t), df.columns if keep is None else keep, rows)


def drop_rejected(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters
) -> DataFrame:
    """The documents that the base rules and a list learned from ``labels`` keep, whatever their
    columns are called."""
    own = [f"c{i}" for i in range(len(documents.columns))]
    place = dict(zip(documents.columns, own))
    stats = stored(with_stats(documents.toDF(*own), place[text], rows=256), "stats")
    rules = fit_rules(stats.drop(place[text]), labels, place[doc_id], **parameters)
    return judged(stats, rules).where("kept").select(own).toDF(*documents.columns)


def base_failed(stats: Sequence[str] = ("n_words", "n_repeat_words")) -> Column:
    words, repeats = map(F.col, stats)
    return (words < 10) | (100 * repeats > 20 * words)


def features() -> dict[str, Column]:
    """What rules may ask about: shares and means, so that length alone decides little."""
    c = F.col
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "word_length": c("word_chars") / words,
        "symbol_share": c("n_symbols") / words,
        "dup_line_share": c("n_dup_lines") / lines,
        "repeat_share": c("n_repeat_words") / words,
        "distinct_share": c("n_distinct_words") / words,
        "upper_share": c("n_upper") / chars,
        "digit_share": c("n_digits") / chars,
        "punct_share": c("n_punct") / words,
        "top_word_share": c("n_top_word") / words,
        "words_per_line": c("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, or <= threshold
    threshold: float


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    right: float  # share of the pruning rows covered that it gets right


def _covered(x: np.ndarray, names: list[str], conditions: Sequence[Condition]) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        mask &= v > c.threshold if c.above else v <= c.threshold
    return mask


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the highest information gain for the rows still covered."""
    p0, n0 = y.sum(), len(y) - y.sum()
    best, found = 0.0, None
    if not p0 or not n0:
        return best, found
    was = np.log2(p0 / (p0 + n0))
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, below = x[order, j], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])  # between different values only
        if not len(cuts):
            continue
        size = cuts + 1.0
        for above in (False, True):
            p = p0 - below[cuts] if above else below[cuts]
            total = len(y) - size if above else size
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - was), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-12:
                best = float(gain[k])
                found = Condition(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best, found


def learn_rules(
    x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 4,
    precision: float = 0.97, least: int = 3,
) -> list[Rule]:
    """Rules for ``y == 1``; rows are split by position, so the result is repeatable."""
    rules: list[Rule] = []
    x, y = np.asarray(x, float), np.asarray(y, int)
    while len(rules) < max_rules and y.sum() >= least:
        prune = np.arange(len(y)) % 3 == 2
        gx, gy, px, py = x[~prune], y[~prune], x[prune], y[prune]
        conditions: list[Condition] = []
        mask = np.ones(len(gy), bool)
        while len(conditions) < max_conditions:
            _, c = _best_condition(gx[mask], gy[mask], names)
            if c is None:
                break
            conditions.append(c)
            mask &= _covered(gx, names, [c])
        if not conditions:
            break

        def worth(cs):
            m = _covered(px, names, cs)
            p, n = py[m].sum(), m.sum() - py[m].sum()
            return ((p - n) / (p + n) if p + n else -1.0), p / max(p + n, 1)

        # Shorter beginnings of the conjunction; the shortest of equals is the simplest.
        choices = [tuple(conditions[:k]) for k in range(1, len(conditions) + 1)]
        pick = max(choices, key=lambda cs: (worth(cs)[0], -len(cs)))
        right = float(worth(pick)[1])
        whole = _covered(x, names, pick)
        if right < precision or y[whole].mean() < precision or y[whole].sum() < least:
            break
        rules.append(Rule(pick, right))
        x, y = x[~whole], y[~whole]
    return rules


def as_condition(rules: Sequence[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, else null."""
    known = features()
    out = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule.conditions:
            v, t = known[c.feature], F.lit(c.threshold)
            test = test & ((v > t) if c.above else (v <= t))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def fit_rules(
    stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
    max_labels: int = MAX_LABELS, label_id: str = "doc_id",
) -> list[Rule]:
    """Learns from labelled statistics; documents that fail the base rules teach nothing."""
    sample = (
        labels.where(F.col(label_id).isNotNull() & F.col(quality).isNotNull())
        .select(F.col(label_id).alias("id"), F.col(quality).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(max_labels)
    )
    known = features()
    rows = (
        stats.where(~base_failed()).join(F.broadcast(sample), F.col(doc_id) == F.col("id"))
        .select("id", "label", *[v.alias(k) for k, v in known.items()])
        .orderBy(F.xxhash64("id"), *["id", "label", *known]).limit(max_labels).toPandas()
    )
    if rows.empty:
        return []
    names = list(known)
    return learn_rules(rows[names].to_numpy(), (rows["label"] == 0).to_numpy(), names)


def judged(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (null: none holds) and ``kept``."""
    return (
        stats.withColumn("base_failed", base_failed()).withColumn("rule", as_condition(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
