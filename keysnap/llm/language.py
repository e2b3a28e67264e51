"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Texts become lower-case letters and marks, any run of other characters one space. Grams of ``ORDER``
characters are counted over all labelled documents: packed into 64 bits, counted within each task and
summed by Spark. Shorter grams count the different characters that precede them, discounts come from
the counts of counts, and each order is interpolated with the next shorter one by joins on the grams.

A model is sorted arrays of gram hashes with a log probability for each language. Hashes have just as
many bits as keep all arrays within ``MODEL_BYTES`` (grams that collide share the mean probability), so
what is broadcast has a bound that no corpus exceeds. A document gets the language with the lowest
cross-entropy for each character. Scores and rejection are calibrated on a fold of the labelled
documents, judged by a second model that has not counted them.

Defined results: null texts and those without a letter are ``und`` with score 0, as is everything if
nothing is labelled; a row without language is not learned from; equal cross-entropies go to the first
language in order; repeated rows count as often as they occur; long texts stream through in pieces of
``PIECE`` characters. Characters beyond the basic plane are folded onto it. Only the named columns are used.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import stored, unused

ORDER = 4
MODEL_BYTES = 256_000_000
MAX_LANGUAGES = 4096
# One in so many labelled documents calibrates.
FOLDS = 32
# Rejected: less likely right than this, or a cross-entropy so far above the language's own that less
# than a thousandth of the calibration's texts lies there, by this factor.
MIN_SCORE, SHARE, SLACK = 0.5, 0.999, 1.5
PIECE = 1 << 20
SPACE = 32
_FLUSH = 1 << 21
_MASK = [0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each character of the basic plane: 2 a letter, 1 a mark, 0 neither."""
    return np.array(
        [2 if chr(c).isalpha() else unicodedata.category(chr(c))[0] == "M" for c in range(1 << 16)], np.uint8
    )


def _kind(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds()[codes & 0xFFFF]
    for at in np.flatnonzero(codes > 0xFFFF):
        c = chr(codes[at])
        kinds[at] = 2 if c.isalpha() else unicodedata.category(c)[0] == "M"
    return kinds


def streams(text: str | None) -> Iterator[np.ndarray]:
    """The text's characters as arrays; each begins with the ``ORDER - 1`` characters before it."""
    if not text:
        return
    before, lettered, held = np.full(ORDER - 1, SPACE, np.uint64), False, []
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kind(raw)
        lettered |= bool((kinds == 2).any())
        codes = np.where(kinds > 0, raw & 0xFFFF, SPACE).astype(np.uint64)
        space = codes == SPACE
        codes = codes[~(space & np.concatenate(([before[-1] == SPACE], space[:-1])))]
        if len(codes):
            piece = np.concatenate((before, codes))
            before = piece[len(piece) - ORDER + 1 :]
            held.append(piece)
        # Until a letter is seen pieces are short: runs of other characters are one space.
        if lettered:
            yield from held
            held = []
    if lettered and before[-1] != SPACE:
        yield np.concatenate((before, np.array([SPACE], np.uint64)))


def grams(codes: np.ndarray) -> np.ndarray:
    """The packed grams that end at each character but the first ``ORDER - 1``."""
    n = len(codes) - ORDER + 1
    out = codes[:n].copy()
    for i in range(1, ORDER):
        out <<= np.uint64(16)
        out |= codes[i : i + n]
    return out


def hashes(keys: np.ndarray, bits: int) -> np.ndarray:
    h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(64 - bits)).astype(np.uint32)


# Counting


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def count_grams(documents: DataFrame, text: str, lang: str, fold: Column) -> DataFrame:
    """(lang, gram, n, n_fit) over all rows with a language; ``n_fit`` leaves out rows where ``fold``."""
    source = documents.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
        F.coalesce(fold, F.lit(False)).alias("fold"),
    ).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], tuple[list, list]] = {}
        fresh: dict[tuple[str, bool], list] = {}
        n_fresh = n_held = 0

        def settle():
            nonlocal n_fresh, n_held
            for group, keys in fresh.items():
                some, times = np.unique(np.concatenate(keys), return_counts=True)
                have = held.get(group, ([], []))
                held[group] = tuple([a] for a in _summed([*have[0], some], [*have[1], times]))
            fresh.clear()
            n_fresh, n_held = 0, sum(len(k[0]) for k, _ in held.values())

        def told():
            nonlocal n_held
            for (name, out), (keys, counts) in held.items():
                n = len(keys[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(keys[0].view(np.int64)), pa.array(counts[0]),
                     pa.array(np.zeros(n, np.int64) if out else counts[0])],
                    names=["lang", "gram", "n", "n_fit"],
                )
            held.clear()
            n_held = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for name, t, out in zip(part["lang"], part["text"], part["fold"]):
                    for codes in streams(t):
                        fresh.setdefault((name, out), []).append(grams(codes))
                        n_fresh += len(codes)
                        if n_fresh > _FLUSH:
                            settle()
                        if n_held > _FLUSH:
                            yield from told()
        settle()
        yield from told()

    counted = source.mapInArrow(run, "lang string, gram long, n long, n_fit long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_fit").alias("n_fit"))


def estimate(counts: DataFrame) -> DataFrame:
    """(k, lang, gram, n, p, prefix, bow) for each gram of each order k.

    ``p`` is the interpolated probability of the last character after the ones before it, which are
    ``prefix``; ``bow`` is the weight that the prefix leaves to shorter grams.
    """
    own = Window.partitionBy("lang", "prefix")
    tables = {ORDER: counts.select("lang", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit(_MASK[k]))
        tables[k] = stored(tables[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}")
    alphabet = tables[1].select(F.count_distinct("gram").alias("chars"))
    out, lower = None, None
    for k in range(1, ORDER + 1):
        share = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
        of_counts = (
            tables[k].groupBy("lang")
            .agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
            .select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(share, F.lit(0.5)))).alias("d"))
        )
        # One row for each language, of which there are at most MAX_LANGUAGES.
        t = tables[k].join(F.broadcast(of_counts), "lang").withColumn("prefix", F.shiftrightunsigned("gram", 16))
        t = t.withColumns({"total": F.sum("n").over(own), "types": F.count("*").over(own)})
        t = t.withColumn("bow", F.col("d") * F.col("types") / F.col("total"))
        if lower is None:
            t = t.crossJoin(F.broadcast(alphabet)).withColumn("low", 1 / (F.col("chars") + 1))  # one row
        else:
            short = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            t = t.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_MASK[k - 1]))).join(short, ["lang", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("bow") * F.col("low")
        t = t.select(F.lit(k).alias("k"), "lang", "gram", "n", p.alias("p"), "prefix", "bow")
        lower = stored(t, f"estimates-{k}")
        out = lower if out is None else out.unionByName(lower)
    return out


# The model


@dataclass
class Table:
    """Sorted hashes and, for each, a value in every language."""

    ids: np.ndarray
    values: np.ndarray
    bits: int

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "values": self.values, "bits": self.bits}  # tasks make their own index

    @cached_property
    def starts(self) -> np.ndarray:
        """Where each hash begins among the sorted ones: a search is one look."""
        return np.searchsorted(self.ids, np.arange((1 << self.bits) + 1)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = hashes(keys, self.bits)
        place = self.starts.take(ids)
        return place, self.starts.take(ids + np.uint32(1)) != place


@dataclass
class Model:
    """``grams[k]`` holds, for each gram of order k that any language knows, its log probability in
    every language; ``prefixes[k]`` the log weights that prefixes leave to shorter grams."""

    langs: list[str]
    unseen: np.ndarray
    grams: dict[int, Table] = field(default_factory=dict)
    prefixes: dict[int, Table] = field(default_factory=dict)
    calibration: tuple[float, float] = (0.0, 1.0)
    usual: dict[str, tuple[float, float]] = field(default_factory=dict)

    def backed_off(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of grams of order k by their prefixes' weights and the next shorter grams."""
        if k == 1:
            return np.broadcast_to(self.unseen, (len(keys), len(self.langs)))
        low = self.log_p(k - 1, keys & np.uint64(_MASK[k - 1]))
        place, found = self.prefixes[k].find(keys >> np.uint64(16))
        return low + np.where(found[:, None], self.prefixes[k].values.take(place, axis=0, mode="clip"), 0)

    def log_p(self, k: int, keys: np.ndarray) -> np.ndarray:
        """For each gram (row) and language (column) the log probability of its last character."""
        place, found = self.grams[k].find(keys)
        out = self.grams[k].values.take(place, axis=0, mode="clip")
        if not found.all():
            out[~found] = self.backed_off(k, keys[~found])
        return out


def hash_bits(n_langs: int, model_bytes: int = MODEL_BYTES) -> int:
    """So many bits that ``2 * ORDER`` full tables fit: index, hashes and a value for each language."""
    return max(8, min(22, int(math.log2(model_bytes / (2 * ORDER * 4 * (2 + n_langs))))))


@F.pandas_udf(T.LongType())
def _hashed(keys: pd.Series, bits: pd.Series) -> pd.Series:
    if not len(keys):
        return pd.Series([], dtype="int64")
    return pd.Series(hashes(keys.to_numpy().astype(np.int64).view(np.uint64), int(bits.iloc[0])).astype(np.int64))


def build(estimates: DataFrame, langs: list[str], bits: int) -> pa.Table:
    """Hashes the estimates and collects them: ``2 ** bits`` rows at most for each order, language and
    kind (gram or prefix)."""
    own = estimates.select(F.lit(True).alias("whole"), "k", "lang", "gram", "n", F.col("p").alias("v"))
    prefixes = estimates.groupBy("k", "lang", F.col("prefix").alias("gram")).agg(F.sum("n").alias("n"), F.first("bow").alias("v"))
    both = own.unionByName(prefixes.select(F.lit(False).alias("whole"), "k", "lang", "gram", "n", "v"))
    return (
        both.withColumn("id", _hashed("gram", F.lit(bits))).groupBy("whole", "k", "lang", "id")
        .agg(
            F.log(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"),
            F.max_by("gram", F.struct("n", "gram")).alias("gram"), F.sum("n").alias("n"),
        ).toArrow()
    )


def model_of(rows: pa.Table, langs: list[str], bits: int) -> Model:
    """The arrays of a model, from the rows that ``build`` has collected."""
    frame = rows.to_pandas()
    frame = frame[frame["lang"].isin(langs)]
    code = {name: i for i, name in enumerate(langs)}
    # After that order the most frequent of several grams with one hash comes last and stays.
    frame = frame.assign(at=frame["lang"].map(code)).sort_values(["n", "gram"])
    parts = {key: part for key, part in frame.groupby(["whole", "k"])}

    def laid_out(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, place = np.unique(part["id"].to_numpy().astype(np.uint32), return_inverse=True)
        values = np.full((len(ids), len(langs)), np.nan, np.float32)
        values[place, part["at"].to_numpy()] = part["v"].to_numpy()
        keys = np.zeros(len(ids), np.uint64)
        keys[place] = part["gram"].to_numpy().astype(np.int64).view(np.uint64)
        return ids, keys, values

    n_chars = len(laid_out(parts[True, 1])[0])
    unseen = laid_out(parts[False, 1])[2][0] - math.log(n_chars + 1)
    model = Model(langs, unseen)
    for k in range(1, ORDER + 1):
        if k > 1:
            ids, _, weights = laid_out(parts[False, k])
            model.prefixes[k] = Table(ids, np.nan_to_num(weights, nan=0.0), bits)
        ids, keys, values = laid_out(parts[True, k])
        values = np.where(np.isnan(values), model.backed_off(k, keys), values).astype(np.float32)
        model.grams[k] = Table(ids, values, bits)
    return model


# Judging


SCORED = T.StructType([
    T.StructField("best", T.IntegerType()), T.StructField("chars", T.LongType()),
    T.StructField("entropy", T.DoubleType()), T.StructField("margin", T.DoubleType()),
])


def score_texts(documents: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, for each row, the best language's index (null: no letter), the number
    of characters, its cross-entropy and how far the next language's lies above it."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("scored_text_"))
    schema = T.StructType([source.schema[c] for c in keep] + SCORED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        known, arrow = shared.value, to_arrow_schema(SCORED)
        n_langs = len(known.langs)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                total, chars = np.zeros((part.num_rows, n_langs)), np.zeros(part.num_rows, np.int64)
                keys, owners, size = [], [], 0

                def settle():
                    if keys:
                        starts = np.cumsum([0, *map(len, keys)])[:-1]
                        found = known.log_p(ORDER, np.concatenate(keys)).astype(np.float64)
                        np.add.at(total, owners, np.add.reduceat(found, starts, axis=0))

                for i, t in enumerate(part.column(part.num_columns - 1)):
                    for codes in streams(t.as_py()) if n_langs else ():
                        keys.append(grams(codes))
                        owners.append(i)
                        size += len(keys[-1])
                        chars[i] += len(keys[-1])
                        if size > PIECE:
                            settle()
                            keys, owners, size = [], [], 0
                settle()
                entropy = -total / np.maximum(chars, 1)[:, None]
                some = chars > 0
                best = entropy.argmin(axis=1) if n_langs else np.zeros(part.num_rows, int)
                low = np.sort(entropy, axis=1)
                margin = low[:, 1] - low[:, 0] if n_langs > 1 else np.full(part.num_rows, math.inf)
                own = [best, chars, low[:, 0] if n_langs else margin, margin]
                arrays = list(part.columns[:-1])
                arrays += [pa.array(v, f.type, mask=~some if f.name != "chars" else None) for v, f in zip(own, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *SCORED.names])

    return source.mapInArrow(run, schema)


def evidence() -> Column:
    """The log of the likelihood ratio between the best and the next language."""
    return F.log1p(F.least(F.col("margin") * F.col("chars"), F.lit(1e12)))


def _deviation(mean: Column) -> Column:
    return (F.col("entropy") - mean) * F.sqrt("chars")


def calibrate(model: Model, scored: DataFrame) -> None:
    """Fits the score and the languages' usual cross-entropies to rows with ``right`` (true or false)."""
    bins = scored.where("best is not null").groupBy(F.round(evidence() * 4).alias("x")).agg(
        F.count("*").alias("n"), F.count_if("right").alias("right")
    )
    counts = [(r["x"] / 4, r["n"], r["right"]) for r in bins.collect()]  # evidence is below 28: few bins
    a, b = 0.0, 1.0
    for _ in range(50 if counts else 0):  # Newton's method, held near (0, 1) by a weak prior
        ga, gb, haa, hab, hbb = -0.1 * a, -0.1 * (b - 1), 0.1, 0.0, 0.1
        for x, n, right in counts:
            p = 1 / (1 + math.exp(-max(-500, min(500, a + b * x))))
            ga, gb, w = ga + right - n * p, gb + (right - n * p) * x, n * p * (1 - p)
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        step = ((hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det)
        a, b = a + max(-1, min(1, step[0])), b + max(-1, min(1, step[1]))
    model.calibration = (a, b)
    right = scored.where("best is not null and right")
    means = right.groupBy("best").agg(F.avg("entropy").alias("mean"))
    spread = right.join(F.broadcast(means), "best").groupBy("best").agg(  # a row for each language
        F.first("mean").alias("mean"), F.percentile_approx(_deviation(F.col("mean")), F.lit(SHARE)).alias("top")
    )
    model.usual = {model.langs[r["best"]]: (r["mean"], r["top"]) for r in spread.collect()}


def train(
    documents: DataFrame, fold: Column, text: str = "text", lang: str = "lang", model_bytes: int = MODEL_BYTES
) -> Model:
    """A calibrated model of all rows with a language; rows where ``fold`` is true calibrate it."""
    counts = stored(count_grams(documents, text, lang, fold), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return Model([], np.empty(0, np.float32))
    bits = hash_bits(len(langs), model_bytes)
    # Both models are estimated in one go, as if they were of different languages.
    both = F.explode(F.array(F.struct(F.lit("=").alias("of"), "n"), F.struct(F.lit("-").alias("of"), F.col("n_fit").alias("n"))))
    counts = counts.select("lang", "gram", both.alias("c")).select(F.concat("c.of", "lang").alias("lang"), "gram", "c.n").where("n > 0")
    rows = build(estimate(counts), langs, bits)
    model = model_of(rows, [f"={name}" for name in langs], bits)
    model.langs = langs
    fit = sorted(n for n in set(rows["lang"].to_pylist()) if n[0] == "-")
    if fit:
        apart = model_of(rows, fit, bits)
        kept = documents.where(F.coalesce(fold, F.lit(False))).select(
            F.concat(F.lit("-"), F.col(f"`{lang}`").cast("string")).alias("lang"), F.col(f"`{text}`").alias("text")
        ).where("lang is not null")
        scored = stored(score_texts(kept, apart, "text", ["lang"]), "calibration")
        guess = F.get(F.array(*[F.lit(n) for n in fit]), F.col("best"))
        place = F.array_position(F.array(*[F.lit(f"-{n}") for n in langs]), guess) - 1
        calibrate(model, scored.withColumn("right", guess == F.col("lang")).withColumn("best", place.cast("int")))
    return model


def predict(
    documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all), lang_pred, score (the probability that it is right), cross_entropy
    and rejected (too unsure, or unlike all that the language's texts are); with an underscore where
    a kept column has such a name."""
    keep = documents.columns if keep is None else keep
    named = lambda name: unused(documents.select(*[F.col(f"`{c}`") for c in keep]), name)
    own = [f"c{i}" for i in range(len(keep))]
    renamed = documents.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.col(f"`{text}`").alias("judged"))
    scored = score_texts(renamed, model, "judged", own)
    names = F.array(*[F.lit(n) for n in model.langs]) if model.langs else F.array().cast("array<string>")
    a, b = model.calibration
    score = F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * evidence()))))
    odd = F.lit(False)
    for i, name in enumerate(model.langs):
        if name in model.usual:
            mean, top = model.usual[name]
            odd = F.when(F.col("best") == i, _deviation(F.lit(mean)) > SLACK * max(top, 0.0)).otherwise(odd)
    return scored.select(
        *[F.col(o).alias(c) for o, c in zip(own, keep)],
        F.coalesce(F.get(names, F.col("best")), F.lit("und")).alias(named("lang_pred")),
        score.alias(named("score")), F.col("entropy").alias(named("cross_entropy")),
        (F.col("best").isNull() | (score < MIN_SCORE) | odd).alias(named("rejected")),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning, by a checksum of its id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predictions for all documents, learned from those that are not held out. A document without
    id is neither held out nor learned from."""
    fold = F.floor(F.crc32(F.col(doc_id).cast("string").cast("binary")) / 3) % FOLDS == 0
    model = train(documents.where(~held_out(doc_id)), fold, text, lang)
    return predict(documents, model, text, [doc_id]).select(
        doc_id, F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )
