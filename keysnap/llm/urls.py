"""URL filters: longest matching rule, else a logistic regression on hashed character n-grams.

Everything runs in the JVM: host and path are cut out by SQL functions, n-grams of three and four
characters (host and path apart, with marks at their ends) are hashed to a fixed number of
features, and Spark's logistic regression is trained on a small labelled table of URLs. Scoring
is a projection of the page table; nothing is shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path, so no rule fits
unless it is for them, and the verdict is the model's for no features. A URL of any length is judged whole; of
rules that fit the longest wins, of equally long ones the first listed. Repeated rows are judged
alike; an empty table gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4)
FEATURES = 1 << 14


@dataclass(frozen=True)
class UrlRule:
    """``prefix`` is a host, then the beginning of a path; it fits subdomains of the host too."""

    verdict: str
    prefix: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, start = self.prefix.partition("/")
        at_host = (host == name) | F.endswith(host, F.lit("." + name))
        return at_host & F.startswith(path, F.lit("/" + start))


RULES = (
    UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"),
)

# The labelled URLs: invented sites of two words each. Paths are shared, so that hosts decide.
BLOCKED_WORDS = (
    "cheap", "pills", "casino", "bonus", "free", "money", "adult", "cams", "spam", "farm", "win", "prize", "bets", "slots",
    "ads", "track", "click", "viagra", "payday", "loans", "warez", "crack", "poker", "jackpot", "xxx", "hot", "singles",
)
ALLOWED_WORDS = (
    "nation", "other", "weather", "station", "river", "museum", "science", "library", "garden", "history", "thunder",
    "mountain", "northern", "times", "teaching", "math", "cooking", "writers", "another", "world", "edition", "tradition",
    "recipes", "travelling", "there", "shore", "walks", "erosion", "reading", "interaction", "painting", "orchard", "heritage",
    "treatment", "sound", "answers", "chess", "enterprise", "heron", "island", "lessons", "the", "then", "thin", "these",
)
STEPS = (1, 2, 5, 9)  # each word goes with those so many places behind it


def _sites(words: Sequence[str]) -> list[str]:
    return [f"{w}-{words[(i + s) % len(words)]}" if s % 2 else f"{w}{words[(i + s) % len(words)]}"
            for i, w in enumerate(words) for s in STEPS]


PARTS = ("", "www.", "blog.", "m.")
ENDS = ("example.com", "example.net", "example.org")
PATHS = ("/", "/en/12", "/fr/825.html", "/de/7/", "/es/431", "/en/9001")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label), 1 for a URL to block; sites, parts, ends and paths are dealt out in turn."""
    rows = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, site in enumerate(_sites(words)):
            for k, end in enumerate(ENDS):
                path = PATHS[(i + i // len(PATHS) + k) % len(PATHS)]
                rows.append((f"https://{PARTS[(i + k) % len(PARTS)]}{site}.{end}{path}", label))
    return rows


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty where there is no ``://``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(whole, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def grams(host: Column, path: Column) -> Column:
    """Overlapping n-grams: a group inside a lookahead is found at every place."""
    marked = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(F.lit("^"), F.lower(path), F.lit("$"))}
    found = [
        _tagged(kind, F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
        for kind, s in marked.items() for n in SIZES
    ]
    return F.concat(*found)


def _tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda g: F.concat(F.lit(kind), g))


def _features(df: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return hashing.transform(df.withColumn("grams", grams(F.col("host"), F.col("path"))))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]]) -> LogisticRegressionModel:
    """A regularised model of the labelled URLs; 1 means block."""
    values = ", ".join("('{}', {})".format(u.replace("\\", "\\\\").replace("'", "\\'"), y) for u, y in labelled)
    rows = spark.sql(f"select url, cast(label as double) as label from values {values} as t(url, label)")
    fit = LogisticRegression(maxIter=50, regParam=0.01, featuresCol="features", labelCol="label")
    return fit.fit(_features(with_parts(rows)).select("features", "label"))


def rule_for(rules: Sequence[UrlRule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.prefix)):
        test, result = rule.fits(host, path), F.lit(value(rule))
        out = F.when(test, result) if out is None else out.when(test, result)
    return F.lit(None).cast("string") if out is None else out


def judge_urls(
    pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[UrlRule] = RULES, page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: host, path, the rule if any, the verdict and the model's verdict."""
    parts = with_parts(pages.select(page_id, url), url)
    scored = model.transform(_features(parts))
    host, path = F.col("host"), F.col("path")
    learned = F.when(F.col("prediction") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        page_id, "host", "path",
        rule_for(rules, host, path, lambda r: r.prefix).alias("rule"),
        F.coalesce(rule_for(rules, host, path, lambda r: r.verdict), learned).alias("verdict"),
        learned.alias("learned"),
    )
