"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: A-Z lower-cased, copyright lines taken out, equivalent
spellings made one, everything but letters and digits turned into single spaces. The SHA-256 of
the form is joined to the digests of known licences, which get theirs by the same expressions.
Looked up are the entire text and each of its lines, so both a licence as a document and a notice
inside one are found; a digest equals only when all of the text or line does.

All of it is SQL functions. The known texts are a fixed list of a few dozen, so their side of the
hash join is broadcast. Lines are summed up for each row before the one shuffle.

Defined results: a null or empty text, or one without letters and digits, matches nothing (its
digest is that of the empty form). Repeated rows give repeated results, an empty
table none. Texts of any length are hashed whole. Texts that the canonical form
makes equal are one licence if their names agree; the smallest name wins otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.llm.license_texts import LICENCES, NOTICES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line that names a holder or a year; "copyright notice" at the start of a wrapped line is text.
COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|:|by |[0-9]{4})|\(c\)[ \t]*(copyright|[0-9]{4})|©)[^\n]*"
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("all rights reserved", " "), (" & ", " and "), ("http://", "https://"),
    ("favour", "favor"), ("organisation", "organization"),
)
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
MAX_KNOWN = 10_000


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "utf-8"), 256)


def known_digests(spark: SparkSession, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(known, licence) of a fixed list; its size is checked, as it is broadcast."""
    if len(texts) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts")
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in texts)
    rows = spark.sql(f"select name, text from values {values} as t(name, text)")
    return rows.groupBy(digest(F.col("text")).alias("known")).agg(F.min("name").alias("licence"))


def scan_licences(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    known: Sequence[tuple[str, str]] = (*LICENCES, *NOTICES),
) -> DataFrame:
    """(doc_id, digest, licence, notices): of the entire text, and those of its lines in order of name."""
    table = F.broadcast(known_digests(documents.sparkSession, known))
    rows = documents.select(
        F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(text, F.lit("")).alias("text")
    )
    # The entire text is entry 0, its lines follow.
    parts = rows.select(
        "id", "row", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("part", "text")
    ).select("id", "row", "part", digest(F.col("text")).alias("digest"))
    found = parts.join(table, parts["digest"] == F.col("known"), "left")
    whole = F.col("part") == 0
    return (
        found.groupBy("id", "row")
        .agg(
            F.max(F.when(whole, F.col("digest"))).alias("digest"),
            F.max(F.when(whole, F.col("licence"))).alias("licence"),
            F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("licence")))), ",").alias("notices"),
        )
        .select(F.col("id").alias(doc_id), "digest", "licence", "notices")
    )


def oracle_sql(known: Sequence[tuple[str, str]] = (*LICENCES, *NOTICES)) -> str:
    """The same for DuckDB."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"translate(coalesce(t, ''), '{UPPER}', '{LOWER}')"
    form = f"regexp_replace({form}, '{COPYRIGHT}', ' ', 'g')"
    for old, new in SPELLINGS:
        form = f"replace({form}, '{old}', '{new}')"
    form = f"sha256(trim(regexp_replace({form}, '{OTHER}', ' ', 'g')))"
    values = ", ".join(f"({text(name)}, {text(t)})" for name, t in known)
    return f"""
with known as (select {form} as k, min(name) as licence from (values {values}) v(name, t) group by 1),
     parts as (select doc_id, 0 as part, coalesce(text, '') as t from documents
               union all
               select doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) from documents),
     found as (select doc_id, part, d, licence from (select doc_id, part, {form} as d from parts) p
               left join known on d = k)
select doc_id, max(case when part = 0 then d end) as digest, max(case when part = 0 then licence end) as licence,
       coalesce(string_agg(distinct case when part = 1 then licence end, ',' order by case when part = 1 then licence end), '')
         as notices
from found group by doc_id"""
