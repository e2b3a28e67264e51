"""The registered corpus queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysnap.llm import conversations, html_text, language, lexical, licences, packing, pii, quality, sharding, simhash, suffixes, tiling, urls
from keysnap.llm.common import hexed, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(spark, urls.labelled_urls())
    return urls.judge_urls(table(spark, sf_dir, "pages"), model)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality.with_stats(table(spark, sf_dir, "documents"), keep=["doc_id"]), "stats")
    rules = quality.fit_rules(stats, table(spark, sf_dir, "labels"))
    return quality.judged(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "rule",
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(simhash.with_fingerprint(table(spark, sf_dir, "documents"), keep=["doc_id"]), "fingerprinted")
    return simhash.near_duplicates(docs).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_licences": op3_licences,
    "op4_quality_rules": op4_quality_rules,
    "op5_repeats": op5_repeats,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_conversations": op11_conversations,
    "op12_lexical": op12_lexical,
    "op13_language": op13_language,
}

# The others are beyond SQL or too slow there on whole tables; tests hold brute force against them.
ORACLE_SQL: dict[str, str] = {"op3_licences": licences.oracle_sql(), "op12_lexical": lexical.oracle_sql()}
