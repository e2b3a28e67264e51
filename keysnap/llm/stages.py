"""The pipeline's stages over tables shaped like ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keysnap.llm import packing as packs
from keysnap.llm import pii, quality, simhash, tiling
from keysnap.llm.common import table
from keysnap.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is masked."""
    return pii.mask_pii(docs, n_chars="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packs.pack(docs, tokenizer_path())
