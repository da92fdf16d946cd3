"""The corpus pipeline: from raw documents to packed token sequences, stage by stage.

Each stage reads what its predecessor wrote and works on all of it; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velomart.llm import decontaminate, line_quality, near_duplicates, packing, quality
from velomart.llm.common import stage, table
from velomart.llm.registry import VOCABULARIES


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain predicts to be good; null and empty texts are not.

    Rows go through whole, columns called ``score`` or ``predicted`` too; rows that repeat are judged each.
    """
    chain = line_quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    return line_quality.scored(rows, chain).where("predicted = 1").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule; null and empty texts fail. Rows go through whole, whatever their columns are called."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, null and empty texts being one class; of rows that repeat one stays."""
    return near_duplicates.deduplicated(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null and empty texts have no words and stay."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in the packed sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, f"{VOCABULARIES}/word_bpe_49k.json", end_id=0).places


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
