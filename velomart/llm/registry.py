"""The queries of this subpackage by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velomart.llm import (
    binary,
    collocations,
    decontaminate,
    html,
    line_quality,
    lm,
    near_duplicates,
    packing,
    periodic,
    quality,
    sharding,
    url_filter,
    warc,
)
from velomart.llm.common import table

VOCABULARIES = "/opt/tokenizers"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    packed = packing.pack(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/word_bpe_49k.json", end_id=0)
    return packed.places.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it; shards differ by one row at most."""
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    return lm.score(docs, model).withColumn("held_out", lm.held_out(F.col("doc_id")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies, named by the smallest doc_id in it."""
    return near_duplicates.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, read back."""
    files = binary.write_token_files(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json", end_id=2)
    return binary.read_token_files(spark, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in windows of benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archives, read back and put together: one row per page."""
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.captures(spark, path).select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    chain = line_quality.train(docs, table(spark, sf_dir, "labels"))
    return line_quality.scored(docs.select("doc_id", "text"), chain).select(
        "doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored phrases of each language."""
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the longest rule that fits its url."""
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's longest run of repeated words, and digests of its runs and of what is left without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.reported(periodic.collapsed(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_warc": op9_warc,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_collocations": op11_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_periodic_runs": op13_periodic_runs,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


SQL = {
    "op6_decontamination": decontaminate.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_warc": warc.SQL,
    "op11_collocations": collocations.SQL,
    "op12_url_filter": url_filter.SQL,
}


def all_sql() -> dict[str, str]:
    return dict(SQL)
