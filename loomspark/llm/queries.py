"""The ten training-data operators as registered queries, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import bpe, exact, langid, lines, nearjoin, packing, quality, simple8b, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document as Simple-8b words with block offsets."""
    return simple8b.encode_packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, similarity and rejection of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.classify(docs, langid.train(docs), drop=("text",))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that many sites share."""
    return lines.remove(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of token ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, of those with equal texts one."""
    return exact.dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies and the number of links of every document."""
    return nearjoin.join(_table(spark, sf_dir, "documents"))


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global capture index of all pages. The table has no time of capture; a second for each page_id stands in for it."""
    return warc.capture_index(_table(spark, sf_dir, "pages")).drop("run", "record_offset")


def op9_capture_index_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the run and the offset in it at which each record lies, which SQL cannot give."""
    return warc.capture_index(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the verdict of each policy."""
    return quality.judge(quality.ledger_of(_table(spark, sf_dir, "documents"), sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects alone and with others, from the bits of the stored ledger."""
    return quality.ablation(quality.ledger_of(_table(spark, sf_dir, "documents"), sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_output": op2_token_output,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_near_copies": op8_near_copies,
    "op9_capture_index": op9_capture_index,
    "op9_capture_index_full": op9_capture_index_full,
    "op10_quality": op10_quality,
    "quality_ablation": quality_ablation,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": lines.remove_sql(),
    "op6_exact_dedup": exact.dedup_sql(),
    "op9_capture_index": warc.capture_index_sql(),
    "op10_quality": quality.ledger_sql(),
    "quality_ablation": quality.ablation_sql(),
}
