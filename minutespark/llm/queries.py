"""The registered queries of the training-data operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutespark.llm import chat_format, ctw, decontaminate, jaccard_join, line_dedup, packing, pii, prefix_trie, quality, secret_scan, sentence_spans, suffix_dedup, token_align
from minutespark.llm.oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    windows = chat_format.format_windows(turns.union(chat_format.control_conversation(spark)))
    return chat_format.with_digest(chat_format.read_back(windows))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.with_digest(suffix_dedup.remove_repeats(_documents(spark, sf_dir)))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed run: where it is, and the documents where its runs stay."""
    found = sentence_spans.remove_repeated_runs(_documents(spark, sf_dir), only_changed=True)
    runs = found.select("doc_id", "n_sentences", "n_removed", F.explode("spans").alias("s"))
    return runs.select("doc_id", "n_sentences", "n_removed", F.col("s.first").alias("first_sentence"), F.col("s.last").alias("last_sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.first_docs").alias("first_docs"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_documents(spark, sf_dir), k=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.with_digest(secret_scan.find_secrets(_documents(spark, sf_dir)))


def op9_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(_documents(spark, sf_dir), depth=ctw.DEPTH)


def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_digest(pii.find_personal_data(_documents(spark, sf_dir)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.shared_starts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_align.align(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return token_align.with_digest(found)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.with_digest(line_dedup.drop_repeated_lines(_documents(spark, sf_dir)))


__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_suffix_array_dedup, op4_sentence_spans, op5_jaccard_join, op6_best_fit_packing, op7_benchmark_decontamination, op8_secret_scan, op9_ctw_scoring, op10_pii_weak_supervision, op11_prefix_trie, op12_token_align, op13_line_dedup)}
