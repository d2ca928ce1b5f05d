"""Thin queries over the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evograph.llm import (bpe, fill_in_middle, nn_descent, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup,
                          topk, toxicity, vector_codes, warc)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.spans(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the two marks of ``labels``: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 1, 2 - F.col("toxic")).when(F.col("quality") == 0, 0)
    ratings = _read(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return quality_classifier.score(_read(spark, sf_dir, "documents"), ratings)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(_read(spark, sf_dir, "embeddings"))


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.round_trip(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_contextual_pii": op7_contextual_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_vector_codes": op11_vector_codes,
    "op12_nn_descent": op12_nn_descent,
    "op13_fill_in_middle": op13_fill_in_middle,
}
