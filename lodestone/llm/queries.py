"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, near_dedup, packing, quality_classifier, quality_rules, repeats, token_counts, token_files, url_filter
from lodestone.llm.common import stage, stage_path
from lodestone.llm.tokens import fixed_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.apply(docs, quality_classifier.fit(docs)).drop("text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = stage(quality_rules.metrics(docs).drop("text"), "metrics")
    cutoffs = stage(quality_rules.select_cutoffs(measured, table(spark, sf_dir, "labels")), "cutoffs")
    judged = quality_rules.judge(measured, cutoffs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed, _ = near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classed.select("doc_id", "class_id", "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = fixed_path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), file)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), fixed_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), fixed_path("byte_bpe_50k.json"), folder, vocabulary_size=50_257)
    return token_files.read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), fixed_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict_hits").cast("long").alias("n_strict"), F.size("soft_hits").cast("long").alias("n_soft"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeats.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_nearest": op7_nearest,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_repeats": op10_repeats,
}
