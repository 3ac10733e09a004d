"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import (
    importance, license_scan, line_dedup, mixing, near_dup, quality_classifier, quality_rules, sentence_pieces,
    source_audit, substring_dedup, token_files, vector_search, warc,
)
from waymark.llm.oracles import ORACLES  # noqa: F401

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), split_special=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = quality_classifier.classify(docs, _table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return scored.select(
        "doc_id", F.coalesce(quality_classifier.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        score.alias("score"), (score >= quality_classifier.CUT).cast("int").alias("predicted"),
    )


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_components(_table(spark, sf_dir, "documents"), width=2)


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.NOT_BLANK)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return kept.select("doc_id", "n_lines", "n_dropped", crc.alias("text_crc32"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentence_pieces.load(vocabulary(PIECES))
    return sentence_pieces.round_trip(_table(spark, sf_dir, "documents"), model)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_source_mix, op3_token_files, op4_quality_classifier, op5_warc_normaliser,
    op6_near_duplicates, op7_vector_search, op8_license_scan, op9_line_dedup, op10_sentence_pieces,
    op11_substring_dedup, op12_importance_resampling, op13_source_audit,
)}
