"""Documents to token ids: classifier, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from waymark.llm import line_dedup, mixing, near_dup, quality_classifier, sentence_pieces  # noqa: E402
from waymark.llm.common import scratch  # noqa: E402
from waymark.llm.queries import PIECES, vocabulary  # noqa: E402


#: Columns that the stages read; all others travel under names that no operator uses.
READ = ("doc_id", "text", "source")


def hidden(docs: DataFrame) -> DataFrame:
    """`docs` with every column that no stage reads renamed, so that no operator's own columns
    can clash with it."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in READ})


def shown(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` out of a stage's result, under their own names."""
    return out.select(*(F.col(c if c in READ else f"_own_{c}").alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality_classifier.classify(hidden(docs), labels)
    return shown(scored.where(F.col("quality_score") >= quality_classifier.CUT), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat one of an earlier document; n_chars follows."""
    cut = line_dedup.dedup_lines(hidden(docs), line_dedup.NOT_BLANK)
    if "n_chars" in docs.columns:
        size, old = F.length("text").cast(docs.schema["n_chars"].dataType), F.col("_own_n_chars")
        cut = cut.withColumn("_own_n_chars", F.when(F.col("n_dropped") > 0, size).otherwise(old))
    return shown(cut, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group, by five-word shingles: that with the
    smallest doc_id. Rows that are equal in doc_id and text are one."""
    mine = hidden(docs)
    kept = near_dup.first_rows(mine, width=5).withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content"))
    sortable = [c for c, t in mine.dtypes if "map<" not in t and "variant" not in t]
    row = F.min_by(F.struct(*mine.columns), F.struct(*sortable)).alias("_row")
    return shown(mine.join(kept, same).groupBy("_id", "_content").agg(row).select("_row.*"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks for."""
    mine = hidden(docs)
    return shown(mixing.repeated(mixing.mix(mine), mine.columns), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document of the mix."""
    model = sentence_pieces.load(vocabulary(PIECES))
    tokens = sentence_pieces.encode(docs.select("doc_id", "text"), model)
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_copies),
    ("source mix", mix_sources),
    ("sentence pieces", encode),
]

#: Stages that learn, hash and tokenize have no SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
