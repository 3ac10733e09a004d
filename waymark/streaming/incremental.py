"""Restartable incremental work: a file stream of answers kept as compacted parts.

Every micro-batch is reduced to its latest row per key and written to its own folder, which
a replay overwrites. Reading resolves the latest row over all parts, so after each batch
the stream and a batch run over the same files agree.

`compact` folds the parts into a generation, one row per key, and a pointer table names the
newest generation and the last batch in it. Readers take that generation and the parts after
it, so what they read is bounded by the number of keys and the batches since. A generation is
whole before the pointer names it; a compaction that dies half-way is never seen, and a replay
of a batch that is already in a generation writes a part that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from waymark.operators.lookup import pending
from waymark.operators.ranking import pick_one


def absorb(
    spark: SparkSession, source: str, schema: ST.StructType, state: str, checkpoint: str,
    shape, ks: Sequence[str], order: Sequence[Column], glob: str = "*", files_per_batch: int = 1000,
) -> None:
    """Take in all files that arrived since the last run, then stop.

    shape turns source rows into journal rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = pick_one(shape(batch), ks, order)
        latest.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _newest(spark: SparkSession, state: str) -> tuple[int, str | None]:
    """Last batch of the newest generation and the generation's folder."""
    try:
        pointer = spark.read.parquet(f"{state}-pointer")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, None
    row = pointer.orderBy(F.desc("upto"), F.desc("written_at")).first()  # one row per compaction
    return (row["upto"], row["folder"]) if row else (-1, None)


def _parts(spark: SparkSession, state: str, after: int) -> DataFrame:
    return spark.read.parquet(state).where(F.col("batch") > after)


def current(spark: SparkSession, state: str, ks: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key over all absorbed batches."""
    upto, folder = _newest(spark, state)
    rows = _parts(spark, state, upto).drop("batch")
    if folder is not None:
        rows = spark.read.parquet(folder).unionByName(rows)
    return pick_one(rows, ks, order)


def compact(spark: SparkSession, state: str, ks: Sequence[str], order: Sequence[Column]) -> int:
    """Fold all parts so far into a new generation; returns its last batch (-1 without parts).

    To be called between runs of `absorb`. Parts and generations before the newest one are no
    longer read and may be deleted by the owner of the folder."""
    upto, _ = _newest(spark, state)
    last = _parts(spark, state, upto).agg(F.max("batch")).first()[0]
    if last is None:
        return upto
    folder = f"{state}-generations/{last}-{uuid.uuid4().hex}"
    current(spark, state, ks, order).write.parquet(folder)
    pointer = spark.range(1).select(
        F.lit(int(last)).cast("long").alias("upto"), F.lit(folder).alias("folder"), F.current_timestamp().alias("written_at")
    )
    pointer.coalesce(1).write.mode("append").parquet(f"{state}-pointer")
    return int(last)


def outstanding(inputs: DataFrame, answers: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Inputs without a successful answer yet."""
    return pending(inputs, answers, ks, F.col("request_status") == "success")
