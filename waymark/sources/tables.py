"""Table scans, column roles, sinks, fan-out and all-or-nothing publishing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from waymark.functions.text import null_tokens
from waymark.operators.quality import require


def scan(
    spark: SparkSession, path: str, schema: ST.StructType | None = None,
    cols: Sequence[str] | None = None, null_words: Iterable[str] = (), fmt: str = "parquet",
    encoding: str = "UTF-8",
) -> DataFrame:
    """Read a table, keep the wanted columns and null the missing words of text columns."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        # empty and NA-like text is kept as text, so that the null policy is ours alone
        reader = reader.options(
            header=True, encoding=encoding, nullValue="\u0000", emptyValue="", multiLine=False
        )
    df = reader.load(path)
    if cols is not None:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}; available {df.columns}")
        df = df.select(*cols)
    words = list(null_words)
    if not words:
        return df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, ST.StringType)]
    return df.withColumns({c: null_tokens(c, words) for c in texts})


def _token(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.casefold()).strip("_")


def resolve_roles(
    df: DataFrame, aliases: dict[str, Sequence[str]], optional: Iterable[str] = ()
) -> DataFrame:
    """Select columns by role: the first alias present, ignoring case and punctuation."""
    have = {_token(c): c for c in reversed(df.columns)}
    chosen, missing = [], []
    for role, names in aliases.items():
        hit = next((have[_token(n)] for n in names if _token(n) in have), None)
        if hit is not None:
            chosen.append(F.col(f"`{hit}`").alias(role))
        elif role not in set(optional):
            missing.append(role)
    if missing:
        raise ValueError(f"no column for roles {missing}; available {df.columns}")
    return df.select(*chosen)


def sink(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", header: bool = True) -> None:
    """Write a table; an empty frame keeps its schema."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header)
    writer.save(path)


def fan_out(df: DataFrame, class_col: str, classes: Iterable[str]) -> dict[str, DataFrame]:
    """One frame per class; `sink_by_class` writes all classes in one pass."""
    return {c: df.where(F.col(class_col) == c) for c in classes}


def sink_by_class(df: DataFrame, class_col: str, path: str, classes: DataFrame) -> None:
    """Write every class of a table to a part of its own, all in one pass.

    `classes` (one column, class_col) names the classes there should be. Their row counts are
    written beside the parts, an absent class with 0. 
    """
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(class_col).parquet(f"{path}/parts")
    # read by the folders alone, with the schema that an empty table would not tell
    counts = _parts(spark, path, df.schema).groupBy(class_col).agg(F.count(F.lit(1)).alias("rows_n"))
    wanted = classes.select(F.col(class_col).alias("_c")).distinct()
    both = wanted.join(counts, F.col("_c").eqNullSafe(F.col(class_col)), "left")
    sink(both.select(F.col("_c").alias(class_col), F.coalesce("rows_n", F.lit(0)).cast("long").alias("rows_n")), f"{path}/classes")
    # a table of no rows carries the schema for classes without rows
    sink(df.limit(0), f"{path}/schema")


def _parts(spark: SparkSession, path: str, schema: ST.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/parts")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """The classes of a partitioned sink and their row counts."""
    return spark.read.parquet(f"{path}/classes")


def read_class(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One class of a partitioned sink; only its own files are read. A class without rows is an
    empty frame of the same columns."""
    schema = spark.read.parquet(f"{path}/schema").schema
    class_col = spark.read.parquet(f"{path}/classes").columns[0]
    return _parts(spark, path, schema).where(F.col(class_col) == name)


def publish(
    outputs: dict[str, DataFrame], base: str, run_id: str, gates: dict[str, DataFrame] | None = None
) -> None:
    """Write a run's tables, pass its gates, then make the run visible in one small commit.

    Readers follow the pointer table, so a run that fails half-way is never seen.
    """
    spark = next(iter(outputs.values())).sparkSession
    for name, df in outputs.items():
        sink(df, f"{base}/runs/{run_id}/{name}")
    for name, violations in (gates or {}).items():
        require(name, violations)
    pointer = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("published_at")
    )
    sink(pointer, f"{base}/pointer", mode="append")


def published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The named table of the latest published run."""
    latest = (
        spark.read.parquet(f"{base}/pointer").orderBy(F.col("published_at").desc(), F.col("run_id").desc())
        .limit(1).collect()[0]["run_id"]
    )
    return spark.read.parquet(f"{base}/runs/{latest}/{name}")
