"""Region layers: boundary segments plus cleaned labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import tokens as T
from waymark.functions.text import null_tokens

# Fixed value: labels starting with the key are shown as the value.
LABEL_PREFIXES = {"Oceania_simplify": "Oceania"}


def clean_label(c: Column | str, prefixes: dict[str, str] = LABEL_PREFIXES) -> Column:
    text = null_tokens(c, T.LABEL)
    expr = text
    for prefix, label in prefixes.items():
        expr = F.when(text.startswith(prefix), label).otherwise(expr)
    return expr


def prepare_regions(
    attrs: DataFrame, edges: DataFrame, label_col: str, prefixes: dict[str, str] = LABEL_PREFIXES
) -> tuple[DataFrame, DataFrame]:
    """Regions that have a label and a boundary, with the label cleaned."""
    named = attrs.withColumn("label", clean_label(label_col, prefixes)).where(
        F.col("label").isNotNull()
    )
    real = edges.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    kept = real.join(named.select("region"), "region", "left_semi")
    bounded = named.join(real.select("region").distinct(), "region", "left_semi")
    return kept, bounded


def load_regions(
    spark: SparkSession, edges_path: str, attrs_path: str, label_col: str,
    prefixes: dict[str, str] = LABEL_PREFIXES,
) -> tuple[DataFrame, DataFrame]:
    """Edge and attribute tables written by a vector tool beforehand."""
    return prepare_regions(
        spark.read.parquet(attrs_path), spark.read.parquet(edges_path), label_col, prefixes
    )


def rectangle_edges(
    df: DataFrame, region: str, x0: str, x1: str, y0: str, y1: str
) -> DataFrame:
    """Edge rows of axis-parallel boxes, counter-clockwise."""
    def seg(a: str, b: str, c: str, d: str) -> Column:
        return F.struct(
            *[F.col(v).cast("double").alias(n) for v, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"))]
        )

    sides = F.array(seg(x0, y0, x1, y0), seg(x1, y0, x1, y1), seg(x1, y1, x0, y1), seg(x0, y1, x0, y0))
    return df.select(F.col(region).alias("region"), F.explode(sides).alias("s")).select("region", "s.*")


def ring_edges(df: DataFrame, region: str, ring: Sequence[str], seq: str, x: str, y: str) -> DataFrame:
    """Edge rows from ordered ring vertices; the last vertex connects to the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(region, *ring).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        F.col(region).alias("region"), F.col(x).alias("x0"), F.col(y).alias("y0"),
        F.coalesce(F.lead(x).over(w), F.first(x).over(whole)).alias("x1"),
        F.coalesce(F.lead(y).over(w), F.first(y).over(whole)).alias("y1"),
    )
