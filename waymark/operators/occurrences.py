"""Occurrence quality control and coordinate dedupe."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.coords import in_range, scaled
from waymark.functions.hashing import stable_hash
from waymark.operators.ranking import pick_one

# Excluded record kinds and limits.
EXCLUDED_BASIS = ("FOSSIL_SPECIMEN", "LIVING_SPECIMEN")
MAX_UNCERTAINTY_M = 100000.0
COORDINATE_DECIMALS = 5
MAX_PER_TAXON = 1000


def failed_rule(
    lat: str = "lat", lon: str = "lon", uncertainty: str = "uncertainty_m", basis: str = "basis",
    max_uncertainty: float = MAX_UNCERTAINTY_M, excluded: Iterable[str] = EXCLUDED_BASIS,
) -> Column:
    """Name of the first rule a record breaks, null when it is kept."""
    return (
        F.when(~in_range(lat, lon), "invalid_coordinates")
        .when((F.col(lat) == 0) & (F.col(lon) == 0), "zero_zero")
        .when(F.col(uncertainty) > max_uncertainty, "high_uncertainty")
        .when(F.upper(F.col(basis)).isin(list(excluded)), "excluded_basis")
    )


def quality_filter(df: DataFrame, rule: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept records, and removal counts per first broken rule."""
    marked = df.withColumn("failed_rule", failed_rule() if rule is None else rule)
    kept = marked.where(F.col("failed_rule").isNull()).drop("failed_rule")
    removed = marked.where(F.col("failed_rule").isNotNull()).groupBy("failed_rule").agg(
        F.count(F.lit(1)).alias("removed_n")
    )
    return kept, removed


def with_identity(
    df: DataFrame, identity: Sequence[str], lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Stable content hash over identity columns and scaled coordinates."""
    return df.withColumn("stable_hash", stable_hash(*identity, scaled(lat, 7), scaled(lon, 7)))


def unique_coordinates(
    df: DataFrame, ks: Sequence[str], lat: str = "lat", lon: str = "lon",
    decimals: int = COORDINATE_DECIMALS, tie: Sequence[str] = (),
) -> DataFrame:
    """One record per key and rounded coordinate, the one with the lowest hash."""
    keyed = df.withColumns({"_y": scaled(lat, decimals), "_x": scaled(lon, decimals)})
    order = [F.col("stable_hash").asc(), *[F.col(t).asc() for t in tie]]
    return pick_one(keyed, [*ks, "_y", "_x"], order).drop("_y", "_x")
