"""Reproducible samples and allocations. Draws depend on seed and row key only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.coords import grid_cell
from waymark.functions.hashing import draw_key
from waymark.operators.ranking import bucket_rank, hash_rank, null_safe, pick_one


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows in hash order."""
    return (
        df.withColumn("_draw", draw_key(seed, *key)).orderBy("_draw", *key).limit(n).drop("_draw")
    )


def one_per_group(df: DataFrame, ks: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """One drawn row per group, whatever the input order."""
    drawn = df.withColumn("_draw", draw_key(seed, *key))
    return pick_one(drawn, ks, [F.col("_draw"), *[F.col(k) for k in key]]).drop("_draw")


def allocate(caps: DataFrame, stratum: str, capacity: str, n: int, mode: str) -> DataFrame:
    """Quota per stratum: proportional by largest remainder, or balanced, within capacity.

    caps has one row per stratum, so the windows here see strata, not records. A size above
    the total capacity fails the job.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    whole = Window.partitionBy()
    cap = F.col(capacity)
    total = F.sum(capacity).over(whole)

    def checked(out: DataFrame, quota: Column) -> DataFrame:
        short = F.raise_error(F.format_string(f"sample size {n} exceeds the total capacity %s", F.col("_total").cast("string")))
        value = F.when(F.col("_total") < n, short.cast("bigint")).otherwise(quota.cast("bigint"))
        return out.select(stratum, capacity, value.alias("quota"))

    caps = caps.withColumn("_total", total)
    if mode == "proportional":
        exact = caps.withColumns(
            {
                "_floor": F.expr(f"({n} * {capacity}) div _total"),
                "_rest": F.expr(f"({n} * {capacity}) % _total"),
            }
        )
        by_rest = Window.orderBy(F.col("_rest").desc(), F.col(stratum).asc())
        placed = exact.withColumn("_left", F.lit(n) - F.sum("_floor").over(whole)).withColumn(
            "_place", F.row_number().over(by_rest)
        )
        return checked(placed, F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("bigint"))
    if mode != "balanced":
        raise ValueError(f"unknown mode {mode}")
    asc = Window.orderBy(capacity, stratum)
    sized = caps.withColumns(
        {
            "_strata": F.count(F.lit(1)).over(whole),
            "_place": F.row_number().over(asc),
            "_below": F.coalesce(
                F.sum(capacity).over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    )
    # highest common level whose total stays within n
    level = sized.withColumn(
        "_level", F.max(F.expr(f"({n} - _below) div (_strata - _place + 1)")).over(whole)
    ).withColumn("_base", F.least(cap, F.col("_level")))
    room = cap > F.col("_level")
    by_name = Window.partitionBy(room).orderBy(stratum)
    turned = level.withColumn("_left", F.lit(n) - F.sum("_base").over(whole)).withColumn(
        "_turn", F.row_number().over(by_name)
    )
    return checked(turned, F.col("_base") + F.when(room & (F.col("_turn") <= F.col("_left")), 1).otherwise(0))


def stratified_sample(
    df: DataFrame, stratum: str, quotas: DataFrame, key: Sequence[str], seed: int
) -> DataFrame:
    """Draw each stratum's quota; quotas(stratum, quota) has one row per stratum."""
    limits = quotas.select(stratum, F.col("quota").alias("_at_most"))
    ranked = hash_rank(df, [stratum], key, seed, "_rank", limits=limits)
    return ranked.where(F.col("_rank") <= F.col("_at_most")).drop("_rank", "_at_most")


def equal_per_stratum(
    df: DataFrame, stratum: str, n: int, key: Sequence[str], seed: int
) -> DataFrame:
    """ceil(n / strata) rows per stratum, then at most n in stratum and hash order."""
    strata = df.agg(F.count_distinct(F.coalesce(F.col(stratum), F.lit(""))).alias("_strata"))
    quota = F.ceil(F.lit(float(n)) / F.greatest(F.col("_strata"), F.lit(1)))
    with_quota = df.withColumn("_quota", strata.select(quota.alias("_quota")).scalar())
    ranked = hash_rank(with_quota, [stratum], key, seed, "_rank", at_most=F.col("_quota"))
    picked = ranked.where(F.col("_rank") <= F.col("_quota"))
    return picked.orderBy(stratum, "_rank", *key).limit(n).drop("_rank", "_quota")


def split(
    df: DataFrame, stratum: str, fraction: float, key: Sequence[str], seed: int,
    out: str = "validation_split",
) -> DataFrame:
    """Calibration/holdout split per stratum, at least one row on each side if possible."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    named = df.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("Missing")))
    sizes = named.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.greatest(
        F.lit(1), F.least(F.rint(F.col("_n") * fraction).cast("bigint"), F.col("_n") - 1)
    )
    ranked = hash_rank(named, ["_stratum"], key, seed, "_rank")
    return (
        ranked.join(sizes, "_stratum")
        .withColumn(out, F.when(F.col("_rank") <= wanted, "calibration").otherwise("holdout"))
        .drop("_stratum", "_n", "_rank")
    )


def balanced_sample(
    df: DataFrame, ks: Sequence[str], cap: int | None, order: Sequence[str],
    lat: str = "lat", lon: str = "lon", degrees: float = 1.0, cell: str = "grid_cell",
) -> DataFrame:
    """Spatially balanced rows per key: one per occupied cell first, then fill to the cap.

    order names unique columns, the first being a stable hexadecimal hash. A hot key or cell
    is never gathered: cell firsts come from an aggregate, and rows are ranked in buckets of
    that hash, of which those beyond the cap are dropped unsorted. Without a cap all rows stay.
    available_n and dropped_n tell per key how many rows there were and how many the cap cut.
    """
    celled = df.withColumn(cell, grid_cell(lat, lon, degrees))
    totals = celled.groupBy(*ks).agg(F.count(F.lit(1)).alias("available_n"))
    if cap is None:
        full = null_safe(celled, totals, ks, "inner")
        return full.withColumns({"sampling_applied": F.lit(False), "dropped_n": F.lit(0).cast("bigint")})
    position = F.struct(*order)
    firsts = celled.groupBy(*ks, cell).agg(F.min(position).alias("_first"))
    marked = celled.join(firsts, [*ks, cell]).withColumn("_later", (position != F.col("_first")).cast("string"))
    ranked = bucket_rank(marked, ks, F.concat("_later", F.col(order[0])), order, "_rank", cap, lead=1)
    kept = ranked.where(F.col("_rank") <= cap).drop("_first", "_later", "_rank")
    return kept.join(totals, list(ks)).withColumns(
        {
            "sampling_applied": F.col("available_n") > cap,
            "dropped_n": F.greatest(F.col("available_n") - cap, F.lit(0)),
        }
    )
