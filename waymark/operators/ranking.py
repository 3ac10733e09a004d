"""Ranking, top-k, duplicate and running-total operators that hold under skew.

Per-group picks are row_number/rank filters, which Spark prunes before the shuffle
(WindowGroupLimit). Whole-group ranks and running totals never gather a group in one
task: rows are spread over ordered buckets, and small bucket totals supply the offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.hashing import draw_key
from waymark.functions.stats import ratio
from waymark.session import cut_lineage

#: Rows of a sorting bucket of the largest stratum, at most about this many.
BUCKET_ROWS = 50_000
#: Up to this k Spark prunes row_number filters itself (the engine's default limit).
PRUNED_K = 1000


def null_safe(left: DataFrame, right: DataFrame, ks: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which missing keys equal each other; left key columns are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in ks], *[c for c in right.columns if c not in ks]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in ks])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in ks])


def pick_one(df: DataFrame, ks: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key; the order must end with a unique column."""
    w = Window.partitionBy(*ks).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(w)).where("_pick = 1").drop("_pick")


def first_k(df: DataFrame, ks: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of every key; the order must end with a unique column.

    Up to `PRUNED_K` Spark keeps k rows per key and task before the shuffle. Beyond that rows
    are range-partitioned by key and order, and counts per (range, key) tell which ranges a key
    has filled already: their rows are dropped unsorted, and no key is sorted by one task."""
    if k <= PRUNED_K:
        w = Window.partitionBy(*ks).orderBy(*order)
        return df.withColumn("_pick", F.row_number().over(w)).where(F.col("_pick") <= k).drop("_pick")
    spread = _spread_sorted(df, [*[F.asc_nulls_first(c) for c in ks], *order])
    sizes = spread.groupBy(*ks, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).where(F.col("_before") < k)
    placed = null_safe(spread, before.drop("_size"), [*ks, "_part"], "inner")
    inside = Window.partitionBy(*ks, "_part").orderBy(*order)
    rank = F.row_number().over(inside) + F.col("_before")
    return placed.withColumn("_pick", rank).where(F.col("_pick") <= k).drop("_pick", "_part", "_before")


def rank_sorted(df: DataFrame, ks: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Rank (from 1) of every row inside its key along the order, which is total.

    Rows are range-partitioned by key and order; counts per (range, key), one row each, are the
    offsets, so no key is gathered or sorted by one task."""
    spread = _spread_sorted(df, [*[F.asc_nulls_first(c) for c in ks], *order])
    sizes = spread.groupBy(*ks, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    placed = null_safe(spread, before, [*ks, "_part"], "inner")
    inside = Window.partitionBy(*ks, "_part").orderBy(*order)
    rank = (F.row_number().over(inside) + F.col("_before")).cast("bigint")
    return placed.withColumn(out, rank).drop("_part", "_before")


def top_with_ties(df: DataFrame, ks: Sequence[str], order: Column) -> DataFrame:
    """All rows that share the best value of their key."""
    w = Window.partitionBy(*ks).orderBy(order)
    return df.withColumn("_pick", F.rank().over(w)).where("_pick = 1").drop("_pick")


def duplicates(df: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    repeated = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return null_safe(df, repeated, ks, "left_semi")


def hash_rank(
    df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int, out: str = "draw_rank",
    at_most: Column | int | None = None, limits: DataFrame | None = None,
) -> DataFrame:
    """Rank of every row inside its stratum in hash order."""
    drawn = df.withColumn("_draw", draw_key(seed, *key))
    return bucket_rank(drawn, strata, F.col("_draw"), ["_draw", *key], out, at_most, limits=limits).drop("_draw")


def bucket_rank(
    df: DataFrame, strata: Sequence[str], digest: Column, order: Sequence[str], out: str,
    at_most: Column | int | None = None, lead: int = 0, limits: DataFrame | None = None,
) -> DataFrame:
    """Rank of every row inside its stratum along `order`, which begins as `digest` does.

    Leading hexadecimal digits of the digest (after `lead` other characters) are ordered
    buckets of equal expected size. Their number follows from the largest stratum, so that a
    bucket holds about `BUCKET_ROWS` rows. Buckets wholly beyond at_most are dropped before
    any row is sorted.

    limits(strata, _at_most) gives every stratum, one row each, a limit of its own; it meets the
    buckets and not the rows, which would gather by stratum. Rows of other strata are left out,
    those returned carry _at_most.
    """
    most = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_most")).scalar()
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.coalesce(most, F.lit(1)) / BUCKET_ROWS)).cast("int"))
    drawn = df.withColumn("_bucket", F.substring(digest, F.lit(1), digits + lead))
    ks = [*strata, "_bucket"]
    sizes = drawn.groupBy(*ks).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    if limits is not None:
        wanted = null_safe(offsets, limits, strata, "inner").where(F.col("_before") < F.col("_at_most"))
        # few buckets are left: they are looked up, and rows are not sorted to meet them
        offsets = wanted.hint("shuffle_hash")
    placed = null_safe(drawn, offsets.drop("_size"), ks, "inner")
    if at_most is not None:
        placed = placed.where(F.col("_before") < at_most)
    inside = Window.partitionBy(*ks).orderBy(*[F.substring(digest, F.lit(1), F.lit(lead))] * bool(lead), *order)
    return placed.withColumn(
        out, (F.row_number().over(inside) + F.col("_before")).cast("bigint")
    ).drop("_bucket", "_before")


def _spread_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition by the order and record each row's partition in the written copy."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order)
    return cut_lineage(spread.withColumn("_part", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    values: dict[str, str | Column],
) -> DataFrame:
    """Global running sums {out: value} along a total order, without one sorting task.

    The frame is range-partitioned by the full order, so one repeated leading value still
    spreads over many partitions; partition totals (one row each) give the offsets.
    """
    named = {out: (F.col(v) if isinstance(v, str) else v) for out, v in values.items()}
    spread = _spread_sorted(
        df.withColumns({f"_v_{out}": expr for out, expr in named.items()}), order
    )
    totals = spread.groupBy("_part").agg(
        *[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in named]
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_o_{out}") for out in named],
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # one offset row per shuffle partition, so the broadcast side is bounded
    return (
        spread.join(F.broadcast(offsets), "_part")
        .withColumns({out: F.sum(f"_v_{out}").over(inside) + F.col(f"_o_{out}") for out in named})
        .drop("_part", *[f"_v_{o}" for o in named], *[f"_o_{o}" for o in named])
    )


def quantiles(
    df: DataFrame, cols: Sequence[str], q: float = 0.5, by: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of several columns, overall and per value of `by`.

    Returns (_all, by, one column each). Values are counted first; running sums of the counts
    over range-partitioned values tell which values stand at the wanted places, so no task
    ever holds a column. Null and NaN values do not count.
    """
    ks = ["_all", *([by] if by else []), "_col"]
    scope = F.array(F.lit(1), F.lit(0)) if by else F.array(F.lit(1))
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_value")) for c in cols])
    long = df.select(*([by] if by else []), F.explode(pairs).alias("_p")).select(
        *([by] if by else []), "_p.*", F.explode(scope).alias("_all")
    ).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    if by:
        long = long.withColumn(by, F.when(F.col("_all") == 0, F.col(by)))
    counts = long.groupBy(*ks, "_value").agg(F.count(F.lit(1)).alias("_n"))
    summed = running_total(counts, [*[F.asc_nulls_first(k) for k in ks], F.asc("_value")], {"_to": "_n"})
    ends = summed.groupBy(*ks).agg(F.min(F.col("_to") - F.col("_n")).alias("_base"), F.sum("_n").alias("_size"))
    at = (F.col("_size") - 1) * F.lit(q)
    placed = null_safe(summed, ends, ks, "inner").withColumns(
        {"_at": at, "_low": F.col("_base") + F.floor(at), "_high": F.col("_base") + F.ceil(at)}
    )

    def value(place: str) -> Column:
        here = (F.col("_to") - F.col("_n") <= F.col(place)) & (F.col(place) < F.col("_to"))
        return F.max(F.when(here, F.col("_value")))

    share = F.max("_at") - F.floor(F.max("_at"))
    found = placed.groupBy(*ks).agg((value("_low") * (1 - share) + value("_high") * share).alias("_q"))
    return found.groupBy(*ks[:-1]).agg(*[F.max(F.when(F.col("_col") == c, F.col("_q"))).alias(c) for c in cols])


def number_rows(
    df: DataFrame, order: Sequence[Column], out: str = "row_id", start: int = 1,
    fmt: str | None = None,
) -> DataFrame:
    """Consecutive ids along a total order, as numbers or formatted text."""
    numbered = running_total(df, order, {out: F.lit(1)})
    value = F.col(out) + (start - 1)
    return numbered.withColumn(out, F.format_string(fmt, value) if fmt else value)


def cumulative_share(
    df: DataFrame, order: Sequence[Column], value: str,
    rank: str = "priority_rank", total: str = "cumulative_n", share: str = "cumulative_share",
) -> DataFrame:
    """Rank, running total, its share of the grand total and the share before the row."""
    ranked = running_total(df, order, {rank: F.lit(1), total: value})
    grand = ranked.agg(F.max(total).alias("_grand"))
    zero = F.lit(0.0)
    return (
        ranked.withColumn("_grand", grand.scalar())
        .withColumn(share, F.coalesce(ratio(total, "_grand"), zero))
        .withColumn(
            f"{share}_before", F.coalesce(ratio(F.col(total) - F.col(value), "_grand"), zero)
        )
        .drop("_grand")
    )


# Cumulative-share limits of the priority bands.
PRIORITY_CUTS = (0.50, 0.80, 0.90, 0.95)
PRIORITY_BANDS = (
    "P0_no_incremental_records", "P1_first_50_percent", "P2_50_to_80_percent",
    "P3_80_to_90_percent", "P4_90_to_95_percent", "P5_remaining",
)
TOP_NS = (10, 25, 50, 100, 250, 500, 1000, 2000)
COVERAGE_TARGETS = (0.50, 0.80, 0.90, 0.95, 0.99)


def priority_band(value: str, share_before: str) -> Column:
    expr = F.when(F.col(value) == 0, PRIORITY_BANDS[0])
    for cut, label in zip(PRIORITY_CUTS, PRIORITY_BANDS[1:]):
        expr = expr.when(F.col(share_before) < cut, label)
    return expr.otherwise(PRIORITY_BANDS[-1])


def top_n_coverage(
    ranked: DataFrame, rank: str, value: str, sums: Sequence[str], ns: Iterable[int] = TOP_NS
) -> DataFrame:
    """Sums over the top N ranks and their share of the whole, in one pass."""
    ns = list(ns)
    r = F.col(rank)
    aggs = [F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_grand")]
    for i, n in enumerate([*ns, None]):
        inside = F.lit(True) if n is None else r <= n
        aggs += [F.sum(F.when(inside, F.col(s))).alias(f"_{i}_{s}") for s in sums]
    one = ranked.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                (F.col("_rows") if n is None else F.least(F.lit(n), F.col("_rows")))
                .cast("bigint").alias("top_n"),
                *[F.col(f"_{i}_{s}").alias(s) for s in sums],
            )
            for i, n in enumerate([*ns, None])
        ]
    )
    out = one.select("_grand", F.explode(F.array_distinct(rows)).alias("_row"))
    return out.select(
        "_row.*", F.coalesce(ratio(F.col(f"_row.{value}"), "_grand"), F.lit(0.0)).alias("share")
    )


def rows_for_target(
    ranked: DataFrame, rank: str, total: str, share: str,
    targets: Iterable[float] = COVERAGE_TARGETS,
) -> DataFrame:
    """Fewest leading rows that reach each target share."""
    targets = list(targets)
    aggs = [F.max(rank).alias("_rows"), F.max(total).alias("_grand")]
    for i, t in enumerate(targets):
        hit = F.col(share) >= t
        aggs += [
            F.min(F.when(hit, F.col(rank))).alias(f"_n{i}"),
            F.min(F.when(hit, F.col(total))).alias(f"_r{i}"),
        ]
    one = ranked.agg(*aggs)
    empty = F.col("_grand") == 0
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.when(empty, 0).otherwise(F.coalesce(f"_n{i}", "_rows")).cast("bigint").alias("rows_required_n"),
                F.when(empty, 0).otherwise(F.coalesce(f"_r{i}", "_grand")).cast("bigint").alias("records_reached_n"),
            )
            for i, t in enumerate(targets)
        ]
    )
    out = one.select("_grand", F.explode(rows).alias("_row"))
    return out.select(
        "_row.*",
        F.coalesce(ratio("_row.records_reached_n", "_grand"), F.lit(0.0)).alias("actual_coverage"),
    )
