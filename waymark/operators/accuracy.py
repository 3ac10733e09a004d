"""Entity metrics, interval estimates, threshold grids, recommendations and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.stats import ratio, wilson
from waymark.operators.ranking import null_safe, number_rows, pick_one, quantiles

# Tested thresholds, accuracy targets and bootstrap settings.
SHARE_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
COUNT_GRID = (5, 10, 20, 30, 50)
COVERAGE_GRID = (0.50, 0.70, 0.80, 0.90)
BAND_TARGETS = (("High", 0.90), ("Medium", 0.75))
MIN_BAND_SPECIES = 10
BOOTSTRAP_REPS = 2000
BOOTSTRAP_SEED = 20260727
#: Values of a bootstrap block.
BOOTSTRAP_BLOCK = 4096


def as_fraction(df: DataFrame, *cols: str) -> DataFrame:
    """Percentages become fractions when the column's upper quartile exceeds one.

    Only finite values count for the quartile; all columns are measured in one pass."""
    finite = df.select(*[F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) for c in cols])
    upper = quantiles(finite, cols, 0.75)
    out = df
    for c in cols:
        scale = F.when(upper.select(c).scalar() > 1.0, 100.0).otherwise(1.0)
        value = F.col(c) / scale
        out = out.withColumn(c, F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))
    return out


def majority(df: DataFrame, ks: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per key, the first alphabetically among equals."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*ks, label).agg(F.count(F.lit(1)).alias("n"))
    return pick_one(counts, ks, [F.col("n").desc(), F.col(label).asc()])


def entity_metrics(
    records: DataFrame, key: str, carried: Sequence[str],
    predicted: str = "predicted_label", observed: str = "observed_label",
    weight: str | None = None,
) -> DataFrame:
    """Validation counts, match rate and observed majority per entity.

    Records are summed per (entity, observed label) first, so a very common entity meets
    the per-entity step as a handful of rows. weight holds the count of rows already summed.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    right = F.col(observed) == F.col(predicted)
    per_label = records.groupBy(key, observed).agg(
        F.sum(n).alias("n"), F.sum(F.when(right, n).otherwise(0)).alias("good"),
        *[F.min(c).alias(c) for c in [predicted, *carried]],
    )
    leader = F.min(
        F.when(F.col(observed).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(observed).alias("label")))
    )
    out = per_label.groupBy(key).agg(
        *[F.min(c).alias(c) for c in [predicted, *carried]],
        F.sum("n").alias("validation_records_n"),
        F.sum("good").alias("correct_records_n"),
        F.count(observed).alias("observed_labels_n"),
        leader["label"].alias("observed_dominant"),
    )
    return out.withColumns(
        {
            "record_match_rate": ratio("correct_records_n", "validation_records_n"),
            "dominant_matches": F.coalesce(F.col("observed_dominant") == F.col(predicted), F.lit(False)),
        }
    )


def bootstrap_mean(
    df: DataFrame, value: str, key: str, by: str | None = None,
    reps: int = BOOTSTRAP_REPS, seed: int = BOOTSTRAP_SEED, block: int = BOOTSTRAP_BLOCK,
) -> DataFrame:
    """95% interval of the mean by exact n-out-of-n resampling.

    Values stand in blocks of `block` positions. A replicate first deals its n draws over the
    blocks (a multinomial: every draw names a block by a seeded digest, and only the counts
    leave the task), then each block makes its share of the draws from its own values and
    hands on a sum. What is shuffled is one row per replicate and block.
    """
    group = by or "_g"
    named = df.withColumn("_g", F.lit("all")) if by is None else df
    named = named.where(F.col(value).isNotNull() & ~F.isnan(value)).select(group, key, value)
    # positions follow the key inside each group
    ordered = number_rows(named, [F.col(group).asc_nulls_first(), F.col(key).asc()], "_row")
    ranges = ordered.groupBy(group).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), F.avg(value).alias("mean")
    )
    place = F.col("_row") - F.col("_first")
    blocks = null_safe(ordered, ranges, [group], "inner").groupBy(
        group, F.floor(place / block).cast("long").alias("_block")
    ).agg(F.transform(F.array_sort(F.collect_list(F.struct("_row", F.col(value).alias("_v")))), lambda p: p["_v"]).alias("_values"))

    def number(*parts: Column) -> Column:
        text = F.concat_ws("#", F.lit(str(seed)), *[p.cast("string") for p in parts])
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")

    # few rows with much work behind each: a fixed number of tasks
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = ranges.select(group, "_n", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep")).repartition(tasks, "_rep")
    dealt = turns.select(group, "_n", "_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i")).select(
        group, "_rep", F.floor(number(F.col("_rep"), F.col("_i")) % F.col("_n") / block).cast("long").alias("_block")
    ).groupBy(group, "_rep", "_block").agg(F.count(F.lit(1)).alias("_draws"))
    drawn = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1), F.lit(0.0),
        lambda acc, j: acc + F.get(F.col("_values"), (number(F.col("_rep"), F.col("_block"), j) % F.size("_values")).cast("int")),
    )
    sums = null_safe(dealt, blocks, [group, "_block"], "inner").select(group, "_rep", drawn.alias("_sum"))
    totals = null_safe(sums.groupBy(group, "_rep").agg(F.sum("_sum").alias("_sum")), ranges, [group], "inner")
    means = totals.select(group, (F.col("_sum") / F.col("_n")).alias("_mean"))
    # a group has one mean per replicate
    bounds = means.groupBy(group).agg(
        F.percentile("_mean", 0.025).alias("ci_low"), F.percentile("_mean", 0.975).alias("ci_high")
    )
    base = ranges.select(group, "mean", F.col("_n").alias("n"))
    out = null_safe(base, bounds, [group], "left")
    return out.drop("_g") if by is None else out


def band_accuracy(
    df: DataFrame, band: str, bands: Sequence[str] = ("High", "Medium", "Low"),
    records: str = "validation_records_n", correct: str = "correct_records_n",
    rate: str = "record_match_rate", match: str = "dominant_matches", key: str = "species_key",
    reps: int = BOOTSTRAP_REPS, seed: int = BOOTSTRAP_SEED, block: int = BOOTSTRAP_BLOCK,
) -> DataFrame:
    """Micro, macro and dominant-label accuracy overall and per band, with Wilson bounds and,
    for the macro mean, bootstrap bounds."""
    inside = df.where(F.col(band).isin(list(bands)))
    scopes = df.withColumn(band, F.lit("All")).unionByName(inside.select(*df.columns))
    macro = bootstrap_mean(scopes, rate, key, band, reps, seed, block).select(
        F.col(band).alias("group_name"), F.col("ci_low").alias("macro_low"), F.col("ci_high").alias("macro_high")
    )
    grouped = df.groupingSets([[], [band]], band).agg(
        F.grouping(band).alias("_all"),
        F.count(F.lit(1)).alias("species_n"),
        F.sum(records).alias("records_n"), F.sum(correct).alias("correct_n"),
        F.avg(rate).alias("macro_accuracy"), F.count_if(F.col(match)).alias("matches_n"),
    )
    total = F.max(F.when(F.col("_all") == 1, F.col("species_n"))).over(Window.partitionBy())
    micro = wilson("correct_n", "records_n")
    dominant = wilson("matches_n", "species_n")
    scoped = grouped.withColumn("_total", total).where(
        (F.col("_all") == 1) | F.col(band).isin(list(bands))
    )
    rows = scoped.select(
        F.when(F.col("_all") == 1, "All").otherwise(F.col(band)).alias("group_name"),
        "species_n", "records_n", "correct_n", "matches_n",
        ratio("species_n", "_total").alias("species_coverage"),
        ratio("correct_n", "records_n").alias("micro_accuracy"),
        micro[0].alias("micro_low"), micro[1].alias("micro_high"),
        "macro_accuracy",
        ratio("matches_n", "species_n").alias("dominant_accuracy"),
        dominant[0].alias("dominant_low"), dominant[1].alias("dominant_high"),
    )
    return rows.join(macro, "group_name", "left")


def threshold_grid(
    df: DataFrame, shares: Sequence[float] = SHARE_GRID, counts: Sequence[int] = COUNT_GRID,
    coverages: Sequence[float] = COVERAGE_GRID, share: str = "dominant_proportion",
    count: str = "assigned_records_n", coverage: str = "overlay_coverage",
    match: str = "dominant_matches", rate: str = "record_match_rate",
) -> DataFrame:
    """Accuracy of every threshold combination in one pass over the entities.

    Entities are summed by the highest threshold they pass on each measure; each such cell
    (at most one per grid point) then counts for all thresholds below it. A measure that is
    missing everywhere passes a zero threshold.
    """
    grids = {share: list(shares), count: list(counts), coverage: list(coverages)}

    def level(c: str) -> Column:
        passed = [F.when(F.col(c) >= t, 1).otherwise(0) for t in sorted(grids[c])]
        out = passed[0]
        for p in passed[1:]:
            out = out + p
        return out

    cells = df.groupBy(*[level(c).alias(f"_l_{c}") for c in grids]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(match)).alias("good"),
        F.sum(rate).alias("rates"), F.count(rate).alias("rates_n"),
        *[F.count(c).alias(f"_k_{c}") for c in (count, coverage)],
    )
    whole = Window.partitionBy()
    cells = cells.withColumns(
        {"_all": F.sum("n").over(whole),
         **{f"_known_{c}": F.sum(f"_k_{c}").over(whole) for c in (count, coverage)}}
    )
    spread = cells
    for i, (c, grid) in enumerate(grids.items()):
        grid = sorted(grid)
        reached = F.slice(F.array(*[F.lit(t) for t in grid]), F.lit(1), F.col(f"_l_{c}"))
        if c != share and 0 in grid:
            zero = F.array(F.lit(grid[0]))
            reached = F.when((F.col(f"_known_{c}") == 0), zero).otherwise(reached)
        spread = spread.withColumn(f"_t{i}", F.explode(reached))
    sums = spread.groupBy("_t0", "_t1", "_t2").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("rates").alias("rates"),
        F.sum("rates_n").alias("rates_n"),
    )
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    points = total
    for i, grid in enumerate(grids.values()):
        points = points.withColumn(f"_t{i}", F.explode(F.array(*[F.lit(t) for t in sorted(grid)])))
    full = points.join(sums, ["_t0", "_t1", "_t2"], "left")
    n = F.coalesce("n", F.lit(0))
    good = F.coalesce("good", F.lit(0))
    low, high = wilson(good, n)
    return full.select(
        F.col("_t0").alias("share_threshold"), F.col("_t1").alias("count_threshold"),
        F.col("_t2").alias("coverage_threshold"), n.alias("species_n"), good.alias("matches_n"),
        ratio(n, "_total").alias("species_coverage"), ratio(good, n).alias("accuracy"),
        low.alias("accuracy_low"), high.alias("accuracy_high"),
        ratio("rates", "rates_n").alias("macro_accuracy"),
    )


def select_threshold(
    grid: DataFrame, target: float, min_n: int = MIN_BAND_SPECIES
) -> DataFrame:
    """The widest grid point whose lower bound meets the target, else the best available.

    One row always: without a point of min_n species its thresholds are null and its counts 0.
    """
    enough = grid.where(F.col("species_n") >= min_n)
    meets = F.coalesce(F.col("accuracy_low") >= target, F.lit(False))

    def most(c: str, where: Column) -> Column:
        return F.coalesce(-F.when(where, F.col(c)), F.lit(float("inf")))

    order = [
        (~meets).cast("int"), most("species_coverage", meets), most("accuracy_low", ~meets),
        most("accuracy", ~meets), most("species_coverage", ~meets),
        F.col("share_threshold"), F.col("count_threshold"), F.col("coverage_threshold"),
    ]
    ranked = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *grid.columns)
    best = enough.agg(F.min(ranked).alias("best"))
    counts = [c for c in ("species_n", "matches_n") if c in grid.columns]
    return best.select(
        *[(F.coalesce(f"best.{c}", F.lit(0)) if c in counts else F.col(f"best.{c}")).alias(c) for c in grid.columns],
        F.when(F.col("best").isNull(), "insufficient_validation_species")
        .when(F.col("best._0") == 0, "meets_target_with_ci")
        .otherwise("best_available_but_target_not_confirmed").alias("selection_status"),
    )


def recommend_thresholds(
    calibration: DataFrame, holdout: DataFrame,
    targets: Sequence[tuple[str, float]] = BAND_TARGETS, min_n: int = MIN_BAND_SPECIES,
) -> DataFrame:
    """Chosen thresholds per band with their accuracy on calibration and holdout rows."""
    grid = threshold_grid(calibration)
    held = threshold_grid(holdout).select(
        "share_threshold", "count_threshold", "coverage_threshold",
        F.col("species_n").alias("holdout_species_n"),
        F.col("species_coverage").alias("holdout_coverage"),
        F.col("accuracy").alias("holdout_accuracy"),
        F.col("accuracy_low").alias("holdout_low"), F.col("accuracy_high").alias("holdout_high"),
    )
    out = None
    for band, target in targets:
        one = select_threshold(grid, target, min_n).withColumns(
            {"band": F.lit(band), "target": F.lit(target)}
        )
        out = one if out is None else out.unionByName(one)
    both = out.join(held, ["share_threshold", "count_threshold", "coverage_threshold"], "left")
    none = F.col("selection_status") == "insufficient_validation_species"
    return both.withColumn("holdout_species_n", F.when(none, 0).otherwise(F.col("holdout_species_n")))


def audit(
    n: Column | str, accuracy: Column | str, low: Column | str, target: Column | float,
    min_n: int = MIN_BAND_SPECIES,
) -> Column:
    """What to do with a confidence band given its accuracy and lower bound."""
    n, accuracy, low = (F.col(c) if isinstance(c, str) else c for c in (n, accuracy, low))
    return (
        F.when(n.isNull() | (n < min_n), "INSUFFICIENT_EVIDENCE")
        .when(low >= target, "RETAIN")
        .when(accuracy >= target, "PROVISIONAL_MORE_VALIDATION_NEEDED")
        .otherwise("MODIFY_OR_RESTRICT_AUTOMATIC_USE")
    )


def weighted_coverage(df: DataFrame, flag: Column, weight: str) -> DataFrame:
    sums = df.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("weight_n"),
        F.coalesce(F.sum(F.when(flag, F.col(weight))), F.lit(0)).alias("covered_weight_n"),
    )
    return sums.withColumn("weighted_coverage", ratio("covered_weight_n", "weight_n"))


def performance(df: DataFrame, band: str) -> DataFrame:
    """Counts, rates, unclipped intervals and medians overall and per band."""
    middle = quantiles(df, ["assigned_records_n", "record_match_rate", "dominant_proportion", "overlay_coverage"], 0.5, band)
    medians = middle.select(
        "_all", band, F.col("assigned_records_n").alias("assigned_records_median"), F.col("record_match_rate").alias("match_rate_median"),
        F.col("dominant_proportion").alias("dominant_proportion_median"), F.col("overlay_coverage").alias("overlay_coverage_median"),
    )
    counted = df.groupingSets([[], [band]], band).agg(
        F.grouping(band).cast("int").alias("_all"),
        F.count(F.lit(1)).alias("species_n"),
        F.sum("validation_records_n").alias("validation_records_n"),
        F.sum("correct_records_n").alias("correct_records_n"),
        F.avg("record_match_rate").alias("match_rate_mean"),
        F.count_if("dominant_matches").alias("matches_n"),
    )
    grouped = null_safe(counted, medians, ["_all", band], "left")
    rec = wilson("correct_records_n", "validation_records_n", 1.96, clip=False)
    dom = wilson("matches_n", "species_n", 1.96, clip=False)
    return grouped.withColumns(
        {
            "performance_group": F.when(F.col("_all") == 1, "Overall").otherwise(F.col(band)),
            "weighted_match_rate": ratio("correct_records_n", "validation_records_n"),
            "match_rate_low": rec[0], "match_rate_high": rec[1],
            "dominant_accuracy": ratio("matches_n", "species_n"),
            "dominant_low": dom[0], "dominant_high": dom[1],
        }
    ).drop("_all", *([band] if band != "performance_group" else []))
