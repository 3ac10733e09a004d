"""Data-quality gates: each returns the violations, an empty frame when all is well."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.coords import to_number


class GateFailed(ValueError):
    """A gate found violations."""


def require(name: str, violations: DataFrame, examples: int = 10) -> None:
    """Stop the run when a gate has violations, naming a few of them."""
    found = violations.limit(examples).collect()
    if found:
        raise GateFailed(f"{name}: {[row.asDict() for row in found]}")


def gate_unique(df: DataFrame, ks: Sequence[str]) -> DataFrame:
    return df.groupBy(*ks).agg(F.count(F.lit(1)).alias("rows_n")).where("rows_n > 1")


def gate_ids_agree(updated: DataFrame, key: str, id_col: str) -> DataFrame:
    return updated.where(~F.col("update_id_ok")).select(key, id_col)


def gate_same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both counts, if they differ."""
    a = before.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("before_n"))
    b = after.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("after_n"))
    both = a.unionByName(b).agg(
        F.max(F.when(F.col("side") == "before_n", F.col("n"))).alias("before_n"),
        F.max(F.when(F.col("side") == "after_n", F.col("n"))).alias("after_n"),
    )
    return both.where("before_n <> after_n")


def gate_classes_add_up(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Total and class counts, if the classes do not add up to the total."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_n"),
        *[F.count_if(cond).alias(name) for name, cond in classes.items()],
    )
    parts = reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    return counts.where(F.col("total_n") != parts)


def gate_all_met(updates: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Update rows that meet no record."""
    return updates.join(df.select(key), key, "left_anti")


def gate_expected(inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics whose value differs from the expectation table (metric, expected)."""
    return expected.join(inventory, "metric", "left").where(
        ~F.col("value").eqNullSafe(F.col("expected"))
    )


def gate_no_conflict(df: DataFrame, ks: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with more than one distinct value in any of the columns."""
    counted = df.groupBy(*ks).agg(
        *[F.min(v).alias(f"_lo_{v}") for v in values], *[F.max(v).alias(f"_hi_{v}") for v in values]
    )
    differs = reduce(lambda a, b: a | b, [F.col(f"_lo_{v}") != F.col(f"_hi_{v}") for v in values])
    return counted.where(differs).select(*ks)


def gate_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with missing values and how many."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column_name", "missing_n").where("missing_n > 0")


def gate_holdout_sample(
    sample: DataFrame, n: int, cluster: str, remaining: str, min_remaining: int
) -> DataFrame:
    """Wrong size, repeated clusters or too little evidence left, as one row of counts."""
    checks = sample.agg(
        F.count(F.lit(1)).alias("rows_n"), F.count_distinct(cluster).alias("clusters_n"),
        F.count_if(F.col(remaining) < min_remaining).alias("thin_n"),
    )
    return checks.where((F.col("rows_n") != n) | (F.col("clusters_n") != F.col("rows_n")) | (F.col("thin_n") > 0))


def gate_known_words(df: DataFrame, col: str, words: Iterable[str]) -> DataFrame:
    """Words of a column outside the allowed ones, with their rows."""
    word = F.lower(F.trim(F.col(col).cast("string")))
    return df.select(word.alias("word")).where(F.col("word").isNotNull() & ~F.col("word").isin(list(words))).groupBy(
        "word"
    ).agg(F.count(F.lit(1)).alias("rows_n"))


def gate_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-numeric, negative and fractional values per count column."""
    aggs = []
    for c in cols:
        v = to_number(c)
        aggs.append(
            F.struct(
                F.count_if(v.isNull() & F.col(c).isNotNull()).alias("non_numeric_n"),
                F.count_if(v < 0).alias("negative_n"),
                F.count_if(v % 1 != 0).alias("fractional_n"),
            ).alias(c)
        )
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in cols])
    out = one.select(F.explode(rows).alias("r")).select("r.column_name", "r.v.*")
    return out.where("non_numeric_n + negative_n + fractional_n > 0")


def gate_accepted(df: DataFrame, rank: str, order: str, key: str) -> DataFrame:
    """Accepted names that are not species of the wanted order with a key."""
    def up(c: str) -> Column:
        return F.upper(F.coalesce(F.col(c), F.lit("")))

    return df.where((up(rank) != "SPECIES") | (up(order) != "COLEOPTERA") | F.col(key).isNull())


def flag_disagreements(df: DataFrame, stored: Column, computed: Column) -> DataFrame:
    """How often a stored flag disagrees with the computed one (reported, not fatal)."""
    return df.agg(
        F.count_if(stored.isNotNull()).alias("flag_known_n"),
        F.count_if(stored != computed).alias("disagreements_n"),
    )
