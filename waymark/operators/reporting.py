"""Counts, facets, profiles, inventories and per-key merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.stats import percent
from waymark.functions.text import null_tokens
from waymark.functions import tokens as T
from waymark.operators.ranking import first_k, null_safe, quantiles, rank_sorted


def count_by(df: DataFrame, ks: Sequence[str], name: str = "records_n") -> DataFrame:
    return df.groupBy(*ks).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage of every value, missing included."""
    counts = count_by(df, [col])
    return counts.withColumn("percentage", percent("records_n", counts.agg(F.sum("records_n")).scalar()))


def facets(df: DataFrame, sets: dict[str, Sequence[str]], keep: Column | None = None) -> DataFrame:
    """Long table facet, value, records_n, percentage for several groupings in one pass.

    Each facet is one grouping set over the whole frame; values of several columns are
    joined by ' | '.
    """
    cols = sorted({c for ks in sets.values() for c in ks})
    base = df if keep is None else df.where(keep)
    grouped = base.groupingSets([list(ks) for ks in sets.values()], *cols).agg(
        F.count(F.lit(1)).alias("records_n"), F.grouping_id().alias("_gid")
    )

    def gid(ks: Sequence[str]) -> int:
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in ks)

    name = None
    value = None
    for facet, ks in sets.items():
        here = F.col("_gid") == gid(ks)
        text = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in ks])
        name = F.when(here, facet) if name is None else name.when(here, facet)
        value = F.when(here, text) if value is None else value.when(here, text)
    long = grouped.select(name.alias("facet"), value.alias("value"), "records_n")
    return _with_share(long, "facet", "records_n")


def _with_share(counts: DataFrame, scope: str, n: str) -> DataFrame:
    """Percentages within each scope: totals are an aggregate of their own, joined by the scope."""
    totals = counts.groupBy(F.col(scope).alias("_scope")).agg(F.sum(n).alias("_total"))
    shared = counts.join(totals, F.col(scope) == F.col("_scope"))
    return shared.withColumn("percentage", percent(n, F.col("_total"))).drop("_scope", "_total")


def decision_summary(df: DataFrame, decision: str, by: str) -> DataFrame:
    """Decisions overall and within each band, with the share of that scope."""
    grouped = df.groupingSets([[decision], [by, decision]], by, decision).agg(
        F.count(F.lit(1)).alias("names_n"), F.grouping(by).alias("_all")
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.coalesce(F.col(by), F.lit("missing")))
    scoped = grouped.select(scope.alias("scope"), decision, "names_n")
    return _with_share(scoped, "scope", "names_n")


def category_summary(df: DataFrame, ks: Sequence[str], sums: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*ks).agg(
        F.count(F.lit(1)).alias(name), *[F.sum(s).alias(s) for s in sums]
    )


#: Texts in one part of a merged text.
PART_TEXTS = 1000


def text_parts(
    df: DataFrame, ks: Sequence[str], col: str, sep: str = " | ", size: int = PART_TEXTS
) -> DataFrame:
    """(keys, part, texts_n, col): the sorted distinct values per key, `size` to a part, parts
    numbered from 0 in order. Null values take no part; keys without values have no row.

    This is the form to store and to join with: no row grows with its key. Repeats go by a
    distinct, values are numbered in range partitions, and only a part is gathered.
    """
    pairs = df.select(*ks, col).where(F.col(col).isNotNull()).distinct()
    placed = rank_sorted(pairs, ks, [F.col(col).asc()], "_rank")
    part = F.floor((F.col("_rank") - 1) / size).cast("bigint").alias("part")
    return placed.groupBy(*ks, part).agg(
        F.count(F.lit(1)).alias("texts_n"), F.array_join(F.array_sort(F.collect_list(col)), sep).alias(col)
    )


def joined_texts(parts: DataFrame, ks: Sequence[str], col: str, sep: str = " | ") -> DataFrame:
    """(keys, col): the parts of each key as one text, for a sink that wants it on one row.

    The text is as long as its key's values; what is gathered is one entry per part."""
    inorder = F.array_sort(F.collect_list(F.struct("part", col)))
    return parts.groupBy(*ks).agg(F.array_join(F.transform(inorder, lambda p: p[col]), sep).alias(col))


def join_unique(df: DataFrame, key: str, col: str, sep: str = " | ") -> DataFrame:
    """Sorted distinct non-blank values per key, by way of bounded parts."""
    cleaned = df.select(key, null_tokens(col, T.BLANK).alias(col))
    return joined_texts(text_parts(cleaned, [key], col, sep), [key], col, sep)


def merge_by_key(
    df: DataFrame, key: str, sums: Sequence[str], texts: Sequence[str], distinct_of: str
) -> DataFrame:
    """One row per key: sums, distinct inputs and merged texts (empty if a key has none).

    Sums are an aggregate of their own. The texts of all columns go through bounded parts
    together, as (key, column, value), and join the sums as one row per key.
    """
    cleaned = df.withColumns({c: null_tokens(c, T.BLANK) for c in texts})
    totals = cleaned.groupBy(key).agg(
        F.count_distinct(distinct_of).alias("inputs_n"), *[F.sum(s).alias(s) for s in sums]
    )
    long = cleaned.select(key, *texts).unpivot([key], list(texts), "_column", "_text")
    merged = joined_texts(text_parts(long, [key, "_column"], "_text"), [key, "_column"], "_text")
    wide = merged.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col("_column") == c, F.col("_text"))), F.lit("")).alias(c) for c in texts]
    )
    met = null_safe(totals, wide, [key], "left")
    return met.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def species_counters(df: DataFrame, species: str, band: str, auto: str) -> DataFrame:
    """Candidate records per species by confidence class."""
    def n(level: str) -> Column:
        return F.count_if(F.col(band) == level)

    return df.groupBy(species).agg(
        F.count(F.lit(1)).alias("candidate_records_n"),
        n("High").alias("high_records_n"), n("Medium").alias("medium_records_n"),
        n("Low").alias("low_records_n"), n("Insufficient").alias("insufficient_records_n"),
        n("No cluster").alias("no_cluster_records_n"),
        F.count_if(F.col(auto)).alias("auto_records_n"),
    )


def species_evidence(
    df: DataFrame, species: str, missing: Column, evidence: Column, label: str
) -> DataFrame:
    """Records lacking a place, evidence records and evidence labels per species."""
    marked = df.where(F.col(species).isNotNull()).withColumns(
        {"_missing": missing.cast("int"), "_evidence": evidence.cast("int"),
         "_label": F.when(evidence, F.col(label))}
    )
    return marked.groupBy(species).agg(
        F.sum("_missing").alias("missing_records_n"),
        F.sum("_evidence").alias("evidence_records_n"),
        F.count_distinct("_label").alias("evidence_labels_n"),
    ).where("missing_records_n > 0")


def profile(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = T.POOL) -> DataFrame:
    """Non-missing count and share per column, in one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(null_tokens(F.col(c).cast("string"), tokens)).alias(c) for c in cols],
    )
    long = one.unpivot(["_rows"], list(cols), "column_name", "present_n")
    return long.select(
        "column_name", "present_n", percent("present_n", "_rows").alias("present_pct")
    )


def examples(df: DataFrame, cols: Sequence[str], k: int = 15) -> DataFrame:
    """The k smallest distinct non-missing values of each column, for any k."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"),
                   null_tokens(F.col(c).cast("string"), T.POOL).alias("value")) for c in cols]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
    few = first_k(long.distinct(), ["column_name"], [F.col("value").asc()], k)
    return few.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("examples")
    )


def medians(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Exact medians overall and per group."""
    grouped = df.groupingSets([[], [by]], by).agg(
        F.count(F.lit(1)).alias("rows_n"), F.grouping(by).cast("int").alias("_all"),
    )
    middle = quantiles(df, cols, 0.5, by)
    scope = F.when(F.col("_all") == 1, "Overall").otherwise(F.col(by))
    return null_safe(grouped, middle, ["_all", by], "left").select(
        scope.alias("performance_group"), "rows_n", *[F.col(c).alias(f"{c}_median") for c in cols]
    )


def inventory(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Named counts of a run as metric, value rows, from one aggregate."""
    one = df.agg(*[F.count_if(cond).cast("bigint").alias(name) for name, cond in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")
