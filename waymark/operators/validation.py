"""Hold-out checks: key sets, leakage, outcomes, accuracy, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.stats import ratio
from waymark.operators.evidence import MIN_SUPPORT, confidence
from waymark.operators.ranking import null_safe


def key_diff(a: DataFrame, b: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Keys with the side they occur on: left, right or both."""
    left = a.select(*ks).distinct().withColumn("_a", F.lit(True))
    right = b.select(*ks).distinct().withColumn("_b", F.lit(True))
    joined = left.join(right, list(ks), "full_outer")
    return joined.select(
        *ks,
        F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right")
        .otherwise("both").alias("side"),
    )


def exclude(df: DataFrame, keys: DataFrame, ks: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*ks), list(ks), "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, ks: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*ks), list(ks), "left_semi")


def leakage(df: DataFrame, keys: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Rows of df whose key should have been removed; must be empty."""
    return keep_keys(df, keys, ks)


def join_truth(
    predictions: DataFrame, truth: DataFrame, ks: Sequence[str], how: str = "inner",
    predicted: str = "predicted_label", observed: str = "observed_label",
) -> DataFrame:
    """Truth rows with their prediction and whether it is correct."""
    joined = truth.join(predictions, list(ks), how)
    return joined.withColumn("is_correct", F.col(observed) == F.col(predicted))


def assemble(
    base: DataFrame, parts: Sequence[DataFrame], ks: Sequence[str], zero_fill: Sequence[str] = ()
) -> DataFrame:
    """1:1 assembly of per-key tables; listed counts become zero where absent."""
    out = base
    for part in parts:
        out = null_safe(out, part, ks, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero_fill})


def score_holdout(
    hidden: DataFrame, remaining: DataFrame, cluster: str, truth: str = "true_label",
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """Prediction status, confidence and outcome of every hidden location."""
    joined = hidden.join(remaining, cluster, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in
         ("locations_n", "assigned_n", "unassigned_n", "labels_n", "dominant_n", "tied_n")}
    ).withColumn("composition_json", F.coalesce("composition_json", F.lit("{}")))
    status = (
        F.when(F.col("locations_n") == 0, "no_remaining_evidence")
        .when(F.col("assigned_n") < min_support, "insufficient_realm_support")
        .when(F.col("tied_n") > 1, "ambiguous_dominant_realm_tie")
        .otherwise("predicted")
    )
    made = F.col("prediction_status") == "predicted"
    scored = joined.withColumn("prediction_status", status).withColumns(
        {
            "predicted_label": F.when(made, F.col("dominant_label")),
            "cluster_confidence": confidence(
                F.col("assigned_n"), F.col("tied_n"), F.col("dominant_proportion"), min_support
            ),
        }
    )
    right = F.col("predicted_label") == F.col(truth)
    return scored.withColumn("prediction_correct", F.when(made, right)).withColumn(
        "outcome",
        F.when(F.col("prediction_status") == "no_remaining_evidence", "not_predicted_no_remaining_evidence")
        .when(F.col("prediction_status") == "insufficient_realm_support", "not_predicted_insufficient_realm_support")
        .when(F.col("prediction_status") == "ambiguous_dominant_realm_tie", "not_predicted_ambiguous_tie")
        .when(F.coalesce("prediction_correct", F.lit(False)), "correct")
        .otherwise("wrong_realm"),
    )


def accuracy(
    df: DataFrame, by: str | None = None, weight: str = "records_n",
    made: Column | None = None, right: Column | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Coverage, accuracy among predicted and end-to-end success, by row and by weight.

    order ranks the known groups; unknown and missing groups follow.
    """
    made = F.col("prediction_status") == "predicted" if made is None else made
    made = F.coalesce(made, F.lit(False))
    right = F.col("prediction_correct") if right is None else right
    good = made & F.coalesce(right, F.lit(False))
    w = F.col(weight)
    grouped = df.groupBy(by) if by else df.groupBy()
    sums = grouped.agg(
        F.count(F.lit(1)).alias("rows_n"),
        F.count_if(made).alias("predicted_n"),
        F.count_if(good).alias("correct_n"),
        F.coalesce(F.sum(w), F.lit(0)).alias("weight_n"),
        F.coalesce(F.sum(F.when(made, w)), F.lit(0)).alias("predicted_weight_n"),
        F.coalesce(F.sum(F.when(good, w)), F.lit(0)).alias("correct_weight_n"),
    )
    out = sums.withColumns(
        {
            "unpredicted_n": F.col("rows_n") - F.col("predicted_n"),
            "incorrect_n": F.col("predicted_n") - F.col("correct_n"),
            "coverage": ratio("predicted_n", "rows_n"),
            "accuracy_predicted": ratio("correct_n", "predicted_n"),
            "end_to_end": ratio("correct_n", "rows_n"),
            "weighted_coverage": ratio("predicted_weight_n", "weight_n"),
            "weighted_accuracy_predicted": ratio("correct_weight_n", "predicted_weight_n"),
            "weighted_end_to_end": ratio("correct_weight_n", "weight_n"),
        }
    )
    if by and order:
        places = F.array(*[F.lit(o) for o in order])
        found = F.array_position(places, F.col(by))
        out = out.withColumn(
            "sort_order",
            F.when(F.coalesce(found, F.lit(0)) > 0, found - 1).otherwise(len(order)),
        )
    return out


def confusion(
    df: DataFrame, truth: str, predicted: str, missing: str = "UNPREDICTED"
) -> DataFrame:
    """Counts per truth and prediction, long form; pivot_confusion makes it a matrix."""
    return df.groupBy(
        F.col(truth), F.coalesce(F.col(predicted), F.lit(missing)).alias(predicted)
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_with_totals(df: DataFrame, truth: str, predicted: str, total: str = "Total") -> DataFrame:
    """Long confusion counts with row, column and grand totals."""
    both = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    cube = both.cube(truth, predicted).agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping(truth).alias("_g1"), F.grouping(predicted).alias("_g2"),
    )
    return cube.select(
        F.when(F.col("_g1") == 1, total).otherwise(F.col(truth)).alias(truth),
        F.when(F.col("_g2") == 1, total).otherwise(F.col(predicted)).alias(predicted),
        "n",
    )


def pivot_confusion(
    long: DataFrame, truth: str, predicted: str, labels: Sequence[str]
) -> DataFrame:
    """One column per listed label, zero where nothing was counted."""
    wide = long.groupBy(truth).pivot(predicted, list(labels)).agg(F.sum("n"))
    return wide.select(truth, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])
