"""Accuracy of taxon labels against record labels, thresholds and band audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import tokens as T
from waymark.functions.coords import in_range
from waymark.functions.names import explode_names
from waymark.functions.text import canonical_band, canonical_label, null_tokens, parse_bool, strip
from waymark.operators.accuracy import (
    BAND_TARGETS, BOOTSTRAP_SEED, MIN_BAND_SPECIES, as_fraction, audit, band_accuracy,
    entity_metrics, recommend_thresholds,
)
from waymark.operators.sampling import split
from waymark.operators.validation import join_truth
from waymark.session import cut_lineage

CALIBRATION_FRACTION = 0.70


def species_key(col: str):
    return F.lower(null_tokens(col, T.TRUTH, collapse=True))


def prepare_predictions(taxa: DataFrame, names: str = "input_names") -> DataFrame:
    """One prediction per species name: names exploded, labels canonical, best row kept.

    taxa has input_names, dominant_label, taxon_confidence, dominant_proportion,
    assigned_records_n, overlay_coverage. A species with two different labels fails the job.
    """
    scaled = as_fraction(taxa, "dominant_proportion", "overlay_coverage")
    named = explode_names(scaled, names, "species_name").withColumns(
        {
            "species_key": F.lower("species_name"),
            "predicted_label": canonical_label("dominant_label"),
            "band": canonical_band("taxon_confidence"),
        }
    ).where(F.col("species_key").isNotNull())
    carried = ["predicted_label", "band", "dominant_proportion", "assigned_records_n", "overlay_coverage"]
    # most records first, missing counts last; one aggregate serves the choice and the gate
    order = [F.col("assigned_records_n").isNull(), -F.col("assigned_records_n"), F.col("species_name"), F.col("taxon_key")]
    ranked = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], "species_name", *carried)
    per_key = named.groupBy("species_key").agg(
        F.min(ranked).alias("best"), F.min("predicted_label").alias("lo"), F.max("predicted_label").alias("hi")
    )
    clash = F.raise_error(F.format_string("species %s has conflicting labels", F.col("species_key")))
    label = F.when(F.col("lo") != F.col("hi"), clash.cast("string")).otherwise(F.col("best.predicted_label"))
    return per_key.select(
        "species_key", "best.species_name", label.alias("predicted_label"), *[F.col(f"best.{c}") for c in carried[1:]]
    )


def truth_rows(records: DataFrame, flag: str | None = None, source: str = "final_source") -> DataFrame:
    """Records with a known label at an original coordinate.

    A table without original coordinates must say where its coordinates come from in `source`;
    those called "original" count then."""
    if {"original_latitude", "original_longitude"} <= set(records.columns):
        known = in_range("original_latitude", "original_longitude")
    elif source in records.columns:
        known = F.lower(strip(F.coalesce(F.col(source).cast("string"), F.lit("")))) == "original"
    else:
        raise ValueError(f"truth needs original_latitude and original_longitude, or {source}")
    known = canonical_label("label").isNotNull() & known
    if flag is not None:
        known = known & parse_bool(flag, T.TRUE_LOOKUP)
    return records.where(known).select(
        "row_key", species_key("species").alias("species_key"),
        canonical_label("label").alias("observed_label"),
    ).where(F.col("species_key").isNotNull())


def species_metrics(
    records: DataFrame, predictions: DataFrame, seed: int = BOOTSTRAP_SEED,
    fraction: float = CALIBRATION_FRACTION,
) -> DataFrame:
    """Validation metrics per species with its calibration or holdout side.

    Only this step reads the records. Its one row per species feeds several later steps,
    so it is written once.
    """
    usable = predictions.where(F.col("predicted_label").isNotNull())
    # summed before the join, so a very common species is never gathered in one task
    truth = truth_rows(records).groupBy("species_key", "observed_label").agg(
        F.count(F.lit(1)).alias("n")
    )
    metrics = entity_metrics(
        join_truth(usable, truth, ["species_key"]), "species_key",
        ["band", "dominant_proportion", "assigned_records_n", "overlay_coverage"], weight="n",
    )
    return split(cut_lineage(metrics), "band", fraction, ["species_key"], seed)


def threshold_report(metrics: DataFrame) -> DataFrame:
    sides = F.col("validation_split")
    return recommend_thresholds(
        metrics.where(sides == "calibration"), metrics.where(sides == "holdout")
    )


def band_audit(metrics: DataFrame, min_n: int = MIN_BAND_SPECIES) -> DataFrame:
    """Audit decision per band against its target accuracy."""
    target = F.when(F.col("group_name") == BAND_TARGETS[0][0], BAND_TARGETS[0][1]).otherwise(
        BAND_TARGETS[1][1]
    )
    rows = band_accuracy(metrics, "band").where(
        F.col("group_name").isin([b for b, _ in BAND_TARGETS])
    )
    return rows.withColumn(
        "decision", audit("species_n", "dominant_accuracy", "dominant_low", target, min_n)
    )
