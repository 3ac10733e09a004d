"""Label evidence per cluster and per taxon: composition, dominance, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.coords import round_half_even, valid_coord
from waymark.functions.stats import ratio
from waymark.operators.regions import VALID_STATUSES

# Support and purity thresholds of the confidence classes.
MIN_SUPPORT = 3
HIGH_N = 5
HIGH_PURITY = 0.90
MEDIUM_PURITY = 0.70
TAXON_HIGH = (10, 0.90)
TAXON_MEDIUM = (5, 0.70)
CONFIDENCE_ORDER = ("High", "Medium", "Low", "Insufficient")


def composition(
    df: DataFrame, ks: Sequence[str], label: str, weight: str | None = None
) -> DataFrame:
    """Rows (or weights) per key and label with the share inside the key."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(*ks, label).agg(n.alias("n"))
    w = Window.partitionBy(*ks)
    return counted.withColumn("share", ratio("n", F.sum("n").over(w)))


def names_per_group(df: DataFrame, ks: Sequence[str], name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(*ks).agg(
        F.count_distinct(name).alias("names_n"), F.min(name).alias("example_name")
    )


def cluster_locations(
    records: DataFrame, cluster: str, lat: str, lon: str, decimals: int = 4
) -> DataFrame:
    """Records per cluster and independent (rounded) location."""
    rounded = records.withColumns(
        {"location_latitude": round_half_even(lat, decimals),
         "location_longitude": round_half_even(lon, decimals)}
    )
    return rounded.groupBy(cluster, "location_latitude", "location_longitude").agg(
        F.count(F.lit(1)).alias("records_at_location_n")
    )


def dominant(
    counts: DataFrame, ks: Sequence[str], label: str, n: str
) -> DataFrame:
    """Leading label, its count, number of tied leaders, total and labels per key.

    counts has one row per key and label (null label: unlabelled rows). One partitioning by
    key serves the window and the aggregate, over rows already summed per label.
    """
    named = F.col(label).isNotNull()
    top = F.max(F.when(named, F.col(n))).over(Window.partitionBy(*ks))
    leads = named & (F.col(n) == F.col("_top"))
    return counts.withColumn("_top", top).groupBy(*ks).agg(
        F.sum(n).alias("locations_n"),
        F.coalesce(F.sum(F.when(named, F.col(n))), F.lit(0)).alias("assigned_n"),
        F.count(label).alias("labels_n"),
        F.coalesce(F.max("_top"), F.lit(0)).alias("dominant_n"),
        F.count_if(leads).alias("tied_n"),
        F.min(F.when(leads, F.col(label))).alias("dominant_label"),
    )


def confidence(
    assigned: Column, tied: Column, purity: Column, min_support: int = MIN_SUPPORT,
    high_n: int = HIGH_N, high: float = HIGH_PURITY, medium: float = MEDIUM_PURITY,
) -> Column:
    """High/Medium/Low for supported, untied clusters, else Insufficient."""
    formal = (assigned >= min_support) & (tied == 1)
    return (
        F.when(~formal, "Insufficient")
        .when((assigned >= high_n) & (purity >= high), "High")
        .when(purity >= medium, "Medium")
        .otherwise("Low")
    )


def cluster_votes(
    evidence: DataFrame, cluster: str, label: str = "true_label", status: str = "overlay_status"
) -> DataFrame:
    """One row per cluster and valid location with its single label, if it has one.

    Locations listed with several labels stay as locations but do not vote.
    """
    lat, lon = "location_latitude", "location_longitude"
    usable = F.col(status).isin(list(VALID_STATUSES)) & F.col(label).isNotNull()
    vote = F.when(usable, F.col(label))
    return (
        evidence.where(F.col(cluster).isNotNull() & valid_coord(lat, lon))
        .groupBy(cluster, lat, lon)
        .agg(F.min(vote).alias("_lo"), F.max(vote).alias("_hi"))
        .select(cluster, lat, lon, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("vote"),
                (F.col("_lo") != F.col("_hi")).alias("conflicting"))
    )


def predict_clusters(
    evidence: DataFrame, cluster: str, label: str = "true_label", status: str = "overlay_status",
    min_support: int = MIN_SUPPORT, high_n: int = HIGH_N, high: float = HIGH_PURITY,
    medium: float = MEDIUM_PURITY,
) -> DataFrame:
    """One label prediction per cluster from equally voting independent locations."""
    votes = cluster_votes(evidence, cluster, label, status)
    counts = votes.groupBy(cluster, "vote").agg(F.count(F.lit(1)).alias("n"))
    d = dominant(counts, [cluster], "vote", "n").withColumn(
        "dominant_proportion", ratio("dominant_n", "assigned_n")
    )
    level = confidence(
        F.col("assigned_n"), F.col("tied_n"), F.col("dominant_proportion"),
        min_support, high_n, high, medium,
    )
    formal = F.col("cluster_confidence") != "Insufficient"
    return d.withColumn("cluster_confidence", level).select(
        cluster,
        F.when(formal, F.col("dominant_label")).alias("predicted_label"),
        "cluster_confidence", "locations_n", "assigned_n", "dominant_n", "dominant_proportion",
        "labels_n", "tied_n",
        ratio("assigned_n", "locations_n").alias("overlay_coverage"),
        F.col("cluster_confidence").isin("High", "Medium").alias("auto_eligible"),
    )


def cluster_summary(
    evidence: DataFrame, cluster: str, label: str = "true_label", status: str = "overlay_status",
    min_remaining: int = 3,
) -> DataFrame:
    """Evidence counts per cluster, its dominant label and eligibility for hold-out tests."""
    counts = evidence.groupBy(cluster, label, status).agg(
        F.count(F.lit(1)).alias("n"), F.sum("records_at_location_n").alias("records")
    )
    base = counts.groupBy(cluster).agg(
        F.sum("records").alias("records_n"),
        F.sum(F.when(F.col(status) == "ambiguous_realm_boundary", F.col("n")).otherwise(0)).alias("ambiguous_locations_n"),
        F.sum(F.when(F.col(status) == "no_realm_polygon_match", F.col("n")).otherwise(0)).alias("unmatched_locations_n"),
    )
    by_label = counts.groupBy(cluster, label).agg(F.sum("n").alias("n"))
    d = dominant(by_label, [cluster], label, "n")
    eligible = F.col("assigned_n") >= min_remaining + 1
    return base.join(d, cluster).select(
        cluster, "records_n", "locations_n", "assigned_n", "ambiguous_locations_n",
        "unmatched_locations_n", "dominant_label",
        F.when(F.col("assigned_n") > 0, F.col("dominant_n")).alias("dominant_n"),
        ratio("dominant_n", "assigned_n").alias("dominant_proportion"),
        F.when(F.col("assigned_n") > 0, F.col("labels_n")).alias("labels_n"),
        eligible.alias("eligible"),
        F.when(eligible, F.col("assigned_n")).otherwise(0).alias("eligible_locations_n"),
    )


def remaining_evidence(
    evidence: DataFrame, cluster: str, label: str = "true_label", status: str = "overlay_status"
) -> DataFrame:
    """Evidence left per cluster with its label composition as key-sorted JSON."""
    vote = F.when(F.col(status).isin(list(VALID_STATUSES)), F.col(label))
    counts = evidence.withColumn("_vote", vote).groupBy(cluster, "_vote").agg(
        F.count(F.lit(1)).alias("n")
    )
    d = dominant(counts, [cluster], "_vote", "n")
    # one entry per label, so the map is as small as the label set
    entries = F.collect_list(
        F.when(F.col("_vote").isNotNull(), F.struct(F.col("_vote").alias("k"), F.col("n").alias("v")))
    )
    parts = counts.groupBy(cluster).agg(F.array_sort(entries).alias("_e"))
    return d.join(parts, cluster).select(
        cluster, "locations_n", "assigned_n",
        (F.col("locations_n") - F.col("assigned_n")).alias("unassigned_n"),
        "labels_n", "dominant_label", "dominant_n", "tied_n",
        ratio("dominant_n", "assigned_n").alias("dominant_proportion"),
        ratio("assigned_n", "locations_n").alias("overlay_coverage"),
        F.to_json(F.map_from_entries("_e")).alias("composition_json"),
    )


def taxon_confidence(
    records: DataFrame, taxon: str, label: str = "assigned_label",
    status: str = "overlay_status", coord_ok: str = "coordinate_status",
    unit: str = "evidence_unit", high: tuple[int, float] = TAXON_HIGH,
    medium: tuple[int, float] = TAXON_MEDIUM, first_of: Sequence[str] = (),
) -> DataFrame:
    """Evidence summary and confidence per taxon.

    Shares are over evidence units summed by label, so a unit holding two labels counts
    for both. The records are read once: counts per (taxon, label, unit, ...) feed sums per
    label, and those the taxon row, so a very common taxon is spread until its last step.
    """
    usable = F.col(label).isNotNull() & F.col(status).isin(list(VALID_STATUSES))
    unusable = F.col(status).isin(
        "outside_terrestrial_ecoregions", "ambiguous_realm_boundary", "invalid_coordinate"
    )
    cells = records.withColumns(
        {"_usable": usable, "_unusable": unusable, "_valid": F.col(coord_ok) == "valid"}
    ).groupBy(taxon, label, "_usable", "_unusable", "_valid", unit).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in first_of],
    )

    def total(cond: str) -> Column:
        return F.sum(F.when(F.col(cond), F.col("n")).otherwise(0))

    per_label = cells.groupBy(taxon, label).agg(
        F.sum("n").alias("n"), total("_valid").alias("valid"), total("_unusable").alias("unusable"),
        total("_usable").alias("used"),
        F.count_distinct(F.when(F.col("_usable"), F.col(unit))).alias("units"),
        *[F.min(c).alias(c) for c in first_of],
    )
    shared = per_label.withColumn(
        "unit_share", ratio("units", F.sum("units").over(Window.partitionBy(taxon)))
    )
    lead = F.min(
        F.when(
            F.col("used") > 0,
            F.struct((-F.col("unit_share")).alias("s"), (-F.col("used")).alias("u"), F.col(label).alias("label")),
        )
    )
    out = shared.groupBy(taxon).agg(
        *[F.min(c).alias(c) for c in first_of],
        F.sum("n").alias("records_n"), F.sum("valid").alias("valid_records_n"),
        F.sum(F.when(F.col(label).isNotNull(), F.col("n")).otherwise(0)).alias("assigned_records_n"),
        F.sum("unusable").alias("unusable_records_n"), lead.alias("_lead"),
        F.sum("units").alias("assigned_units_n"), F.count_if(F.col("used") > 0).alias("labels_n"),
    ).withColumns(
        {
            "dominant_label": F.col("_lead.label"),
            "dominant_proportion": -F.col("_lead.s"),
            "assignment_coverage": ratio("assigned_records_n", "records_n"),
        }
    ).drop("_lead")
    units, share = F.col("assigned_units_n"), F.col("dominant_proportion")
    return out.withColumn(
        "taxon_confidence",
        F.when(units == 0, "no_realm_evidence")
        .when((units >= high[0]) & (share >= high[1]), "high")
        .when((units >= medium[0]) & (share >= medium[1]), "medium")
        .otherwise("low"),
    )


def taxon_composition(
    records: DataFrame, taxon: str, label: str = "assigned_label",
    status: str = "overlay_status", unit: str = "evidence_unit",
) -> DataFrame:
    """Records and distinct evidence units per taxon and label, with shares."""
    usable = records.where(F.col(label).isNotNull() & F.col(status).isin(list(VALID_STATUSES)))
    counted = usable.groupBy(taxon, label).agg(
        F.count(F.lit(1)).alias("records_n"), F.count_distinct(unit).alias("units_n")
    )
    w = Window.partitionBy(taxon)
    return counted.withColumns(
        {
            "records_total": F.sum("records_n").over(w),
            "units_total": F.sum("units_n").over(w),
            "labels_n": F.count(F.lit(1)).over(w),
        }
    ).withColumns(
        {
            "record_share": ratio("records_n", "records_total"),
            "unit_share": ratio("units_n", "units_total"),
        }
    )
