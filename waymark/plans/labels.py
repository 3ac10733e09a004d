"""From coordinates and cluster evidence to labels: overlay, pool, hold-out, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tokens as T
from waymark.functions.coords import close_to, in_range, valid_coord
from waymark.functions.text import map_values, null_tokens, strip
from waymark.operators.evidence import (
    MIN_SUPPORT, cluster_locations, cluster_summary, names_per_group, predict_clusters,
    remaining_evidence,
)
from waymark.operators.lookup import apply_updates
from waymark.operators.ranking import number_rows
from waymark.operators.regions import (
    DIRECT_STATUS, POOL_STATUS, VALID_STATUSES, label_points,
)
from waymark.operators.sampling import allocate, one_per_group, stratified_sample
from waymark.operators.validation import exclude, keep_keys, score_holdout
from waymark.functions.hashing import draw_key
from waymark.session import cut_lineage

# Assignment method and provenance confidence by coordinate source.
SOURCE_METHOD = {
    "original": "original_coordinate_overlay",
    "osm_raw": "site_geocoding_overlay",
    "osm_clean": "site_geocoding_overlay",
    "google_fallback": "site_geocoding_overlay",
    "province_centroid": "province_centroid_overlay",
    "country_centroid": "country_centroid_overlay",
    "missing_source": "unknown_coordinate_overlay",
}
SOURCE_CONFIDENCE = {
    "original": "High",
    "osm_raw": "Medium",
    "osm_clean": "Medium",
    "google_fallback": "Medium",
    "province_centroid": "Low",
    "country_centroid": "Low",
    "missing_source": "Insufficient",
}
# Fixed value: the method name that consumers of the update table filter on.
CLUSTER_METHOD = "PTP_cluster_realm_inference"


def standard_source(c: str) -> Column:
    return F.coalesce(F.lower(null_tokens(c, T.LABEL)), F.lit("missing_source"))


def direct_targets(records: DataFrame) -> DataFrame:
    """Records with a usable final coordinate and no label."""
    return records.where(
        in_range("final_latitude", "final_longitude") & null_tokens("label", T.LABEL).isNull()
    )


def direct_labels(records: DataFrame, edges: DataFrame, attrs: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Label every target by the region around its final coordinate."""
    target = direct_targets(records).withColumn("source_standard", standard_source("final_source"))
    labelled = label_points(
        target, "final_latitude", "final_longitude", edges, attrs, DIRECT_STATUS, degrees
    )
    same = (
        in_range("original_latitude", "original_longitude")
        & close_to("original_latitude", "final_latitude")
        & close_to("original_longitude", "final_longitude")
    )
    return labelled.withColumns(
        {
            "assignment_method": map_values("source_standard", SOURCE_METHOD, "unknown_coordinate_overlay"),
            "assignment_confidence": map_values("source_standard", SOURCE_CONFIDENCE, "Insufficient"),
            "original_match": same,
        }
    ).withColumn(
        "evidence_eligible",
        (F.col("source_standard") == "original") & F.col("original_match")
        & (F.col("overlay_status") == "assigned"),
    )


def update_table(assignments: DataFrame) -> DataFrame:
    """Narrow table of the labels to apply."""
    return assignments.where(
        (F.col("overlay_status") == "assigned") & F.col("assigned_label").isNotNull()
    ).select(
        "row_key", "record_id", "assigned_label", "assignment_method", "assignment_confidence",
        "source_standard", "evidence_eligible",
    )


def evidence_pool(
    records: DataFrame, edges: DataFrame, attrs: DataFrame, decimals: int = 4, degrees: float = 1.0
) -> DataFrame:
    """Labelled independent locations per cluster, from original coordinates only."""
    candidates = records.where(
        F.col("cluster_id").isNotNull() & in_range("original_latitude", "original_longitude")
    )
    places = cluster_locations(
        candidates, "cluster_id", "original_latitude", "original_longitude", decimals
    )
    labelled = label_points(
        places, "location_latitude", "location_longitude", edges, attrs, POOL_STATUS, degrees
    )
    return labelled.withColumnRenamed("assigned_label", "true_label").drop(
        "candidate_list", "matched_regions_n"
    )


def pool_eligibility(
    records: DataFrame, evidence: DataFrame, min_remaining: int = 3
) -> DataFrame:
    """Cluster summary with species names."""
    candidates = records.where(
        F.col("cluster_id").isNotNull() & in_range("original_latitude", "original_longitude")
    )
    names = names_per_group(candidates, ["cluster_id"], "species")
    return cluster_summary(evidence, "cluster_id", min_remaining=min_remaining).join(
        names, "cluster_id", "left"
    )


def holdout_candidates(evidence: DataFrame, eligibility: DataFrame, min_remaining: int = 3) -> DataFrame:
    """Locations that may be hidden: labelled ones of clusters with enough evidence."""
    return _eligible(_hideable(evidence), eligibility, min_remaining)


def _hideable(evidence: DataFrame) -> DataFrame:
    label = strip("true_label")
    return evidence.where(
        F.col("overlay_status").isin(list(VALID_STATUSES))
        & in_range("location_latitude", "location_longitude")
        & label.isNotNull() & ~label.isin(list(T.VALID_EXACT[:-1]))
    )


def _eligible(places: DataFrame, eligibility: DataFrame, min_remaining: int) -> DataFrame:
    clusters = eligibility.where(
        F.col("eligible") & (F.col("locations_n") >= min_remaining + 1)
    ).select("cluster_id", F.col("locations_n").alias("cluster_locations_n"))
    return places.join(clusters, "cluster_id")


def one_candidate_per_cluster(
    evidence: DataFrame, eligibility: DataFrame, seed: int, min_remaining: int = 3
) -> DataFrame:
    """One drawn location per eligible cluster.

    Whether a cluster is eligible does not depend on the location, so the draw comes first
    and the join sees one row per cluster.
    """
    key = ["cluster_id", "location_latitude_e4", "location_longitude_e4"]
    keyed = _hideable(evidence).withColumns(
        {
            "location_latitude_e4": F.rint(F.col("location_latitude") * 10000.0).cast("bigint"),
            "location_longitude_e4": F.rint(F.col("location_longitude") * 10000.0).cast("bigint"),
        }
    )
    single = one_per_group(keyed, ["cluster_id"], key, seed).drop(*key[1:])
    return _eligible(single, eligibility, min_remaining)


def draw_holdout(
    evidence: DataFrame, eligibility: DataFrame, n: int, seed: int,
    mode: str = "proportional", min_remaining: int = 3,
) -> DataFrame:
    """n hidden locations, at most one per cluster, allocated over labels.

    Asking for more than there are eligible clusters is an error.
    """
    # one row per cluster, read by the allocation and by the draw
    single = cut_lineage(one_candidate_per_cluster(evidence, eligibility, seed, min_remaining))
    return draw_candidates(single, n, seed, mode)


def draw_candidates(single: DataFrame, n: int, seed: int, mode: str = "proportional") -> DataFrame:
    """n of the candidates, which have one row per eligible cluster; more is an error."""
    available = single.count()
    if n > available:
        raise ValueError(f"asked for {n} locations, but only {available} clusters are eligible")
    if mode == "unstratified":
        picked = single.withColumn("_draw", draw_key(seed + 1, "cluster_id")).orderBy(
            "_draw", "cluster_id"
        ).limit(n).drop("_draw")
    else:
        caps = single.groupBy("true_label").agg(F.count(F.lit(1)).alias("capacity"))
        quotas = allocate(caps, "true_label", "capacity", n, mode)
        picked = stratified_sample(single, "true_label", quotas, ["cluster_id"], seed + 1)
    shuffled = picked.withColumn("_draw", draw_key(seed + 2, "cluster_id"))
    named = number_rows(
        shuffled, [F.col("_draw").asc(), F.col("cluster_id").asc()], "hidden_id", fmt="H%04d"
    )
    return named.withColumn("remaining_locations_n", F.col("cluster_locations_n") - 1).drop("_draw")


def score_hidden(evidence: DataFrame, hidden: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Predict every hidden location from what is left of its cluster."""
    ks = ["cluster_id", "location_latitude", "location_longitude"]
    rest = keep_keys(exclude(evidence, hidden, ks), hidden.select("cluster_id").distinct(), ["cluster_id"])
    summary = remaining_evidence(rest, "cluster_id")
    kept = hidden.select(
        "hidden_id", *ks, "true_label", F.col("records_at_location_n").alias("records_n")
    )
    return score_holdout(kept, summary, "cluster_id", min_support=min_support)


def effective_labels(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Records with direct updates applied virtually, and their inference class."""
    cleaned = records.withColumn("label", null_tokens("label", T.LABEL))
    updated = apply_updates(cleaned, updates, "row_key", "record_id", "label")
    valid = valid_coord("final_latitude", "final_longitude")
    gap = F.col("effective_label").isNull()
    return updated.withColumn(
        "inference_class",
        F.when(gap & ~valid, "target").when(gap, "coordinate_without_label").otherwise("labelled"),
    )


def cluster_predictions(evidence: DataFrame) -> DataFrame:
    return predict_clusters(evidence, "cluster_id")


def record_predictions(effective: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster prediction of every target whose cluster has evidence."""
    target = effective.where(
        (F.col("inference_class") == "target") & F.col("cluster_id").isNotNull()
    ).select("row_key", "record_id", "cluster_id")
    return target.join(clusters, "cluster_id").withColumn(
        "prediction_method", F.lit(CLUSTER_METHOD)
    )


def automatic_updates(predictions: DataFrame) -> DataFrame:
    """High and Medium predictions as an update table."""
    return predictions.where(
        F.col("auto_eligible") & F.col("predicted_label").isNotNull()
    ).select(
        "row_key", "record_id", "cluster_id", F.col("predicted_label").alias("assigned_label"),
        F.col("prediction_method").alias("assignment_method"),
        F.col("cluster_confidence").alias("assignment_confidence"),
        "locations_n", "assigned_n", "dominant_n", "dominant_proportion", "labels_n",
        "overlay_coverage",
    )
