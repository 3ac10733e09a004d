"""Checks of occurrence quality control, balanced selection and taxon confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, bridge, check, regions
from waymark.operators.accuracy import weighted_coverage
from waymark.operators.evidence import taxon_composition
from waymark.operators.occurrences import MAX_PER_TAXON, quality_filter, unique_coordinates, with_identity
from waymark.operators.sampling import balanced_sample
from waymark.plans.occurrences import label_occurrences, select_occurrences, taxon_labels

CAP = 40

VIEWS["o_rule"] = """
SELECT b_occurrence.*, CASE WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'invalid_coordinates'
  WHEN lat = 0 AND lon = 0 THEN 'zero_zero' WHEN uncertainty_m > 100000 THEN 'high_uncertainty'
  WHEN basis IN ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN') THEN 'excluded_basis' END AS failed_rule FROM b_occurrence"""
VIEWS["o_kept"] = """
SELECT o_rule.*, CAST(round_even(lat * 100000, 0) AS bigint) AS ky, CAST(round_even(lon * 100000, 0) AS bigint) AS kx,
  concat(CAST(CAST(floor(lat + 90) AS bigint) AS varchar), '_', CAST(CAST(floor(lon + 180) AS bigint) AS varchar)) AS grid_cell,
  sha256(concat_ws('|', CAST(taxon_key AS varchar), occ_id, CAST(CAST(round_even(lat * 10000000, 0) AS bigint) AS varchar),
    CAST(CAST(round_even(lon * 10000000, 0) AS bigint) AS varchar))) AS stable_hash
FROM o_rule WHERE failed_rule IS NULL"""
VIEWS["o_unique"] = """
SELECT * FROM (SELECT o_kept.*, row_number() OVER (PARTITION BY taxon_key, ky, kx ORDER BY stable_hash, occ_id) AS r FROM o_kept) t WHERE r = 1"""


def _balanced(cap: int) -> str:
    return f"""
SELECT taxon_key, occ_id, grid_cell, stable_hash, lat, lon, n > {cap} AS sampling_applied FROM (
  SELECT u.*, row_number() OVER (PARTITION BY taxon_key ORDER BY CASE WHEN cell_turn = 1 THEN 0 ELSE 1 END, stable_hash, occ_id) AS turn
  FROM (SELECT o_unique.*, count(*) OVER (PARTITION BY taxon_key) AS n,
      row_number() OVER (PARTITION BY taxon_key, grid_cell ORDER BY stable_hash, occ_id) AS cell_turn FROM o_unique) u) v
WHERE turn <= {cap}"""


VIEWS["o_balanced"] = _balanced(1000)


@check("l08_quality_removals", "SELECT failed_rule, count(*) AS removed_n FROM o_rule WHERE failed_rule IS NOT NULL GROUP BY failed_rule")
def _(spark, sf):
    return quality_filter(bridge(spark, sf, "b_occurrence"))[1]


@check("l08_quality_kept", "SELECT taxon_key, occ_id, lat, lon FROM o_kept")
def _(spark, sf):
    return quality_filter(bridge(spark, sf, "b_occurrence"))[0].select("taxon_key", "occ_id", "lat", "lon")


def unique_rows(spark, sf):
    kept, _ = quality_filter(bridge(spark, sf, "b_occurrence"))
    return unique_coordinates(with_identity(kept, ["taxon_key", "occ_id"]), ["taxon_key"], tie=["occ_id"])


@check("w13_unique_coordinates", "SELECT taxon_key, occ_id, stable_hash FROM o_unique")
def _(spark, sf):
    return unique_rows(spark, sf).select("taxon_key", "occ_id", "stable_hash")


@check("w12_cell_firsts_then_fill", _balanced(CAP))
def _(spark, sf):
    out = balanced_sample(unique_rows(spark, sf), ["taxon_key"], CAP, ["stable_hash", "occ_id"])
    return out.select("taxon_key", "occ_id", "grid_cell", "stable_hash", "lat", "lon", "sampling_applied")


@check("r08_balanced_small_cap", _balanced(5))
def _(spark, sf):
    out = balanced_sample(unique_rows(spark, sf), ["taxon_key"], 5, ["stable_hash", "occ_id"])
    return out.select("taxon_key", "occ_id", "grid_cell", "stable_hash", "lat", "lon", "sampling_applied")


@check("p10_selected_occurrences", "SELECT taxon_key, occ_id, grid_cell, stable_hash, sampling_applied FROM o_balanced")
def _(spark, sf):
    return select_occurrences(bridge(spark, sf, "b_occurrence"), MAX_PER_TAXON).select(
        "taxon_key", "occ_id", "grid_cell", "stable_hash", "sampling_applied"
    )


@check(
    "m07_weighted_coverage",
    """SELECT CAST(sum(seq) AS bigint) AS weight_n, CAST(sum(seq) FILTER (raw_success = 'True') AS bigint) AS covered_weight_n,
    CAST(sum(seq) FILTER (raw_success = 'True') AS double) / sum(seq) AS weighted_coverage FROM b_place""",
)
def _(spark, sf):
    return weighted_coverage(bridge(spark, sf, "b_place"), F.col("raw_success") == "True", "seq")


# ---------------------------------------------------------------- taxon labels

VIEWS["o_occ_label"] = """
SELECT o.taxon_key, o.occ_id, o.coordinate_status, o.uncertainty_warning, count(label_raw) AS labelled_regions_n,
  count(DISTINCT label_raw) AS matched_labels_n, CASE WHEN count(DISTINCT label_raw) = 1 THEN min(label_raw) END AS assigned_label,
  CASE WHEN o.coordinate_status <> 'valid' THEN 'invalid_coordinate' WHEN count(label_raw) = 0 THEN 'outside_terrestrial_ecoregions'
    WHEN count(DISTINCT label_raw) > 1 THEN 'ambiguous_realm_boundary' WHEN count(label_raw) > 1 THEN 'assigned_multiple_polygons_same_realm'
    ELSE 'assigned' END AS overlay_status,
  concat(CAST(CAST(round_even(o.lat * 100, 0) AS bigint) AS varchar), '_', CAST(CAST(round_even(o.lon * 100, 0) AS bigint) AS varchar)) AS evidence_unit
FROM (SELECT row_number() OVER () AS i, t.* FROM o_occ_status t) o
LEFT JOIN b_region ON o.coordinate_status = 'valid' AND o.lon BETWEEN x0 AND x1 AND o.lat BETWEEN y0 AND y1
GROUP BY o.i, o.taxon_key, o.occ_id, o.coordinate_status, o.uncertainty_warning, o.lat, o.lon"""

VIEWS["o_taxon_comp"] = """
SELECT taxon_key, assigned_label, count(*) AS records_n, count(DISTINCT evidence_unit) AS units_n FROM o_occ_label
WHERE assigned_label IS NOT NULL GROUP BY taxon_key, assigned_label"""
VIEWS["o_taxon_share"] = """
SELECT c.*, t.records_total, t.units_total, t.labels_n, CAST(c.records_n AS double) / t.records_total AS record_share,
  CAST(c.units_n AS double) / t.units_total AS unit_share
FROM o_taxon_comp c JOIN (SELECT taxon_key, CAST(sum(records_n) AS bigint) AS records_total, CAST(sum(units_n) AS bigint) AS units_total, count(*) AS labels_n
  FROM o_taxon_comp GROUP BY taxon_key) t ON t.taxon_key = c.taxon_key"""
VIEWS["o_taxon"] = """
SELECT b.taxon_key, records_n, valid_records_n, assigned_records_n, unusable_records_n, dominant_label, dominant_proportion,
  coalesce(units, 0) AS assigned_units_n, coalesce(labels, 0) AS labels_n, CAST(assigned_records_n AS double) / records_n AS assignment_coverage,
  CASE WHEN coalesce(units, 0) = 0 THEN 'no_realm_evidence' WHEN units >= 10 AND dominant_proportion >= 0.9 THEN 'high'
    WHEN units >= 5 AND dominant_proportion >= 0.7 THEN 'medium' ELSE 'low' END AS taxon_confidence
FROM (SELECT taxon_key, count(*) AS records_n, count(*) FILTER (coordinate_status = 'valid') AS valid_records_n, count(assigned_label) AS assigned_records_n,
    count(*) FILTER (overlay_status NOT LIKE 'assigned%') AS unusable_records_n FROM o_occ_label GROUP BY taxon_key) b
LEFT JOIN (SELECT taxon_key AS k, max(units_total) AS units, max(labels_n) AS labels, max(unit_share) AS dominant_proportion,
    (array_agg(assigned_label ORDER BY unit_share DESC, records_n DESC, assigned_label))[1] AS dominant_label
  FROM o_taxon_share GROUP BY taxon_key) d ON d.k = b.taxon_key"""


def labelled(spark, sf):
    edges, attrs = regions(spark, sf)
    return label_occurrences(bridge(spark, sf, "b_occurrence"), edges, attrs, cell=None, degrees=2.0)


@check(
    "p11_labelled_occurrences",
    """SELECT taxon_key, occ_id, coordinate_status, uncertainty_warning, labelled_regions_n, matched_labels_n, assigned_label, overlay_status, evidence_unit
    FROM o_occ_label""",
)
def _(spark, sf):
    return labelled(spark, sf).drop("lat", "lon", "uncertainty_m", "basis")


@check("a04_taxon_composition", "SELECT * FROM o_taxon_share")
def _(spark, sf):
    return taxon_composition(labelled(spark, sf), "taxon_key")


@check("a08_taxon_summary", "SELECT * FROM o_taxon")
def _(spark, sf):
    return taxon_labels(labelled(spark, sf))


@check("a09_taxon_confidence", "SELECT taxon_confidence, count(*) AS taxa_n FROM o_taxon GROUP BY taxon_confidence")
def _(spark, sf):
    return taxon_labels(labelled(spark, sf)).groupBy("taxon_confidence").agg(F.count(F.lit(1)).alias("taxa_n"))
