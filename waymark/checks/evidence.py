"""Checks of cluster evidence, hold-out validation, cluster inference and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, bridge, check, records, regions, table
from waymark.checks.lookups import placed
from waymark.checks.scalars import nulled
from waymark.checks import spatial  # noqa: F401  (derived tables)
from waymark.functions import tokens as T
from waymark.operators.evidence import (
    CONFIDENCE_ORDER, cluster_locations, composition, dominant, names_per_group,
    remaining_evidence,
)
from waymark.operators.reporting import inventory
from waymark.operators.sampling import (
    allocate, equal_per_stratum, hash_sample, split, stratified_sample,
)
from waymark.operators.validation import (
    accuracy, assemble, confusion, exclude, keep_keys, key_diff, leakage, pivot_confusion,
)
from waymark.plans.labels import (
    automatic_updates, cluster_predictions, direct_labels, draw_candidates, effective_labels, evidence_pool,
    holdout_candidates, one_candidate_per_cluster, pool_eligibility, record_predictions, score_hidden, update_table,
)
from waymark.session import cut_lineage

#: Hidden locations wanted; a table with fewer eligible clusters hides one of each.
HIDDEN_N = 20
SEED = 42

VIEWS["o_location"] = """
SELECT cluster_id, round_even(original_latitude * 10000, 0) / 10000 AS location_latitude,
  round_even(original_longitude * 10000, 0) / 10000 AS location_longitude, count(*) AS records_at_location_n
FROM o_coord WHERE cluster_id IS NOT NULL AND original_latitude IS NOT NULL
GROUP BY ALL"""

VIEWS["o_evidence"] = """
SELECT l.cluster_id, l.location_latitude, l.location_longitude, l.records_at_location_n,
  count(label_raw) AS labelled_regions_n, count(DISTINCT label_raw) AS matched_labels_n,
  CASE WHEN count(DISTINCT label_raw) = 1 THEN min(label_raw) END AS true_label,
  CASE WHEN count(label_raw) = 0 THEN 'no_realm_polygon_match' WHEN count(DISTINCT label_raw) > 1 THEN 'ambiguous_realm_boundary'
    WHEN count(label_raw) > 1 THEN 'assigned_multiple_polygons_same_realm' ELSE 'assigned' END AS overlay_status
FROM o_location l LEFT JOIN b_region ON location_longitude BETWEEN x0 AND x1 AND location_latitude BETWEEN y0 AND y1
GROUP BY l.cluster_id, l.location_latitude, l.location_longitude, l.records_at_location_n"""

VIEWS["o_comp"] = """
SELECT cluster_id, true_label, count(*) AS n FROM o_evidence WHERE true_label IS NOT NULL GROUP BY cluster_id, true_label"""

# Correlated and aggregate forms on purpose: the Spark side uses windows.
VIEWS["o_lead"] = """
SELECT c.cluster_id, m.top AS dominant_n, m.labels_n, m.assigned_n, count(*) AS tied_n, min(c.true_label) AS dominant_label
FROM o_comp c JOIN (SELECT cluster_id, max(n) AS top, count(*) AS labels_n, CAST(sum(n) AS bigint) AS assigned_n FROM o_comp GROUP BY cluster_id) m
  ON m.cluster_id = c.cluster_id AND m.top = c.n
GROUP BY c.cluster_id, m.top, m.labels_n, m.assigned_n"""

VIEWS["o_cluster"] = """
SELECT e.cluster_id, e.locations_n, e.records_n, e.ambiguous_locations_n, e.unmatched_locations_n,
  coalesce(d.assigned_n, 0) AS assigned_n, coalesce(d.dominant_n, 0) AS dominant_n, coalesce(d.labels_n, 0) AS labels_n,
  coalesce(d.tied_n, 0) AS tied_n, d.dominant_label,
  CAST(d.dominant_n AS double) / d.assigned_n AS dominant_proportion,
  CAST(coalesce(d.assigned_n, 0) AS double) / e.locations_n AS overlay_coverage
FROM (SELECT cluster_id, count(*) AS locations_n, CAST(sum(records_at_location_n) AS bigint) AS records_n,
        count(*) FILTER (overlay_status = 'ambiguous_realm_boundary') AS ambiguous_locations_n,
        count(*) FILTER (overlay_status = 'no_realm_polygon_match') AS unmatched_locations_n
      FROM o_evidence GROUP BY cluster_id) e
LEFT JOIN o_lead d ON d.cluster_id = e.cluster_id"""

VIEWS["o_prediction"] = """
SELECT cluster_id, CASE WHEN confidence <> 'Insufficient' THEN dominant_label END AS predicted_label,
  confidence AS cluster_confidence, locations_n, assigned_n, dominant_n, dominant_proportion, labels_n, tied_n,
  overlay_coverage, confidence IN ('High', 'Medium') AS auto_eligible
FROM (SELECT o_cluster.*, CASE WHEN assigned_n < 3 OR tied_n <> 1 THEN 'Insufficient'
        WHEN assigned_n >= 5 AND dominant_proportion >= 0.90 THEN 'High'
        WHEN dominant_proportion >= 0.70 THEN 'Medium' ELSE 'Low' END AS confidence FROM o_cluster) t"""


def evidence(spark, sf):
    edges, attrs = regions(spark, sf)
    return evidence_pool(records(spark, sf), edges, attrs)


@check("a02_location_counts", "SELECT * FROM o_location")
def _(spark, sf):
    df = records(spark, sf).where("cluster_id IS NOT NULL AND original_latitude IS NOT NULL")
    return cluster_locations(df, "cluster_id", "original_latitude", "original_longitude")


@check(
    "a03_names_per_cluster",
    """SELECT cluster_id, count(DISTINCT species) AS names_n, min(species) AS example_name FROM b_record
    WHERE species IS NOT NULL GROUP BY cluster_id""",
)
def _(spark, sf):
    return names_per_group(bridge(spark, sf, "b_record"), ["cluster_id"], "species")


@check(
    "a04_label_composition",
    """SELECT cluster_id, true_label, n, CAST(n AS double) / (SELECT sum(n) FROM o_comp d WHERE d.cluster_id = c.cluster_id) AS share
    FROM o_comp c""",
)
def _(spark, sf):
    df = evidence(spark, sf).where("true_label IS NOT NULL")
    return composition(df, ["cluster_id"], "true_label")


@check(
    "w03_weighted_shares",
    """SELECT country, site, CAST(sum(seq) AS bigint) AS n, CAST(sum(seq) AS double) / sum(sum(seq)) OVER (PARTITION BY country) AS share
    FROM b_place GROUP BY country, site""",
)
def _(spark, sf):
    return composition(bridge(spark, sf, "b_place"), ["country"], "site", weight="seq")


@check(
    "w02_dominant_label",
    """SELECT cluster_id, locations_n, assigned_n, labels_n, dominant_n, tied_n, dominant_label FROM o_cluster""",
)
def _(spark, sf):
    counts = evidence(spark, sf).groupBy("cluster_id", "true_label").agg(F.count(F.lit(1)).alias("n"))
    return dominant(counts, ["cluster_id"], "true_label", "n")


@check(
    "p04_evidence_pool",
    """SELECT cluster_id, location_latitude, location_longitude, records_at_location_n, labelled_regions_n, matched_labels_n,
    true_label, overlay_status FROM o_evidence""",
)
def _(spark, sf):
    return evidence(spark, sf)


@check(
    "a05_cluster_summary",
    """SELECT c.cluster_id, records_n, locations_n, assigned_n, ambiguous_locations_n, unmatched_locations_n, dominant_label,
    CASE WHEN assigned_n > 0 THEN dominant_n END AS dominant_n, dominant_proportion,
    CASE WHEN assigned_n > 0 THEN labels_n END AS labels_n, assigned_n >= 4 AS eligible,
    CASE WHEN assigned_n >= 4 THEN assigned_n ELSE 0 END AS eligible_locations_n, names_n, example_name
    FROM o_cluster c LEFT JOIN (SELECT cluster_id, count(DISTINCT species) AS names_n, min(species) AS example_name
      FROM o_coord WHERE species IS NOT NULL AND original_latitude IS NOT NULL GROUP BY cluster_id) s ON s.cluster_id = c.cluster_id""",
)
def _(spark, sf):
    return pool_eligibility(records(spark, sf), evidence(spark, sf))


@check("a07_cluster_predictions", "SELECT * FROM o_prediction")
def _(spark, sf):
    return cluster_predictions(evidence(spark, sf))


# ---------------------------------------------------------------- inference

VIEWS["o_effective"] = f"""
SELECT f.row_key, f.record_id, f.cluster_id, f.species, l AS label, coalesce(l, u.assigned_label) AS effective_label,
  CASE WHEN u.assigned_label IS NULL THEN 'none' WHEN l IS NULL THEN 'applied' ELSE 'existing_preserved' END AS update_status,
  CASE WHEN coalesce(l, u.assigned_label) IS NOT NULL THEN 'labelled'
    WHEN f.final_valid THEN 'coordinate_without_label' ELSE 'target' END AS inference_class
FROM (SELECT o_final.*, {nulled('label', T.LABEL)} AS l FROM o_final) f
LEFT JOIN (SELECT row_key, assigned_label FROM o_direct WHERE overlay_status = 'assigned') u ON u.row_key = f.row_key"""

VIEWS["o_record_prediction"] = """
SELECT e.row_key, e.record_id, p.* FROM o_effective e JOIN o_prediction p ON p.cluster_id = e.cluster_id
WHERE e.inference_class = 'target'"""


def effective(spark, sf):
    # the stages before read the records once; their result is written and read twice
    base = cut_lineage(placed(spark, sf))
    edges, attrs = regions(spark, sf)
    return effective_labels(base, update_table(direct_labels(base, edges, attrs)))


def predicted_records(spark, sf):
    return record_predictions(effective(spark, sf), cluster_predictions(evidence(spark, sf)))


@check(
    "l05_inference_classes",
    "SELECT row_key, effective_label, update_status, inference_class FROM o_effective",
)
def _(spark, sf):
    return effective(spark, sf).select("row_key", "effective_label", "update_status", "inference_class")


@check(
    "l06_potential_cluster_targets",
    """SELECT row_key, cluster_id FROM o_effective WHERE inference_class = 'target'
    AND cluster_id IN (SELECT cluster_id FROM o_location)""",
)
def _(spark, sf):
    targets = effective(spark, sf).where("inference_class = 'target'").select("row_key", "cluster_id")
    return keep_keys(targets, evidence(spark, sf).select("cluster_id").distinct(), ["cluster_id"])


@check(
    "p06_record_predictions",
    """SELECT row_key, record_id, cluster_id, predicted_label, cluster_confidence, locations_n, assigned_n, dominant_n,
    dominant_proportion, labels_n, tied_n, overlay_coverage, auto_eligible FROM o_record_prediction""",
)
def _(spark, sf):
    return predicted_records(spark, sf).drop("prediction_method")


@check(
    "l10_automatic_updates",
    """SELECT row_key, record_id, predicted_label AS assigned_label, cluster_confidence AS assignment_confidence, dominant_proportion
    FROM o_record_prediction WHERE cluster_confidence IN ('High', 'Medium')""",
)
def _(spark, sf):
    return automatic_updates(predicted_records(spark, sf)).select(
        "row_key", "record_id", "assigned_label", "assignment_confidence", "dominant_proportion"
    )


@check(
    "a29_inference_inventory",
    """SELECT metric, value FROM (SELECT count(*) AS total, count(*) FILTER (update_status = 'applied') AS applied,
      count(*) FILTER (update_status = 'existing_preserved') AS preserved,
      count(*) FILTER (inference_class = 'target') AS targets,
      count(*) FILTER (inference_class = 'coordinate_without_label') AS coordinate_without_label FROM o_effective) t
    UNPIVOT (value FOR metric IN (total, applied, preserved, targets, coordinate_without_label))""",
)
def _(spark, sf):
    kind, status = F.col("inference_class"), F.col("update_status")
    return inventory(
        effective(spark, sf),
        {"total": F.lit(True), "applied": status == "applied", "preserved": status == "existing_preserved",
         "targets": kind == "target", "coordinate_without_label": kind == "coordinate_without_label"},
    )


# ---------------------------------------------------------------- hold-out

VIEWS["o_candidate"] = """
SELECT e.*, c.locations_n AS cluster_locations_n FROM o_evidence e JOIN o_cluster c ON c.cluster_id = e.cluster_id
WHERE c.assigned_n >= 4 AND c.locations_n >= 4 AND e.true_label IS NOT NULL"""

VIEWS["o_single"] = f"""
SELECT * FROM (SELECT o_candidate.*, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(concat_ws('#', '{SEED}', cluster_id,
    CAST(CAST(round_even(location_latitude * 10000, 0) AS bigint) AS varchar),
    CAST(CAST(round_even(location_longitude * 10000, 0) AS bigint) AS varchar)))) AS place FROM o_candidate) t WHERE place = 1"""

VIEWS["o_cap"] = "SELECT true_label, count(*) AS capacity FROM o_single GROUP BY true_label"


def _proportional(caps: str, n: str) -> str:
    return f"""
SELECT true_label, capacity, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, true_label) <= {n} - sum(f) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT true_label, capacity, {n} * capacity // total AS f, ({n} * capacity) % total AS rest
  FROM (SELECT true_label, capacity, CAST(sum(capacity) OVER () AS bigint) AS total FROM {caps}) a) b"""


VIEWS["o_quota"] = _proportional("o_cap", f"least({HIDDEN_N}, CAST((SELECT sum(capacity) FROM o_cap) AS bigint))")
VIEWS["o_hidden"] = f"""
SELECT printf('H%04d', row_number() OVER (ORDER BY md5(concat_ws('#', '{SEED + 2}', cluster_id)), cluster_id)) AS hidden_id, h.*
FROM (SELECT s.*, q.quota, row_number() OVER (PARTITION BY s.true_label ORDER BY md5(concat_ws('#', '{SEED + 1}', cluster_id)), cluster_id) AS turn
      FROM o_single s JOIN o_quota q ON q.true_label = s.true_label) h WHERE turn <= quota"""

VIEWS["o_rest"] = """
SELECT e.* FROM o_evidence e WHERE cluster_id IN (SELECT cluster_id FROM o_hidden)
AND NOT EXISTS (SELECT 1 FROM o_hidden h WHERE h.cluster_id = e.cluster_id AND h.location_latitude = e.location_latitude
  AND h.location_longitude = e.location_longitude)"""

VIEWS["o_rest_count"] = "SELECT cluster_id, true_label, count(*) AS n FROM o_rest WHERE true_label IS NOT NULL GROUP BY ALL"
VIEWS["o_rest_summary"] = """
SELECT t.cluster_id, t.locations_n, coalesce(a.assigned_n, 0) AS assigned_n, t.locations_n - coalesce(a.assigned_n, 0) AS unassigned_n,
  coalesce(a.labels_n, 0) AS labels_n, a.dominant_label, coalesce(a.dominant_n, 0) AS dominant_n, coalesce(b.tied_n, 0) AS tied_n,
  CAST(a.dominant_n AS double) / a.assigned_n AS dominant_proportion,
  CAST(coalesce(a.assigned_n, 0) AS double) / t.locations_n AS overlay_coverage, coalesce(a.composition_json, '{}') AS composition_json
FROM (SELECT cluster_id, count(*) AS locations_n FROM o_rest GROUP BY cluster_id) t
LEFT JOIN (SELECT cluster_id, CAST(sum(n) AS bigint) AS assigned_n, count(*) AS labels_n, max(n) AS dominant_n,
    (array_agg(true_label ORDER BY n DESC, true_label))[1] AS dominant_label,
    concat('{', string_agg(concat('"', true_label, '":', CAST(n AS varchar)), ',' ORDER BY true_label), '}') AS composition_json
  FROM o_rest_count GROUP BY cluster_id) a ON a.cluster_id = t.cluster_id
LEFT JOIN (SELECT c.cluster_id, count(*) AS tied_n FROM o_rest_count c WHERE n = (SELECT max(n) FROM o_rest_count d WHERE d.cluster_id = c.cluster_id)
  GROUP BY c.cluster_id) b ON b.cluster_id = t.cluster_id"""

VIEWS["o_score"] = """
SELECT s.*, CASE WHEN status = 'predicted' THEN dominant_label END AS predicted_label,
  CASE WHEN status = 'predicted' THEN dominant_label = true_label END AS prediction_correct,
  CASE status WHEN 'no_remaining_evidence' THEN 'not_predicted_no_remaining_evidence'
    WHEN 'insufficient_realm_support' THEN 'not_predicted_insufficient_realm_support'
    WHEN 'ambiguous_dominant_realm_tie' THEN 'not_predicted_ambiguous_tie'
    ELSE CASE WHEN dominant_label = true_label THEN 'correct' ELSE 'wrong_realm' END END AS outcome,
  CASE WHEN status <> 'predicted' THEN 'Insufficient' WHEN assigned_n >= 5 AND dominant_proportion >= 0.9 THEN 'High'
    WHEN dominant_proportion >= 0.7 THEN 'Medium' ELSE 'Low' END AS cluster_confidence
FROM (SELECT h.hidden_id, h.cluster_id, h.true_label, h.records_at_location_n AS records_n, r.dominant_label, r.dominant_proportion,
    coalesce(r.assigned_n, 0) AS assigned_n, coalesce(r.composition_json, '{}') AS composition_json,
    CASE WHEN coalesce(r.locations_n, 0) = 0 THEN 'no_remaining_evidence' WHEN r.assigned_n < 3 THEN 'insufficient_realm_support'
      WHEN r.tied_n > 1 THEN 'ambiguous_dominant_realm_tie' ELSE 'predicted' END AS status
  FROM o_hidden h LEFT JOIN o_rest_summary r ON r.cluster_id = h.cluster_id) s"""


def hidden_and_evidence(spark, sf):
    pool = cut_lineage(evidence(spark, sf))
    single = cut_lineage(one_candidate_per_cluster(pool, pool_eligibility(records(spark, sf), pool), SEED))
    return pool, draw_candidates(single, min(HIDDEN_N, single.count()), SEED)


def scored(spark, sf):
    pool, hidden = hidden_and_evidence(spark, sf)
    return score_hidden(pool, hidden)


@check(
    "l11_valid_label_statuses",
    """SELECT cluster_id, count(*) AS locations_n FROM o_evidence
    WHERE overlay_status IN ('assigned', 'assigned_multiple_polygons_same_realm') GROUP BY cluster_id""",
)
def _(spark, sf):
    from waymark.operators.regions import VALID_STATUSES

    return evidence(spark, sf).where(F.col("overlay_status").isin(list(VALID_STATUSES))).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("locations_n")
    )


@check(
    "r03_one_per_cluster",
    "SELECT cluster_id, location_latitude, location_longitude, true_label FROM o_single",
)
def _(spark, sf):
    pool = evidence(spark, sf)
    single = one_candidate_per_cluster(pool, pool_eligibility(records(spark, sf), pool), SEED)
    return single.select("cluster_id", "location_latitude", "location_longitude", "true_label")


@check("l11_holdout_candidates", "SELECT cluster_id, location_latitude, location_longitude, cluster_locations_n FROM o_candidate")
def _(spark, sf):
    pool = evidence(spark, sf)
    return holdout_candidates(pool, pool_eligibility(records(spark, sf), pool)).select(
        "cluster_id", "location_latitude", "location_longitude", "cluster_locations_n"
    )


@check(
    "r06_hidden_sample",
    """SELECT hidden_id, cluster_id, location_latitude, location_longitude, true_label, cluster_locations_n - 1 AS remaining_locations_n FROM o_hidden""",
)
def _(spark, sf):
    return hidden_and_evidence(spark, sf)[1].select(
        "hidden_id", "cluster_id", "location_latitude", "location_longitude", "true_label", "remaining_locations_n"
    )


@check(
    "j09_key_equality",
    """SELECT side, count(*) AS keys_n FROM (
      SELECT CASE WHEN o.k IS NULL THEN 'left' WHEN c.k IS NULL THEN 'right' ELSE 'both' END AS side
      FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) c
      FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.k) t GROUP BY side""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return key_diff(a, b, ["k"]).groupBy("side").agg(F.count(F.lit(1)).alias("keys_n"))


@check("j10_exclude_hidden", "SELECT cluster_id, location_latitude, location_longitude FROM o_rest")
def _(spark, sf):
    pool, hidden = hidden_and_evidence(spark, sf)
    ks = ["cluster_id", "location_latitude", "location_longitude"]
    return keep_keys(exclude(pool, hidden, ks), hidden.select("cluster_id"), ["cluster_id"]).select(*ks)


@check("j11_leakage_probe", "SELECT count(*) AS probed_n, 0 AS leaked_n FROM o_hidden")
def _(spark, sf):
    pool, hidden = hidden_and_evidence(spark, sf)
    ks = ["cluster_id", "location_latitude", "location_longitude"]
    leaked = leakage(exclude(pool, hidden, ks), hidden, ks).agg(F.count(F.lit(1)))
    return hidden.agg(F.count(F.lit(1)).alias("probed_n")).withColumn("leaked_n", leaked.scalar())


@check(
    "j12_semi_join",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(spark, sf):
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keep_keys(table(spark, sf, "orders", ["o_orderkey", "o_custkey"]), keys, ["o_custkey"]).select("o_orderkey")


@check(
    "j15_assembled_counts",
    """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') AS builders_n,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers_n FROM nation""",
)
def _(spark, sf):
    n = F.count(F.lit(1))
    builders = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").groupBy(
        F.col("c_nationkey").alias("n_nationkey")).agg(n.alias("builders_n"))
    suppliers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(n.alias("suppliers_n"))
    base = table(spark, sf, "nation").select("n_nationkey")
    return assemble(base, [builders, suppliers], ["n_nationkey"], ["builders_n", "suppliers_n"])


@check("a06_remaining_evidence", "SELECT * FROM o_rest_summary")
def _(spark, sf):
    pool, hidden = hidden_and_evidence(spark, sf)
    ks = ["cluster_id", "location_latitude", "location_longitude"]
    rest = keep_keys(exclude(pool, hidden, ks), hidden.select("cluster_id"), ["cluster_id"])
    return remaining_evidence(rest, "cluster_id")


@check(
    "p05_holdout_scores",
    """SELECT hidden_id, cluster_id, true_label, records_n, status AS prediction_status, predicted_label, prediction_correct,
    outcome, cluster_confidence, composition_json FROM o_score""",
)
def _(spark, sf):
    return scored(spark, sf).select(
        "hidden_id", "cluster_id", "true_label", "records_n", "prediction_status", "predicted_label",
        "prediction_correct", "outcome", "cluster_confidence", "composition_json",
    )


def _accuracy_sql(source: str, made: str, good: str, weight: str, by: str | None) -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}rows_n, predicted_n, correct_n, weight_n, predicted_weight_n, correct_weight_n,
      rows_n - predicted_n AS unpredicted_n, predicted_n - correct_n AS incorrect_n,
      CAST(predicted_n AS double) / nullif(rows_n, 0) AS coverage, CAST(correct_n AS double) / nullif(predicted_n, 0) AS accuracy_predicted,
      CAST(correct_n AS double) / nullif(rows_n, 0) AS end_to_end, CAST(predicted_weight_n AS double) / nullif(weight_n, 0) AS weighted_coverage,
      CAST(correct_weight_n AS double) / nullif(predicted_weight_n, 0) AS weighted_accuracy_predicted,
      CAST(correct_weight_n AS double) / nullif(weight_n, 0) AS weighted_end_to_end
      FROM (SELECT {head}count(*) AS rows_n, count(*) FILTER ({made}) AS predicted_n, count(*) FILTER ({good}) AS correct_n,
        CAST(coalesce(sum({weight}), 0) AS bigint) AS weight_n, CAST(coalesce(sum({weight}) FILTER ({made}), 0) AS bigint) AS predicted_weight_n,
        CAST(coalesce(sum({weight}) FILTER ({good}), 0) AS bigint) AS correct_weight_n FROM {source} {group}) t"""


@check(
    "a13_holdout_accuracy",
    _accuracy_sql("o_score", "status = 'predicted'", "coalesce(prediction_correct, FALSE)", "records_n", None),
)
def _(spark, sf):
    return accuracy(scored(spark, sf))


@check(
    "a13_label_accuracy",
    _accuracy_sql("(SELECT * FROM documents LEFT JOIN labels USING (doc_id)) d", "quality IS NOT NULL",
                  "coalesce(quality = toxic, FALSE)", "n_chars", None),
)
def _(spark, sf):
    df = table(spark, sf, "documents", ["doc_id", "n_chars"]).join(table(spark, sf, "labels"), "doc_id", "left")
    return accuracy(df, weight="n_chars", made=F.col("quality").isNotNull(), right=F.col("quality") == F.col("toxic"))


@check(
    "a14_accuracy_by_group",
    "SELECT *, CASE cluster_confidence WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS sort_order FROM ("
    + _accuracy_sql("o_score", "status = 'predicted'", "coalesce(prediction_correct, FALSE)", "records_n", "cluster_confidence")
    + ") g",
)
def _(spark, sf):
    return accuracy(scored(spark, sf), by="cluster_confidence", order=CONFIDENCE_ORDER)


@check(
    "a15_confusion_matrix",
    """SELECT true_label, count(*) FILTER (p = 'AFRICA') AS "AFRICA", count(*) FILTER (p = 'AMERICA') AS "AMERICA",
    count(*) FILTER (p = 'ASIA') AS "ASIA", count(*) FILTER (p = 'EUROPE') AS "EUROPE", count(*) FILTER (p = 'MIDDLE EAST') AS "MIDDLE EAST",
    count(*) FILTER (p = 'UNPREDICTED') AS "UNPREDICTED"
    FROM (SELECT true_label, coalesce(predicted_label, 'UNPREDICTED') AS p FROM o_score) t GROUP BY true_label""",
)
def _(spark, sf):
    long = confusion(scored(spark, sf), "true_label", "predicted_label")
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "UNPREDICTED"]
    return pivot_confusion(long, "true_label", "predicted_label", names)


# ---------------------------------------------------------------- sampling


@check(
    "r01_hash_sample",
    """SELECT row_key, raw_query FROM b_raw_query ORDER BY md5(concat_ws('#', '42', CAST(row_key AS varchar))), row_key LIMIT 100""",
)
def _(spark, sf):
    return hash_sample(bridge(spark, sf, "b_raw_query"), ["row_key"], 100, 42)


@check(
    "r02_equal_per_stratum",
    """SELECT o_orderkey, o_orderpriority FROM (
      SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('#', '7', CAST(o_orderkey AS varchar)))) AS r,
        (SELECT count(DISTINCT o_orderpriority) FROM orders) AS k FROM orders) t
    WHERE r <= ceil(203.0 / k) ORDER BY o_orderpriority, r LIMIT 203""",
)
def _(spark, sf):
    df = table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
    return equal_per_stratum(df, "o_orderpriority", 203, ["o_orderkey"], 7)


VIEWS["o_capacity"] = "SELECT n_name AS true_label, count(*) AS capacity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def _capacities(spark, sf):
    return (
        table(spark, sf, "orders", ["o_custkey"])
        .join(table(spark, sf, "customer", ["c_custkey", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("true_label")).agg(F.count(F.lit(1)).alias("capacity"))
    )


@check("r04_proportional_allocation", _proportional("o_capacity", "1000"))
def _(spark, sf):
    return allocate(_capacities(spark, sf), "true_label", "capacity", 1000, "proportional")


@check(
    "r05_balanced_allocation",
    """WITH lev AS (SELECT max(l) AS l FROM range(0, 2001) r(l) WHERE (SELECT sum(least(capacity, l)) FROM o_capacity) <= 1400),
    base AS (SELECT true_label, capacity, least(capacity, l) AS q, capacity > l AS room FROM o_capacity, lev)
    SELECT true_label, capacity, q + CASE WHEN room AND row_number() OVER (PARTITION BY room ORDER BY true_label) <= 1400 - (SELECT sum(q) FROM base) THEN 1 ELSE 0 END AS quota
    FROM base""",
)
def _(spark, sf):
    return allocate(_capacities(spark, sf), "true_label", "capacity", 1400, "balanced")


@check(
    "r06_stratified_draw",
    """SELECT o_orderkey, o_orderpriority FROM (
      SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('#', '11', CAST(o_orderkey AS varchar)))) AS r
      FROM orders) t WHERE r <= 10 * CAST(substr(o_orderpriority, 1, 1) AS int)""",
)
def _(spark, sf):
    df = table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
    quotas = df.select("o_orderpriority").distinct().withColumn(
        "quota", 10 * F.substring("o_orderpriority", 1, 1).cast("int")
    )
    return stratified_sample(df, "o_orderpriority", quotas, ["o_orderkey"], 11)


@check(
    "r07_calibration_split",
    """SELECT p_partkey, CASE WHEN r <= greatest(1, least(CAST(round_even(n * 0.7::double, 0) AS bigint), n - 1)) THEN 'calibration' ELSE 'holdout' END AS validation_split
    FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws('#', '5', CAST(p_partkey AS varchar)))) AS r,
      count(*) OVER (PARTITION BY p_brand) AS n FROM part) t""",
)
def _(spark, sf):
    return split(table(spark, sf, "part", ["p_partkey", "p_brand"]), "p_brand", 0.7, ["p_partkey"], 5).drop("p_brand")
