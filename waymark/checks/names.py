"""Checks of species candidates, name-match decisions and review order."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, bridge, check, table
from waymark.checks.evidence import effective, evidence
from waymark.checks.lookups import placed
from waymark.checks.scalars import _NAME_SQL, nulled
from waymark.functions import tokens as T
from waymark.functions.names import caution, corrected_match_problems, first_present, review_type
from waymark.functions.text import map_values
from waymark.functions.names import REVIEW_ACTIONS
from waymark.operators.ranking import rows_for_target, top_n_coverage
from waymark.operators.reporting import category_summary, decision_summary, join_unique
from waymark.plans.labels import cluster_predictions, record_predictions
from waymark.plans.species import (
    accepted_names, candidate_records, exclusions, flatten_response, latest_answers, match_names,
    occurrence_queries, pilot_sample, pilot_summary, prioritise_review, species_table,
)
from waymark.session import cut_lineage

# ---------------------------------------------------------------- candidates

VIEWS["o_pilot"] = rf"""
SELECT species, missing_records_n, evidence_records_n, evidence_labels_n,
  CASE WHEN evidence_records_n = 0 THEN '0_internal_locations' WHEN evidence_records_n <= 2 THEN '1_2_internal_locations'
    WHEN evidence_records_n <= 9 THEN '3_9_internal_locations' ELSE '10plus_internal_locations' END AS sampling_band
FROM (SELECT species, count(*) FILTER (NOT final_valid AND regexp_matches(species, '^[A-Z][A-Za-z.-]+\s+[a-z][A-Za-z.-]+(?:\s|$)')) AS missing_records_n,
    count(*) FILTER (final_source = 'original') AS evidence_records_n,
    count(DISTINCT l) FILTER (final_source = 'original') AS evidence_labels_n
  FROM (SELECT o_final.*, {nulled('label', T.PILOT)} AS l FROM o_final) o WHERE species IS NOT NULL GROUP BY species) t
WHERE missing_records_n > 0"""


@check("a24_species_evidence", "SELECT species, missing_records_n, evidence_records_n, evidence_labels_n FROM o_pilot")
def _(spark, sf):
    return pilot_summary(placed(spark, sf)).drop("sampling_band")


@check("x43_sampling_band", "SELECT sampling_band, count(*) AS species_n FROM o_pilot GROUP BY sampling_band")
def _(spark, sf):
    return pilot_summary(placed(spark, sf)).groupBy("sampling_band").agg(F.count(F.lit(1)).alias("species_n"))


@check(
    "p07_pilot_sample",
    """SELECT species, missing_records_n, evidence_records_n, evidence_labels_n, sampling_band FROM (
      SELECT o_pilot.*, row_number() OVER (PARTITION BY sampling_band ORDER BY md5(concat_ws('#', '20260722', species))) AS r,
        (SELECT count(DISTINCT sampling_band) FROM o_pilot) AS k FROM o_pilot) t
    WHERE r <= ceil(200.0 / k) ORDER BY sampling_band, r LIMIT 200""",
)
def _(spark, sf):
    return pilot_sample(pilot_summary(placed(spark, sf)))


VIEWS["o_species_class"] = _NAME_SQL.replace(
    "(SELECT row_key, name FROM b_name UNION ALL SELECT -1 - row_key, species FROM b_record) u",
    "(SELECT row_key, species AS name FROM b_record) u",
)
VIEWS["o_species_candidate"] = """
SELECT e.row_key, e.species, c.strict_class AS name_flag, coalesce(p.cluster_confidence, 'No cluster') AS cluster_confidence,
  coalesce(p.auto_eligible, FALSE) AS auto_eligible, p.row_key IS NOT NULL AS cluster_candidate, p.predicted_label
FROM o_effective e JOIN o_species_class c ON c.row_key = e.row_key
LEFT JOIN o_record_prediction p ON p.row_key = e.row_key WHERE e.inference_class = 'target'"""


def candidates(spark, sf):
    base = cut_lineage(effective(spark, sf))
    return candidate_records(base, record_predictions(base, cluster_predictions(evidence(spark, sf))))


@check(
    "j19_attach_predictions",
    "SELECT row_key, name_flag, cluster_confidence, auto_eligible, cluster_candidate, predicted_label FROM o_species_candidate",
)
def _(spark, sf):
    return candidates(spark, sf).select(
        "row_key", "name_flag", "cluster_confidence", "auto_eligible", "cluster_candidate", "predicted_label"
    )


@check(
    "a23_species_counters",
    """SELECT species AS species_name, count(*) AS candidate_records_n,
    count(*) FILTER (cluster_confidence = 'High') AS high_records_n, count(*) FILTER (cluster_confidence = 'Medium') AS medium_records_n,
    count(*) FILTER (cluster_confidence = 'Low') AS low_records_n, count(*) FILTER (cluster_confidence = 'Insufficient') AS insufficient_records_n,
    count(*) FILTER (cluster_confidence = 'No cluster') AS no_cluster_records_n, count(*) FILTER (auto_eligible) AS auto_records_n
    FROM o_species_candidate WHERE name_flag = 'clean_binomial' GROUP BY species""",
)
def _(spark, sf):
    return species_table(candidates(spark, sf))


@check(
    "a25_exclusion_counts",
    """SELECT species AS species_name, name_flag, count(*) AS records_n FROM o_species_candidate
    WHERE name_flag NOT IN ('clean_binomial', 'missing_species') GROUP BY species, name_flag""",
)
def _(spark, sf):
    return exclusions(candidates(spark, sf))


# ---------------------------------------------------------------- name matching

VIEWS["o_match"] = r"""
SELECT seq, query_name, request_status, usage, accepted, rank_, status_, kind, conf, ord, alts,
  CASE WHEN request_status <> 'success' THEN 'api_failed' WHEN kind = 'NONE' THEN 'no_match'
    WHEN rank_ <> 'SPECIES' OR ord <> 'Coleoptera' OR status_ NOT IN ('ACCEPTED', 'SYNONYM') OR kind <> 'EXACT' OR conf < 95 THEN 'review'
    WHEN status_ = 'SYNONYM' THEN 'accepted_synonym' ELSE 'accepted_exact' END AS match_decision,
  CASE WHEN request_status <> 'success' THEN 'request failed, retry' WHEN kind = 'NONE' THEN 'no usable match'
    WHEN rank_ <> 'SPECIES' THEN concat('rank: ', rank_) WHEN ord <> 'Coleoptera' THEN concat('order: ', lower(ord))
    WHEN status_ NOT IN ('ACCEPTED', 'SYNONYM') THEN concat('status: ', status_) WHEN kind <> 'EXACT' THEN concat('match type: ', kind)
    WHEN conf < 95 THEN concat('confidence below threshold: ', CAST(conf AS varchar))
    WHEN status_ = 'SYNONYM' THEN 'exact synonym' ELSE 'exact accepted name' END AS match_reason,
  coalesce(accepted, usage) AS taxon_key
FROM (SELECT seq, query_name, request_status, CAST(json_extract_string(body, '$.usageKey') AS bigint) AS usage,
    CAST(json_extract_string(body, '$.acceptedUsageKey') AS bigint) AS accepted, json_extract_string(body, '$.rank') AS rank_,
    json_extract_string(body, '$.status') AS status_, json_extract_string(body, '$.matchType') AS kind,
    CAST(json_extract_string(body, '$.confidence') AS bigint) AS conf, json_extract_string(body, '$.order') AS ord,
    CAST(json_extract(body, '$.alternatives') AS varchar) AS alts FROM b_response) t"""

VIEWS["o_latest"] = "SELECT * FROM o_match m WHERE seq = (SELECT max(seq) FROM b_response r WHERE r.query_name = m.query_name)"


def matched(spark, sf):
    return match_names(bridge(spark, sf, "b_response"))


@check(
    "x39_flatten_response",
    """SELECT seq, usage AS usage_key, accepted AS accepted_key, rank_ AS taxon_rank, kind AS match_type, conf AS confidence,
    CASE WHEN alts = '[]' THEN 0 ELSE 2 END AS alternatives_n, alts AS alternatives_json FROM o_match""",
)
def _(spark, sf):
    flat = flatten_response(bridge(spark, sf, "b_response"), "body")
    return flat.select(
        "seq", F.col("usageKey").alias("usage_key"), F.col("acceptedUsageKey").alias("accepted_key"),
        F.col("rank").alias("taxon_rank"), F.col("matchType").alias("match_type"), "confidence",
        "alternatives_n", "alternatives_json",
    )


@check(
    "x37_match_decision",
    """SELECT seq, match_decision, match_reason, match_decision NOT LIKE 'accepted%' AS manual_review FROM o_match""",
)
def _(spark, sf):
    return matched(spark, sf).select("seq", "match_decision", "match_reason", "manual_review")


@check("x38_preferred_key", "SELECT seq, taxon_key FROM o_match")
def _(spark, sf):
    return matched(spark, sf).select("seq", "taxon_key")


@check(
    "x40_safety_problems",
    """SELECT seq, concat_ws('; ', CASE WHEN request_status <> 'success' THEN 'no_answer' END,
      CASE WHEN rank_ <> 'SPECIES' THEN 'rank' END,
      CASE WHEN upper(ord) <> 'COLEOPTERA' THEN 'order' END,
      CASE WHEN kind <> 'EXACT' THEN 'match_type' END,
      CASE WHEN status_ NOT IN ('ACCEPTED', 'SYNONYM') THEN concat('status:', status_) END) AS problems FROM o_match""",
)
def _(spark, sf):
    df = matched(spark, sf)
    problems = corrected_match_problems(
        F.col("request_status") == "success", F.col("rank"), F.col("order"), F.col("matchType"),
        F.col("status"), F.col("taxon_key"),
    )
    return df.select("seq", problems.alias("problems"))


@check(
    "x41_resolved_name",
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, CASE WHEN p_partkey % 3 = 1 THEN trim(p_name) END, p_brand) AS resolved
    FROM part""",
)
def _(spark, sf):
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select(
        "p_partkey",
        first_present(F.when(k == 0, F.col("p_type")).otherwise(" "), F.when(k == 1, F.col("p_name")), F.lit("nan"), "p_brand").alias("resolved"),
    )


@check(
    "x42_review_type",
    """SELECT seq, CASE WHEN seq % 17 = 0 THEN 'input_placeholder_or_higher_taxon' WHEN rank_ = 'SPECIES' AND kind = 'FUZZY' THEN 'species_level_fuzzy_match'
      WHEN rank_ = 'SPECIES' THEN 'other_species_level_review' WHEN rank_ = 'GENUS' THEN 'higher_rank_match_unsafe' ELSE 'other_review' END AS review_type,
    CASE WHEN seq % 17 = 0 THEN 'exclude unless resolvable to a species' WHEN rank_ = 'SPECIES' AND kind = 'FUZZY' THEN 'confirm spelling, authorship or synonym'
      WHEN rank_ = 'SPECIES' THEN 'inspect the match and its alternatives' ELSE 'find a valid species name; do not use the higher-rank key' END AS suggested_action
    FROM o_match""",
)
def _(spark, sf):
    flag = F.when(F.col("seq") % 17 == 0, "placeholder_or_higher_taxon").otherwise("clean_binomial")
    df = matched(spark, sf).select("seq", review_type(flag, "rank", "matchType").alias("review_type"))
    return df.withColumn("suggested_action", map_values("review_type", REVIEW_ACTIONS, ""))


@check(
    "x44_caution_flag",
    "SELECT seq, CASE WHEN status_ = 'DOUBTFUL' THEN 'GBIF_DOUBTFUL' ELSE '' END AS caution FROM o_match",
)
def _(spark, sf):
    return matched(spark, sf).select("seq", caution("status").alias("caution"))


@check(
    "a19_decision_summary",
    """SELECT scope, match_decision, names_n, round_even(names_n * 100.0::double / sum(names_n) OVER (PARTITION BY scope), 4) AS percentage FROM (
      SELECT 'overall' AS scope, match_decision, count(*) AS names_n FROM o_latest GROUP BY match_decision
      UNION ALL SELECT substr(query_name, 1, 6), match_decision, count(*) FROM o_latest GROUP BY 1, match_decision) t""",
)
def _(spark, sf):
    df = latest_answers(matched(spark, sf)).withColumn("genus_head", F.substring("query_name", 1, 6))
    return decision_summary(df, "match_decision", "genus_head")


@check(
    "p08_latest_decisions",
    "SELECT query_name, seq, match_decision, taxon_key FROM o_latest",
)
def _(spark, sf):
    return latest_answers(matched(spark, sf)).select("query_name", "seq", "match_decision", "taxon_key")


VIEWS["o_accepted"] = """
SELECT query_name AS species, query_name AS resolved_name, match_decision, 'automatic' AS decision_source, status_ AS status,
  taxon_key, seq % 50 AS records_n FROM o_latest WHERE match_decision IN ('accepted_exact', 'accepted_synonym')
UNION ALL SELECT query_name, concat(query_name, ' fixed'), 'accepted_manual_correction', 'manual', 'ACCEPTED', coalesce(accepted, usage), seq % 50
FROM o_latest WHERE match_decision = 'review' AND seq % 2 = 0"""


def accepted(spark, sf):
    latest = latest_answers(matched(spark, sf)).withColumn("records_n", F.col("seq") % 50)
    manual = latest.where("match_decision = 'review'").select(
        F.col("query_name").alias("species"), F.concat("query_name", F.lit(" fixed")).alias("manual_name"),
        F.lit("accepted_manual_correction").alias("manual_decision"), F.lit("ACCEPTED").alias("manual_status"),
        F.col("taxon_key").alias("manual_key"), (F.col("seq") % 2 == 0).alias("include"), "records_n",
    )
    return accepted_names(latest, manual)


@check("u04_accepted_names", "SELECT * FROM o_accepted")
def _(spark, sf):
    return accepted(spark, sf)


@check(
    "a22_query_table",
    """SELECT taxon_key, count(DISTINCT species) AS inputs_n, CAST(sum(records_n) AS bigint) AS records_n,
    string_agg(DISTINCT species, ' | ' ORDER BY species) AS species, string_agg(DISTINCT resolved_name, ' | ' ORDER BY resolved_name) AS resolved_name,
    string_agg(DISTINCT match_decision, ' | ' ORDER BY match_decision) AS match_decision,
    string_agg(DISTINCT decision_source, ' | ' ORDER BY decision_source) AS decision_source,
    string_agg(DISTINCT status, ' | ' ORDER BY status) AS status FROM o_accepted GROUP BY taxon_key""",
)
def _(spark, sf):
    return occurrence_queries(accepted(spark, sf))


@check(
    "a21_joined_names",
    "SELECT p_brand, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS p_name FROM part GROUP BY p_brand",
)
def _(spark, sf):
    return join_unique(table(spark, sf, "part"), "p_brand", "p_name")


# ---------------------------------------------------------------- review order

VIEWS["o_review"] = """
SELECT query_name AS species, CASE WHEN seq % 17 = 0 THEN 'placeholder_or_higher_taxon' ELSE 'clean_binomial' END AS name_flag,
  rank_ AS rank, kind AS match_type, seq % 41 + 5 AS candidate_records_n, CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 41 END AS incremental_records_n
FROM o_match WHERE match_decision IN ('review', 'no_match')"""

VIEWS["o_review"] = VIEWS["o_review"].replace("SELECT query_name AS species", "SELECT concat(query_name, ' ', CAST(seq AS varchar)) AS species")

VIEWS["o_ranked"] = """
SELECT r.*, CAST(cumulative_n AS double) / grand AS cumulative_share, CAST(cumulative_n - incremental_records_n AS double) / grand AS cumulative_share_before,
  CASE WHEN incremental_records_n = 0 THEN 'P0_no_incremental_records'
    WHEN CAST(cumulative_n - incremental_records_n AS double) / grand < 0.5 THEN 'P1_first_50_percent'
    WHEN CAST(cumulative_n - incremental_records_n AS double) / grand < 0.8 THEN 'P2_50_to_80_percent'
    WHEN CAST(cumulative_n - incremental_records_n AS double) / grand < 0.9 THEN 'P3_80_to_90_percent'
    WHEN CAST(cumulative_n - incremental_records_n AS double) / grand < 0.95 THEN 'P4_90_to_95_percent' ELSE 'P5_remaining' END AS priority_band
FROM (SELECT species, candidate_records_n, incremental_records_n,
    CASE WHEN name_flag = 'placeholder_or_higher_taxon' THEN 'input_placeholder_or_higher_taxon'
      WHEN rank = 'SPECIES' AND match_type = 'FUZZY' THEN 'species_level_fuzzy_match'
      WHEN rank = 'SPECIES' THEN 'other_species_level_review' ELSE 'higher_rank_match_unsafe' END AS review_type,
    row_number() OVER w AS priority_rank, CAST(sum(incremental_records_n) OVER (w ROWS UNBOUNDED PRECEDING) AS bigint) AS cumulative_n,
    CAST(sum(incremental_records_n) OVER () AS bigint) AS grand
  FROM o_review WINDOW w AS (ORDER BY incremental_records_n DESC, candidate_records_n DESC, species)) r"""


def reviewed(spark, sf):
    df = matched(spark, sf).where(F.col("match_decision").isin("review", "no_match")).select(
        F.concat_ws(" ", "query_name", F.col("seq").cast("string")).alias("species"),
        F.when(F.col("seq") % 17 == 0, "placeholder_or_higher_taxon").otherwise("clean_binomial").alias("name_flag"),
        "rank", F.col("matchType").alias("match_type"), (F.col("seq") % 41 + 5).alias("candidate_records_n"),
        F.when(F.col("seq") % 3 == 0, F.lit(0)).otherwise(F.col("seq") % 41).cast("bigint").alias("incremental_records_n"),
    )
    return prioritise_review(df)


@check(
    "w08_running_share",
    "SELECT species, priority_rank, cumulative_n, cumulative_share, cumulative_share_before FROM o_ranked",
)
def _(spark, sf):
    return reviewed(spark, sf).select(
        "species", "priority_rank", "cumulative_n", "cumulative_share", "cumulative_share_before"
    )


@check("w09_priority_band", "SELECT species, priority_rank, review_type, priority_band FROM o_ranked")
def _(spark, sf):
    return reviewed(spark, sf).select("species", "priority_rank", "review_type", "priority_band")


@check(
    "w10_top_n_coverage",
    """SELECT top_n, CAST(sum(candidate_records_n) AS bigint) AS candidate_records_n, CAST(sum(incremental_records_n) AS bigint) AS incremental_records_n,
    CAST(sum(incremental_records_n) AS double) / max(grand) AS share
    FROM (SELECT DISTINCT least(n, (SELECT count(*) FROM o_ranked)) AS top_n FROM (VALUES (10), (25), (50), (100), (250), (500), (1000), (2000), (999999999)) v(n)) k
    JOIN (SELECT o_ranked.*, (SELECT sum(incremental_records_n) FROM o_ranked) AS grand FROM o_ranked) r ON r.priority_rank <= k.top_n GROUP BY top_n""",
)
def _(spark, sf):
    return top_n_coverage(
        reviewed(spark, sf), "priority_rank", "incremental_records_n", ["candidate_records_n", "incremental_records_n"]
    )


@check(
    "w11_rows_for_target",
    """SELECT target, min(priority_rank) AS rows_required_n, min(cumulative_n) AS records_reached_n,
    CAST(min(cumulative_n) AS double) / max(total) AS actual_coverage
    FROM (VALUES (0.5::double), (0.8::double), (0.9::double), (0.95::double), (0.99::double)) v(target)
    JOIN (SELECT o_ranked.*, (SELECT sum(incremental_records_n) FROM o_ranked) AS total FROM o_ranked) r ON r.cumulative_share >= target GROUP BY target""",
)
def _(spark, sf):
    return rows_for_target(reviewed(spark, sf), "priority_rank", "cumulative_n", "cumulative_share")


@check(
    "a20_category_summary",
    """SELECT review_type, priority_band, count(*) AS review_species_n, CAST(sum(candidate_records_n) AS bigint) AS candidate_records_n,
    CAST(sum(incremental_records_n) AS bigint) AS incremental_records_n FROM o_ranked GROUP BY review_type, priority_band""",
)
def _(spark, sf):
    return category_summary(
        reviewed(spark, sf), ["review_type", "priority_band"], ["candidate_records_n", "incremental_records_n"], "review_species_n"
    )


@check(
    "p09_review_order",
    """SELECT priority_rank, species, priority_band FROM o_ranked ORDER BY priority_rank""",
)
def _(spark, sf):
    return reviewed(spark, sf).select("priority_rank", "species", "priority_band").orderBy("priority_rank")
