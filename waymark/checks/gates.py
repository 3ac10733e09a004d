"""Checks of the data-quality gates, on tables that break and tables that keep them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import bridge, check, table
from waymark.checks.evidence import HIDDEN_N, hidden_and_evidence
from waymark.checks.lookups import placed
from waymark.checks.names import accepted, matched
from waymark.functions import tokens as T
from waymark.functions.coords import valid_coord
from waymark.functions.text import null_tokens
from waymark.operators.lookup import apply_updates
from waymark.operators.quality import (
    flag_disagreements, gate_accepted, gate_all_met, gate_classes_add_up, gate_counts,
    gate_expected, gate_holdout_sample, gate_ids_agree, gate_no_conflict, gate_present,
    gate_same_count, gate_unique,
)
from waymark.operators.reporting import inventory
from waymark.operators.validation import exclude, leakage


@check("v01_repeated_keys", "SELECT country, site, count(*) AS rows_n FROM b_place GROUP BY country, site HAVING count(*) > 1")
def _(spark, sf):
    return gate_unique(bridge(spark, sf, "b_place"), ["country", "site"])


@check(
    "v02_update_id_mismatches",
    """SELECT r.row_key, r.record_id FROM b_record r JOIN b_update u ON u.row_key = r.row_key WHERE u.record_id <> r.record_id""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_record").withColumn("label", null_tokens("label", T.LABEL))
    updated = apply_updates(df, bridge(spark, sf, "b_update"), "row_key", "record_id", "label")
    return gate_ids_agree(updated, "row_key", "record_id")


@check(
    "v03_row_count_preserved",
    "SELECT (SELECT count(*) FROM customer) AS before_n, (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey) AS after_n",
)
def _(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return gate_same_count(customer, customer.join(orders, "k"))


def outcome(checked, violations):
    """Rows that a gate looked at and the violations it found."""
    found = violations.agg(F.count(F.lit(1)).alias("violations_n"))
    return checked.agg(F.count(F.lit(1)).alias("checked_n")).withColumn("violations_n", found.scalar())


@check("v03_recovery_keeps_rows", "SELECT count(*) AS checked_n, 0 AS violations_n FROM b_record")
def _(spark, sf):
    recovered = placed(spark, sf)
    return outcome(recovered, gate_same_count(bridge(spark, sf, "b_record"), recovered))


@check(
    "v04_classes_add_up",
    """SELECT count(*) AS total_n, count(*) FILTER (event_type = 'click') AS click_n, count(*) FILTER (event_type = 'error') AS error_n FROM events""",
)
def _(spark, sf):
    kind = F.col("event_type")
    return gate_classes_add_up(table(spark, sf, "events"), {"click_n": kind == "click", "error_n": kind == "error"})


@check("v05_unmet_updates", "SELECT row_key, record_id, assigned_label FROM b_update WHERE row_key NOT IN (SELECT row_key FROM b_record)")
def _(spark, sf):
    return gate_all_met(bridge(spark, sf, "b_update"), bridge(spark, sf, "b_record"), "row_key")


@check(
    "v06_unexpected_counts",
    """SELECT 'customers' AS metric, (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM customer) AS value""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("expected"))
    expected = orders.withColumn("metric", F.lit("customers"))
    same = table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") > 0).alias("expected")).withColumn(
        "metric", F.lit("in_credit")
    )
    counts = inventory(table(spark, sf, "customer"), {"customers": F.lit(True), "in_credit": F.col("c_acctbal") > 0})
    return gate_expected(counts, expected.unionByName(same))


@check(
    "v07_conflicting_values",
    """SELECT country, site FROM b_place GROUP BY country, site HAVING count(DISTINCT lat_text) > 1 OR count(DISTINCT lon_text) > 1""",
)
def _(spark, sf):
    return gate_no_conflict(bridge(spark, sf, "b_place"), ["country", "site"], ["lat_text", "lon_text"])


@check(
    "v08_missing_values",
    """SELECT column_name, missing_n FROM (SELECT count(*) FILTER (species IS NULL) AS species, count(*) FILTER (record_id IS NULL) AS record_id,
      count(*) FILTER (label IS NULL) AS label FROM b_record) t UNPIVOT (missing_n FOR column_name IN (species, record_id, label)) WHERE missing_n > 0""",
)
def _(spark, sf):
    return gate_present(bridge(spark, sf, "b_record"), ["species", "record_id", "label"])


@check("v09_hidden_leakage", "SELECT cluster_id, location_latitude, location_longitude FROM o_hidden")
def _(spark, sf):
    pool, hidden = hidden_and_evidence(spark, sf)
    ks = ["cluster_id", "location_latitude", "location_longitude"]
    kept = leakage(exclude(pool, hidden, ks), hidden, ks)
    return leakage(pool, hidden, ks).unionByName(kept).select(*ks)


@check(
    "v10_sample_rules",
    f"""SELECT count(*) AS rows_n, count(DISTINCT cluster_id) AS clusters_n, count(*) FILTER (cluster_locations_n - 1 < 5) AS thin_n
    FROM o_hidden HAVING count(*) <> {HIDDEN_N + 1} OR count(DISTINCT cluster_id) <> count(*) OR count(*) FILTER (cluster_locations_n - 1 < 5) > 0""",
)
def _(spark, sf):
    _, hidden = hidden_and_evidence(spark, sf)
    # one more is asked for than were drawn, so the gate has something to say
    return gate_holdout_sample(hidden, HIDDEN_N + 1, "cluster_id", "remaining_locations_n", 5)


@check(
    "v11_bad_counts",
    r"""SELECT 'text' AS column_name, count(*) FILTER (text IS NOT NULL AND v IS NULL) AS non_numeric_n, count(*) FILTER (v < 0) AS negative_n,
    count(*) FILTER (v % 1 <> 0) AS fractional_n FROM (SELECT text, CASE WHEN regexp_matches(trim(text), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
      THEN CAST(trim(text) AS double) END AS v FROM b_number_text) t""",
)
def _(spark, sf):
    return gate_counts(bridge(spark, sf, "b_number_text"), ["text", "event_id"])


@check(
    "v12_unsafe_acceptances",
    "SELECT seq, taxon_key FROM o_match WHERE rank_ <> 'SPECIES' OR ord <> 'Coleoptera'",
)
def _(spark, sf):
    return gate_accepted(matched(spark, sf), "rank", "order", "taxon_key").select("seq", "taxon_key")


@check(
    "v12_automatic_acceptances_safe",
    "SELECT count(*) AS checked_n, 0 AS violations_n FROM o_match WHERE match_decision IN ('accepted_exact', 'accepted_synonym')",
)
def _(spark, sf):
    good = matched(spark, sf).where(F.col("match_decision").isin("accepted_exact", "accepted_synonym"))
    return outcome(good, gate_accepted(good, "rank", "order", "taxon_key"))


@check("v08_accepted_without_key", "SELECT count(*) AS checked_n, 0 AS violations_n FROM o_accepted")
def _(spark, sf):
    names = accepted(spark, sf)
    return outcome(names, gate_present(names, ["taxon_key"]))


@check(
    "v13_flag_disagreements",
    """SELECT count(*) FILTER (flag IS NOT NULL) AS flag_known_n, count(*) FILTER (flag <> ok) AS disagreements_n FROM (
      SELECT CASE basis WHEN 'FOSSIL_SPECIMEN' THEN NULL WHEN 'HUMAN_OBSERVATION' THEN TRUE ELSE FALSE END AS flag,
        coordinate_status = 'valid' AS ok FROM o_occ_status) t""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_occurrence")
    stored = F.when(F.col("basis") == "HUMAN_OBSERVATION", True).when(F.col("basis") == "PRESERVED_SPECIMEN", False)
    return flag_disagreements(df, stored, valid_coord("lat", "lon"))
