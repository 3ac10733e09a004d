"""Spark against SQL on the small tables. WAYMARK_CHECKS=all runs every registered check;
by default one or two per area run here, and `python -m waymark.checks.run DIR` runs all."""

import os

import pytest

from conftest import SMALL
from waymark.checks import load_all
from waymark.checks.base import ORACLES, QUERIES
from waymark.checks.run import compare, connect

load_all()

FEW = [
    "s04_column_roles", "x01_null_tokens", "x03_fold_key", "x07_clean_place_query", "x09_parse_coord",
    "x31_name_screen", "w01_prioritised_dedupe", "j04_country_resolution", "p01_recovery_funnel",
    "p02_centroid_fill", "p03_direct_labels", "g04_region_centroids", "a07_cluster_predictions",
    "p05_holdout_scores", "p06_record_predictions", "r05_balanced_allocation", "a22_query_table",
    "w11_rows_for_target", "p10_selected_occurrences", "a08_taxon_summary", "m04_threshold_grid",
    "v10_sample_rules", "i01_stream_equals_batch",
]
NAMES = list(QUERIES) if os.environ.get("WAYMARK_CHECKS") == "all" else FEW


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_check(spark, duck, name):
    verdict, _, _ = compare(spark, duck, name, SMALL)
    assert verdict == "ok"


def test_every_check_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["p03_direct_labels", "p06_record_predictions", "p10_selected_occurrences", "j01_site_lookup", "m04_threshold_grid"])
def test_plans_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "ArrowEval"):
        assert node not in plan
