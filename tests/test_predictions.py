"""Predictions per species: the best duplicate stays, conflicting labels fail."""

from __future__ import annotations

import pytest

from waymark.plans.accuracy import prepare_predictions

_COLS = (
    "taxon_key long, input_names string, dominant_label string, taxon_confidence string, "
    "dominant_proportion double, assigned_records_n long, overlay_coverage double"
)


def test_best_duplicate_and_conflict(spark):
    rows = [
        (1, "Genus a", "Nearctic", "high", 0.9, None, 1.0),
        (2, "genus A", "Nearctic", "low", 0.5, 7, 0.4),
        (3, "Genus b", "Nearctic", "medium", 0.7, 3, None),
    ]
    got = {r.species_key: r for r in prepare_predictions(spark.createDataFrame(rows, _COLS)).collect()}
    assert set(got) == {"genus a", "genus b"}
    assert (got["genus a"].assigned_records_n, got["genus a"].overlay_coverage) == (7, 0.4)
    clash = [*rows, (4, "Genus b", "Palearctic", "high", 0.8, 9, 0.9)]
    with pytest.raises(Exception, match="conflicting labels"):
        prepare_predictions(spark.createDataFrame(clash, _COLS)).collect()
