"""Occurrence selection and taxon labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.coords import coord_status, evidence_unit, uncertainty_flag, valid_coord
from waymark.operators.evidence import taxon_confidence
from waymark.operators.occurrences import (
    quality_filter, unique_coordinates, with_identity,
)
from waymark.operators.regions import TAXON_STATUS, label_points
from waymark.operators.sampling import balanced_sample


def select_occurrences(
    occurrences: DataFrame, cap: int | None, taxon: str = "taxon_key", record: str = "occ_id",
    degrees: float = 1.0,
) -> DataFrame:
    """Quality-checked, coordinate-unique, spatially balanced records per taxon; no cap keeps all."""
    kept, _ = quality_filter(occurrences)
    named = with_identity(kept, [taxon, record])
    single = unique_coordinates(named, [taxon], tie=[record])
    return balanced_sample(single, [taxon], cap, ["stable_hash", record], degrees=degrees)


def label_occurrences(
    occurrences: DataFrame, edges: DataFrame, attrs: DataFrame, cell: str | None = "grid_cell",
    degrees: float = 1.0,
) -> DataFrame:
    """Occurrences with coordinate status, warning, region label and evidence unit."""
    marked = occurrences.withColumns(
        {
            "coordinate_status": coord_status("lat", "lon"),
            "uncertainty_warning": uncertainty_flag("uncertainty_m"),
        }
    )
    usable = valid_coord("lat", "lon")
    placed = marked.withColumns(
        {"_lat": F.when(usable, F.col("lat")), "_lon": F.when(usable, F.col("lon"))}
    )
    labelled = label_points(placed, "_lat", "_lon", edges, attrs, TAXON_STATUS, degrees)
    zero = F.lit(0).cast("bigint")
    unit = evidence_unit(cell if cell else F.lit(None).cast("string"), "lat", "lon")
    return labelled.withColumns(
        {
            "overlay_status": F.when(usable, F.col("overlay_status")).otherwise("invalid_coordinate"),
            "labelled_regions_n": F.coalesce("labelled_regions_n", zero),
            "matched_labels_n": F.coalesce("matched_labels_n", zero),
            "evidence_unit": unit,
        }
    ).drop("_lat", "_lon", "matched_regions_n", "candidate_list")


def taxon_labels(labelled: DataFrame, taxon: str = "taxon_key", first_of: tuple[str, ...] = ()) -> DataFrame:
    return taxon_confidence(labelled, taxon, first_of=first_of)
