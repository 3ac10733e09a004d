"""Checks of region labelling, overlay roll-ups, centroids and the direct-label plan."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, bridge, check, regions
from waymark.checks.lookups import placed
from waymark.checks.scalars import nulled
from waymark.functions import tokens as T
from waymark.operators.regions import (
    _E, _E2, _QP, _RADIUS, EQUAL_EARTH, NEWTON_STEPS, POOL_STATUS, TAXON_STATUS, build_areas,
    label_distinct_points, label_points, match_points, region_centroids,
    representative_region, roll_up_overlay,
)
from waymark.operators.reporting import facets, inventory, value_counts
from waymark.plans.labels import direct_labels, direct_targets, update_table
from waymark.session import shared_folder
from waymark.sources.regions import load_regions, prepare_regions
from waymark.sources.tables import sink

# The SQL twin tests rectangles with BETWEEN; Spark counts crossings of their edges.
VIEWS["o_hit"] = """
SELECT row_key, final_latitude, final_longitude, region, eco, label_raw
FROM o_final JOIN b_region ON final_longitude BETWEEN x0 AND x1 AND final_latitude BETWEEN y0 AND y1"""

VIEWS["o_overlay"] = """
SELECT f.row_key, count(h.region) AS matched_regions_n, count(DISTINCT h.label_raw) AS matched_labels_n,
  coalesce(string_agg(DISTINCT h.label_raw, '|' ORDER BY h.label_raw), '') AS candidate_list,
  CASE WHEN count(DISTINCT h.label_raw) = 1 THEN min(h.label_raw) END AS assigned_label
FROM o_final f LEFT JOIN o_hit h ON h.row_key = f.row_key GROUP BY f.row_key"""

VIEWS["o_direct"] = f"""
SELECT f.row_key, f.record_id, o.matched_regions_n, o.matched_labels_n, o.candidate_list, o.assigned_label,
  CASE o.matched_labels_n WHEN 0 THEN 'no_terrestrial_realm' WHEN 1 THEN 'assigned' ELSE 'boundary_or_overlap_conflict' END AS overlay_status,
  f.final_source AS source_standard,
  CASE WHEN f.final_source = 'original' THEN 'original_coordinate_overlay' ELSE 'site_geocoding_overlay' END AS assignment_method,
  CASE WHEN f.final_source = 'original' THEN 'High' ELSE 'Medium' END AS assignment_confidence,
  f.final_source = 'original' AS original_match,
  f.final_source = 'original' AND o.matched_labels_n = 1 AS evidence_eligible
FROM o_final f JOIN o_overlay o ON o.row_key = f.row_key
WHERE f.final_valid AND ({nulled('f.label', T.LABEL)}) IS NULL"""

_DIRECT_COLS = (
    "row_key, matched_regions_n, matched_labels_n, candidate_list, assigned_label, overlay_status, "
    "source_standard, assignment_method, assignment_confidence, original_match, evidence_eligible"
)


def direct(spark, sf):
    edges, attrs = regions(spark, sf)
    return direct_labels(placed(spark, sf), edges, attrs)


@check(
    "s13_region_tables",
    """SELECT region, label_raw AS label, 4 AS edges_n FROM b_region""",
)
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    base = f"{shared_folder(spark)}/regions-{uuid.uuid4().hex}"
    sink(edges, f"{base}/edges")
    sink(attrs, f"{base}/attrs")
    kept, named = load_regions(spark, f"{base}/edges", f"{base}/attrs", "label")
    sides = kept.groupBy("region").agg(F.count(F.lit(1)).alias("edges_n"))
    return named.join(sides, "region").select("region", "label", "edges_n")


@check(
    "s14_region_labels",
    """SELECT region, CASE WHEN region % 5 = 1 THEN 'Oceania' ELSE label_raw END AS label FROM b_region WHERE region % 5 <> 2""",
)
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    kind = F.col("region") % 5
    raw = attrs.withColumn(
        "label_in", F.when(kind == 1, " Oceania_simplify_3 ").when(kind == 2, "N/A").otherwise(F.col("label"))
    ).drop("label")
    return prepare_regions(raw, edges, "label_in")[1].select("region", "label")


@check("j08_point_in_region", "SELECT row_key, region FROM o_hit")
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    points = placed(spark, sf).select("row_key", "final_latitude", "final_longitude")
    matched = match_points(points, edges, attrs, "final_latitude", "final_longitude")
    return matched.select("row_key", "region")


@check(
    "g01_label_points",
    "SELECT row_key, matched_regions_n, matched_labels_n, candidate_list, assigned_label FROM o_overlay "
    "JOIN o_final USING (row_key) WHERE final_valid",
)
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    points = placed(spark, sf).where("final_valid")
    out = label_points(points, "final_latitude", "final_longitude", edges, attrs)
    return out.select("row_key", "matched_regions_n", "matched_labels_n", "candidate_list", "assigned_label")


@check(
    "g02_label_distinct_locations",
    """SELECT final_latitude, final_longitude, max(matched_regions_n) AS matched_regions_n,
    max(CASE WHEN matched_labels_n = 0 THEN 'no_realm_polygon_match' WHEN matched_labels_n > 1 THEN 'ambiguous_realm_boundary'
      WHEN matched_regions_n > 1 THEN 'assigned_multiple_polygons_same_realm' ELSE 'assigned' END) AS overlay_status
    FROM o_overlay JOIN o_final USING (row_key) WHERE final_valid GROUP BY final_latitude, final_longitude""",
)
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    points = placed(spark, sf).where("final_valid")
    out = label_distinct_points(points, "final_latitude", "final_longitude", edges, attrs, POOL_STATUS, 2.5)
    return out.select("final_latitude", "final_longitude", "matched_regions_n", "overlay_status")


@check(
    "a10_overlay_roll_up",
    """SELECT row_key, count(*) AS matched_regions_n, count(label) AS labelled_regions_n, count(DISTINCT label) AS matched_labels_n,
    CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS assigned_label,
    CASE WHEN count(DISTINCT label) = 0 THEN 'outside_terrestrial_ecoregions' WHEN count(DISTINCT label) > 1 THEN 'ambiguous_realm_boundary'
      WHEN count(label) > 1 THEN 'assigned_multiple_polygons_same_realm' ELSE 'assigned' END AS overlay_status
    FROM (SELECT row_key, region, CASE WHEN region % 5 <> 0 THEN label_raw END AS label FROM o_hit) t GROUP BY row_key""",
)
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    points = placed(spark, sf).select("row_key", "final_latitude", "final_longitude")
    some = attrs.withColumn("label", F.when(F.col("region") % 5 != 0, F.col("label")))
    matched = match_points(points, edges, some, "final_latitude", "final_longitude")
    return roll_up_overlay(matched, ["row_key"], TAXON_STATUS).drop("candidate_list")


@check(
    "w14_representative_region",
    """SELECT row_key, label, eco FROM (SELECT t.*, row_number() OVER (PARTITION BY row_key ORDER BY label NULLS LAST, eco) AS r
      FROM (SELECT row_key, eco, CASE WHEN region % 5 <> 0 THEN label_raw END AS label FROM o_hit) t) u WHERE r = 1""",
)
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    points = placed(spark, sf).select("row_key", "final_latitude", "final_longitude")
    some = attrs.withColumn("label", F.when(F.col("region") % 5 != 0, F.col("label")))
    matched = match_points(points, edges, some, "final_latitude", "final_longitude")
    named = matched.join(attrs.select("region", "eco"), "region")
    return representative_region(named, ["row_key"], "label", "eco").select("row_key", "label", "eco")


@check(
    "l03_overlay_targets",
    f"SELECT row_key, final_source FROM o_final WHERE final_valid AND ({nulled('label', T.LABEL)}) IS NULL",
)
def _(spark, sf):
    return direct_targets(placed(spark, sf)).select("row_key", "final_source")


@check("p03_direct_labels", f"SELECT {_DIRECT_COLS} FROM o_direct")
def _(spark, sf):
    return direct(spark, sf).select(*_DIRECT_COLS.split(", "))


@check(
    "p03_direct_update_table",
    """SELECT row_key, record_id, assigned_label, assignment_method, assignment_confidence, source_standard, evidence_eligible
    FROM o_direct WHERE overlay_status = 'assigned'""",
)
def _(spark, sf):
    return update_table(direct(spark, sf))


@check(
    "a16_value_counts",
    """SELECT overlay_status, count(*) AS records_n, round_even(count(*) * 100.0::double / sum(count(*)) OVER (), 4) AS percentage
    FROM o_direct GROUP BY overlay_status""",
)
def _(spark, sf):
    return value_counts(direct(spark, sf), "overlay_status")


_FACETS = {
    "source": ["source_standard"], "method": ["assignment_method"],
    "confidence": ["assignment_confidence"], "status": ["overlay_status"],
    "label": ["assigned_label"], "source_by_status": ["source_standard", "overlay_status"],
}


def _facet_sql(sets) -> str:
    parts = [
        f"SELECT '{name}' AS facet, concat_ws(' | ', {', '.join(f'coalesce(CAST({c} AS varchar), {chr(39)}missing{chr(39)})' for c in ks)}) AS value, "
        f"count(*) AS records_n FROM o_direct GROUP BY {', '.join(ks)}"
        for name, ks in sets.items()
    ]
    return (
        "SELECT facet, value, records_n, round_even(records_n * 100.0::double / sum(records_n) OVER (PARTITION BY facet), 4) AS percentage FROM ("
        + " UNION ALL ".join(parts) + ") t"
    )


@check("a17_faceted_summary", _facet_sql(_FACETS))
def _(spark, sf):
    return facets(direct(spark, sf), _FACETS)


@check("a18_paired_facets", _facet_sql({"pair": ["assignment_confidence", "overlay_status"]}))
def _(spark, sf):
    return facets(direct(spark, sf), {"pair": ["assignment_confidence", "overlay_status"]})


@check(
    "a29_overlay_inventory",
    """SELECT metric, value FROM (SELECT count(*) AS targets, count(*) FILTER (overlay_status = 'assigned') AS assigned,
      count(*) FILTER (overlay_status <> 'assigned') AS unassigned, count(*) FILTER (evidence_eligible) AS evidence_eligible FROM o_direct) t
    UNPIVOT (value FOR metric IN (targets, assigned, unassigned, evidence_eligible))""",
)
def _(spark, sf):
    return inventory(
        direct(spark, sf),
        {
            "targets": F.lit(True), "assigned": F.col("overlay_status") == "assigned",
            "unassigned": F.col("overlay_status") != "assigned", "evidence_eligible": F.col("evidence_eligible"),
        },
    )


# ---------------------------------------------------------------- centroids


def _centroid_sql(source: str, key: str) -> str:
    """Rectangle centroids through the projection, with unrolled Newton steps."""
    a1, a2, a3, a4 = EQUAL_EARTH
    r3 = math.sqrt(3)

    def q(lat: str) -> str:
        s = f"sin(radians({lat}))"
        return f"({1 - _E2!r} * ({s} / (1 - {_E2!r} * {s} * {s}) - ln((1 - {_E!r} * {s}) / (1 + {_E!r} * {s})) / {2 * _E!r}))"

    def theta(lat: str) -> str:
        return f"asin({r3 / 2!r} * sin(asin(greatest(-1.0, least(1.0, {q(lat)} / {_QP!r})))))"

    def slope(t: str) -> str:
        return f"({a1} + {3 * a2} * {t}**2 + {7 * a3} * {t}**6 + {9 * a4} * {t}**8)"

    def height(t: str) -> str:
        return f"({a1} * {t} + {a2} * {t}**3 + {a3} * {t}**7 + {a4} * {t}**9)"

    step = "m0"
    ctes = [
        f"edge AS (SELECT {key}, unnest([x0, x1, x1, x0])::double AS ax, unnest([y0, y0, y1, y1])::double AS ay, "
        f"unnest([x1, x1, x0, x0])::double AS bx, unnest([y0, y1, y1, y0])::double AS by_ FROM {source})",
        f"turned AS (SELECT {key}, ax, bx, {theta('ay')} AS ta, {theta('by_')} AS tb FROM edge)",
        f"flat AS (SELECT {key}, {2 * r3 * _RADIUS!r} * radians(ax) * cos(ta) / (3 * {slope('ta')}) AS ax, {_RADIUS!r} * {height('ta')} AS ay, "
        f"{2 * r3 * _RADIUS!r} * radians(bx) * cos(tb) / (3 * {slope('tb')}) AS bx, {_RADIUS!r} * {height('tb')} AS by_ FROM turned)",
        f"m0 AS (SELECT {key}, sum((ax + bx) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)) AS cx, "
        f"sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)) / {_RADIUS!r} AS cy, "
        f"sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)) / {_RADIUS * a1!r} AS t FROM flat GROUP BY {key})",
    ]
    for i in range(1, NEWTON_STEPS + 1):
        ctes.append(f"m{i} AS (SELECT {key}, cx, cy, t - ({height('t')} - cy) / {slope('t')} AS t FROM {step})")
        step = f"m{i}"
    e4, e6 = _E2**2, _E2**3
    return (
        "WITH " + ", ".join(ctes)
        + f" SELECT {key}, round(degrees(b + {_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040!r} * sin(2 * b) + "
        f"{23 * e4 / 360 + 251 * e6 / 3780!r} * sin(4 * b) + {761 * e6 / 45360!r} * sin(6 * b)), 6) AS latitude, "
        f"round(degrees(3 * (cx / {_RADIUS!r}) * {slope('t')} / ({2 * r3!r} * cos(t))), 6) AS longitude "
        f"FROM (SELECT {key}, cx, t, asin(2 * sin(t) / {r3!r}) AS b FROM {step}) u"
    )


VIEWS["o_outer"] = "SELECT * FROM b_region WHERE region < 1000"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@check("g04_region_centroids", _centroid_sql("b_region", "region"))
def _(spark, sf):
    edges, _ = regions(spark, sf)
    return _rounded(region_centroids(edges, ["region"]))


@check("g03_dissolved_centroids", _centroid_sql("o_outer", "label_raw").replace("SELECT label_raw, round", "SELECT label_raw AS label, round"))
def _(spark, sf):
    edges, attrs = regions(spark, sf)
    outer = edges.where("region < 1000").join(attrs.select("region", "label"), "region")
    return _rounded(region_centroids(outer, ["label"]))


@check(
    "g05_dissolved_names",
    "SELECT label_raw AS label, string_agg(eco, ' | ' ORDER BY eco) AS names, count(*) AS map_units_n FROM b_region GROUP BY label_raw",
)
def _(spark, sf):
    _, attrs = regions(spark, sf)
    return build_areas(attrs, "label", "eco")
