"""Point-in-region labelling, overlay roll-up and region centroids over edge tables.

A region layer is edges(region, x0, y0, x1, y1), one row per directed boundary segment of
any ring, plus attributes(region, label, ...). Rings are combined by crossing parity, so
holes and multiple parts need no geometry type.

Labelling is one left equi-join of the points with a cell table. Segments are cut at the
meridians of the grid; a cell carries the pieces that lie in it and one parity bit for all
that lies right of it. The bit is a running sum: two neighbouring pieces right of the cell
cancel at the vertex they share, so only the places where the boundary crosses the cell's
right meridian count, and those below the cell are summed once per (region, column). A piece
stands in the cells it passes and nowhere else. Cells in which a region has more than
`CELL_SEGMENTS` pieces are split into rows, so lists stay short where a boundary is fine (a
segment taller than a row stands in every row it passes).
The table's size depends on the layer and the cell size, never on the points: it is
broadcast only if Spark measures it small, else both sides are shuffled by cell and hot
cells are split at run time. Points are neither deduplicated nor regrouped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import let
from waymark.operators.ranking import null_safe, pick_one
from waymark.operators.reporting import joined_texts, text_parts

#: Pieces of one region in a cell beyond which the cell is split, and the numbers of rows tried.
CELL_SEGMENTS, CELL_ROWS = 64, (4, 8, 16, 32, 64, 128, 256)
#: Degrees by which a piece's rows are widened, against rounding at a cell's edge.
_PAD = 1e-9


def _cell(c: Column | str, degrees: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / degrees).cast("int")


def _row(y: Column, cy: Column, rows: Column, degrees: float) -> Column:
    """Row of a cell that a latitude falls into; outside the cell the first or last one."""
    at = F.floor((y / degrees - cy) * rows).cast("int")
    return F.greatest(F.lit(0), F.least(rows - 1, at))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Piece passes the horizontal line through y strictly right of x (half-open in y)."""
    spans = (e["ya"] <= y) != (e["yb"] <= y)
    at = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
    return spans & F.when(spans, at > x).otherwise(False)


def _touches(e: Column, x: Column, y: Column) -> Column:
    """Point lies on the segment."""
    cross = (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])
    return (
        (cross == 0)
        & (x >= F.least(e["x0"], e["x1"])) & (x <= F.greatest(e["x0"], e["x1"]))
        & (y >= F.least(e["y0"], e["y1"])) & (y <= F.greatest(e["y0"], e["y1"]))
    )


def cut_segments(edges: DataFrame, degrees: float) -> DataFrame:
    """(region, cx, e, low, high): the segments cut at the meridians between columns.

    e holds the whole segment, the latitudes `ya` and `yb` between which the piece runs, and
    `cut`, the latitude at which it goes on into the next column (null if it does not). The
    two pieces that meet at a meridian have the same latitude there, bit for bit.
    """
    ends = edges.select(
        "region", "x0", "y0", "x1", "y1", _cell("x0", degrees).alias("c0"), _cell("x1", degrees).alias("c1"),
    ).withColumn("cx", F.explode(F.sequence(F.least("c0", "c1"), F.greatest("c0", "c1"))))

    def latitude(meridian: Column) -> Column:
        at = F.col("y0") + F.try_divide((meridian * F.lit(degrees) - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("x1") - F.col("x0"))
        return F.greatest(F.least("y0", "y1"), F.least(F.greatest("y0", "y1"), at))

    more = F.col("cx") < F.greatest("c0", "c1")
    right = F.when(more, latitude(F.col("cx") + 1))
    left = F.when(F.col("cx") > F.least("c0", "c1"), latitude(F.col("cx")))
    onward = F.col("c0") <= F.col("c1")  # from west to east
    west = F.coalesce(left, F.when(onward, F.col("y0")).otherwise(F.col("y1")))
    east = F.coalesce(right, F.when(onward, F.col("y1")).otherwise(F.col("y0")))
    cut = ends.withColumns({"ya": west, "yb": east, "cut": right})
    return cut.select(
        "region", "cx", F.struct("x0", "y0", "x1", "y1", "ya", "yb", "cut").alias("e"),
        (F.least("ya", "yb") - _PAD).alias("low"), (F.greatest("ya", "yb") + _PAD).alias("high"),
    )


def build_cover(edges: DataFrame, degrees: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The rows (cx, cy, row, region, odd, segments) that a region reaches, and (cx, cy, rows)
    of the cells that are split into more than one row.

    `odd` is the parity of what lies right of the cell's pieces; a row without pieces lies
    inside the region if it is odd, and is left out otherwise.
    """
    pieces = cut_segments(edges, degrees)
    placed = pieces.withColumn("cy", F.explode(F.sequence(_cell("low", degrees), _cell("high", degrees))))
    held = placed.groupBy("region", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    splits = _split_cells(placed, held, degrees)
    rows = F.coalesce("rows", F.lit(1))
    listed = placed.join(splits, ["cx", "cy"], "left").withColumn("rows", rows)
    first, last = (_row(F.col(c), F.col("cy"), F.col("rows"), degrees) for c in ("low", "high"))
    ends_here = F.col("cy") == _cell("high", degrees)
    lists = listed.select(
        "region", "cx", "cy", "e", last.alias("_last"), ends_here.alias("_ends"), F.explode(F.sequence(first, last)).alias("row"),
    ).groupBy("region", "cx", "cy", "row").agg(
        F.collect_list("e").alias("segments"),
        F.count_if(F.col("e.cut").isNotNull() & F.col("_ends") & (F.col("row") == F.col("_last"))).alias("_cuts"),
    )
    # every row between a column's lowest and highest piece
    column = held.groupBy("region", "cx").agg(F.min("cy").alias("_c0"), F.max("cy").alias("_c1"))
    cells = column.select("region", "cx", F.explode(F.sequence("_c0", "_c1")).alias("cy"))
    grid = cells.join(splits, ["cx", "cy"], "left").select(
        "region", "cx", "cy", F.explode(F.sequence(F.lit(0), rows - 1)).alias("row")
    )
    below = Window.partitionBy("region", "cx").orderBy("cy", "row").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.coalesce("_cuts", F.lit(0))).over(below), F.lit(0)) % 2 == 1
    cover = grid.join(lists, ["region", "cx", "cy", "row"], "left").withColumn("odd", odd)
    return cover.where(F.col("odd") | F.col("segments").isNotNull()).drop("_cuts"), splits


def _split_cells(placed: DataFrame, held: DataFrame, degrees: float) -> DataFrame:
    """(cx, cy, rows) of the cells with long lists: the fewest rows that make all their lists
    short, or else those that leave the shortest ones. Only pieces of such cells are tried."""
    long = held.where(F.col("n") > CELL_SEGMENTS).select("region", "cx", "cy")
    tried = placed.join(long, ["region", "cx", "cy"]).withColumn("rows", F.explode(F.array(*map(F.lit, CELL_ROWS))))
    first, last = (_row(F.col(c), F.col("cy"), F.col("rows"), degrees) for c in ("low", "high"))
    sizes = tried.select("region", "cx", "cy", "rows", F.explode(F.sequence(first, last)).alias("row")).groupBy(
        "region", "cx", "cy", "rows", "row"
    ).count().groupBy("cx", "cy", "rows").agg(F.greatest(F.lit(CELL_SEGMENTS), F.max("count")).alias("_most"))
    return sizes.groupBy("cx", "cy").agg(F.min(F.struct("_most", "rows"))["rows"].alias("rows"))


def cell_table(cover: DataFrame, attrs: DataFrame, label: str = "label") -> DataFrame:
    """(cx, cy, row, candidates): the regions reaching each row of a cell, with their labels."""
    named = cover.join(attrs.select("region", F.col(label).alias("label")), "region", "left")
    return named.groupBy("cx", "cy", "row").agg(
        F.collect_list(F.struct("region", "label", "odd", "segments")).alias("candidates")
    )


def _hits(candidates: Column, x: Column, y: Column) -> Column:
    """Candidates that contain the point; the boundary counts as inside."""
    def contains(c: Column) -> Column:
        crossed = F.size(F.filter(c["segments"], lambda e: _crosses(e, x, y) != F.coalesce(e["cut"] <= y, F.lit(False)))) % 2 == 1
        lone = c["segments"].isNull()
        return F.when(lone, c["odd"]).otherwise((c["odd"] != crossed) | F.exists(c["segments"], lambda e: _touches(e, x, y)))

    return F.filter(candidates, contains)


def _join_cells(
    points: DataFrame, cover: tuple[DataFrame, DataFrame], attrs: DataFrame, label: str, lat: str, lon: str,
    degrees: float, how: str,
) -> DataFrame:
    """Points with the candidates of their cell. Points without a place get spread keys."""
    spread = -1000 - F.pmod(F.xxhash64(*points.columns), F.lit(4096)).cast("int")
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    keyed = points.withColumns(
        {"cx": F.when(placed, _cell(lon, degrees)).otherwise(spread), "cy": F.when(placed, _cell(lat, degrees)).otherwise(0)}
    )
    cover, splits = cover
    row = F.coalesce(_row(F.col(lat), F.col("cy"), F.col("rows"), degrees), F.lit(0))
    keyed = keyed.join(splits, ["cx", "cy"], "left").withColumn("row", row)
    return keyed.join(cell_table(cover, attrs, label), ["cx", "cy", "row"], how).drop("cx", "cy", "row", "rows")


def match_points(
    points: DataFrame, edges: DataFrame, attrs: DataFrame, lat: str, lon: str,
    degrees: float = 1.0, label: str = "label",
) -> DataFrame:
    """One row per (point row, containing region), with the region's label."""
    met = _join_cells(points, build_cover(edges, degrees), attrs, label, lat, lon, degrees, "inner")
    hit = F.explode(_hits(F.col("candidates"), F.col(lon), F.col(lat))).alias("_hit")
    return met.select(*points.columns, hit).select(
        *points.columns, F.col("_hit.region").alias("region"), F.col("_hit.label").alias("label")
    )


# Status words of the three overlay vocabularies, by outcome.
DIRECT_STATUS = {
    "one": "assigned", "same": "assigned", "many": "boundary_or_overlap_conflict",
    "none": "no_terrestrial_realm",
}
POOL_STATUS = {
    "one": "assigned", "same": "assigned_multiple_polygons_same_realm",
    "many": "ambiguous_realm_boundary", "none": "no_realm_polygon_match",
}
TAXON_STATUS = {**POOL_STATUS, "none": "outside_terrestrial_ecoregions"}
VALID_STATUSES = ("assigned", "assigned_multiple_polygons_same_realm")


def roll_up_overlay(
    matched: DataFrame, ks: Sequence[str], words: dict[str, str], label: str = "label"
) -> DataFrame:
    """Match count, distinct labels, sorted label list, single label and status per key."""
    w = matched.groupBy(*ks).agg(
        F.count("region").cast("bigint").alias("matched_regions_n"),
        F.count(label).cast("bigint").alias("labelled_regions_n"),
        F.array_sort(F.collect_set(label)).alias("_labels"),
    )
    n = F.size("_labels")
    return w.select(
        *ks, "matched_regions_n", "labelled_regions_n",
        n.cast("bigint").alias("matched_labels_n"),
        F.array_join("_labels", "|").alias("candidate_list"),
        F.when(n == 1, F.get("_labels", 0)).alias("assigned_label"),
        F.when(n == 0, words["none"]).when(n > 1, words["many"])
        .when(F.col("labelled_regions_n") > 1, words["same"]).otherwise(words["one"])
        .alias("overlay_status"),
    )


def _overlay(hits: Column, words: dict[str, str]) -> Column:
    """The roll-up of one point's containing regions as a struct."""
    def rolled(h: Column) -> Column:
        labels = F.filter(F.transform(h, lambda c: c["label"]), lambda v: v.isNotNull())
        return F.struct(
            F.size(h).cast("bigint").alias("matched_regions_n"),
            F.size(labels).cast("bigint").alias("labelled_regions_n"),
            F.array_sort(F.array_distinct(labels)).alias("labels"),
        )

    def worded(r: Column) -> Column:
        n = F.size(r["labels"])
        return F.struct(
            r["matched_regions_n"].alias("matched_regions_n"),
            r["labelled_regions_n"].alias("labelled_regions_n"),
            n.cast("bigint").alias("matched_labels_n"),
            F.array_join(r["labels"], "|").alias("candidate_list"),
            F.when(n == 1, F.get(r["labels"], 0)).alias("assigned_label"),
            F.when(n == 0, words["none"]).when(n > 1, words["many"])
            .when(r["labelled_regions_n"] > 1, words["same"]).otherwise(words["one"])
            .alias("overlay_status"),
        )

    return let(let(hits, rolled), worded)


def label_points(
    points: DataFrame, lat: str, lon: str, edges: DataFrame, attrs: DataFrame,
    words: dict[str, str] = DIRECT_STATUS, degrees: float = 1.0, label: str = "label",
) -> DataFrame:
    """Overlay columns for every point row."""
    met = _join_cells(points, build_cover(edges, degrees), attrs, label, lat, lon, degrees, "left")
    none = F.array().cast(met.schema["candidates"].dataType)
    hits = F.coalesce(_hits(F.col("candidates"), F.col(lon), F.col(lat)), none)
    found = met.withColumn("_o", _overlay(hits, words))
    return found.select(*[F.col(f"`{c}`") for c in points.columns], "_o.*")


def label_distinct_points(
    points: DataFrame, lat: str, lon: str, edges: DataFrame, attrs: DataFrame,
    words: dict[str, str], degrees: float = 1.0, label: str = "label",
) -> DataFrame:
    """(lat, lon, overlay columns) for every distinct location, for points that repeat a lot."""
    places = points.select(lat, lon).where(
        F.col(lat).isNotNull() & F.col(lon).isNotNull()
    ).distinct()
    return label_points(places, lat, lon, edges, attrs, words, degrees, label)


def representative_region(
    matched: DataFrame, ks: Sequence[str], label: str, name: str
) -> DataFrame:
    """One region row per point: labelled before unlabelled, then by label and name."""
    order = [
        F.col(label).asc_nulls_last(), F.col(name).asc_nulls_last(), F.col("region").asc()
    ]
    return pick_one(matched, ks, order)


def build_areas(
    regions: DataFrame, key: str, name: str
) -> DataFrame:
    """Sorted distinct names and number of map units per dissolved key."""
    units = regions.groupBy(key).agg(F.count(F.lit(1)).alias("map_units_n"))
    names = joined_texts(text_parts(regions, [key], name), [key], name)
    named = null_safe(units, names.withColumnRenamed(name, "names"), [key], "left")
    return named.withColumn("names", F.coalesce("names", F.lit("")))


# WGS84 ellipsoid and the Equal Earth polynomial.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)
_E2 = WGS84_F * (2 - WGS84_F)
_E = math.sqrt(_E2)
_QP = (1 - _E2) * (1 / (1 - _E2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))
_RADIUS = WGS84_A * math.sqrt(_QP / 2)
NEWTON_STEPS = 12


def _slope(theta: Column) -> Column:
    a1, a2, a3, a4 = EQUAL_EARTH
    t2 = theta * theta
    t6 = t2 * t2 * t2
    return a1 + 3 * a2 * t2 + t6 * (7 * a3 + 9 * a4 * t2)


def _height(theta: Column) -> Column:
    a1, a2, a3, a4 = EQUAL_EARTH
    t2 = theta * theta
    t6 = t2 * t2 * t2
    return theta * (a1 + a2 * t2 + t6 * (a3 + a4 * t2))


def project_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal Earth easting and northing in metres from degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _QP)))
    theta = F.asin(math.sqrt(3) / 2 * F.sin(beta))
    x = _RADIUS * 2 * math.sqrt(3) * F.radians(lon) * F.cos(theta) / (3 * _slope(theta))
    return x, _RADIUS * _height(theta)


def unproject_equal_area(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees from Equal Earth metres, by a fixed number of Newton steps."""
    target = y / _RADIUS
    theta = F.aggregate(
        F.sequence(F.lit(1), F.lit(NEWTON_STEPS)),
        target / EQUAL_EARTH[0],
        lambda t, _: t - (_height(t) - target) / _slope(t),
    )
    lon = F.degrees(3 * (x / _RADIUS) * _slope(theta) / (2 * math.sqrt(3) * F.cos(theta)))
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.sin(theta) / math.sqrt(3))))
    e4, e6 = _E2**2, _E2**3
    lat = (
        beta
        + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    return lon, F.degrees(lat)


def region_centroids(edges: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Area-weighted centroid of all edges of a key, in an equal-area projection.

    Moments are sums over edges, so parts of a key that do not overlap need no union.
    """
    ax, ay = project_equal_area(F.col("x0"), F.col("y0"))
    bx, by = project_equal_area(F.col("x1"), F.col("y1"))
    flat = edges.select(*ks, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    turn = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    moments = flat.groupBy(*ks).agg(
        F.sum(turn).alias("_twice_area"),
        F.sum((F.col("ax") + F.col("bx")) * turn).alias("_mx"),
        F.sum((F.col("ay") + F.col("by")) * turn).alias("_my"),
    )
    cx = F.try_divide(F.col("_mx"), 3 * F.col("_twice_area"))
    cy = F.try_divide(F.col("_my"), 3 * F.col("_twice_area"))
    lon, lat = unproject_equal_area(cx, cy)
    return moments.select(*ks, lat.alias("latitude"), lon.alias("longitude"))
