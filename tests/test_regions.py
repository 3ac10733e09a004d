import math
import random

from pyspark.sql import functions as F

from waymark.operators.regions import (
    CELL_SEGMENTS, POOL_STATUS, build_cover, label_points, match_points, project_equal_area, region_centroids,
    unproject_equal_area,
)
from waymark.sources.regions import ring_edges

# (region, ring, vertices)
SHAPES = [
    (1, 0, [(0, 0), (4, 0), (0, 4)]),  # triangle
    (2, 0, [(10, 0), (16, 0), (16, 6), (10, 6), (10, 4), (14, 4), (14, 2), (10, 2)]),  # C shape
    (3, 0, [(20, 0), (26, 0), (26, 6), (20, 6)]),  # square ...
    (3, 1, [(22, 2), (22, 4), (24, 4), (24, 2)]),  # ... with a hole
    (4, 0, [(30, 0), (32, 0), (32, 2), (30, 2)]),  # two squares sharing an edge
    (5, 0, [(32, 0), (34, 0), (34, 2), (32, 2)]),
]
LABELS = [(1, "T"), (2, "C"), (3, "H"), (4, "L"), (5, "R")]


def layer(spark):
    rows = [(r, ring, i, float(x), float(y)) for r, ring, vs in SHAPES for i, (x, y) in enumerate(vs)]
    df = spark.createDataFrame(rows, "region long, ring int, seq int, x double, y double")
    return ring_edges(df, "region", ["ring"], "seq", "x", "y"), spark.createDataFrame(LABELS, "region long, label string")


CASES = [
    ((1, 1), {1}), ((0, 0), {1}), ((2, 2), {1}), ((2.1, 2), set()), ((4, 0), {1}), ((2, 0), {1}),
    ((12, 3), set()), ((12, 1), {2}), ((15, 3), {2}), ((12, 2), {2}), ((10, 3), set()), ((14, 3), {2}),
    ((23, 3), set()), ((22, 3), {3}), ((21, 3), {3}), ((23, 4), {3}), ((26, 6), {3}),
    ((32, 1), {4, 5}), ((31, 1), {4}), ((33, 1), {5}), ((32, 2), {4, 5}), ((35, 1), set()),
    ((-1, 0), set()), ((9.99, 0), set()), ((16, 3), {2}), ((13, 4), {2}), ((19, 6), set()),
]


def test_points_in_shapes_for_several_cell_sizes(spark):
    edges, attrs = layer(spark)
    rows = [(i, float(x), float(y)) for i, ((x, y), _) in enumerate(CASES)]
    points = spark.createDataFrame(rows, "i int, lon double, lat double")
    for degrees in (0.7, 1.0, 2.0, 5.0):
        found = {}
        for r in match_points(points, edges, attrs, "lat", "lon", degrees).collect():
            found.setdefault(r["i"], set()).add(r["region"])
        assert [found.get(i, set()) for i in range(len(CASES))] == [want for _, want in CASES], degrees


def inside(x, y, rings):
    """Brute force: on any edge, or an odd number of crossings."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                odd = not odd
    return odd


def test_random_points_against_brute_force(spark):
    edges, attrs = layer(spark)
    rng = random.Random(3)
    rows = [(i, rng.randrange(-4, 140) / 4, rng.randrange(-4, 28) / 4) for i in range(1500)]
    points = spark.createDataFrame(rows, "i int, lon double, lat double")
    got = {(r["i"], r["region"]) for r in match_points(points, edges, attrs, "lat", "lon", 1.3).collect()}
    rings = {}
    for region, _, vs in SHAPES:
        rings.setdefault(region, []).append([(float(a), float(b)) for a, b in vs])
    want = {(i, region) for i, x, y in rows for region, rs in rings.items() if inside(x, y, rs)}
    assert got == want


def test_statuses_and_missing_places(spark):
    edges, attrs = layer(spark)
    rows = [(0, 1.0, 1.0), (1, 32.0, 1.0), (2, 50.0, 1.0), (3, None, None)]
    points = spark.createDataFrame(rows, "i int, lon double, lat double")
    out = {r["i"]: r for r in label_points(points, "lat", "lon", edges, attrs, POOL_STATUS).collect()}
    assert [out[i]["overlay_status"] for i in range(4)] == [
        "assigned", "ambiguous_realm_boundary", "no_realm_polygon_match", "no_realm_polygon_match"
    ]
    assert out[1]["candidate_list"] == "L|R" and out[1]["assigned_label"] is None
    assert out[3]["matched_regions_n"] == 0


def test_label_plan_has_no_nested_loop_and_no_python(spark):
    edges, attrs = layer(spark)
    points = spark.range(100).select(F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"))
    plan = label_points(points, "lat", "lon", edges, attrs)._jdf.queryExecution().executedPlan().toString()
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "ArrowEval"):
        assert node not in plan


def test_projection_round_trip_and_symmetric_centroid(spark):
    df = spark.createDataFrame([(10.0, 45.0), (-170.0, -80.0), (0.0, 0.0), (179.0, 89.0)], "lon double, lat double")
    x, y = project_equal_area(F.col("lon"), F.col("lat"))
    lon, lat = unproject_equal_area(F.col("x"), F.col("y"))
    for r in df.withColumns({"x": x, "y": y}).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-7 and abs(r["lat"] - r["lat2"]) < 1e-7
    box = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(-10, -5), (10, -5), (10, 5), (-10, 5)])],
                                "region long, ring int, seq int, x double, y double")
    c = region_centroids(ring_edges(box, "region", ["ring"], "seq", "x", "y"), ["region"]).first()
    assert abs(c["latitude"]) < 1e-9 and abs(c["longitude"]) < 1e-9


def coast(rng, cx, cy, radius, n):
    """A star-shaped ring with a rough edge of n short segments."""
    angles = [2 * math.pi * k / n for k in range(n)]
    return [(cx + radius * r * math.cos(a), cy + radius * r * math.sin(a)) for a, r in ((a, rng.uniform(0.98, 1.0)) for a in angles)]


def test_fine_coasts_with_split_cells(spark):
    rng = random.Random(11)
    rings = {1: [coast(rng, 1.2, 0.7, 1.5, 900), coast(rng, 1.2, 0.7, 0.6, 300)], 2: [coast(rng, 0.4, 1.1, 0.9, 500)], 3: [[(-9, -9), (9, -9), (9, 9), (-9, 9)]]}
    rows = [(region, k, i, float(x), float(y)) for region, rs in rings.items() for k, r in enumerate(rs) for i, (x, y) in enumerate(r)]
    edges = ring_edges(spark.createDataFrame(rows, "region long, ring int, seq int, x double, y double"), "region", ["ring"], "seq", "x", "y")
    attrs = spark.createDataFrame([(r, str(r)) for r in rings], "region long, label string")
    spots = [(rng.uniform(-1, 3.4), rng.uniform(-1.4, 2.8)) for _ in range(900)]
    spots += [rng.choice(rng.choice(rings[r])) for r in (1, 2, 3) for _ in range(30)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "i int, lon double, lat double")
    for degrees in (1.0, 0.3, 5.0):
        got = {(r["i"], r["region"]) for r in match_points(points, edges, attrs, "lat", "lon", degrees).collect()}
        assert got == {(i, region) for i, (x, y) in enumerate(spots) for region, rs in rings.items() if inside(x, y, rs)}, degrees
    for degrees, parts in ((1.0, 2.0), (3.0, 2.5)):
        cover, splits = build_cover(edges.where("region < 3"), degrees)
        sizes = cover.where("segments is not null").agg(F.max(F.size("segments")), F.sum(F.size("segments"))).first()
        print(sizes)
        assert splits.count() > 0 and sizes[0] <= CELL_SEGMENTS and sizes[1] <= parts * 1700
