import numpy as np
from pyspark.sql import functions as F

from conftest import one_column
from waymark.functions import coords as C


def test_parse_coord(spark):
    cases = {
        "POINT(-1.234 52.345)": (52.345, -1.234), "point ( 10 95 )": None, "52.345 -1.234": (52.345, -1.234),
        "120.5, 30.1": (30.1, 120.5), "0,0": None, "abc": None, "12": None, " N/A ": None, None: None,
        ".5, 1.": (0.5, 1.0), "POINT (1e2 3)": (1.0, 2.0), "100 100": None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string").orderBy("i")
    got = [None if r is None else (r["lat"], r["lon"]) for r in one_column(df, C.parse_coord("s"))]
    assert got == list(cases.values())


def test_to_number(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["1d", "1e3", " 12.5 ", "inf", "nan", "", None, "-.5"])], "i int, s string").orderBy("i")
    assert one_column(df, C.to_number("s")) == [None, 1000.0, 12.5, None, None, None, None, -0.5]


def test_rounding_is_half_even(spark):
    values = [0.00005, 0.00015, 1.00015, -0.00005, 2.5, 12.34565]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    for decimals in (0, 2, 4):
        assert one_column(df, C.round_half_even("v", decimals)) == list(np.round(values, decimals))


def test_validity(spark):
    rows = [(0.0, 0.0), (90.0, 180.0), (90.1, 0.0), (None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lat double, lon double").orderBy("i")
    assert one_column(df, C.valid_coord("lat", "lon")) == [False, True, False, False, False]
    assert one_column(df, C.valid_coord("lat", "lon", allow_zero_zero=True)) == [True, True, False, False, False]
    assert one_column(df, C.coord_status("lat", "lon"))[:4] == ["zero_zero", "valid", "outside_valid_range", "missing_or_non_numeric"]


def test_column_precedence(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "decimalLatitude string, decimalLongitude string, latitude string, longitude string")
    row = C.original_coordinates(df).first()
    assert (row["original_latitude"], row["original_longitude"]) == (1.0, 2.0)
    assert C.original_coordinates(df.withColumn("coord", F.lit("7 8"))).first()["original_latitude"] == 7.0
