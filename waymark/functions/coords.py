"""Coordinate expressions: parsing, validity, rounding, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tokens as T
from waymark.functions.text import _col, let, null_tokens, strip

# Accepted coordinate notations.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WKT_POINT = r"(?i)point\s*\(\s*([-+]?\d+(?:\.\d+)?)\s+([-+]?\d+(?:\.\d+)?)\s*\)"
LOOSE_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"


def to_number(c: Column | str) -> Column:
    """Double from text; anything that is not a plain number is null."""
    text = strip(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def in_range(lat: Column | str, lon: Column | str) -> Column:
    return F.coalesce((F.abs(_col(lat)) <= 90) & (F.abs(_col(lon)) <= 180), F.lit(False))


def valid_coord(
    lat: Column | str, lon: Column | str, allow_zero_zero: bool = False
) -> Column:
    ok = in_range(lat, lon)
    if allow_zero_zero:
        return ok
    return ok & ~F.coalesce((_col(lat) == 0) & (_col(lon) == 0), F.lit(False))


def parse_coord(c: Column | str, wkt_lon_lat: bool = True) -> Column:
    """struct<lat, lon> from "POINT (lon lat)" or two numbers; null when unusable.

    The pair form reads latitude first, unless the first number can only be a longitude.
    """
    first, second = (2, 1) if wkt_lon_lat else (1, 2)

    def numbers(text: Column) -> Column:
        wkt = text.rlike(WKT_POINT)
        ends = F.array(
            F.regexp_extract(text, WKT_POINT, first), F.regexp_extract(text, WKT_POINT, second)
        )
        return F.struct(
            wkt.alias("wkt"),
            F.transform(
                F.when(wkt, ends).otherwise(F.regexp_extract_all(text, F.lit(LOOSE_NUMBER), 0)),
                lambda n: n.try_cast("double"),
            ).alias("found"),
        )

    def ordered(n: Column) -> Column:
        p, q = F.get(n["found"], 0), F.get(n["found"], 1)
        swapped = ~n["wkt"] & (F.abs(p) > 90) & (F.abs(q) <= 90)
        return F.when(swapped, F.struct(q.alias("lat"), p.alias("lon"))).otherwise(
            F.struct(p.alias("lat"), q.alias("lon"))
        )

    def usable(point: Column) -> Column:
        return F.when(valid_coord(point["lat"], point["lon"]), point)

    return let(let(let(null_tokens(c, T.COORD), numbers), ordered), usable)


# Coordinate columns by precedence.
COORDINATE_COLUMNS = (
    ("decimalLatitude", "decimalLongitude"),
    ("latitude", "longitude"),
)


def original_coordinates(
    df: DataFrame, lat: str = "original_latitude", lon: str = "original_longitude"
) -> DataFrame:
    """Original coordinates from whichever columns the table has, text column first."""
    if "coord" in df.columns:
        return df.withColumn("_point", parse_coord("coord")).select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.col("_point.lat").alias(lat), F.col("_point.lon").alias(lon),
        )
    for lat_col, lon_col in COORDINATE_COLUMNS:
        if lat_col in df.columns and lon_col in df.columns:
            return df.withColumns({lat: to_number(lat_col), lon: to_number(lon_col)})
    raise ValueError(f"no coordinate columns among {df.columns}")


def coord_status(lat: Column | str, lon: Column | str) -> Column:
    lat, lon = _col(lat), _col(lon)
    return (
        F.when(lat.isNull() | lon.isNull(), "missing_or_non_numeric")
        .when(~in_range(lat, lon), "outside_valid_range")
        .when((lat == 0) & (lon == 0), "zero_zero")
        .otherwise("valid")
    )


def uncertainty_flag(c: Column | str, limit: float = 100000.0) -> Column:
    c = _col(c)
    return (
        F.when(c > limit, "over_100_km").when(c.isNotNull(), "within_100_km")
        .otherwise("not_reported")
    )


def scaled(c: Column | str, decimals: int) -> Column:
    """Coordinate as an integer number of 10^-decimals degrees, halves to even."""
    return F.rint(_col(c) * float(10**decimals)).cast("bigint")


def round_half_even(c: Column | str, decimals: int) -> Column:
    factor = float(10**decimals)
    return F.rint(_col(c) * factor) / factor


def close_to(a: Column | str, b: Column | str, atol: float = 1e-8) -> Column:
    return F.coalesce(F.abs(_col(a) - _col(b)) <= atol, F.lit(False))


def grid_cell(lat: Column | str, lon: Column | str, degrees: float = 1.0) -> Column:
    return F.concat_ws(
        "_",
        F.floor((_col(lat) + 90.0) / degrees).cast("string"),
        F.floor((_col(lon) + 180.0) / degrees).cast("string"),
    )


def evidence_unit(
    cell: Column | str, lat: Column | str, lon: Column | str, decimals: int = 2
) -> Column:
    """Sampling cell when present, else the rounded location in integer text."""
    named = F.nullif(strip(cell), F.lit(""))
    place = F.concat_ws(
        "_", scaled(lat, decimals).cast("string"), scaled(lon, decimals).cast("string")
    )
    return F.coalesce(named, place)
