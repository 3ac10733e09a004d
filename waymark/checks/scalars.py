"""Checks of scans, scalar expressions and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from waymark.checks.base import VIEWS, bridge, check, records, table
from waymark.functions import coords as C
from waymark.functions import names as N
from waymark.functions import text as X
from waymark.functions import tokens as T
from waymark.functions.hashing import stable_hash
from waymark.operators.accuracy import as_fraction
from waymark.operators.lookup import screen_admin
from waymark.operators.ranking import number_rows
from waymark.plans.places import decide_lookup, unique_places
from waymark.session import shared_folder
from waymark.operators.quality import gate_known_words
from waymark.sources.tables import publish, published, read_class, read_classes, resolve_roles, scan, sink, sink_by_class


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def nulled(expr: str, words, keep=()) -> str:
    """SQL twin of null_tokens for plain blanks."""
    kept = [w for w in words if w not in keep]
    return f"CASE WHEN lower(trim({expr})) IN ({quoted(kept)}) THEN NULL ELSE trim({expr}) END"


VIEWS["o_coord"] = """
SELECT r.*, CASE WHEN ok THEN a END AS original_latitude, CASE WHEN ok THEN b END AS original_longitude
FROM (
  SELECT q.*, a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 AND NOT (a = 0 AND b = 0) AS ok
  FROM (
    SELECT p.*,
      CASE WHEN wkt <> '' THEN CAST(string_split(wkt, ' ')[2] AS double)
           WHEN len(nums) >= 2 AND abs(nums[1]) > 90 AND abs(nums[2]) <= 90 THEN nums[2]
           WHEN len(nums) >= 2 THEN nums[1] END AS a,
      CASE WHEN wkt <> '' THEN CAST(string_split(wkt, ' ')[1] AS double)
           WHEN len(nums) >= 2 AND abs(nums[1]) > 90 AND abs(nums[2]) <= 90 THEN nums[1]
           WHEN len(nums) >= 2 THEN nums[2] END AS b
    FROM (
      SELECT b_record.*,
        coalesce(regexp_extract(coord, 'POINT \\(([^)]*)\\)', 1), '') AS wkt,
        list_transform(regexp_extract_all(coalesce(coord, ''), '[-+]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)'),
                       lambda x: CAST(x AS double)) AS nums
      FROM b_record) p) q) r"""

# ---------------------------------------------------------------- scans and sinks


@check("s01_scan_projection", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 200000")
def _(spark, sf):
    df = scan(spark, f"{sf}/orders.parquet", cols=["o_orderkey", "o_orderpriority", "o_totalprice"])
    return df.where("o_totalprice > 200000").drop("o_totalprice")


@check("s04_column_roles", "SELECT c_custkey AS record_id, c_mktsegment AS province FROM customer")
def _(spark, sf):
    roles = {
        "record_id": ["specimen id", "C-CustKey"],
        "province": ["province_state", "c_mktsegment"],
        "valid": ["coordinate_valid"],
    }
    return resolve_roles(table(spark, sf, "customer"), roles, optional=["valid"])


@check(
    "s06_reader_null_policy",
    f"""SELECT row_key, {nulled('country', T.SCREEN)} AS country,
    {nulled('country_iso', T.SCREEN, T.SCREEN_KEEP_NA)} AS country_iso,
    {nulled('province_state', T.SCREEN)} AS province_state FROM b_record""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_record")
    return df.select(
        "row_key", X.null_tokens("country", T.SCREEN).alias("country"),
        X.null_tokens("country_iso", T.SCREEN, keep=T.SCREEN_KEEP_NA).alias("country_iso"),
        X.null_tokens("province_state", T.SCREEN).alias("province_state"),
    )


@check(
    "s07_csv_sink_append",
    """SELECT part, count(*) AS rows_n, count(nullif(species, '')) AS species_n,
    count(DISTINCT country) AS countries_n
    FROM (SELECT 'first' AS part, species, country FROM b_record
          UNION ALL SELECT 'second', species, country FROM b_record) t GROUP BY part""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_record").select("species", "country")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sink(df.withColumn("part", F.lit("first")), path, fmt="csv")
    sink(df.withColumn("part", F.lit("second")), path, mode="append", fmt="csv")
    schema = ST.StructType([ST.StructField(c, ST.StringType()) for c in ("species", "country", "part")])
    back = scan(spark, path, schema=schema, fmt="csv")
    return back.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows_n"), F.count(F.nullif("species", F.lit(""))).alias("species_n"),
        F.count_distinct("country").alias("countries_n"),
    )


@check(
    "s09_gated_publish",
    """SELECT c_mktsegment, count(*) AS customers_n FROM customer GROUP BY c_mktsegment""",
)
def _(spark, sf):
    from waymark.operators.quality import gate_unique

    base = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    customer = table(spark, sf, "customer")
    counts = customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers_n"))
    publish({"segments": counts}, base, "run-1", {"unique": gate_unique(counts, ["c_mktsegment"])})
    return published(spark, base, "segments")


@check(
    "x15_strict_flags",
    "SELECT seq, coalesce(raw_success = 'True', FALSE) AS raw_ok, coalesce(clean_success = 'yes', FALSE) AS clean_ok, fallback_success IS NOT NULL AS fallback_ok FROM b_place",
)
def _(spark, sf):
    flag = lambda c: X.strict_bool(c, T.TRUE_STRICT, T.FALSE_STRICT)
    return bridge(spark, sf, "b_place").select(
        "seq", flag("raw_success").alias("raw_ok"), flag("clean_success").alias("clean_ok"), flag("fallback_success").alias("fallback_ok")
    )


@check(
    "x15_unknown_words",
    "SELECT lower(trim(band_text)) AS word, count(*) AS rows_n FROM b_label_text WHERE lower(trim(band_text)) NOT IN ('none', 'other', 'low') GROUP BY 1",
)
def _(spark, sf):
    return gate_known_words(bridge(spark, sf, "b_label_text"), "band_text", ("none", "other", "low"))


@check(
    "s12_fan_out",
    """SELECT event_type AS output, count(*) AS rows_n FROM events GROUP BY event_type UNION ALL SELECT 'never', 0""",
)
def _(spark, sf):
    events = table(spark, sf, "events", ["event_id", "event_type"])
    classes = events.select("event_type").distinct().unionByName(spark.range(1).select(F.lit("never").alias("event_type")))
    base = f"{shared_folder(spark)}/classes-{uuid.uuid4().hex}"
    sink_by_class(events, "event_type", base, classes)
    empty = read_class(spark, base, "never")
    return read_classes(spark, base).unionByName(
        empty.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_n"))
    ).withColumnRenamed("event_type", "output")


# ---------------------------------------------------------------- text

_SETS = {
    "query": T.QUERY, "upper_na": T.UPPER_NA, "site": T.SITE, "coord": T.COORD, "screen": T.SCREEN,
    "admin": T.ADMIN, "centroid": T.CENTROID, "label": T.LABEL, "pool": T.POOL, "pilot": T.PILOT,
    "truth": T.TRUTH, "full": T.FULL,
}
_EXACT = {"valid": T.VALID_EXACT, "review": T.REVIEW_EXACT}


@check(
    "x01_null_tokens",
    "SELECT row_key, "
    + ", ".join(
        f"{nulled('country', w)} AS country_{k}, {nulled('label', w)} AS label_{k}, "
        f"{nulled('province_state', w)} AS province_{k}" for k, w in _SETS.items()
    )
    + ", "
    + ", ".join(
        f"CASE WHEN trim(label) IN ({quoted(w)}) THEN NULL ELSE trim(label) END AS label_{k}, "
        f"CASE WHEN trim(province_state) IN ({quoted(w)}) THEN NULL ELSE trim(province_state) END AS province_{k}"
        for k, w in _EXACT.items()
    )
    + " FROM b_record",
)
def _(spark, sf):
    cols = []
    for k, w in _SETS.items():
        cols += [X.null_tokens("country", w).alias(f"country_{k}"),
                 X.null_tokens("label", w).alias(f"label_{k}"),
                 X.null_tokens("province_state", w).alias(f"province_{k}")]
    for k, w in _EXACT.items():
        cols += [X.null_tokens("label", w, fold=False).alias(f"label_{k}"),
                 X.null_tokens("province_state", w, fold=False).alias(f"province_{k}")]
    return bridge(spark, sf, "b_record").select("row_key", *cols)


@check(
    "x02_match_text",
    r"""SELECT row_key, lower(trim(regexp_replace(coalesce(country, ''), '\s+', ' ', 'g'))) AS country_key,
    lower(trim(regexp_replace(coalesce(site, ''), '\s+', ' ', 'g'))) AS site_key,
    lower(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))) AS name_key
    FROM b_record JOIN b_name USING (row_key)""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_record").join(bridge(spark, sf, "b_name"), "row_key")
    return df.select(
        "row_key", X.match_text("country").alias("country_key"), X.match_text("site").alias("site_key"),
        X.match_text("name").alias("name_key"),
    )


@check(
    "x03_fold_key",
    """SELECT doc_id, md5(k) AS key_digest, length(k) AS key_length FROM (
    SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(text, 'ß', 'ss'), '&', ' and '))),
      '[^a-z0-9]+', ' ', 'g')) AS k FROM documents) t""",
)
def _(spark, sf):
    folded = X.fold_key(table(spark, sf, "documents", ["doc_id", "text"]), "text", "k")
    return folded.select(
        "doc_id", F.md5(F.col("k").cast("binary")).alias("key_digest"), F.length("k").alias("key_length")
    )


@check(
    "x04_relaxed_key",
    r"""SELECT row_key, name_key, regexp_replace(
      regexp_replace(name_key, '^(?:(?:province|state|region|department) of )+(.+)$', '\1'),
      '^(.+?)(?: (?:province|state|region|territory|governorate|prefecture|department|county|district|oblast))+$',
      '\1') AS relaxed FROM b_admin_name""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_admin_name").withColumn("relaxed", X.relaxed_key("name_key"))


def _parts(words) -> str:
    return ", ".join(nulled(c, words) for c in ("site", "province_state", "country"))


@check(
    "x05_place_query",
    f"""SELECT row_key, concat_ws(', ', {_parts(T.QUERY)}) AS place_query,
    concat_ws(', ', {_parts(T.UPPER_NA)}) AS upper_query FROM b_record""",
)
def _(spark, sf):
    cols = ("site", "province_state", "country")
    return bridge(spark, sf, "b_record").select(
        "row_key", X.place_query(*cols).alias("place_query"),
        X.place_query(*cols, tokens=T.UPPER_NA).alias("upper_query"),
    )


def _expand_sql(expr: str) -> str:
    for short, full in X.ABBREVIATIONS:
        expr = rf"regexp_replace({expr}, '(?i)\b{short}\.?\b', '{full}', 'g')"
    return expr


def _clean_sql(expr: str) -> str:
    expr = _expand_sql(f"coalesce({expr}, '')")
    for pattern in X.NOISE_PATTERNS:
        expr = f"regexp_replace({expr}, '(?i){pattern}', ' ', 'g')"
    expr = rf"regexp_replace({expr}, '[;:/()\[\]{{}}]', ' ', 'g')"
    expr = rf"regexp_replace({expr}, '\s*,\s*', ', ', 'g')"
    expr = rf"regexp_replace({expr}, '\s+', ' ', 'g')"
    expr = rf"regexp_replace({expr}, '(,\s*)+', ', ', 'g')"
    return f"trim({expr}, ' ,.-')"


VIEWS["o_clean"] = f"SELECT row_key, raw_query, {_clean_sql('raw_query')} AS cleaned FROM b_raw_query"


@check(
    "x06_expand_abbreviations",
    f"SELECT row_key, {_expand_sql('raw_query')} AS expanded FROM b_raw_query",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_raw_query")
    return df.select("row_key", X.expand_abbreviations("raw_query").alias("expanded"))


@check("x07_clean_place_query", "SELECT row_key, cleaned FROM o_clean")
def _(spark, sf):
    df = bridge(spark, sf, "b_raw_query")
    once = X.on_distinct(df, "raw_query", "cleaned", X.clean_place_query)
    return once.select("row_key", F.coalesce("cleaned", F.lit("")).alias("cleaned"))


@check(
    "x08_clean_audit",
    """SELECT row_key, length(coalesce(raw_query, 'nan')) AS raw_query_length,
    length(cleaned) AS clean_query_length, trim(cleaned) = '' AS clean_query_empty,
    raw_query IS NULL OR raw_query <> cleaned AS clean_query_changed,
    CASE WHEN trim(cleaned) = '' THEN raw_query ELSE cleaned END AS clean_query FROM o_clean""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_raw_query").withColumn("clean_query", X.clean_place_query("raw_query"))
    return X.audit_clean(df, "raw_query", "clean_query").drop("raw_query")


# ---------------------------------------------------------------- coordinates


@check(
    "x09_parse_coord",
    "SELECT row_key, original_latitude AS lat, original_longitude AS lon FROM o_coord",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_record").withColumn("p", C.parse_coord("coord"))
    return df.select("row_key", "p.lat", "p.lon")


@check(
    "x10_coordinate_columns",
    """SELECT seq, CAST(lat_text AS double) AS original_latitude,
    CAST(lon_text AS double) AS original_longitude FROM b_place""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_place").select(
        "seq", F.col("lat_text").alias("decimalLatitude"), F.col("lon_text").alias("decimalLongitude"),
        F.lit("x").alias("latitude"), F.lit("x").alias("longitude"),
    )
    return C.original_coordinates(df).select("seq", "original_latitude", "original_longitude")


@check(
    "x11_to_number",
    r"""SELECT event_id, CASE WHEN regexp_matches(trim(text), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
    THEN CAST(trim(text) AS double) END AS number FROM b_number_text""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_number_text")
    return df.select("event_id", C.to_number("text").alias("number"))


@check(
    "x12_valid_coord",
    """SELECT in_box, nonzero, count(*) AS rows_n FROM (
      SELECT lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS in_box,
        lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AS nonzero
      FROM b_occurrence) t GROUP BY in_box, nonzero""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_occurrence").groupBy(
        C.valid_coord("lat", "lon", allow_zero_zero=True).alias("in_box"),
        C.valid_coord("lat", "lon").alias("nonzero"),
    ).agg(F.count(F.lit(1)).alias("rows_n"))


VIEWS["o_occ_status"] = """
SELECT b_occurrence.*,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_or_non_numeric'
       WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'outside_valid_range'
       WHEN lat = 0 AND lon = 0 THEN 'zero_zero' ELSE 'valid' END AS coordinate_status,
  CASE WHEN uncertainty_m > 100000 THEN 'over_100_km' WHEN uncertainty_m IS NOT NULL THEN 'within_100_km'
       ELSE 'not_reported' END AS uncertainty_warning
FROM b_occurrence"""


@check(
    "x13_coord_status",
    "SELECT coordinate_status, count(*) AS rows_n FROM o_occ_status GROUP BY coordinate_status",
)
def _(spark, sf):
    return bridge(spark, sf, "b_occurrence").groupBy(
        C.coord_status("lat", "lon").alias("coordinate_status")
    ).agg(F.count(F.lit(1)).alias("rows_n"))


@check(
    "x14_uncertainty_flag",
    "SELECT uncertainty_warning, count(*) AS rows_n FROM o_occ_status GROUP BY uncertainty_warning",
)
def _(spark, sf):
    return bridge(spark, sf, "b_occurrence").groupBy(
        C.uncertainty_flag("uncertainty_m").alias("uncertainty_warning")
    ).agg(F.count(F.lit(1)).alias("rows_n"))


@check(
    "x15_parse_bool",
    """SELECT seq, coalesce(lower(raw_success) IN ('true', '1', 'yes', 'y'), FALSE) AS raw_ok,
    coalesce(lower(fallback_success) IN ('true', '1', 'yes', 'y', 'success'), FALSE) AS fallback_ok,
    CASE WHEN lower(clean_success) IN ('true', '1', 'yes') THEN TRUE
         WHEN lower(clean_success) IN ('false', '0', 'no') THEN FALSE END AS clean_strict,
    CASE WHEN lower(fallback_success) IN ('true', 't', '1', 'yes', 'y') THEN TRUE
         WHEN lower(fallback_success) IN ('false', 'f', '0', 'no', 'n') THEN FALSE END AS fallback_flag
    FROM b_place""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_place").select(
        "seq", X.parse_bool("raw_success", T.TRUE_LOOKUP).alias("raw_ok"),
        X.parse_bool("fallback_success", T.TRUE_MERGE).alias("fallback_ok"),
        X.parse_bool("clean_success", T.TRUE_STRICT, T.FALSE_STRICT).alias("clean_strict"),
        X.parse_bool("fallback_success", T.TRUE_FLAG, T.FALSE_FLAG).alias("fallback_flag"),
    )


def decided_places(spark, sf):
    df = bridge(spark, sf, "b_place")
    values = {"final_lat": "lat_text", "final_lon": "lon_text", "query_used": "site"}
    return decide_lookup(
        df,
        {"osm_raw": "raw_success", "osm_clean": "clean_success", "google_fallback": "fallback_success"},
        {"osm_raw": values, "osm_clean": values, "google_fallback": {**values, "query_used": "country"}},
    )


VIEWS["o_decided"] = """
SELECT seq, country, site, src AS final_source, src <> 'failed' AS final_success,
  CASE WHEN src <> 'failed' THEN 'site' ELSE 'failed' END AS final_level,
  CASE WHEN src <> 'failed' THEN lat_text END AS final_lat,
  CASE WHEN src <> 'failed' THEN lon_text END AS final_lon,
  CASE WHEN src = 'google_fallback' THEN country WHEN src <> 'failed' THEN site END AS query_used
FROM (SELECT b_place.*, CASE WHEN raw_success = 'True' THEN 'osm_raw' WHEN clean_success = 'yes' THEN 'osm_clean'
        WHEN fallback_success = '1' THEN 'google_fallback' ELSE 'failed' END AS src FROM b_place) t"""


@check(
    "x16_source_cascade",
    """SELECT seq, final_source, final_success, final_level, final_lat, final_lon, query_used FROM o_decided""",
)
def _(spark, sf):
    return decided_places(spark, sf).select(
        "seq", "final_source", "final_success", "final_level", "final_lat", "final_lon", "query_used"
    )


@check(
    "x17_level_label",
    """SELECT final_level, final_source, count(*) AS rows_n FROM o_decided GROUP BY final_level, final_source""",
)
def _(spark, sf):
    return decided_places(spark, sf).groupBy("final_level", "final_source").agg(
        F.count(F.lit(1)).alias("rows_n")
    )


VIEWS["o_screen"] = f"""
SELECT row_key, country, country_iso, province_state,
  CASE WHEN ok THEN 'has_coordinate' WHEN p AND (c OR i) THEN 'province' WHEN c OR i THEN 'country'
       WHEN p THEN 'unresolved' ELSE 'none' END AS target_level,
  CASE WHEN c THEN 'country' WHEN i THEN 'country_iso' ELSE 'missing_country_and_country_iso' END AS identifier_source
FROM (SELECT row_key, country, country_iso, province_state, original_latitude IS NOT NULL AS ok,
        ({nulled('country', T.SCREEN)}) IS NOT NULL AS c,
        ({nulled('country_iso', T.SCREEN, T.SCREEN_KEEP_NA)}) IS NOT NULL AS i,
        ({nulled('province_state', T.SCREEN)}) IS NOT NULL AS p
      FROM o_coord) t"""
@check("x20_centroid_screening", "SELECT row_key, target_level, identifier_source FROM o_screen")
def _(spark, sf):
    df = screen_admin(records(spark, sf), C.valid_coord("original_latitude", "original_longitude"))
    return df.select("row_key", "target_level", "identifier_source")


@check(
    "x21_abbreviation_flag",
    """SELECT row_key, regexp_full_match(replace(province_state, ' ', ''), '[A-Za-z]{1,3}') AS is_short
    FROM b_record""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_record").select("row_key", X.is_abbreviation("province_state").alias("is_short"))


@check(
    "x22_admin_match_key",
    """SELECT row_key, concat(country_iso, '|', coalesce(province_state, '')) AS match_key FROM b_record""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_record").select(
        "row_key", X.admin_match_key("country_iso", "province_state").alias("match_key")
    )


@check(
    "x23_first_code",
    """SELECT c_custkey, CASE WHEN length(trim(r_name)) = 3 THEN r_name
      WHEN c_custkey % 2 = 0 THEN upper(substr(c_mktsegment, 1, 3)) ELSE '' END AS code
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    odd = F.when(F.col("c_custkey") % 2 == 0, F.lower(F.substring("c_mktsegment", 1, 3))).otherwise("-99")
    return df.select("c_custkey", X.first_code("r_name", odd).alias("code"))


@check(
    "x24_source_maps",
    """SELECT final_source, CASE WHEN final_source IN ('osm_raw', 'osm_clean', 'google_fallback')
      THEN 'site_geocoding_overlay' ELSE 'unknown_coordinate_overlay' END AS method,
      CASE WHEN final_source = 'failed' THEN 'Insufficient' ELSE 'Medium' END AS confidence,
      count(*) AS rows_n FROM o_decided GROUP BY ALL""",
)
def _(spark, sf):
    from waymark.plans.labels import SOURCE_CONFIDENCE, SOURCE_METHOD, standard_source

    df = decided_places(spark, sf).withColumn("src", standard_source("final_source"))
    return df.groupBy(
        F.col("src").alias("final_source"),
        X.map_values("src", SOURCE_METHOD, "unknown_coordinate_overlay").alias("method"),
        X.map_values("src", SOURCE_CONFIDENCE, "Insufficient").alias("confidence"),
    ).agg(F.count(F.lit(1)).alias("rows_n"))


@check(
    "x25_close_to",
    """SELECT occ_id, lat, abs(lat - round_even(lat * 10, 0) / 10) <= 1e-8 AS close_lat,
    coalesce(abs(uncertainty_m - 100000) <= 0.5, FALSE) AS close_m FROM b_occurrence""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_occurrence").select(
        "occ_id", "lat", C.close_to("lat", C.round_half_even("lat", 1)).alias("close_lat"),
        C.close_to("uncertainty_m", F.lit(100000.0), 0.5).alias("close_m"),
    )


@check(
    "x26_round_half_even",
    """SELECT occ_id, round_even(lat * 10, 0) / 10 AS lat1, round_even(lon * 10000, 0) / 10000 AS lon4,
    round_even(lon * 1, 0) / 1 AS lon0, CAST(round_even(lat * 100000, 0) AS bigint) AS lat_e5
    FROM b_occurrence""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_occurrence").select(
        "occ_id", C.round_half_even("lat", 1).alias("lat1"), C.round_half_even("lon", 4).alias("lon4"),
        C.round_half_even("lon", 0).alias("lon0"), C.scaled("lat", 5).alias("lat_e5"),
    )


@check(
    "x27_evidence_unit",
    """SELECT occ_id, CASE WHEN trim(basis) = 'FOSSIL_SPECIMEN' THEN basis ELSE
      concat(CAST(CAST(round_even(lat * 100, 0) AS bigint) AS varchar), '_',
             CAST(CAST(round_even(lon * 100, 0) AS bigint) AS varchar)) END AS unit FROM b_occurrence""",
)
def _(spark, sf):
    cell = F.when(F.col("basis") == "FOSSIL_SPECIMEN", F.col("basis")).otherwise(" ")
    return bridge(spark, sf, "b_occurrence").select(
        "occ_id", C.evidence_unit(cell, "lat", "lon").alias("unit")
    )


@check(
    "x28_grid_cell",
    """SELECT occ_id, concat(CAST(CAST(floor(lat + 90) AS bigint) AS varchar), '_',
      CAST(CAST(floor(lon + 180) AS bigint) AS varchar)) AS cell1,
      concat(CAST(CAST(floor((lat + 90) / 2.5) AS bigint) AS varchar), '_',
      CAST(CAST(floor((lon + 180) / 2.5) AS bigint) AS varchar)) AS cell25 FROM b_occurrence""",
)
def _(spark, sf):
    return bridge(spark, sf, "b_occurrence").select(
        "occ_id", C.grid_cell("lat", "lon").alias("cell1"), C.grid_cell("lat", "lon", 2.5).alias("cell25")
    )


@check(
    "x29_stable_hash",
    """SELECT occ_id, sha256(concat_ws('|', CAST(taxon_key AS varchar), occ_id,
      CAST(CAST(round_even(lat * 10000000, 0) AS bigint) AS varchar), '')) AS h FROM b_occurrence""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_occurrence")
    return df.select(
        "occ_id", stable_hash("taxon_key", "occ_id", C.scaled("lat", 7), F.lit(None).cast("string")).alias("h")
    )


# ---------------------------------------------------------------- names

_NAME_SQL = r"""SELECT row_key, name,
  coalesce(regexp_matches(name, '^[A-Z][A-Za-z.-]+\s+[a-z][A-Za-z.-]+(?:\s|$)'), FALSE) AS is_binomial,
  CASE WHEN n = '' THEN 'missing_name'
    WHEN regexp_matches(n, '(?i)(^|\s)(cf|aff|nr)\.?(\s|$)') THEN 'uncertain_identification'
    WHEN regexp_matches(n, '(?i)(^|\s)(sp|spp|gen|genus|species|unknown|unidentified)\.?(\s|$)') THEN 'placeholder_or_higher_taxon'
    WHEN len(w) < 2 THEN 'not_binomial'
    WHEN NOT (regexp_full_match(w[1], '[A-Z][A-Za-zÀ-ÖØ-öø-ÿ''’-]+') AND regexp_full_match(w[2], '[a-z][A-Za-zÀ-ÖØ-öø-ÿ''’-]+')) THEN 'unusual_name_format'
    WHEN len(w) > 2 THEN 'additional_name_tokens' ELSE 'clean_binomial' END AS screen_flag,
  CASE WHEN n = '' OR lower(n) IN ('na', 'n/a', 'nan', 'none', 'null', '<missing>') THEN 'missing_species'
    WHEN len(list_intersect(list_transform(w, lambda t: rtrim(lower(t), '.')),
      ['sp', 'spp', 'cf', 'aff', 'nr', 'gen', 'indet', 'unknown', 'unidentified'])) > 0 THEN 'placeholder_or_uncertain_name'
    WHEN len(w) <> 2 THEN 'not_two_word_binomial'
    WHEN NOT regexp_full_match(w[1], '[A-Z][A-Za-z-]+') THEN 'invalid_genus_format'
    WHEN NOT regexp_full_match(w[2], '[a-z][A-Za-z-]+') THEN 'invalid_specific_epithet_format'
    ELSE 'clean_binomial' END AS strict_class
  FROM (SELECT row_key, name, n, string_split(n, ' ') AS w FROM
    (SELECT row_key, name, trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g')) AS n FROM
      (SELECT row_key, name FROM b_name UNION ALL SELECT -1 - row_key, species FROM b_record) u) v) t"""
VIEWS["o_name"] = _NAME_SQL


def _names(spark, sf):
    extra = bridge(spark, sf, "b_record").select(
        (-1 - F.col("row_key")).alias("row_key"), F.col("species").alias("name")
    )
    return bridge(spark, sf, "b_name").unionByName(extra)


@check("x30_binomial_prefix", "SELECT row_key, is_binomial FROM o_name")
def _(spark, sf):
    return _names(spark, sf).select("row_key", N.is_binomial("name").alias("is_binomial"))


@check("x31_name_screen", "SELECT row_key, screen_flag FROM o_name")
def _(spark, sf):
    return _names(spark, sf).select("row_key", N.screen_name("name").alias("screen_flag"))


@check("x32_strict_name_class", "SELECT row_key, strict_class FROM o_name")
def _(spark, sf):
    return _names(spark, sf).select("row_key", N.name_class("name").alias("strict_class"))


VIEWS["o_label_text"] = r"""
SELECT row_key, CASE
    WHEN t IS NULL OR lower(t) IN ('', 'nan', 'none', 'null', 'na', '<na>') THEN NULL
    WHEN k IN ('marine', 'ocean', 'oceanic', 'sea', 'water', 'freshwater', 'unassigned', 'unknown', 'outside') THEN NULL
    WHEN k IN ('indo malayan', 'indo malaya', 'indomalaya', 'indomalayan') THEN 'Indomalayan'
    WHEN k IN ('neotropic', 'neotropical') THEN 'Neotropical'
    WHEN k IN ('palearctic', 'palaearctic') THEN 'Palearctic'
    ELSE list_aggregate(list_transform(regexp_extract_all(lower(t), '[a-z]+|[^a-z]+'),
      lambda w: concat(upper(w[1]), w[2:])), 'string_agg', '') END AS label,
  CASE WHEN lower(b) LIKE 'high%' THEN 'High' WHEN lower(b) LIKE 'med%' THEN 'Medium'
    WHEN lower(b) LIKE 'low%' THEN 'Low' WHEN b = 'none' THEN NULL ELSE b END AS band
FROM (SELECT row_key, t, trim(regexp_replace(regexp_replace(lower(t), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS k, b
  FROM (SELECT row_key, trim(regexp_replace(label_text, '\s+', ' ', 'g')) AS t, trim(band_text) AS b FROM b_label_text) x) y"""


@check("x33_canonical_label", "SELECT row_key, label FROM o_label_text")
def _(spark, sf):
    return bridge(spark, sf, "b_label_text").select("row_key", X.canonical_label("label_text").alias("label"))


@check("x34_canonical_band", "SELECT row_key, band FROM o_label_text")
def _(spark, sf):
    return bridge(spark, sf, "b_label_text").select("row_key", X.canonical_band("band_text").alias("band"))


@check(
    "x35_as_fraction",
    """SELECT event_id, CASE WHEN q1 > 1 THEN least(greatest(p1 / 100, 0), 1) ELSE least(greatest(p1, 0), 1) END AS share,
      CASE WHEN q2 > 1 THEN least(greatest(p2 / 100, 0), 1) ELSE least(greatest(p2, 0), 1) END AS small
    FROM (SELECT event_id, p1, p2, quantile_cont(p1, 0.75) OVER () AS q1, quantile_cont(p2, 0.75) OVER () AS q2
      FROM (SELECT event_id, CAST(event_id % 130 AS double) AS p1, CAST(event_id % 130 AS double) / 128 AS p2 FROM events) t) u""",
)
def _(spark, sf):
    df = table(spark, sf, "events", ["event_id"]).select(
        "event_id", (F.col("event_id") % 130).cast("double").alias("share"),
        ((F.col("event_id") % 130).cast("double") / 128).alias("small"),
    )
    return as_fraction(as_fraction(df, "share"), "small")


@check(
    "x36_explode_names",
    r"""SELECT row_key, name FROM (SELECT row_key, CASE row_key % 6
      WHEN 0 THEN [concat('Genus a', CAST(row_key % 7 AS varchar)), 'Genus b'] WHEN 1 THEN ['Genus c', 'Genus d']
      WHEN 2 THEN ['Genus e', 'Genus f'] WHEN 3 THEN ['Genus g'] WHEN 4 THEN [NULL] ELSE ['Genus h, 1900'] END AS ns
      FROM b_multi_name) t, unnest(ns) AS u(name)""",
)
def _(spark, sf):
    return N.explode_names(bridge(spark, sf, "b_multi_name"), "input_names").select("row_key", "name")


@check(
    "x45_sequential_ids",
    """SELECT location_id, country, province_state, site, concat_ws(', ',
        CASE WHEN upper(trim(country)) IN ('', 'NA') THEN NULL ELSE trim(country) END,
        CASE WHEN upper(trim(province_state)) IN ('', 'NA') THEN NULL ELSE trim(province_state) END,
        CASE WHEN upper(trim(site)) IN ('', 'NA') THEN NULL ELSE trim(site) END) AS raw_query FROM (
      SELECT country, province_state, site, row_number() OVER (ORDER BY country, province_state, site) AS location_id
      FROM (SELECT DISTINCT coalesce(country, '') AS country, coalesce(province_state, '') AS province_state,
              coalesce(site, '') AS site FROM o_coord
            WHERE original_latitude IS NULL OR original_longitude IS NULL) t) u""",
)
def _(spark, sf):
    return unique_places(records(spark, sf), ["country", "province_state", "site"])


@check(
    "x45_formatted_ids",
    """SELECT printf('H%04d', row_number() OVER (ORDER BY c_custkey)) AS hidden_id, c_custkey FROM customer""",
)
def _(spark, sf):
    df = table(spark, sf, "customer", ["c_custkey"])
    return number_rows(df, [F.col("c_custkey").asc()], "hidden_id", fmt="H%04d")


# ---------------------------------------------------------------- filters


@check(
    "l01_lacking_coordinate",
    """SELECT country, province_state, site FROM o_coord WHERE original_latitude IS NULL OR original_longitude IS NULL""",
)
def _(spark, sf):
    df = records(spark, sf)
    return df.where(F.col("original_latitude").isNull() | F.col("original_longitude").isNull()).select(
        "country", "province_state", "site"
    )


@check("l02_failed_lookups", "SELECT seq, country, site FROM o_decided WHERE NOT final_success")
def _(spark, sf):
    return decided_places(spark, sf).where(~F.col("final_success")).select("seq", "country", "site")


@check(
    "l04_evidence_candidates",
    """SELECT row_key, cluster_id, original_latitude, original_longitude FROM o_coord
    WHERE cluster_id IS NOT NULL AND original_latitude BETWEEN -90 AND 90 AND original_longitude BETWEEN -180 AND 180""",
)
def _(spark, sf):
    df = records(spark, sf)
    return df.where(
        F.col("cluster_id").isNotNull() & C.in_range("original_latitude", "original_longitude")
    ).select("row_key", "cluster_id", "original_latitude", "original_longitude")


@check(
    "u02_distinct_places",
    """SELECT DISTINCT original_latitude, original_longitude FROM o_coord""",
)
def _(spark, sf):
    return records(spark, sf).select("original_latitude", "original_longitude").distinct()
