"""Registry of checked queries and the derived tables they run on.

Every check has a Spark callable and, where SQL can say it, an independent SQL twin. Both
start from the same derived tables, written once in SQL that Spark and a second engine read
alike: integer and string arithmetic only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.coords import original_coordinates
from waymark.sources.regions import rectangle_edges
from waymark.sources.tables import scan

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "labels",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a Spark query and its SQL twin."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate check {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prefix a query with the derived tables it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[bo]_[a-z_0-9]+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_PLANS: dict[tuple, DataFrame] = {}


def _plan(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a scan's plan (never its data) within a session, to infer each schema once."""
    key = (spark.sparkContext.applicationId, id(spark), *key)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def table(spark: SparkSession, sf: str, name: str, cols: list[str] | None = None) -> DataFrame:
    df = _plan(spark, ("table", sf, name), lambda: scan(spark, f"{sf}/{name}.parquet"))
    return df.select(*cols) if cols else df


_ALPHABET = "'abcdefghijklmnopqrstuvwxyz'"


def _s(x: str) -> str:
    return f"CAST({x} AS varchar(20))"


VIEWS["b_record"] = f"""
SELECT row_key, record_id, cluster_id, species, country, country_iso, province_state, site,
  CASE WHEN row_key % 3 <> 0 THEN NULL
       WHEN row_key % 39 = 0 THEN '0, 0'
       WHEN row_key % 51 = 0 THEN 'unknown'
       WHEN row_key % 2 = 0 THEN concat('POINT (', {_s('lon')}, '.0 ', {_s('lat')},
            CASE WHEN row_key % 4 = 0 THEN '.0)' ELSE '.5)' END)
       ELSE concat({_s('lat')}, '.25, ', {_s('lon')}, '.0') END AS coord,
  label
FROM (
  SELECT o_orderkey AS row_key, concat('B', {_s('o_orderkey')}) AS record_id,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         ELSE concat('P', lpad({_s('c_nationkey * 8 + o_custkey % 8')}, 4, '0')) END AS cluster_id,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL
         WHEN o_orderkey % 13 = 0 THEN concat('Genus', substr({_ALPHABET}, CAST(o_custkey % 26 AS int) + 1, 1), ' sp.')
         WHEN o_orderkey % 17 = 0 THEN 'Genus cf. alpha'
         ELSE concat('Genus', substr({_ALPHABET}, CAST(o_custkey % 26 AS int) + 1, 1),
                     ' species', substr({_ALPHABET}, CAST(o_custkey % 11 AS int) + 1, 1)) END AS species,
    CASE WHEN o_orderkey % 23 = 0 THEN 'unknown'
         WHEN o_orderkey % 29 = 0 THEN concat('  ', lower(n_name), ' ') ELSE n_name END AS country,
    CASE WHEN o_orderkey % 21 = 0 THEN 'NA' ELSE {_s('c_nationkey')} END AS country_iso,
    CASE WHEN o_orderkey % 11 = 0 THEN 'NA' WHEN o_orderkey % 31 = 0 THEN ''
         ELSE c_mktsegment END AS province_state,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL
         ELSE concat('Site ', {_s('o_custkey % 50')}) END AS site,
    CASE WHEN o_orderkey % 5 = 0 THEN r_name WHEN o_orderkey % 35 = 1 THEN 'N/A' END AS label,
    -175 + 14 * c_nationkey + o_custkey % 15
      + CASE WHEN o_orderkey % 10 <> 0 THEN 0 WHEN c_nationkey <= 22 THEN 28 ELSE -28 END AS lon,
    -60 + (o_custkey * 7) % 121 AS lat
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
    JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
) x"""

VIEWS["b_region"] = """
SELECT CAST(n_nationkey AS bigint) AS region, n_name AS eco, r_name AS label_raw,
  -175 + 14 * n_nationkey AS x0, -161 + 14 * n_nationkey AS x1, -60 AS y0, 61 AS y1
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey <> 6
UNION ALL
SELECT CAST(n_nationkey + 1000 AS bigint), concat(n_name, '_core'), r_name,
  -175 + 14 * n_nationkey, -170 + 14 * n_nationkey, -10, 10
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0"""

VIEWS["b_occurrence"] = f"""
SELECT l_partkey % 120 AS taxon_key,
  concat({_s('l_orderkey')}, '-', {_s('l_linenumber')}, '-', {_s('l_partkey')}, '-',
         {_s('l_suppkey')}, '-', {_s('CAST(l_quantity AS int)')}) AS occ_id,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS double)
       WHEN l_orderkey % 101 = 0 THEN CAST(95 AS double)
       ELSE CAST(-6000 + (l_suppkey * 1300 + l_linenumber * 2925) % 12100 AS double) / 100 END AS lat,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS double)
       ELSE CAST(-17500 + (l_suppkey * 3700 + (l_orderkey % 7) * 150) % 35000 AS double) / 100 END AS lon,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity * 5000 END AS uncertainty_m,
  CASE WHEN l_returnflag = 'A' THEN 'PRESERVED_SPECIMEN' WHEN l_returnflag = 'N' THEN 'HUMAN_OBSERVATION'
       ELSE 'FOSSIL_SPECIMEN' END AS basis
FROM {{lineitem}}"""

VIEWS["b_response"] = f"""
SELECT p_partkey AS seq,
  concat('Genus', substr({_ALPHABET}, CAST(p_partkey % 26 AS int) + 1, 1),
         ' species', substr({_ALPHABET}, CAST(p_partkey % 11 AS int) + 1, 1)) AS query_name,
  concat('{{{{"usageKey":', {_s('1000 + p_partkey % 90')},
    CASE WHEN p_partkey % 6 = 0 THEN concat(',"acceptedUsageKey":', {_s('1000 + p_partkey % 30')}) ELSE '' END,
    ',"rank":"', CASE WHEN p_partkey % 9 = 0 THEN 'GENUS' ELSE 'SPECIES' END,
    '","status":"', CASE WHEN p_partkey % 6 = 0 THEN 'SYNONYM' WHEN p_partkey % 14 = 0 THEN 'DOUBTFUL' ELSE 'ACCEPTED' END,
    '","matchType":"', CASE WHEN p_partkey % 15 = 0 THEN 'NONE' WHEN p_partkey % 8 = 0 THEN 'FUZZY' ELSE 'EXACT' END,
    '","confidence":', {_s('90 + p_partkey % 11')},
    ',"kingdom":"Animalia","order":"', CASE WHEN p_partkey % 25 = 0 THEN 'Diptera' ELSE 'Coleoptera' END,
    '","alternatives":', CASE WHEN p_partkey % 5 = 0 THEN '[{{{{"k":"1"}}}},{{{{"k":"2"}}}}]' ELSE '[]' END,
    '}}}}') AS body,
  CASE WHEN p_partkey % 33 = 0 THEN 'failed' ELSE 'success' END AS request_status
FROM {{part}}"""

VIEWS["b_place"] = f"""
SELECT n_name AS country, concat('Site ', {_s('c_custkey % 50')}) AS site,
  c_custkey AS seq,
  CASE WHEN (n_nationkey + c_custkey) % 3 = 0 THEN 'True' ELSE 'false' END AS raw_success,
  CASE WHEN (n_nationkey + c_custkey) % 3 = 1 THEN 'yes' ELSE '0' END AS clean_success,
  CASE WHEN (n_nationkey + c_custkey) % 5 = 0 THEN '1' END AS fallback_success,
  concat({_s('-60 + (n_nationkey * 7 + c_custkey) % 121')}, '.5') AS lat_text,
  concat({_s('-170 + (n_nationkey * 14 + c_custkey) % 340')}, '.5') AS lon_text
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""

VIEWS["b_raw_query"] = f"""
SELECT o_orderkey AS row_key,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('Mt. Alpha, 10 km N of Site ', {_s('o_custkey % 50')})
    WHEN 1 THEN 'approx 5 miles SW of Blue Ck, light trap'
    WHEN 2 THEN 'Lk Verde; Nat. Parq (north side of), ca. 3 km'
    WHEN 3 THEN 'Plot B12, near Green River,, Station 7'
    WHEN 4 THEN concat('Hwy ', {_s('o_custkey % 90')}, ' Jct, campground')
    WHEN 5 THEN NULL
    WHEN 6 THEN '10 km'
    ELSE n_name END AS raw_query
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey"""

VIEWS["b_admin_name"] = """
SELECT c_custkey AS row_key,
  CASE c_custkey % 8
    WHEN 0 THEN concat('province of ', lower(c_mktsegment))
    WHEN 1 THEN concat(lower(c_mktsegment), ' state region')
    WHEN 2 THEN 'state province'
    WHEN 3 THEN 'province'
    WHEN 4 THEN concat('state of region of ', lower(c_mktsegment), ' county')
    WHEN 5 THEN concat(lower(c_mktsegment), ' autonomous region')
    WHEN 6 THEN concat(lower(c_mktsegment), ' oblast district territory')
    ELSE lower(c_mktsegment) END AS name_key
FROM {customer}"""

VIEWS["b_number_text"] = f"""
SELECT event_id,
  CASE event_id % 9 WHEN 0 THEN '1d' WHEN 1 THEN '1e3' WHEN 2 THEN concat(' ', {_s('event_id')}, '.5 ')
    WHEN 3 THEN 'inf' WHEN 4 THEN '' WHEN 5 THEN 'nan' WHEN 6 THEN NULL
    WHEN 7 THEN concat('-', {_s('event_id')}, '.25') ELSE {_s('event_id')} END AS text
FROM {{events}}"""

VIEWS["b_name"] = f"""
SELECT o_orderkey AS row_key,
  CASE o_orderkey % 13
    WHEN 0 THEN 'Genus species Author, 1900' WHEN 1 THEN 'genus species' WHEN 2 THEN 'Genus sp'
    WHEN 3 THEN 'Genus cf. alpha' WHEN 4 THEN 'Genus' WHEN 5 THEN 'Genus épithète'
    WHEN 6 THEN 'Clerinae gen' WHEN 7 THEN NULL WHEN 8 THEN '  Genus   minor '
    WHEN 9 THEN 'Genus Upper' WHEN 10 THEN 'Genus x.y' WHEN 11 THEN 'N/A'
    ELSE concat('Genus', substr({_ALPHABET}, CAST(o_custkey % 26 AS int) + 1, 1), ' minor') END AS name
FROM {{orders}}"""

VIEWS["b_multi_name"] = f"""
SELECT p_partkey AS row_key,
  CASE p_partkey % 6
    WHEN 0 THEN concat('Genus a', {_s('p_partkey % 7')}, ' | Genus b') WHEN 1 THEN 'Genus c; Genus d ;NA'
    WHEN 2 THEN '["Genus e", "Genus  f"]' WHEN 3 THEN concat('[', chr(39), 'Genus g', chr(39), ', ', chr(39), 'nan', chr(39), ']')
    WHEN 4 THEN NULL ELSE 'Genus h, 1900' END AS input_names
FROM {{part}}"""

VIEWS["b_label_text"] = f"""
SELECT o_orderkey AS row_key,
  CASE o_orderkey % 9 WHEN 0 THEN 'Indo-Malayan' WHEN 1 THEN ' neotropic ' WHEN 2 THEN 'OCEAN'
    WHEN 3 THEN 'palaearctic' WHEN 4 THEN '<NA>' WHEN 5 THEN 'middle  east' WHEN 6 THEN NULL
    ELSE o_orderpriority END AS label_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'HIGH (10+)' WHEN 1 THEN 'med' WHEN 2 THEN ' Low ' WHEN 3 THEN 'none'
    ELSE 'other' END AS band_text
FROM {{orders}}"""

VIEWS["b_entity_query"] = f"""
SELECT o_orderkey AS row_key,
  CASE o_orderkey % 12 WHEN 0 THEN r_name WHEN 1 THEN 'Zaire'
    WHEN 2 THEN concat(n_name, ':Somewhere|', {_s('o_custkey % 5')})
    WHEN 3 THEN concat('NATION_', {_s('(n_nationkey + 1) % 25')}) WHEN 4 THEN 'Atlantis'
    WHEN 5 THEN 'unknown' WHEN 6 THEN ' nation  ' WHEN 7 THEN 'First  Nation'
    WHEN 8 THEN lower(n_name) ELSE n_name END AS name_in,
  CASE o_orderkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'xx' WHEN 2 THEN NULL
    WHEN 3 THEN concat('r-', {_s('n_regionkey')}) ELSE {_s('n_nationkey')} END AS code_in
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
  JOIN {{region}} ON n_regionkey = r_regionkey"""

VIEWS["b_area"] = f"""
SELECT DISTINCT concat({_s('c_nationkey')}, '-', c_mktsegment) AS area_id,
  concat('N', {_s('c_nationkey')}) AS parent_id,
  CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS name_en,
  CASE WHEN c_nationkey % 3 = 1 THEN lower(c_mktsegment) END AS name,
  CASE WHEN c_nationkey % 3 = 2 THEN
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'BUILDING' ELSE c_mktsegment END END AS name_alt,
  CAST(c_nationkey + length(c_mktsegment) AS double) / 4 AS latitude,
  CAST(c_nationkey * 5 - length(c_mktsegment) AS double) / 4 AS longitude
FROM {{customer}}"""

VIEWS["b_update"] = f"""
SELECT o_orderkey + CASE WHEN o_orderkey % 200 = 4 THEN 100000000 ELSE 0 END AS row_key,
  CASE WHEN o_orderkey % 44 = 0 THEN 'X' ELSE concat('B', {_s('o_orderkey')}) END AS record_id,
  concat('L', {_s('o_orderkey % 3')}) AS assigned_label
FROM {{orders}} WHERE o_orderkey % 4 = 0"""

VIEWS["b_taxon"] = f"""
SELECT p_partkey AS taxon_key,
  concat('Genus', substr({_ALPHABET}, CAST(p_partkey % 26 AS int) + 1, 1),
         ' species', substr({_ALPHABET}, CAST(p_partkey % 11 AS int) + 1, 1),
         CASE WHEN p_partkey % 7 = 0 THEN concat(' | Other name', {_s('p_partkey % 286 % 6')}) ELSE '' END) AS input_names,
  CASE p_partkey % 286 % 6 WHEN 0 THEN 'AFRICA' WHEN 1 THEN ' america' WHEN 2 THEN 'Asia' WHEN 3 THEN 'europe'
    WHEN 4 THEN 'Middle  East' ELSE 'ocean' END AS dominant_label,
  CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'Low' ELSE 'no_realm_evidence' END AS taxon_confidence,
  CAST(50 + p_partkey % 51 AS double) AS dominant_proportion,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_partkey % 61 END AS assigned_records_n,
  CAST(40 + p_partkey % 61 AS double) / 100 AS overlay_coverage
FROM {{part}}"""

VIEWS["b_journal"] = f"""
SELECT event_id AS seq, {_s('user_id')} AS query_name,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS request_status,
  event_type AS decision, value AS confidence
FROM {{events}}"""

_TEMPLATES = dict(VIEWS)
for _name, _text in _TEMPLATES.items():
    VIEWS[_name] = _text.format(**{t: t for t in TABLES})


def bridge(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table as a DataFrame over the given tables."""
    text = _TEMPLATES[name]
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return _plan(
        spark, ("bridge", sf, name),
        lambda: spark.sql(text, **{t: table(spark, sf, t) for t in used}),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their original coordinates."""
    return original_coordinates(bridge(spark, sf, "b_record"))


def regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Edges and attributes of the region layer."""
    boxes = bridge(spark, sf, "b_region")
    attrs = boxes.select("region", "eco", F.col("label_raw").alias("label"))
    return rectangle_edges(boxes, "region", "x0", "x1", "y0", "y1"), attrs
