"""Checks of lookups, resolution, updates and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, bridge, check, records, table
from waymark.checks.scalars import decided_places, nulled
from waymark.functions import tokens as T
from waymark.functions.text import fold_key, null_tokens
from waymark.operators.lookup import (
    country_reference,
    alias_table, apply_updates, compact, enrich, lookup_ready, pending, resolve_alias, resolve_entity,
)
from waymark.operators.ranking import duplicates, pick_one, top_with_ties
from waymark.operators.reporting import inventory
from waymark.plans.places import (
    admin_queries, fill_centroids, recover_coordinates, recovery_metrics, second_round_queries,
    site_lookup, standardise_admin,
)
from waymark.session import cut_lineage

SITE_KEYS = ["country", "site"]

VIEWS["o_lookup"] = r"""
SELECT kc, ks, seq, ok AS site_success, CASE WHEN ok THEN final_source END AS site_source,
  CASE WHEN ok THEN lat END AS site_latitude, CASE WHEN ok THEN lon END AS site_longitude
FROM (SELECT *, row_number() OVER (PARTITION BY kc, ks ORDER BY ok DESC,
        CASE WHEN NOT ok THEN 8 WHEN final_source = 'osm_raw' THEN 1 WHEN final_source = 'osm_clean' THEN 2 ELSE 3 END, seq) AS place
      FROM (SELECT o_decided.*, lower(trim(country)) AS kc, lower(trim(site)) AS ks,
              CAST(final_lat AS double) AS lat, CAST(final_lon AS double) AS lon,
              coalesce(final_success AND CAST(final_lat AS double) BETWEEN -90 AND 90
                AND CAST(final_lon AS double) BETWEEN -180 AND 180, FALSE) AS ok FROM o_decided) t) u
WHERE place = 1"""

VIEWS["o_final"] = f"""
SELECT f.*,
  CASE WHEN final_valid THEN 'not_needed' WHEN has_c AND has_p THEN 'province_centroid'
       WHEN has_c THEN 'country_centroid' ELSE 'no_geographic_information' END AS next_step,
  NOT final_valid AND has_s AND has_c AS unmatched_site
FROM (
  SELECT o_coord.*,
    coalesce(original_latitude, site_latitude) AS final_latitude,
    coalesce(original_longitude, site_longitude) AS final_longitude,
    CASE WHEN original_latitude IS NOT NULL THEN 'original' ELSE site_source END AS final_source,
    CASE WHEN original_latitude IS NOT NULL THEN 'original' WHEN site_latitude IS NOT NULL THEN 'site' END AS final_level,
    original_latitude IS NOT NULL OR site_latitude IS NOT NULL AS final_valid,
    original_latitude IS NULL AND site_latitude IS NOT NULL AS lookup_added,
    site_success IS NOT NULL AS lookup_matched,
    ({nulled('country', T.SITE)}) IS NOT NULL AS has_c,
    ({nulled('province_state', T.SITE)}) IS NOT NULL AS has_p,
    ({nulled('site', T.SITE)}) IS NOT NULL AS has_s
  FROM o_coord LEFT JOIN o_lookup ON kc = lower(trim(coalesce(country, ''))) AND ks = lower(trim(coalesce(site, '')))
) f"""


def best_sites(spark, sf):
    return site_lookup(decided_places(spark, sf), SITE_KEYS, ["seq"])


def placed(spark, sf):
    """Records with recovered coordinates."""
    return recover_coordinates(bridge(spark, sf, "b_record"), best_sites(spark, sf), SITE_KEYS)


@check(
    "w01_prioritised_dedupe",
    "SELECT kc AS _key_country, ks AS _key_site, seq, site_success, site_source, site_latitude, site_longitude FROM o_lookup",
)
def _(spark, sf):
    return best_sites(spark, sf).select(
        "_key_country", "_key_site", "seq", "site_success", "site_source", "site_latitude", "site_longitude"
    )


@check(
    "w07_duplicated_keys",
    """SELECT seq, country, site FROM (SELECT b_place.*, count(*) OVER (PARTITION BY country, site) AS n FROM b_place) t
    WHERE n > 1""",
)
def _(spark, sf):
    return duplicates(bridge(spark, sf, "b_place"), SITE_KEYS).select("seq", "country", "site")


@check(
    "w04_best_with_ties",
    """SELECT p_brand, p_partkey, p_size FROM (SELECT part.*, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) t
    WHERE r = 1""",
)
def _(spark, sf):
    return top_with_ties(
        table(spark, sf, "part", ["p_brand", "p_partkey", "p_size"]), ["p_brand"], F.col("p_size").desc()
    )


_FINAL_COLS = (
    "row_key, final_latitude, final_longitude, final_source, final_level, final_valid, lookup_added, lookup_matched"
)


@check("j01_site_lookup", f"SELECT {_FINAL_COLS} FROM o_final")
def _(spark, sf):
    return placed(spark, sf).select(*_FINAL_COLS.split(", "))


@check(
    "x18_coordinate_provenance",
    """SELECT final_source, final_level, final_valid, lookup_added, lookup_matched, count(*) AS rows_n,
    count(final_latitude) AS lat_n FROM o_final GROUP BY ALL""",
)
def _(spark, sf):
    ks = ["final_source", "final_level", "final_valid", "lookup_added", "lookup_matched"]
    return placed(spark, sf).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("rows_n"), F.count("final_latitude").alias("lat_n")
    )


@check("x19_next_step", "SELECT row_key, next_step FROM o_final")
def _(spark, sf):
    return placed(spark, sf).select("row_key", "next_step")


@check("l09_unmatched_sites", "SELECT row_key, country, site FROM o_final WHERE unmatched_site")
def _(spark, sf):
    return placed(spark, sf).where("unmatched_site").select("row_key", "country", "site")


@check(
    "p01_recovery_funnel",
    """SELECT metric, value FROM (SELECT count(*) AS total_records,
      count(*) FILTER (final_source = 'original') AS original_coordinates,
      count(*) FILTER (lookup_matched) AS lookup_matched, count(*) FILTER (lookup_added) AS lookup_added,
      count(*) FILTER (final_valid) AS final_valid, count(*) FILTER (NOT final_valid) AS still_missing,
      count(*) FILTER (next_step = 'province_centroid') AS province_centroid_needed,
      count(*) FILTER (next_step = 'country_centroid') AS country_centroid_needed,
      count(*) FILTER (next_step = 'no_geographic_information') AS no_geographic_information,
      count(*) FILTER (unmatched_site) AS unmatched_site FROM o_final) t
    UNPIVOT (value FOR metric IN (total_records, original_coordinates, lookup_matched, lookup_added, final_valid,
      still_missing, province_centroid_needed, country_centroid_needed, no_geographic_information, unmatched_site))""",
)
def _(spark, sf):
    return inventory(placed(spark, sf), recovery_metrics())


@check(
    "j02_successive_enrichment",
    """SELECT c_custkey, o_orderkey, n_name FROM customer
    LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT n_nationkey, n_name FROM nation) n ON n_nationkey = c_nationkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderkey"]).withColumnRenamed("o_custkey", "c_custkey")
    nation = table(spark, sf, "nation", ["n_nationkey", "n_name"]).withColumnRenamed("n_nationkey", "c_nationkey")
    customer = table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    return enrich(
        customer,
        [(orders, ["c_custkey"], [F.col("o_orderkey").asc()]), (nation, ["c_nationkey"], [F.col("n_name").asc()])],
    ).drop("c_nationkey")


# ---------------------------------------------------------------- entities

ALIASES = {"first nation": "000", "region zero": "R0"}


def entity_refs(spark, sf):
    """Codes and names of nations out of an attribute table; regions stand for all of their
    nations. Every nation has a territory, whose rows carry the nation's name as well."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("string")
    lands = named.select(
        F.lit("-99").alias("iso3"), F.concat(F.lit("n"), key).alias("adm3"), F.concat(F.lit("N"), key).alias("own"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("iso2"), key.alias("number"),
        F.col("n_name").alias("admin"), F.col("r_name").alias("unit"), F.col("n_name").alias("sovereign"),
    )
    territories = named.select(
        F.concat(F.lit("T"), key).alias("iso3"), F.lit(None).cast("string").alias("adm3"), F.concat(F.lit("N"), key).alias("own"),
        F.lit("-99").alias("iso2"), F.lit("").alias("number"),
        F.col("n_name").alias("admin"), F.concat(F.lit("Isle "), key).alias("unit"), F.col("n_name").alias("sovereign"),
    )
    codes, names, _ = country_reference(
        lands.unionByName(territories), ["iso3", "adm3"], ["iso2"], ["number"], ["admin", "unit"], "own", ["admin", "sovereign"]
    )
    return codes, names


VIEWS["o_entity"] = r"""
SELECT row_key, code_status, name_status, entity_from_code, entity_from_name,
  CASE WHEN entity_from_code <> entity_from_name THEN 'conflict_needs_manual_review'
       WHEN coalesce(entity_from_code, entity_from_name) IS NOT NULL THEN 'resolved'
       WHEN name_clean IS NULL AND code_clean IS NULL THEN 'missing_country_identifier'
       WHEN name_status = 'needs_manual_review' THEN 'country_name_needs_manual_review'
       ELSE 'unresolved_country' END AS entity_status,
  CASE WHEN entity_from_code <> entity_from_name THEN NULL
       ELSE coalesce(entity_from_code, entity_from_name) END AS entity, name_method,
  CASE WHEN entity_from_code <> entity_from_name THEN 'valid_iso_conflicts_with_country_name'
       WHEN entity_from_code IS NOT NULL THEN 'valid_input_iso' WHEN entity_from_name IS NOT NULL THEN name_method
       WHEN name_clean IS NULL AND code_clean IS NULL THEN 'none' WHEN name_status = 'needs_manual_review' THEN name_method
       WHEN code_status = 'invalid' AND name_status IN ('unresolved', 'missing') THEN 'invalid_iso_and_unresolved_name'
       WHEN code_status = 'invalid' THEN 'invalid_input_iso' WHEN name_method <> '' THEN name_method
       ELSE 'country_not_resolved' END AS entity_method
FROM (SELECT *, CASE WHEN key = '' THEN '' WHEN key = 'zaire' THEN 'historical_or_special_name' WHEN key = 'first nation' THEN 'exact_alias'
      WHEN regexp_full_match(key, 'nation [0-9]+') THEN 'natural_earth_exact_name' WHEN name_status = 'ambiguous' THEN 'multiple_natural_earth_name_matches'
      WHEN name_status = 'resolved' THEN 'exact_country_prefix_before_locality' ELSE 'country_name_not_recognised' END AS name_method FROM (
  SELECT q.*,
    CASE WHEN code_clean IS NULL THEN 'missing' WHEN regexp_matches(code_clean, '^[0-9]+$') THEN 'valid'
         WHEN upper(code_clean) LIKE 'R-%' THEN 'ambiguous' ELSE 'invalid' END AS code_status,
    CASE WHEN regexp_matches(code_clean, '^[0-9]+$') THEN concat('N', code_clean) END AS entity_from_code,
    CASE WHEN key = '' THEN 'missing' WHEN key = 'zaire' THEN 'needs_manual_review'
         WHEN key = 'first nation' THEN 'resolved'
         WHEN regexp_full_match(key, 'nation [0-9]+') THEN 'resolved'
         WHEN key IN (SELECT lower(r_name) FROM region) THEN 'ambiguous'
         WHEN contains(name_clean, ':') THEN 'resolved' ELSE 'unresolved' END AS name_status,
    CASE WHEN key = 'first nation' THEN 'N0'
         WHEN regexp_full_match(key, 'nation [0-9]+') THEN concat('N', substr(key, 8))
         WHEN contains(name_clean, ':') THEN concat('N', substr(lower(string_split(name_clean, ':')[1]), 8)) END AS entity_from_name
  FROM (SELECT row_key,
      CASE WHEN lower(trim(code_in)) = 'na' THEN NULL ELSE trim(code_in) END AS code_clean,
      CASE WHEN lower(trim(name_in)) = 'unknown' THEN NULL ELSE trim(name_in) END AS name_clean,
      CASE WHEN lower(trim(name_in)) = 'unknown' THEN '' ELSE
        trim(regexp_replace(lower(name_in), '[^a-z0-9]+', ' ', 'g')) END AS key FROM b_entity_query) q) r0) r"""


@check(
    "j04_country_resolution",
    "SELECT row_key, code_status, name_status, name_method, entity_from_code, entity_from_name, entity_status, entity_method, entity FROM o_entity",
)
def _(spark, sf):
    codes, names = entity_refs(spark, sf)
    out = resolve_entity(bridge(spark, sf, "b_entity_query"), "code_in", "name_in", codes, names, aliases=ALIASES)
    return out.select(
        "row_key", "code_status", "name_status", "name_method", "entity_from_code", "entity_from_name", "entity_status", "entity_method", "entity"
    )


def area_aliases(spark, sf):
    return alias_table(bridge(spark, sf, "b_area"), "area_id", "parent_id", ["name_en", "name", "name_alt"])


VIEWS["o_admin"] = f"""
SELECT target_level, country, country_iso, province_state, identifier_source, record_count,
  entity, CASE WHEN entity IS NOT NULL THEN 'resolved'
     WHEN code_clean IS NULL AND name_clean IS NULL THEN 'missing_country_identifier'
     ELSE 'unresolved_country' END AS entity_status,
  CASE WHEN p IS NULL THEN 'province_missing' WHEN entity IS NULL THEN 'country_not_resolved'
     WHEN length(replace(p, ' ', '')) <= 3 THEN 'ready_but_abbreviation_needs_attention'
     ELSE 'ready_for_matching' END AS province_status,
  concat(coalesce(entity, ''), '|', coalesce(lower(p), '')) AS province_match_key
FROM (SELECT g.*, CASE WHEN code_clean IS NOT NULL THEN concat('N', code_clean)
        WHEN name_clean IS NOT NULL THEN concat('N', substr(lower(name_clean), 8)) END AS entity
  FROM (SELECT target_level, country, country_iso, province_state, identifier_source, count(*) AS record_count,
      {nulled('country_iso', T.ADMIN)} AS code_clean, {nulled('country', T.ADMIN)} AS name_clean,
      {nulled('province_state', T.ADMIN)} AS p
    FROM (SELECT target_level, country, country_iso, identifier_source,
        CASE WHEN target_level = 'province' THEN province_state END AS province_state
      FROM (SELECT o_final.*, CASE WHEN sp AND (sc OR si) THEN 'province' WHEN sc OR si THEN 'country' ELSE 'other' END AS target_level,
          CASE WHEN sc THEN 'country' WHEN si THEN 'country_iso' ELSE 'missing_country_and_country_iso' END AS identifier_source
        FROM (SELECT o_final.*, ({nulled('country', T.SCREEN)}) IS NOT NULL AS sc,
            ({nulled('country_iso', T.SCREEN, T.SCREEN_KEEP_NA)}) IS NOT NULL AS si,
            ({nulled('province_state', T.SCREEN)}) IS NOT NULL AS sp FROM o_final WHERE NOT final_valid) o_final) s
      WHERE target_level <> 'other') t
    GROUP BY target_level, country, country_iso, province_state, identifier_source) g) h"""

_ADMIN_COLS = "target_level, country, country_iso, province_state, identifier_source, record_count"


@check("a01_admin_queries", f"SELECT {_ADMIN_COLS} FROM o_admin")
def _(spark, sf):
    return admin_queries(placed(spark, sf))


def standard_queries(spark, sf):
    codes, names = entity_refs(spark, sf)
    return standardise_admin(admin_queries(placed(spark, sf)), codes, names)


@check(
    "x22_province_readiness",
    f"SELECT {_ADMIN_COLS}, entity, entity_status, province_status, province_match_key FROM o_admin",
)
def _(spark, sf):
    return standard_queries(spark, sf).select(
        *_ADMIN_COLS.split(", "), "entity", "entity_status", "province_status", "province_match_key"
    )


VIEWS["o_area_hits"] = """
SELECT q.country, q.country_iso, q.province_state, q.identifier_source, q.province_status, q.entity,
  count(DISTINCT a.area_id) AS candidates_n, min(a.area_id) AS area_id
FROM (SELECT * FROM o_admin WHERE target_level = 'province') q
LEFT JOIN b_area a ON a.parent_id = q.entity
  AND lower(coalesce(a.name_en, a.name, a.name_alt)) = lower(trim(q.province_state))
GROUP BY q.country, q.country_iso, q.province_state, q.identifier_source, q.province_status, q.entity"""


@check(
    "j05_alias_resolution",
    """SELECT country, country_iso, province_state, identifier_source, candidates_n,
    CASE WHEN province_status <> 'ready_for_matching' THEN 'not_ready_after_standardisation'
      WHEN candidates_n > 1 THEN 'ambiguous_match' WHEN candidates_n = 1 THEN 'matched' ELSE 'unmatched' END AS match_status,
    CASE WHEN candidates_n = 1 THEN area_id END AS area FROM o_area_hits""",
)
def _(spark, sf):
    queries = standard_queries(spark, sf).where("target_level = 'province'")
    out = resolve_alias(
        queries, area_aliases(spark, sf), "entity", "province_key",
        F.col("province_status") == "ready_for_matching",
    )
    return out.select(
        "country", "country_iso", "province_state", "identifier_source", "candidates_n", "match_status", "area"
    )


def country_centroids(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").where(n != 3).select(
        F.concat(F.lit("N"), n.cast("string")).alias("entity"),
        (n.cast("double") / 2).alias("latitude"), (n.cast("double") * 3).alias("longitude"),
    )


@check(
    "j06_ready_lookup",
    """SELECT country, country_iso, identifier_source,
    CASE WHEN entity_status <> 'resolved' THEN 'not_ready_after_standardisation'
      WHEN entity = 'N3' THEN 'unmatched' ELSE 'matched' END AS match_status,
    CASE WHEN entity <> 'N3' THEN CAST(substr(entity, 2) AS double) / 2 END AS latitude
    FROM o_admin WHERE target_level = 'country'""",
)
def _(spark, sf):
    queries = standard_queries(spark, sf).where("target_level = 'country'")
    out = lookup_ready(
        queries, country_centroids(spark, sf), "entity", F.col("entity_status") == "resolved", "latitude"
    )
    return out.select("country", "country_iso", "identifier_source", "match_status", "latitude")


@check(
    "p02_centroid_fill",
    f"""SELECT row_key,
      CASE WHEN final_valid THEN final_latitude WHEN has_p THEN plat WHEN e <> 'N3' THEN CAST(substr(e, 2) AS double) / 2 END AS final_latitude,
      CASE WHEN final_valid THEN final_longitude WHEN has_p THEN plon WHEN e <> 'N3' THEN CAST(substr(e, 2) AS double) * 3 END AS final_longitude,
      CASE WHEN final_valid THEN final_source WHEN has_p AND plat IS NOT NULL THEN 'province_centroid'
        WHEN NOT has_p AND e <> 'N3' THEN 'country_centroid' END AS final_source
    FROM (
      SELECT f.row_key, f.final_valid, f.final_latitude, f.final_longitude, f.final_source, e, hp AS has_p,
        min(latitude) AS plat, min(longitude) AS plon, count(area_id) AS hits
      FROM (SELECT o_final.*, ({nulled('province_state', T.CENTROID)}) IS NOT NULL AS hp,
          CASE WHEN country_iso <> 'NA' THEN concat('N', country_iso)
               WHEN lower(trim(country)) <> 'unknown' THEN concat('N', substr(lower(trim(country)), 8)) END AS e FROM o_final) f
      LEFT JOIN (SELECT area_id, parent_id, lower(coalesce(name_en, name, name_alt)) AS k, latitude, longitude,
            count(*) OVER (PARTITION BY parent_id, lower(coalesce(name_en, name, name_alt))) AS shared FROM b_area) a
        ON parent_id = e AND k = lower(trim(province_state)) AND shared = 1
      GROUP BY ALL) g""",
)
def _(spark, sf):
    areas = bridge(spark, sf, "b_area").select(F.col("area_id").alias("area"), "latitude", "longitude")
    # the recovered records are written once; the queries and the fill both read them
    base = cut_lineage(placed(spark, sf))
    queries = standardise_admin(admin_queries(base), *entity_refs(spark, sf))
    out = fill_centroids(base, queries, area_aliases(spark, sf), areas, country_centroids(spark, sf))
    return out.select("row_key", "final_latitude", "final_longitude", "final_source")


@check(
    "j03_two_level_lookup",
    """SELECT row_key, CASE WHEN prov <> '' THEN CAST(n_regionkey + length(prov) AS double) ELSE CAST(n_regionkey AS double) / 2 END AS final_latitude,
      CASE WHEN prov <> '' THEN 'province' ELSE 'country' END AS fill_level
    FROM (SELECT row_key, n_regionkey, CASE WHEN province_state IN ('NA', '') THEN '' ELSE province_state END AS prov
      FROM b_record JOIN nation ON lower(trim(country)) = lower(n_name)) t""",
)
def _(spark, sf):
    from waymark.functions.text import has_text, match_text
    from waymark.operators.lookup import hierarchical_lookup

    nation = table(spark, sf, "nation")
    parent = nation.select(
        match_text("n_name").alias("_key_country"), (F.col("n_regionkey") / 2.0).alias("latitude"),
        F.lit(1.0).alias("longitude"),
    )
    child = (
        table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "n_regionkey", "c_mktsegment").distinct()
    )
    child = child.select(
        match_text("n_name").alias("_key_country"), match_text("c_mktsegment").alias("_key_province_state"),
        (F.col("n_regionkey") + F.length("c_mktsegment")).cast("double").alias("latitude"),
        F.lit(2.0).alias("longitude"),
    )
    blank = F.lit(None).cast("double")
    df = bridge(spark, sf, "b_record").where(null_tokens("country", T.CENTROID).isNotNull())
    df = df.withColumns({"final_latitude": blank, "final_longitude": blank})
    out = hierarchical_lookup(
        df, child, parent, ["country", "province_state"], ["country"], has_text("province_state", T.CENTROID)
    )
    return out.select("row_key", "final_latitude", "fill_level")


# ---------------------------------------------------------------- updates and journals


@check(
    "j07_virtual_update",
    """SELECT r.row_key, coalesce(r.label, u.assigned_label) AS effective_label,
    CASE WHEN u.row_key IS NULL THEN 'none' WHEN r.label IS NULL THEN 'applied' ELSE 'existing_preserved' END AS update_status,
    u.row_key IS NULL OR u.record_id = r.record_id AS update_id_ok
    FROM (SELECT row_key, record_id, CASE WHEN label = 'N/A' THEN NULL ELSE label END AS label FROM b_record) r
    LEFT JOIN b_update u ON u.row_key = r.row_key""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_record").withColumn("label", null_tokens("label", T.LABEL))
    out = apply_updates(df, bridge(spark, sf, "b_update"), "row_key", "record_id", "label")
    return out.select("row_key", "effective_label", "update_status", "update_id_ok")


@check(
    "j13_pending_work",
    """SELECT row_key, clean_query FROM (
      SELECT row_key, CASE WHEN cleaned = '' THEN raw_query ELSE cleaned END AS clean_query FROM o_clean WHERE row_key % 4 <> 0) t
    WHERE clean_query IS NULL OR clean_query NOT IN (SELECT n_name FROM nation)""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_raw_query").withColumn("ok", F.when(F.col("row_key") % 4 == 0, "true").otherwise("no"))
    done = table(spark, sf, "nation").select(F.col("n_name").alias("clean_query"))
    return second_round_queries(df, "raw_query", "ok", done).select("row_key", "clean_query")


@check(
    "j14_inner_with_renames",
    """SELECT o_orderkey, c_mktsegment AS segment_cluster FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_acctbal > 0""",
)
def _(spark, sf):
    eligible = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment_cluster")
    )
    return table(spark, sf, "orders", ["o_orderkey", "o_custkey"]).join(eligible, "o_custkey").drop("o_custkey")


@check(
    "w05_keep_last",
    """SELECT query_name, arg_max(seq, seq) AS seq, arg_max(request_status, seq) AS request_status,
    arg_max(decision, seq) AS decision FROM b_journal GROUP BY query_name""",
)
def _(spark, sf):
    return pick_one(bridge(spark, sf, "b_journal"), ["query_name"], [F.col("seq").desc()]).drop("confidence")


@check(
    "u05_journal_compaction",
    """SELECT query_name, seq, decision FROM (
      SELECT query_name, seq, decision, row_number() OVER (PARTITION BY query_name ORDER BY seq DESC, decision) AS r FROM (
        SELECT query_name, seq, decision FROM b_journal
        UNION ALL SELECT CAST(c_custkey AS varchar), -1, 'seed' FROM customer) t
      WHERE query_name IN (SELECT CAST(c_custkey AS varchar) FROM customer WHERE c_custkey % 2 = 0)) u WHERE r = 1""",
)
def _(spark, sf):
    customer = table(spark, sf, "customer", ["c_custkey"])
    name = F.col("c_custkey").cast("string").alias("query_name")
    seed = customer.select(name, F.lit(-1).cast("bigint").alias("seq"), F.lit("seed").alias("decision"))
    known = customer.where("c_custkey % 2 = 0").select(name)
    journal = bridge(spark, sf, "b_journal").select("query_name", "seq", "decision")
    return compact([seed, journal], known, ["query_name"], [F.col("seq").desc(), F.col("decision").asc()])


@check(
    "u01_union_aligned",
    """SELECT row_key, country, NULL AS site FROM (SELECT row_key, country FROM b_record) a
    UNION ALL SELECT seq, country, site FROM b_place""",
)
def _(spark, sf):
    a = bridge(spark, sf, "b_record").select("row_key", "country")
    b = bridge(spark, sf, "b_place").select(F.col("seq").alias("row_key"), "country", "site")
    return a.unionByName(b, allowMissingColumns=True)


@check(
    "u03_set_checks",
    """SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) a) AS common_n,
    (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) b) AS left_only_n,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) c) AS right_only_n""",
)
def _(spark, sf):
    from waymark.operators.validation import key_diff

    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    side = key_diff(a, b, ["k"])
    return side.agg(
        F.count_if(F.col("side") == "both").alias("common_n"),
        F.count_if(F.col("side") == "left").alias("left_only_n"),
        F.count_if(F.col("side") == "right").alias("right_only_n"),
    )
