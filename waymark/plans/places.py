"""From place text to coordinates: queries, lookup decisions, merge and centroid fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tokens as T
from waymark.functions.coords import original_coordinates, to_number, valid_coord
from waymark.functions.text import (
    audit_clean, clean_place_query, fold_key, has_text, is_abbreviation, parse_bool,
    place_query, relaxed_key, admin_match_key, null_tokens, on_distinct,
)
from waymark.operators.lookup import (
    cascade, coalesce_coords, hierarchical_lookup, lookup_left, lookup_ready, next_step,
    pending, prepare_centroids, prepare_lookup, resolve_alias, resolve_entity, screen_admin,
)
from waymark.operators.ranking import number_rows
from waymark.session import cut_lineage

SITE_COLUMNS = ("site_success", "site_source", "site_latitude", "site_longitude")


def unique_places(records: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbered distinct places of records lacking either coordinate, with their query text."""
    lacking = records.where(
        F.col("original_latitude").isNull() | F.col("original_longitude").isNull()
    )
    places = lacking.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols]).distinct()
    numbered = number_rows(places, [F.col(c).asc() for c in cols], "location_id")
    return numbered.withColumn("raw_query", place_query(*cols, tokens=T.UPPER_NA))


def second_round_queries(responses: DataFrame, raw: str, success: str, results: DataFrame) -> DataFrame:
    """Cleaned queries of failed lookups that have no completed second-round result."""
    failed = responses.where(~parse_bool(success, T.TRUE_LOOKUP))
    once = on_distinct(failed, raw, "clean_query", clean_place_query)
    filled = once.withColumn("clean_query", F.coalesce("clean_query", F.lit("")))
    cleaned = audit_clean(filled, raw, "clean_query")
    return pending(cleaned, results, ["clean_query"], F.lit(True))


def decide_lookup(
    responses: DataFrame, ok: dict[str, str], values: dict[str, dict[str, str]]
) -> DataFrame:
    """Chosen source and its values per response row, in source order.

    ok maps a source to its success column; values maps it to {output: column}.
    """
    branches = [
        (source, parse_bool(flag, T.TRUE_LOOKUP), {o: F.col(c) for o, c in values[source].items()})
        for source, flag in ok.items()
    ]
    decided = cascade(responses, branches, "failed", "final_source")
    success = F.col("final_source") != "failed"
    return decided.withColumns(
        {"final_success": success, "final_level": F.when(success, "site").otherwise("failed")}
    )


def site_lookup(decided: DataFrame, ks: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One usable lookup row per normalised place key."""
    shaped = decided.withColumns(
        {
            "site_success": parse_bool("final_success", T.TRUE_MERGE),
            "site_source": F.col("final_source"),
            "site_latitude": to_number("final_lat"),
            "site_longitude": to_number("final_lon"),
        }
    )
    return prepare_lookup(
        shaped, ks, "site_success", "site_source", "site_latitude", "site_longitude", tie
    )


def recover_coordinates(records: DataFrame, lookup: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Final coordinates with provenance and the next step for records still without one."""
    located = original_coordinates(records)
    joined = lookup_left(located, lookup, ks, SITE_COLUMNS)
    merged = coalesce_coords(
        joined, ("original_latitude", "original_longitude"), ("site_latitude", "site_longitude"),
        "site_source", F.col("site_success").isNotNull(),
    )
    country = has_text("country", T.SITE)
    return merged.withColumns(
        {
            "next_step": next_step(F.col("final_valid"), country, has_text("province_state", T.SITE)),
            "unmatched_site": ~F.col("final_valid") & has_text("site", T.SITE) & country,
        }
    ).drop(*SITE_COLUMNS)


def recovery_metrics() -> dict[str, Column]:
    """Funnel of a coordinate recovery run, for inventory()."""
    source = F.col("final_source")
    return {
        "total_records": F.lit(True),
        "original_coordinates": source == "original",
        "lookup_matched": F.col("lookup_matched"),
        "lookup_added": F.col("lookup_added"),
        "final_valid": F.col("final_valid"),
        "still_missing": ~F.col("final_valid"),
        "province_centroid_needed": F.col("next_step") == "province_centroid",
        "country_centroid_needed": F.col("next_step") == "country_centroid",
        "no_geographic_information": F.col("next_step") == "no_geographic_information",
        "unmatched_site": F.col("unmatched_site"),
    }


def admin_queries(records: DataFrame) -> DataFrame:
    """Distinct administrative queries of records without a coordinate, with counts."""
    screened = screen_admin(records, valid_coord("final_latitude", "final_longitude"))
    wanted = screened.where(F.col("target_level").isin("province", "country"))
    province = F.when(F.col("target_level") == "province", F.col("province_state"))
    return wanted.groupBy(
        "target_level", "country", "country_iso", province.alias("province_state"), "identifier_source"
    ).agg(F.count(F.lit(1)).alias("record_count"))


def standardise_admin(
    queries: DataFrame, ref_codes: DataFrame, ref_names: DataFrame
) -> DataFrame:
    """Queries with resolved country, folded and relaxed province keys and readiness.

    The queries are an aggregate over all records that several steps read, so they are
    written once.
    """
    resolved = resolve_entity(cut_lineage(queries), "country_iso", "country", ref_codes, ref_names)
    folded = fold_key(resolved, "province_state", "province_key")
    checked = null_tokens("province_state", T.ADMIN, collapse=True)
    missing = checked.isNull()
    short = F.coalesce(is_abbreviation(checked), F.lit(False))
    return folded.withColumns(
        {
            "province_relaxed_key": relaxed_key("province_key"),
            "province_match_key": admin_match_key("entity", "province_key"),
            "possible_abbreviation": short,
            "province_status": F.when(missing, "province_missing")
            .when(F.col("entity_status") != "resolved", "country_not_resolved")
            .when(short, "ready_but_abbreviation_needs_attention")
            .otherwise("ready_for_matching"),
        }
    )


def fill_centroids(
    records: DataFrame, queries: DataFrame, aliases: DataFrame,
    area_centroids: DataFrame, country_centroids: DataFrame,
) -> DataFrame:
    """Fill missing coordinates from province centroids, then from country centroids.

    queries come from standardise_admin; area_centroids(area, latitude, longitude);
    country_centroids(entity, latitude, longitude).
    """
    queries = cut_lineage(queries)
    ready = F.col("province_status") == "ready_for_matching"
    provinces = queries.where(F.col("target_level") == "province")
    matched = resolve_alias(provinces, aliases, "entity", "province_key", ready)
    child = prepare_centroids(
        matched.where(F.col("match_status") == "matched").join(area_centroids, "area"),
        ["country", "country_iso", "province_state"],
    )
    countries = lookup_ready(
        queries.where(F.col("target_level") == "country"), country_centroids, "entity",
        F.col("entity_status") == "resolved", "latitude",
    )
    parent = prepare_centroids(
        countries.where(F.col("match_status") == "matched"), ["country", "country_iso"]
    )
    filled = hierarchical_lookup(
        records, child, parent, ["country", "country_iso", "province_state"],
        ["country", "country_iso"], has_text("province_state", T.CENTROID),
    )
    by_level = F.when(F.col("fill_level") == "province", "province_centroid").when(
        F.col("fill_level") == "country", "country_centroid"
    )
    return filled.withColumns(
        {
            "final_source": F.coalesce(by_level, "final_source"),
            "final_level": F.coalesce("fill_level", "final_level"),
        }
    )
