"""Lookups, hierarchies, entity and alias resolution, virtual updates, journals.

No lookup is broadcast by hand: Spark does it when its measured size allows and otherwise
shuffles; blank keys, and hot ones if counted, are dealt apart (`operators.joins`).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tokens as T
from waymark.functions.text import fold_key, match_text, null_tokens
from waymark.functions.coords import in_range, valid_coord
from waymark.operators.joins import hot_keys, spread_left
from waymark.operators.ranking import null_safe, pick_one


def cascade(
    df: DataFrame, branches: Sequence[tuple[str, Column, dict[str, Column]]],
    default: str, label_col: str = "source",
) -> DataFrame:
    """Take label and values from the first branch whose condition holds."""
    outs = list(branches[0][2])
    chosen = None
    for label, cond, values in branches:
        row = F.struct(
            F.lit(label).alias(label_col), *[values[o].cast("string").alias(o) for o in outs]
        )
        chosen = F.when(cond, row) if chosen is None else chosen.when(cond, row)
    fallback = F.struct(
        F.lit(default).alias(label_col), *[F.lit(None).cast("string").alias(o) for o in outs]
    )
    picked = df.withColumn("_c", chosen.otherwise(fallback))
    return picked.select(*df.columns, *[F.col(f"_c.{c}").alias(c) for c in [label_col, *outs]])


# Precedence of lookup sources, for unlisted and failed sources as well.
SOURCE_PRIORITY = {"osm_raw": 1, "osm_clean": 2, "google_fallback": 3, "failed": 9}
OTHER_SOURCE_PRIORITY = 8


def source_rank(source: str) -> Column:
    pairs = [F.lit(x) for item in SOURCE_PRIORITY.items() for x in item]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), F.col(source)), F.lit(OTHER_SOURCE_PRIORITY)
    )


def best_lookup(
    lookup: DataFrame, ks: Sequence[str], success: str, source: str, tie: Sequence[str]
) -> DataFrame:
    """One row per key: successful first, then by source precedence, then by tie columns."""
    order = [F.col(success).desc(), source_rank(source).asc(), *[F.col(t).asc() for t in tie]]
    return pick_one(lookup, ks, order)


def prepare_lookup(
    lookup: DataFrame, ks: Sequence[str], success: str, source: str, lat: str, lon: str,
    tie: Sequence[str],
) -> DataFrame:
    """Lookup rows keyed by normalised text; failed rows carry neither place nor source."""
    keyed = lookup.withColumns({f"_key_{k}": match_text(k) for k in ks})
    ok = keyed.withColumn(success, F.col(success) & valid_coord(lat, lon))
    blanked = ok.withColumns(
        {c: F.when(F.col(success), F.col(c)) for c in (lat, lon, source)}
    )
    return best_lookup(blanked, [f"_key_{k}" for k in ks], success, source, tie)


def lookup_left(
    df: DataFrame, ref: DataFrame, ks: Sequence[str], cols: Sequence[str], hot: bool = False
) -> DataFrame:
    """N:1 left lookup on normalised text keys prepared in ref as _key_<name>.

    `hot` counts the keys first and salts those that hold a large share of the rows.
    """
    keys = [f"_key_{k}" for k in ks]
    keyed = df.withColumns({f"_key_{k}": match_text(k) for k in ks})
    return spread_left(keyed, ref, keys, cols, hot_keys(keyed, keys) if hot else None).drop(*keys)


def enrich(
    df: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str], Sequence[Column]]]
) -> DataFrame:
    """Successive left joins, each side first reduced to one row per key."""
    out = df
    for ref, ks, order in sides:
        out = spread_left(out, pick_one(ref, ks, order), ks, [c for c in ref.columns if c not in ks])
    return out


def coalesce_coords(
    df: DataFrame, primary: tuple[str, str], fallback: tuple[str, str],
    source_col: str, matched: Column, level: str = "site",
) -> DataFrame:
    """Final coordinate with provenance: primary if valid, else fallback if valid."""
    first = valid_coord(*primary)
    second = valid_coord(*fallback)

    def pick(a: str | Column, b: str | Column) -> Column:
        a = F.col(a) if isinstance(a, str) else a
        b = F.col(b) if isinstance(b, str) else b
        return F.when(first, a).when(second, b)

    return df.withColumns(
        {
            "final_latitude": pick(primary[0], fallback[0]),
            "final_longitude": pick(primary[1], fallback[1]),
            "final_source": pick(F.lit("original"), source_col),
            "final_level": pick(F.lit("original"), F.lit(level)),
            "final_valid": first | second,
            "lookup_added": ~first & second,
            "lookup_matched": matched,
        }
    )


def next_step(valid: Column, country: Column, province: Column) -> Column:
    """What is still needed to place a record."""
    return (
        F.when(valid, "not_needed")
        .when(country & province, "province_centroid")
        .when(country, "country_centroid")
        .otherwise("no_geographic_information")
    )


def screen_admin(
    df: DataFrame, valid: Column, country: str = "country", code: str = "country_iso",
    province: str = "province_state",
) -> DataFrame:
    """Target level and country identifier source of records without a coordinate.

    "NA" stays a usable country code.
    """
    has_country = null_tokens(country, T.SCREEN).isNotNull()
    has_code = null_tokens(code, T.SCREEN, keep=T.SCREEN_KEEP_NA).isNotNull()
    has_province = null_tokens(province, T.SCREEN).isNotNull()
    known = has_country | has_code
    return df.withColumns(
        {
            "target_level": F.when(valid, "has_coordinate")
            .when(has_province & known, "province")
            .when(known, "country")
            .when(has_province, "unresolved")
            .otherwise("none"),
            "identifier_source": F.when(has_country, "country")
            .when(has_code, "country_iso")
            .otherwise("missing_country_and_country_iso"),
        }
    )


def hierarchical_lookup(
    df: DataFrame, child: DataFrame, parent: DataFrame, child_keys: Sequence[str],
    parent_keys: Sequence[str], usable_child: Column,
    lat: str = "final_latitude", lon: str = "final_longitude",
) -> DataFrame:
    """Fill places from the child level, and from the parent only if no usable child name.

    child and parent hold normalised _key_ columns with latitude, longitude.
    """
    keyed = df.withColumns({f"_key_{k}": match_text(k) for k in child_keys})
    kids = child.select(
        *[f"_key_{k}" for k in child_keys],
        F.col("latitude").alias("_clat"), F.col("longitude").alias("_clon"),
    )
    folks = parent.select(
        *[f"_key_{k}" for k in parent_keys],
        F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon"),
    )
    met = spread_left(keyed, kids, [f"_key_{k}" for k in child_keys], ["_clat", "_clon"])
    joined = spread_left(met, folks, [f"_key_{k}" for k in parent_keys], ["_plat", "_plon"])
    before = in_range(lat, lon)
    by_child = ~before & F.col("_clat").isNotNull() & F.col("_clon").isNotNull()
    after_child = before | (by_child & in_range("_clat", "_clon"))
    by_parent = (
        ~after_child & ~usable_child & F.col("_plat").isNotNull() & F.col("_plon").isNotNull()
    )
    marked = joined.withColumn(
        "fill_level", F.when(by_parent, "country").when(by_child, "province")
    )
    level = F.col("fill_level")
    return marked.withColumns(
        {
            lat: F.when(level == "country", F.col("_plat")).when(level == "province", F.col("_clat")).otherwise(F.col(lat)),
            lon: F.when(level == "country", F.col("_plon")).when(level == "province", F.col("_clon")).otherwise(F.col(lon)),
        }
    ).drop("_clat", "_clon", "_plat", "_plon", *[f"_key_{k}" for k in child_keys])


def prepare_centroids(lookup: DataFrame, ks: Sequence[str]) -> DataFrame:
    """One centroid per normalised raw key; keys whose rows disagree raise a gate elsewhere."""
    keyed = lookup.withColumns({f"_key_{k}": match_text(k) for k in ks})
    return keyed.groupBy(*[f"_key_{k}" for k in ks]).agg(
        F.min_by("latitude", F.struct("latitude", "longitude")).alias("latitude"),
        F.min_by("longitude", F.struct("latitude", "longitude")).alias("longitude"),
    )


def country_reference(
    attrs: DataFrame, keys: Sequence[str], short: Sequence[str], numeric: Sequence[str],
    names: Sequence[str], own_code: str, parent_names: Sequence[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reference tables of an administrative attribute table: codes(code, entity),
    names(name_key, entity) and canonical(entity, name).

    An entity's stable key is the first of its `keys` that is filled; rows without one are left
    out. All filled keys, short codes and numeric codes (padded to three digits) lead to it. A
    row whose `own_code` differs from its key is a territory: names it shares with its parent
    (`parent_names` of the row) are not its own, so that they keep meaning the parent alone.
    """
    def filled(c: str) -> Column:
        text = null_tokens(F.col(c).cast("string"), T.ADMIN, collapse=True)
        return F.when(~text.isin("", "-99"), text)

    upper = {c: F.upper(filled(c)) for c in (*keys, *short)}
    padded = [F.lpad(filled(c), F.greatest(F.lit(3), F.length(filled(c))), F.lit("0")) for c in numeric]
    own = F.upper(filled(own_code))
    rows = attrs.select(
        F.coalesce(*[upper[c] for c in keys]).alias("entity"), own.alias("_own"),
        F.array_compact(F.array(*upper.values(), *padded)).alias("_codes"),
        F.array_compact(F.array(*[filled(c) for c in names])).alias("_names"),
        F.array_compact(F.array(*[filled(c) for c in parent_names])).alias("_parents"),
    ).where("entity is not null")
    codes = rows.select(F.explode("_codes").alias("code"), "entity").distinct()
    territory = F.coalesce(F.col("_own") != F.col("entity"), F.lit(False))
    named = rows.select("entity", territory.alias("_territory"), "_parents", F.posexplode("_names").alias("_pos", "_name"))
    named = fold_key(named, "_name", "name_key")
    shared = fold_key(
        rows.where(territory).select("entity", F.explode("_parents").alias("_parent")), "_parent", "name_key"
    ).select("entity", "name_key").distinct().withColumn("_territory", F.lit(True))
    kept = named.join(shared, ["entity", "name_key", "_territory"], "left_anti")
    first = kept.groupBy("entity").agg(F.min(F.struct("_pos", "_name"))["_name"].alias("name"))
    canonical = rows.select("entity").distinct().join(first, "entity", "left").select("entity", F.coalesce("name", "entity").alias("name"))
    return codes, kept.where("name_key <> ''").select("name_key", "entity").distinct(), canonical


def resolve_entity(
    df: DataFrame, code_col: str, name_col: str, ref_codes: DataFrame, ref_names: DataFrame,
    review_terms: Iterable[str] = T.REVIEW_COUNTRIES,
    aliases: dict[str, str] = T.COUNTRY_ALIASES,
    code_aliases: dict[str, str] = T.CODE_ALIASES,
) -> DataFrame:
    """Resolve entities from a code and a name, each exact, and reconcile both.

    ref_codes(code, entity) and ref_names(name_key, entity) may map one key to several
    entities; such keys are ambiguous. A conflict between code and name beats both, a valid
    code beats any problem with the name, and a name may end at its first colon. The status and
    method words are fixed values.
    """
    codes = ref_codes.union(_follow(ref_codes, code_aliases, "code"))
    names = ref_names.union(_follow(ref_codes, aliases, "name_key"))
    by_code = codes.groupBy("code").agg(
        F.min("entity").alias("_c_entity"), F.count_distinct("entity").alias("_c_n")
    )
    by_name = names.groupBy("name_key").agg(
        F.min("entity").alias("_n_entity"), F.count_distinct("entity").alias("_n_n")
    )
    # each distinct (code, name) pair is resolved once
    pairs = df.select(
        F.col(code_col).alias("_code_in"), F.col(name_col).alias("_name_in")
    ).distinct()
    cleaned_name = null_tokens("_name_in", T.ADMIN, collapse=True)
    cleaned_code = null_tokens("_code_in", T.ADMIN, collapse=True)
    bare = F.upper(F.regexp_replace(F.coalesce(cleaned_code, F.lit("")), "[^A-Za-z0-9]", ""))
    prepared = pairs.withColumns(
        {
            "_name": cleaned_name,
            "_has_code": cleaned_code.isNotNull(),
            "_head": F.when(F.contains(cleaned_name, F.lit(":")), F.split(cleaned_name, ":")[0]),
            "code": F.when(bare.rlike("^[0-9]+$") & (F.length(bare) < 3), F.lpad(bare, 3, "0")).otherwise(bare),
        }
    )
    prepared = fold_key(fold_key(prepared, "_name", "name_key"), "_head", "_head_key")
    heads = by_name.select(
        F.col("name_key").alias("_head_key"), F.col("_n_entity").alias("_h_entity"),
        F.col("_n_n").alias("_h_n"),
    )
    met = (
        prepared.join(by_code, "code", "left")
        .join(by_name, "name_key", "left")
        .join(heads, "_head_key", "left")
    )
    code_status = (
        F.when(F.col("code") == "", "missing").when(F.col("_c_n") == 1, "valid")
        .when(F.col("_c_n") > 1, "ambiguous").otherwise("invalid")
    )
    key = F.col("name_key")
    known_alias = F.map_contains_key(F.from_json(F.lit(json.dumps(aliases)), "map<string,string>"), key)
    name_status = (
        F.when(key == "", "missing")
        .when(key.isin(list(review_terms)), "needs_manual_review")
        .when(F.col("_n_n") == 1, "resolved")
        .when(F.col("_n_n") > 1, "ambiguous")
        .when(F.col("_h_n") == 1, "resolved")
        .otherwise("unresolved")
    )
    name_method = (
        F.when(key == "", "")
        .when(key.isin(list(review_terms)), "historical_or_special_name")
        .when((F.col("_n_n") == 1) & known_alias, "exact_alias")
        .when(F.col("_n_n") == 1, "natural_earth_exact_name")
        .when(F.col("_n_n") > 1, "multiple_natural_earth_name_matches")
        .when(F.col("_h_n") == 1, "exact_country_prefix_before_locality")
        .otherwise("country_name_not_recognised")
    )
    met = met.withColumns(
        {"code_status": code_status, "name_status": name_status, "name_method": name_method}
    ).withColumns(
        {
            "entity_from_code": F.when(F.col("code_status") == "valid", F.col("_c_entity")),
            "entity_from_name": F.when(
                F.col("name_status") == "resolved",
                F.when(F.col("_n_n") == 1, F.col("_n_entity")).otherwise(F.col("_h_entity")),
            ),
        }
    )
    from_code, from_name = F.col("entity_from_code"), F.col("entity_from_name")
    conflict = from_code.isNotNull() & from_name.isNotNull() & (from_code != from_name)
    nothing = F.col("_name").isNull() & ~F.col("_has_code")
    status = (
        F.when(conflict, "conflict_needs_manual_review")
        .when(from_code.isNotNull() | from_name.isNotNull(), "resolved")
        .when(nothing, "missing_country_identifier")
        .when(F.col("name_status") == "needs_manual_review", "country_name_needs_manual_review")
        .otherwise("unresolved_country")
    )
    bad_code = F.col("code_status") == "invalid"
    method = (
        F.when(conflict, "valid_iso_conflicts_with_country_name")
        .when(from_code.isNotNull(), "valid_input_iso")
        .when(from_name.isNotNull(), F.col("name_method"))
        .when(nothing, "none")
        .when(F.col("name_status") == "needs_manual_review", F.col("name_method"))
        .when(bad_code & F.col("name_status").isin("unresolved", "missing"), "invalid_iso_and_unresolved_name")
        .when(bad_code, "invalid_input_iso")
        .when(F.col("name_method") != "", F.col("name_method"))
        .otherwise("country_not_resolved")
    )
    answers = met.select(
        "_code_in", "_name_in", "code_status", "name_status", "name_method",
        "entity_from_code", "entity_from_name",
        status.alias("entity_status"), method.alias("entity_method"),
        F.when(~conflict, F.coalesce(from_code, from_name)).alias("entity"),
    )
    keyed = df.withColumns({"_code_in": F.col(code_col), "_name_in": F.col(name_col)})
    return null_safe(keyed, answers, ["_code_in", "_name_in"], "left").drop("_code_in", "_name_in")


def _follow(ref_codes: DataFrame, aliases: dict[str, str], key: str) -> DataFrame:
    """Alias rows whose target code means exactly one entity."""
    pairs = F.from_json(
        F.lit(json.dumps([{"alias": a, "target": t} for a, t in aliases.items()])),
        "array<struct<alias:string,target:string>>",
    )
    wanted = ref_codes.where(F.col("code").isin(sorted(set(aliases.values()))))
    single = wanted.groupBy("code").agg(
        F.min("entity").alias("entity"), F.count_distinct("entity").alias("_n")
    ).where("_n = 1")
    hits = F.filter(pairs, lambda p: p["target"] == F.col("code"))
    return single.select(F.explode(hits).alias("_p"), "entity").select(
        F.col("_p.alias").alias(key), "entity"
    )


def alias_table(
    areas: DataFrame, area_id: str, parent: str, fields: Sequence[str]
) -> DataFrame:
    """(parent, name_key, area, field, priority) with one row per area and folded name."""
    long = areas.select(
        F.col(area_id).alias("area"), F.col(parent).alias("parent"),
        F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("_pos", "_f"),
    ).select("area", "parent", (F.col("_pos") + 1).alias("priority"),
             F.col("_f.field").alias("field"), F.col("_f.value").alias("value"))
    keyed = fold_key(long, "value", "name_key", T.CENTROID).where("name_key <> ''")
    return pick_one(
        keyed.drop("value"), ["area", "parent", "name_key"], [F.col("priority").asc()]
    )


def resolve_alias(
    queries: DataFrame, aliases: DataFrame, parent: str, name_key: str, ready: Column
) -> DataFrame:
    """Match folded names to areas using the best alias field that matches at all.

    A match depends on the key alone, so the alias table is reduced to one row per key
    before the queries meet it.
    """
    per_field = aliases.groupBy("parent", "name_key", "priority").agg(
        F.count_distinct("area").alias("candidates_n"), F.min("area").alias("area"),
        F.min("field").alias("alias_field"),
    )
    best = pick_one(per_field, ["parent", "name_key"], [F.col("priority").asc()]).select(
        F.col("parent").alias("_parent"), F.col("name_key").alias("_name_key"),
        "candidates_n", "area", "alias_field",
    )
    met = queries.join(
        best, (F.col(parent) == F.col("_parent")) & (F.col(name_key) == F.col("_name_key")), "left"
    ).drop("_parent", "_name_key")
    out = met.withColumn("candidates_n", F.coalesce("candidates_n", F.lit(0)).cast("bigint"))
    one = F.col("candidates_n") == 1
    return out.withColumns(
        {
            "match_status": F.when(~ready, "not_ready_after_standardisation")
            .when(F.col("candidates_n") > 1, "ambiguous_match")
            .when(one, "matched").otherwise("unmatched"),
            "area": F.when(one, F.col("area")),
            "alias_field": F.when(one, F.col("alias_field")),
        }
    )


def lookup_ready(
    df: DataFrame, ref: DataFrame, key: str, ready: Column, probe: str
) -> DataFrame:
    """Left lookup that only counts for rows marked ready."""
    out = df.join(ref, key, "left")
    values = [c for c in ref.columns if c != key]
    met = ready & F.col(probe).isNotNull()
    status = (
        F.when(~ready, "not_ready_after_standardisation")
        .when(F.col(probe).isNotNull(), "matched").otherwise("unmatched")
    )
    return out.withColumn("match_status", status).withColumns(
        {c: F.when(met, F.col(c)) for c in values}
    )


def apply_updates(
    df: DataFrame, updates: DataFrame, key: str, id_col: str, target_col: str,
    value_col: str = "assigned_label",
) -> DataFrame:
    """Virtual update: effective value, what happened, and whether the ids agree."""
    ups = updates.select(
        key, F.col(id_col).alias("_u_id"), F.col(value_col).alias("_u_value")
    )
    joined = df.join(ups, key, "left")
    offered = F.col("_u_value").isNotNull()
    gap = F.col(target_col).isNull()
    return joined.withColumns(
        {
            "effective_label": F.coalesce(F.col(target_col), F.col("_u_value")),
            "update_status": F.when(offered & gap, "applied")
            .when(offered, "existing_preserved").otherwise("none"),
            "update_id_ok": ~offered | F.col("_u_id").eqNullSafe(F.col(id_col)),
        }
    ).drop("_u_id", "_u_value")


def pending(inputs: DataFrame, results: DataFrame, ks: Sequence[str], done: Column) -> DataFrame:
    """Inputs that have no completed result yet."""
    return inputs.join(results.where(done).select(*ks).distinct(), list(ks), "left_anti")


def compact(
    parts: Iterable[DataFrame], known: DataFrame | None, ks: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Latest row per key of several journals, restricted to known keys."""
    parts = list(parts)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    if known is not None:
        merged = merged.join(known.select(*ks).distinct(), list(ks), "left_semi")
    return pick_one(merged, ks, order)
