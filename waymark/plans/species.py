"""Species candidates, name-match decisions, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from waymark.functions import tokens as T
from waymark.functions.coords import in_range
from waymark.functions.names import (
    REVIEW_ACTIONS, evidence_band, first_present, is_binomial, match_decision, name_class,
    preferred_key, review_type, screen_name,
)
from waymark.functions.text import map_values, null_tokens, once, squash
from waymark.operators.ranking import cumulative_share, pick_one, priority_band
from waymark.operators.reporting import merge_by_key, species_counters, species_evidence
from waymark.operators.sampling import equal_per_stratum
from waymark.session import cut_lineage

PILOT_SEED = 20260722
PILOT_N = 200

ANSWER_SCHEMA = ST.StructType(
    [
        ST.StructField("usageKey", ST.LongType()),
        ST.StructField("acceptedUsageKey", ST.LongType()),
        ST.StructField("scientificName", ST.StringType()),
        ST.StructField("acceptedScientificName", ST.StringType()),
        ST.StructField("canonicalName", ST.StringType()),
        ST.StructField("rank", ST.StringType()),
        ST.StructField("status", ST.StringType()),
        ST.StructField("matchType", ST.StringType()),
        ST.StructField("confidence", ST.LongType()),
        ST.StructField("kingdom", ST.StringType()),
        ST.StructField("order", ST.StringType()),
        ST.StructField("alternatives", ST.ArrayType(ST.MapType(ST.StringType(), ST.StringType()))),
    ]
)


def pilot_summary(records: DataFrame) -> DataFrame:
    """Binomial species with records lacking a place, and their internal evidence."""
    named = records.withColumns(
        {"species": null_tokens("species", T.PILOT), "label": null_tokens("label", T.PILOT),
         "_source": F.lower(null_tokens("final_source", T.PILOT))}
    )
    lacking = ~in_range("final_latitude", "final_longitude") & is_binomial("species")
    evidence = F.coalesce(
        in_range("original_latitude", "original_longitude") & (F.col("_source") == "original"),
        F.lit(False),
    )
    return species_evidence(named, "species", lacking, evidence, "label").withColumn(
        "sampling_band", evidence_band("evidence_records_n")
    )


def pilot_sample(summary: DataFrame, n: int = PILOT_N, seed: int = PILOT_SEED) -> DataFrame:
    """Pilot species, equally many per band. The summary is an aggregate over all records
    that the draw reads more than once, so it is written first."""
    return equal_per_stratum(cut_lineage(summary), "sampling_band", n, ["species"], seed)


def candidate_records(effective: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inference targets with their name class and cluster prediction, if any."""
    targets = effective.where(F.col("inference_class") == "target").withColumns(
        {"name_flag": name_class("species"), "species_name": null_tokens("species", T.FULL, collapse=True)}
    )
    preds = predictions.select(
        "row_key", "predicted_label", "cluster_confidence", "auto_eligible",
        F.lit(True).alias("cluster_candidate"),
    )
    return targets.join(preds, "row_key", "left").withColumns(
        {
            "cluster_confidence": F.coalesce("cluster_confidence", F.lit("No cluster")),
            "auto_eligible": F.coalesce("auto_eligible", F.lit(False)),
            "cluster_candidate": F.coalesce("cluster_candidate", F.lit(False)),
        }
    )


def species_table(candidates: DataFrame) -> DataFrame:
    clean = candidates.where(F.col("name_flag") == "clean_binomial")
    return species_counters(clean, "species_name", "cluster_confidence", "auto_eligible")


def exclusions(candidates: DataFrame) -> DataFrame:
    """Names left out of matching, with reason and record count."""
    out = candidates.where(~F.col("name_flag").isin("clean_binomial", "missing_species"))
    return out.groupBy("species_name", "name_flag").agg(F.count(F.lit(1)).alias("records_n"))


def flatten_response(df: DataFrame, body: str, schema: ST.StructType = ANSWER_SCHEMA) -> DataFrame:
    """Columns from the JSON answer; alternatives are counted and re-serialised."""
    return _flattened(once(df, "_a", F.from_json(body, schema)), schema)


def _flattened(parsed: DataFrame, schema: ST.StructType) -> DataFrame:
    """The answer's fields as columns instead of the parsed answer `_a`."""
    flat = [F.col(f"_a.`{f.name}`").alias(f.name) for f in schema.fields if f.name != "alternatives"]
    alts = F.coalesce(F.col("_a.alternatives"), F.array().cast(schema["alternatives"].dataType))
    return parsed.select(
        *[F.col(f"`{c}`") for c in parsed.columns if c != "_a"], *flat,
        F.size(alts).cast("bigint").alias("alternatives_n"), F.to_json(alts).alias("alternatives_json"),
    )


def match_names(
    responses: DataFrame, name: str = "query_name", body: str = "body",
    status: str = "request_status", min_confidence: int = 95,
) -> DataFrame:
    """Decision, reason and preferred key for every answered name; each answer is parsed and
    decided once, also below filters on the decision."""
    parsed = once(responses, "_a", F.from_json(body, ANSWER_SCHEMA)).withColumns(
        {"name_flag": screen_name(name), "query_name": squash(F.coalesce(F.col(name), F.lit("")))}
    )

    def decide(a: Column) -> Column:
        answer = {
            "match_type": a["matchType"], "rank": a["rank"], "status": a["status"],
            "kingdom": a["kingdom"], "order": a["order"], "confidence": a["confidence"],
            "usage_key": a["usageKey"], "accepted_key": a["acceptedUsageKey"],
        }
        return match_decision("name_flag", status, answer, min_confidence)

    decided = _flattened(once(parsed, "_d", decide(F.col("_a"))), ANSWER_SCHEMA)
    return decided.withColumns(
        {
            "match_decision": F.col("_d.decision"), "match_reason": F.col("_d.reason"),
            "manual_review": F.col("_d.review"),
            "taxon_key": preferred_key("acceptedUsageKey", "usageKey"),
        }
    ).drop("_d")


def latest_answers(answers: DataFrame, seq: str = "seq") -> DataFrame:
    """The last answer of every queried name."""
    return pick_one(answers, ["query_name"], [F.col(seq).desc()])


ACCEPTED = ("accepted_exact", "accepted_synonym")


def accepted_names(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic and hand-made acceptances in one shape.

    manual has species, manual_name, manual_decision, manual_status, manual_key, include,
    records_n.
    """
    auto = automatic.where(F.col("match_decision").isin(list(ACCEPTED))).select(
        F.col("query_name").alias("species"),
        first_present("acceptedScientificName", "scientificName", "canonicalName", "query_name").alias("resolved_name"),
        "match_decision", F.lit("automatic").alias("decision_source"), "status",
        "taxon_key", "records_n",
    )
    hand = manual.where(F.coalesce("include", F.lit(False))).select(
        "species", F.col("manual_name").alias("resolved_name"),
        F.col("manual_decision").alias("match_decision"), F.lit("manual").alias("decision_source"),
        F.col("manual_status").alias("status"), F.col("manual_key").alias("taxon_key"), "records_n",
    )
    return auto.unionByName(hand).withColumn("records_n", F.coalesce("records_n", F.lit(0)))


def occurrence_queries(names: DataFrame) -> DataFrame:
    """One query per taxon key, merging the names that lead to it."""
    return merge_by_key(
        names, "taxon_key", ["records_n"],
        ["species", "resolved_name", "match_decision", "decision_source", "status"], "species",
    )


def prioritise_review(review: DataFrame) -> DataFrame:
    """Review names in order of the records they would unlock, with share and band.

    review has species, name_flag, rank, match_type, candidate_records_n,
    incremental_records_n.
    """
    typed = review.withColumn("review_type", review_type("name_flag", "rank", "match_type"))
    typed = typed.withColumn("suggested_action", map_values("review_type", REVIEW_ACTIONS, ""))
    order = [
        F.col("incremental_records_n").desc(), F.col("candidate_records_n").desc(),
        F.col("species").asc(),
    ]
    # the range partitioning reads its input twice, to sample it and to deal it out
    ranked = cumulative_share(cut_lineage(typed), order, "incremental_records_n")
    return ranked.withColumn(
        "priority_band", priority_band("incremental_records_n", "cumulative_share_before")
    )
