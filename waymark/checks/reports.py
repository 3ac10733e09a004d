"""Checks of profiles, examples, distinct counts and output order."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import bridge, check, records, table
from waymark.checks.scalars import nulled
from waymark.functions import tokens as T
from waymark.operators.reporting import count_by, examples, inventory, profile

_COLS = ["cluster_id", "species", "country", "country_iso", "province_state", "site", "coord", "label"]


def _profile_sql(source: str, cols, text=lambda c: c) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({nulled(text(c), T.POOL)}) AS present_n, "
        f"round_even(count({nulled(text(c), T.POOL)}) * 100.0::double / count(*), 4) AS present_pct FROM {source}"
        for c in cols
    )


@check("a26_completeness_profile", _profile_sql("b_record", _COLS))
def _(spark, sf):
    return profile(bridge(spark, sf, "b_record"), _COLS)


@check(
    "a26_label_completeness",
    _profile_sql("(SELECT * FROM documents LEFT JOIN labels USING (doc_id)) d", ["lang", "source", "quality", "toxic"],
                 lambda c: f"CAST({c} AS varchar)"),
)
def _(spark, sf):
    df = table(spark, sf, "documents", ["doc_id", "lang", "source"]).join(table(spark, sf, "labels"), "doc_id", "left")
    return profile(df, ["lang", "source", "quality", "toxic"])


@check(
    "a27_column_examples",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, string_agg(v, ' | ' ORDER BY v) AS examples FROM (
        SELECT DISTINCT {nulled(c, T.POOL)} AS v FROM b_record WHERE ({nulled(c, T.POOL)}) IS NOT NULL ORDER BY v LIMIT 15) t"""
        for c in _COLS
    ),
)
def _(spark, sf):
    return examples(bridge(spark, sf, "b_record"), _COLS)


@check(
    "a27_many_examples",
    f"""SELECT 'record_id' AS column_name, v AS example FROM (SELECT DISTINCT {nulled('record_id', T.POOL)} AS v FROM b_record
      WHERE ({nulled('record_id', T.POOL)}) IS NOT NULL ORDER BY v LIMIT 5000) t""",
)
def _(spark, sf):
    many = examples(bridge(spark, sf, "b_record"), ["record_id"], 5000)
    return many.select("column_name", F.explode(F.split("examples", r" \| ")).alias("example"))


@check(
    "a30_distinct_counts",
    "SELECT count(DISTINCT cluster_id) AS clusters_n, count(DISTINCT species) AS species_n, count(DISTINCT record_id) AS records_n FROM b_record",
)
def _(spark, sf):
    return bridge(spark, sf, "b_record").agg(
        F.count_distinct("cluster_id").alias("clusters_n"), F.count_distinct("species").alias("species_n"),
        F.count_distinct("record_id").alias("records_n"),
    )


@check(
    "a01_counts_in_order",
    "SELECT country, province_state, count(*) AS records_n FROM b_record GROUP BY country, province_state ORDER BY records_n DESC, country, province_state",
)
def _(spark, sf):
    return count_by(bridge(spark, sf, "b_record"), ["country", "province_state"]).orderBy(
        F.col("records_n").desc(), "country", "province_state"
    )


@check(
    "w16_total_order",
    "SELECT seq, country, site FROM b_place ORDER BY country DESC, site, seq",
)
def _(spark, sf):
    return bridge(spark, sf, "b_place").select("seq", "country", "site").orderBy(
        F.col("country").desc(), "site", "seq"
    )


@check(
    "w17_input_order_restored",
    "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey",
)
def _(spark, sf):
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders", ["o_orderkey", "o_custkey"]).join(seg, "o_custkey").select(
        "o_orderkey", "c_mktsegment"
    ).orderBy("o_orderkey")


@check(
    "a29_coordinate_inventory",
    """SELECT metric, value FROM (SELECT count(*) AS total, count(original_latitude) AS with_coordinate, count(*) FILTER (cluster_id IS NULL) AS without_cluster FROM o_coord) t
    UNPIVOT (value FOR metric IN (total, with_coordinate, without_cluster))""",
)
def _(spark, sf):
    return inventory(
        records(spark, sf),
        {"total": F.lit(True), "with_coordinate": F.col("original_latitude").isNotNull(),
         "without_cluster": F.col("cluster_id").isNull()},
    )
