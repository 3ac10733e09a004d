"""Checks of truth joins, entity metrics, intervals, threshold grids and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, bridge, check, records, table
from waymark.checks.lookups import placed
from waymark.functions.stats import Z95, wilson
from waymark.operators.accuracy import (
    COUNT_GRID, COVERAGE_GRID, SHARE_GRID, audit, band_accuracy, bootstrap_mean,
    majority, performance, select_threshold, threshold_grid,
)
from waymark.operators.reporting import medians
from waymark.operators.validation import confusion_with_totals, join_truth
from waymark.plans.accuracy import (
    band_audit, prepare_predictions, species_metrics, threshold_report, truth_rows,
)

SEED = 20260727
DIGITS = 9

VIEWS["o_pred"] = """
SELECT species_key, predicted_label, band, dominant_proportion, assigned_records_n, overlay_coverage FROM (
  SELECT lower(nm) AS species_key, CASE trim(regexp_replace(lower(dominant_label), '\\s+', ' ', 'g')) WHEN 'africa' THEN 'Africa' WHEN 'america' THEN 'America'
      WHEN 'asia' THEN 'Asia' WHEN 'europe' THEN 'Europe' WHEN 'middle east' THEN 'Middle East' END AS predicted_label,
    CASE taxon_confidence WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'Low' THEN 'Low' ELSE taxon_confidence END AS band,
    dominant_proportion / 100 AS dominant_proportion, assigned_records_n, overlay_coverage,
    row_number() OVER (PARTITION BY lower(nm) ORDER BY assigned_records_n DESC NULLS LAST, nm, taxon_key) AS r
  FROM (SELECT b_taxon.*, trim(unnest(string_split(input_names, '|'))) AS nm FROM b_taxon) t) u WHERE r = 1"""

VIEWS["o_truth"] = """
SELECT row_key, lower(trim(species)) AS species_key,
  CASE label WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'America' WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE 'Middle East' END AS observed_label
FROM o_coord WHERE label IN (SELECT r_name FROM region) AND original_latitude IS NOT NULL AND species IS NOT NULL"""
# the text label 'N/A' is a known label here, because the truth tokens do not list it
VIEWS["o_truth"] = VIEWS["o_truth"].replace("ELSE 'Middle East' END", "WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE label END").replace(
    "label IN (SELECT r_name FROM region)", "label IS NOT NULL"
)

VIEWS["o_joined"] = """
SELECT t.row_key, t.species_key, t.observed_label, p.predicted_label, p.band, p.dominant_proportion, p.assigned_records_n, p.overlay_coverage,
  t.observed_label = p.predicted_label AS is_correct
FROM o_truth t JOIN o_pred p ON p.species_key = t.species_key WHERE p.predicted_label IS NOT NULL"""

VIEWS["o_majority"] = """
SELECT species_key, observed_label, n FROM (SELECT species_key, observed_label, count(*) AS n,
    row_number() OVER (PARTITION BY species_key ORDER BY count(*) DESC, observed_label) AS r FROM o_joined GROUP BY species_key, observed_label) t WHERE r = 1"""

VIEWS["o_metric"] = """
SELECT j.*, m.observed_label AS observed_dominant, m.observed_label = j.predicted_label AS dominant_matches,
  CAST(correct_records_n AS double) / validation_records_n AS record_match_rate
FROM (SELECT species_key, min(predicted_label) AS predicted_label, min(band) AS band, min(dominant_proportion) AS dominant_proportion,
    min(assigned_records_n) AS assigned_records_n, min(overlay_coverage) AS overlay_coverage, count(*) AS validation_records_n,
    count(*) FILTER (is_correct) AS correct_records_n, count(DISTINCT observed_label) AS observed_labels_n FROM o_joined GROUP BY species_key) j
JOIN o_majority m ON m.species_key = j.species_key"""

VIEWS["o_split"] = f"""
SELECT o_metric.*, CASE WHEN row_number() OVER (PARTITION BY coalesce(band, 'Missing') ORDER BY md5(concat_ws('#', '{SEED}', species_key)))
    <= greatest(1, least(CAST(round_even(count(*) OVER (PARTITION BY coalesce(band, 'Missing')) * 0.7::double, 0) AS bigint),
       count(*) OVER (PARTITION BY coalesce(band, 'Missing')) - 1)) THEN 'calibration' ELSE 'holdout' END AS validation_split FROM o_metric"""


def wilson_sql(k: str, n: str, side: str, z: float = Z95, clip: bool = True) -> str:
    p = f"(CAST({k} AS double) / nullif({n}, 0))"
    n1 = f"CAST(nullif({n}, 0) AS double)"
    sign = "-" if side == "low" else "+"
    raw = (
        f"(({p} + {z * z!r} / (2 * {n1})) {sign} {z!r} * sqrt(greatest(0, {p} * (1 - {p}) / {n1} + {z * z!r} / (4 * {n1} * {n1})))) / (1 + {z * z!r} / {n1})"
    )
    if clip:
        raw = f"CASE WHEN {n} > 0 THEN " + (f"greatest(0.0::double, {raw})" if side == "low" else f"least(1.0::double, {raw})") + " END"
    return f"round({raw}, {DIGITS})"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


def predictions(spark, sf):
    return prepare_predictions(bridge(spark, sf, "b_taxon"))


def metrics(spark, sf):
    return species_metrics(records(spark, sf), predictions(spark, sf), SEED)


@check("w06_best_prediction", "SELECT species_key, predicted_label, band, dominant_proportion, assigned_records_n, overlay_coverage FROM o_pred")
def _(spark, sf):
    return predictions(spark, sf).drop("species_name")


@check("l07_truth_rows", "SELECT row_key, species_key, observed_label FROM o_truth")
def _(spark, sf):
    return truth_rows(records(spark, sf))


@check(
    "l07_truth_by_source",
    "SELECT t.row_key, t.species_key, t.observed_label FROM o_truth t JOIN o_final f ON f.row_key = t.row_key WHERE f.final_source = 'original'",
)
def _(spark, sf):
    return truth_rows(placed(spark, sf).drop("original_latitude", "original_longitude"))


@check("j16_truth_join", "SELECT row_key, species_key, observed_label, predicted_label, is_correct FROM o_joined")
def _(spark, sf):
    usable = predictions(spark, sf).where("predicted_label IS NOT NULL")
    return join_truth(usable, truth_rows(records(spark, sf)), ["species_key"]).select(
        "row_key", "species_key", "observed_label", "predicted_label", "is_correct"
    )


@check(
    "j17_truth_coverage",
    """SELECT p.species_key, count(t.row_key) AS truth_records_n, count(t.row_key) > 0 AS has_truth FROM o_pred p
    LEFT JOIN o_truth t ON t.species_key = p.species_key GROUP BY p.species_key""",
)
def _(spark, sf):
    counts = truth_rows(records(spark, sf)).groupBy("species_key").agg(F.count(F.lit(1)).alias("truth_records_n"))
    out = predictions(spark, sf).select("species_key").join(counts, "species_key", "left")
    return out.withColumn("truth_records_n", F.coalesce("truth_records_n", F.lit(0))).withColumn(
        "has_truth", F.col("truth_records_n") > 0
    )


@check("a11_majority_label", "SELECT species_key, observed_label, n FROM o_majority")
def _(spark, sf):
    usable = predictions(spark, sf).where("predicted_label IS NOT NULL")
    joined = join_truth(usable, truth_rows(records(spark, sf)), ["species_key"])
    return majority(joined, ["species_key"], "observed_label")


@check("a12_entity_metrics", "SELECT * FROM o_metric")
def _(spark, sf):
    return metrics(spark, sf).drop("validation_split")


@check("p12_species_split", "SELECT species_key, band, dominant_matches, validation_split FROM o_split")
def _(spark, sf):
    return metrics(spark, sf).select("species_key", "band", "dominant_matches", "validation_split")


@check(
    "m01_wilson_intervals",
    f"""SELECT query_name, {wilson_sql('k', 'n', 'low')} AS low, {wilson_sql('k', 'n', 'high')} AS high,
    {wilson_sql('k', 'n', 'low', 1.96, False)} AS low_plain, {wilson_sql('k', 'n', 'high', 1.96, False)} AS high_plain
    FROM (SELECT query_name, count(*) FILTER (decision = 'error') AS k, count(*) FILTER (decision <> 'click') AS n FROM b_journal GROUP BY query_name) t""",
)
def _(spark, sf):
    df = bridge(spark, sf, "b_journal").groupBy("query_name").agg(
        F.count_if(F.col("decision") == "error").alias("k"), F.count_if(F.col("decision") != "click").alias("n")
    )
    a, b = wilson("k", "n")
    c, d = wilson("k", "n", 1.96, clip=False)
    out = df.select("query_name", a.alias("low"), b.alias("high"), c.alias("low_plain"), d.alias("high_plain"))
    return rounded(out, "low", "high", "low_plain", "high_plain")


#: Small blocks, so that the few species of the checks stand in several.
BLOCK = 32


def _bootstrap_sql(group: str, source: str = "o_metric") -> str:
    def number(*parts: str) -> str:
        text = ", ".join(f"CAST({p} AS varchar)" for p in parts)
        return f"CAST(concat('0x', substr(md5(concat_ws('#', '{SEED}', {text})), 1, 12)) AS bigint)"

    return f"""WITH v AS (SELECT {group} AS g, record_match_rate AS x, row_number() OVER (PARTITION BY {group} ORDER BY species_key) - 1 AS pos,
      count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
    c AS (SELECT g, n, rep, {number('rep', 'pos')} % n // {BLOCK} AS blk, pos FROM v, range(1, 2001) r(rep)),
    e AS (SELECT *, row_number() OVER (PARTITION BY g, rep, blk ORDER BY pos) - 1 AS j FROM c),
    d AS (SELECT g, rep, blk * {BLOCK} + {number('rep', 'blk', 'j')} % least({BLOCK}, n - blk * {BLOCK}) AS pos FROM e),
    m AS (SELECT d.g, d.rep, avg(v.x) AS mean FROM d JOIN v ON v.g IS NOT DISTINCT FROM d.g AND v.pos = d.pos GROUP BY d.g, d.rep),
    b AS (SELECT g, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY g)
    SELECT HEAD b0.n, round(b0.mean, {DIGITS}) AS mean, round(lo, {DIGITS}) AS ci_low, round(hi, {DIGITS}) AS ci_high
    FROM (SELECT g, count(*) AS n, avg(x) AS mean FROM v GROUP BY g) b0 JOIN b ON b.g IS NOT DISTINCT FROM b0.g"""


@check("m02_bootstrap_mean", _bootstrap_sql("'all'").replace("HEAD", ""))
def _(spark, sf):
    out = bootstrap_mean(metrics(spark, sf), "record_match_rate", "species_key", block=BLOCK)
    return rounded(out, "mean", "ci_low", "ci_high")


@check("m02_bootstrap_by_band", _bootstrap_sql("band").replace("HEAD", "b0.g AS band,"))
def _(spark, sf):
    out = bootstrap_mean(metrics(spark, sf), "record_match_rate", "species_key", by="band", block=BLOCK)
    return rounded(out, "mean", "ci_low", "ci_high")


VIEWS["o_band"] = f"""
SELECT group_name, species_n, records_n, correct_n, matches_n, CAST(species_n AS double) / (SELECT count(*) FROM o_metric) AS species_coverage,
  CAST(correct_n AS double) / records_n AS micro_accuracy, {wilson_sql('correct_n', 'records_n', 'low')} AS micro_low,
  {wilson_sql('correct_n', 'records_n', 'high')} AS micro_high, macro AS macro_accuracy, CAST(matches_n AS double) / species_n AS dominant_accuracy,
  {wilson_sql('matches_n', 'species_n', 'low')} AS dominant_low, {wilson_sql('matches_n', 'species_n', 'high')} AS dominant_high
FROM (SELECT g AS group_name, count(*) AS species_n, CAST(sum(validation_records_n) AS bigint) AS records_n, CAST(sum(correct_records_n) AS bigint) AS correct_n,
    count(*) FILTER (dominant_matches) AS matches_n, round(avg(record_match_rate), {DIGITS}) AS macro
  FROM (SELECT 'All' AS g, o_metric.* FROM o_metric UNION ALL SELECT band, o_metric.* FROM o_metric WHERE band IN ('High', 'Medium', 'Low')) t GROUP BY g) u"""

_BAND_FLOATS = ("micro_low", "micro_high", "macro_accuracy", "dominant_low", "dominant_high")


VIEWS["o_scope"] = """
SELECT 'All' AS g, o_metric.* FROM o_metric UNION ALL SELECT band, o_metric.* FROM o_metric WHERE band IN ('High', 'Medium', 'Low')"""


@check(
    "m03_band_accuracy",
    f"SELECT o_band.*, macro_low, macro_high FROM o_band LEFT JOIN ({_bootstrap_sql('g', 'o_scope').replace('SELECT HEAD b0.n', 'SELECT b0.g, b0.n').replace('AS ci_low', 'AS macro_low').replace('AS ci_high', 'AS macro_high')}) m ON m.g = group_name",
)
def _(spark, sf):
    return rounded(band_accuracy(metrics(spark, sf), "band", block=BLOCK), *_BAND_FLOATS, "macro_low", "macro_high")


@check(
    "m06_band_audit",
    """SELECT group_name, species_n, CASE WHEN species_n < 10 THEN 'INSUFFICIENT_EVIDENCE' WHEN dominant_low >= t THEN 'RETAIN'
      WHEN dominant_accuracy >= t THEN 'PROVISIONAL_MORE_VALIDATION_NEEDED' ELSE 'MODIFY_OR_RESTRICT_AUTOMATIC_USE' END AS decision
    FROM (SELECT o_band.*, CASE WHEN group_name = 'High' THEN 0.9 ELSE 0.75 END AS t FROM o_band WHERE group_name IN ('High', 'Medium')) b""",
)
def _(spark, sf):
    return band_audit(metrics(spark, sf)).select("group_name", "species_n", "decision")


@check(
    "m06_audit_decisions",
    """SELECT n, CASE WHEN n < 10 THEN 'INSUFFICIENT_EVIDENCE' WHEN low >= 0.5 THEN 'RETAIN' WHEN acc >= 0.5 THEN 'PROVISIONAL_MORE_VALIDATION_NEEDED'
      ELSE 'MODIFY_OR_RESTRICT_AUTOMATIC_USE' END AS decision, count(*) AS rows_n
    FROM (SELECT CAST(l_quantity AS int) AS n, l_discount * 10 AS acc, l_tax * 10 AS low FROM lineitem) t GROUP BY ALL""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax"]).select(
        F.col("l_quantity").cast("int").alias("n"), (F.col("l_discount") * 10).alias("acc"), (F.col("l_tax") * 10).alias("low")
    )
    return df.groupBy("n", audit("n", "acc", "low", 0.5).alias("decision")).agg(F.count(F.lit(1)).alias("rows_n"))


def grid_sql(source: str, shares=SHARE_GRID, counts=COUNT_GRID, coverages=COVERAGE_GRID) -> str:
    """Every threshold combination evaluated by its own scan."""
    def values(v):
        return ", ".join(f"({x!r}::double)" if isinstance(x, float) else f"({x})" for x in v)

    return f"""
SELECT share_threshold, count_threshold, coverage_threshold, species_n, matches_n,
  CAST(species_n AS double) / (SELECT count(*) FROM {source}) AS species_coverage, CAST(matches_n AS double) / nullif(species_n, 0) AS accuracy,
  {wilson_sql('matches_n', 'species_n', 'low')} AS accuracy_low, {wilson_sql('matches_n', 'species_n', 'high')} AS accuracy_high, macro AS macro_accuracy
FROM (SELECT s.x AS share_threshold, c.x AS count_threshold, v.x AS coverage_threshold, count(m.species_key) AS species_n,
    count(*) FILTER (m.dominant_matches) AS matches_n, round(avg(m.record_match_rate), {DIGITS}) AS macro
  FROM (VALUES {values(shares)}) s(x) CROSS JOIN (VALUES {values(counts)}) c(x) CROSS JOIN (VALUES {values(coverages)}) v(x)
  LEFT JOIN {source} m ON m.dominant_proportion >= s.x AND m.assigned_records_n >= c.x AND m.overlay_coverage >= v.x
  GROUP BY s.x, c.x, v.x) g"""


VIEWS["o_calibration"] = "SELECT * FROM o_split WHERE validation_split = 'calibration'"
VIEWS["o_holdout"] = "SELECT * FROM o_split WHERE validation_split = 'holdout'"
VIEWS["o_grid"] = grid_sql("o_calibration")
VIEWS["o_grid_holdout"] = grid_sql("o_holdout")
_GRID_FLOATS = ("accuracy_low", "accuracy_high", "macro_accuracy")


@check("m04_threshold_grid", "SELECT * FROM o_grid")
def _(spark, sf):
    side = metrics(spark, sf).where("validation_split = 'calibration'")
    return rounded(threshold_grid(side), *_GRID_FLOATS)


@check(
    "j18_fixed_grid",
    "SELECT * FROM (" + grid_sql("o_metric", (0.5, 0.6, 0.7, 0.8, 0.9), (5, 10, 20, 50), (0.7, 0.8, 0.9)) + ") g WHERE species_n > 0",
)
def _(spark, sf):
    grid = threshold_grid(metrics(spark, sf), (0.5, 0.6, 0.7, 0.8, 0.9), (5, 10, 20, 50), (0.7, 0.8, 0.9))
    return rounded(grid.where("species_n > 0"), *_GRID_FLOATS)


def _select_sql(grid: str, target: float) -> str:
    return f"""(SELECT *, 'meets_target_with_ci' AS selection_status FROM {grid} WHERE species_n >= 10 AND accuracy_low >= {target}
      ORDER BY species_coverage DESC, share_threshold, count_threshold, coverage_threshold LIMIT 1)"""


def _chosen_sql(grid: str, target: float) -> str:
    return f"""SELECT * FROM {_select_sql(grid, target)} a UNION ALL
    SELECT * FROM (SELECT *, 'best_available_but_target_not_confirmed' AS selection_status FROM {grid} WHERE species_n >= 10
      ORDER BY accuracy_low DESC, accuracy DESC, species_coverage DESC, share_threshold, count_threshold, coverage_threshold LIMIT 1) b
    WHERE NOT EXISTS (SELECT 1 FROM {grid} WHERE species_n >= 10 AND accuracy_low >= {target})"""


@check("w15_threshold_selection", _chosen_sql("o_grid", 0.1))
def _(spark, sf):
    side = metrics(spark, sf).where("validation_split = 'calibration'")
    return rounded(select_threshold(threshold_grid(side), 0.1), *_GRID_FLOATS)


@check(
    "m05_threshold_recommendation",
    f"""SELECT c.band, c.selection_status, c.share_threshold, c.count_threshold, c.coverage_threshold, c.species_n, c.accuracy,
      h.species_n AS holdout_species_n, h.species_coverage AS holdout_coverage, h.accuracy AS holdout_accuracy
    FROM (SELECT 'High' AS band, * FROM ({_chosen_sql('o_grid', 0.9)}) x UNION ALL SELECT 'Medium', * FROM ({_chosen_sql('o_grid', 0.75)}) y) c
    JOIN o_grid_holdout h ON h.share_threshold = c.share_threshold AND h.count_threshold = c.count_threshold AND h.coverage_threshold = c.coverage_threshold""",
)
def _(spark, sf):
    return threshold_report(metrics(spark, sf)).select(
        "band", "selection_status", "share_threshold", "count_threshold", "coverage_threshold", "species_n", "accuracy",
        "holdout_species_n", "holdout_coverage", "holdout_accuracy",
    )


@check(
    "a15_confusion_with_totals",
    """SELECT CASE WHEN grouping(observed_label) = 1 THEN 'Total' ELSE observed_label END AS observed_label,
    CASE WHEN grouping(predicted_label) = 1 THEN 'Total' ELSE predicted_label END AS predicted_label, count(*) AS n
    FROM o_joined GROUP BY CUBE (observed_label, predicted_label)""",
)
def _(spark, sf):
    usable = predictions(spark, sf).where("predicted_label IS NOT NULL")
    joined = join_truth(usable, truth_rows(records(spark, sf)), ["species_key"])
    return confusion_with_totals(joined, "observed_label", "predicted_label")


@check(
    "a28_medians",
    """SELECT CASE WHEN grouping(band) = 1 THEN 'Overall' ELSE band END AS performance_group, count(*) AS rows_n,
    median(assigned_records_n) AS assigned_records_n_median, median(record_match_rate) AS record_match_rate_median
    FROM o_metric GROUP BY GROUPING SETS ((), (band))""",
)
def _(spark, sf):
    return medians(metrics(spark, sf), ["assigned_records_n", "record_match_rate"], "band")


@check(
    "p12_performance_summary",
    f"""SELECT performance_group, species_n, assigned_records_median, validation_records_n, correct_records_n, match_rate_mean, match_rate_median,
      matches_n, dominant_proportion_median, overlay_coverage_median, CAST(correct_records_n AS double) / validation_records_n AS weighted_match_rate,
      {wilson_sql('correct_records_n', 'validation_records_n', 'low', 1.96, False)} AS match_rate_low, {wilson_sql('correct_records_n', 'validation_records_n', 'high', 1.96, False)} AS match_rate_high,
      CAST(matches_n AS double) / species_n AS dominant_accuracy, {wilson_sql('matches_n', 'species_n', 'low', 1.96, False)} AS dominant_low,
      {wilson_sql('matches_n', 'species_n', 'high', 1.96, False)} AS dominant_high
    FROM (SELECT CASE WHEN grouping(band) = 1 THEN 'Overall' ELSE band END AS performance_group, count(*) AS species_n, median(assigned_records_n) AS assigned_records_median,
      CAST(sum(validation_records_n) AS bigint) AS validation_records_n, CAST(sum(correct_records_n) AS bigint) AS correct_records_n,
      round(avg(record_match_rate), {DIGITS}) AS match_rate_mean, median(record_match_rate) AS match_rate_median, count(*) FILTER (dominant_matches) AS matches_n,
      median(dominant_proportion) AS dominant_proportion_median, median(overlay_coverage) AS overlay_coverage_median
      FROM o_metric GROUP BY GROUPING SETS ((), (band))) t""",
)
def _(spark, sf):
    return rounded(
        performance(metrics(spark, sf), "band"),
        "match_rate_mean", "match_rate_low", "match_rate_high", "dominant_low", "dominant_high",
    )
