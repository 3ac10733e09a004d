"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Document i of source s gets the rate r_i = exp(lambda_s), the solution of

    min  sum_i n_i (r_i log r_i - r_i)   with   sum_{i in s} n_i r_i = T_s   for every s,

n_i being its words and T_s its source's target. The dual  sum_i n_i exp(lambda_s(i)) -
sum_s lambda_s T_s  is smooth and convex. Its gradient and Hessian need of the documents only
sums per source, and each document is under one constraint, so the Hessian is diagonal: the
documents are summed once, and Newton's iteration runs for all sources side by side, one
row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import WORD, stored

#: Weights given to the sources in code point order, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
NEWTON_STEPS = 60
#: Documents that one sort of the rounding step holds on average.
GROUP_ROWS = 1000
PHASES = 32


def sized(docs: DataFrame) -> DataFrame:
    """The documents with `size`, their number of words (0 for null)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """Words to take of each source: `target` next to `source` and `source_size`.

    The sources share the sum of all sizes by weight. No target exceeds `most` times its
    source's size; what is above is shared again by weight. That is the level at which
    sum min(most * size, level * weight) equals the total: sources in order of
    most * size / weight are at their bound up to some rank and share the rest beyond it.
    One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_bound = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bound").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (
        sums.withColumn("weight", weight)
        .withColumn("bound", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.lit(float(most)) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("try", F.col("left") / F.col("heavy"))
        .withColumn("first", F.min(F.when(F.col("try") <= F.col("bound"), F.struct("bound", "source", "try"))).over(every))
        .withColumn("level", F.col("first.try"))
    )
    return level.select(
        "source", "source_size",
        F.coalesce(
            F.least(F.col("level") * F.col("weight"), F.lit(float(most)) * F.col("source_size")), F.lit(0.0)
        ).alias("target"),
    )


def newton(sums: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Add `tilt`, the minimiser of size * exp(tilt) - tilt * target, found by Newton's steps.

    A step is (size * exp(tilt) - target) / (size * exp(tilt)), held within one unit so that
    a start far above the solution cannot overshoot. A source without words or target has
    tilt null (rate 0).
    """
    value = F.col("source_size") * F.exp(F.lit(0.0))
    start = F.lit(0.0)

    def step(x, _):
        mass = F.col("source_size") * F.exp(x)
        return x - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (mass - F.col("target")) / mass))

    tilt = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return sums.withColumn("tilt", F.when((value > 0) & (F.col("target") > 0), tilt))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Every row of `docs` with size, source_size, target, rate, copies (0 to `most`) and taken.

    Rates are rounded to copies by systematic sampling: a source's documents stand in order
    of size class, then of a hash; document number k gets floor(k f + u) - floor((k - 1) f + u)
    copies, f the rate; u is that of `PHASES` start values that brings the source nearest to its
    target. Positions come from counts per group and short sorts inside groups of about
    `GROUP_ROWS` documents, so a source with a third of all rows is many small groups.

    Null texts have size 0 and take no part (0 copies, as all empty texts); a null source
    is a source of its own, ordered last. Rows that are equal in every column are
    interchangeable. Extra columns pass through; the working columns carry a prefix.
    """
    key, klass, hashed, slot, before, rank, phase = work = [
        f"_mix_{x}" for x in ("key", "class", "hash", "slot", "before", "rank", "phase")
    ]
    content = F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith(("map", "variant"))))
    base = (
        sized(docs)
        .withColumn(key, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn(klass, F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
        .withColumn(hashed, content)
    )
    narrow = stored(base.select(key, "source", klass, hashed, "size"), "mix-sizes")
    sums = narrow.groupBy("source", key).agg(F.sum("size").alias("source_size"))
    solved = stored(newton(targets(sums, weights, most)), "mix-targets").select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(key), "source_size", "target",
        F.least(F.lit(float(most)), F.coalesce(F.exp("tilt"), F.lit(0.0))).alias("rate"),
    )
    largest = narrow.groupBy(key, klass).count().agg(F.max("count")).head()[0] or 0
    slots = F.pmod(F.xxhash64(hashed), F.lit(-(-largest // GROUP_ROWS) or 1))
    order = Window.partitionBy(key).orderBy(F.desc(klass), slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        narrow.groupBy(key, klass, slots.alias(slot)).count()
        .withColumn(before, F.coalesce(F.sum("count").over(order), F.lit(0)))
        .drop("count").join(solved, key)
    )
    in_slot = Window.partitionBy(key, klass, slot).orderBy(F.desc("size"), hashed)

    def ranked(df: DataFrame, offsets: DataFrame) -> DataFrame:
        df = df.withColumn(slot, slots).withColumn(rank, F.row_number().over(in_slot))
        return df.join(offsets, [key, klass, slot]).withColumn(rank, F.col(rank) + F.col(before))

    def copies(u) -> F.Column:
        count = F.floor(F.col(rank) * F.col("rate") + u) - F.floor((F.col(rank) - 1) * F.col("rate") + u)
        return F.when(F.col("size") > 0, F.least(count, F.lit(most))).otherwise(0)

    starts = [(i + 0.5) / PHASES for i in range(PHASES)]
    miss = F.array(*(F.struct(F.abs(F.sum(F.col("size") * copies(F.lit(u))) - F.first("target")), F.lit(u).alias("u")) for u in starts))
    best = ranked(narrow, offsets).groupBy(key).agg(F.array_min(miss)["u"].alias(phase))
    final = stored(offsets.join(best, key), "mix-offsets")
    return (
        ranked(base, final)
        .withColumn("copies", copies(F.col(phase)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*work)
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select(*columns)
