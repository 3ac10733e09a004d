"""Lookup joins that stay even when blank or hot keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in (SHARES x shuffle partitions) of the rows.
SHARES = 8


def hot_keys(df: DataFrame, ks: Sequence[str], shares: int | None = None) -> DataFrame:
    """(_key, _salts) of the key combinations with more than one in `shares` of all rows; by
    default `SHARES` times the shuffle partitions. Rows with a null key do not count.

    There are fewer than `shares` of them and their salts add up to less than twice that, which
    is what makes this table safe to broadcast whatever the size of `df`. Counting reads the keys
    of all rows once more: count on the frame from which the keys come, before joins.
    """
    shares = shares or SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.where(_every([F.col(k).isNotNull() for k in ks]))
    counts = keyed.groupBy(F.xxhash64(*ks).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    salts = F.ceil(F.col("_n") * shares / total).cast("long").alias("_salts")
    return counts.where(F.col("_n") * shares > total).select("_key", salts)


def _every(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def spread_left(
    df: DataFrame, ref: DataFrame, ks: Sequence[str], cols: Sequence[str],
    hot: DataFrame | None = None, by: Sequence[str] | None = None,
) -> DataFrame:
    """`df` with the columns `cols` of the row of `ref` that has its keys, else nulls.

    ref has at most one row per combination of keys, and the keys have equal types on both sides.
    A null key meets nothing. Rows are dealt so that no task gets all of a frequent key, without
    session flags:

    * rows whose keys are all empty text get salts by their content, and the one empty-keyed row
      of ref is repeated per salt; this and the next need no pass over the rows;
    * rows with a null key are spread by their content and meet nothing;
    * rows of the keys in `hot` (from `hot_keys`) get salts, and ref's row is repeated per salt.

    `by` names columns that tell rows apart for this purpose; all columns by default. Rows that
    are equal in all of them stay together.
    """
    types = dict(df.dtypes)
    unlike = [k for k in ks if types[k] != dict(ref.dtypes)[k]]
    if unlike:
        raise ValueError(f"keys of different types: {unlike}")
    texts = all(types[k] == "string" for k in ks)
    content = by or [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    empty = F.coalesce(_every([F.col(k) == "" for k in ks]), F.lit(False)) if texts else F.lit(False)
    apart = empty | ~_every([F.col(k).isNotNull() for k in ks])

    own = F.xxhash64(*[F.col(f"`{c}`") for c in content])
    blank_salts = F.lit(SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).cast("long")
    salt, salts = F.when(empty, F.pmod(own, blank_salts)).when(apart, own), F.when(empty, blank_salts)
    left, right = df, ref
    if hot is not None:
        few, key = F.broadcast(hot), F.xxhash64(*ks)
        left, right = (x.withColumn("_key", key).join(few, "_key", "left") for x in (left, right))
        salt = salt.when(F.col("_salts") > 1, F.pmod(own, F.col("_salts")))
        salts = salts.when(F.col("_salts") > 1, F.col("_salts"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), salts.otherwise(F.lit(1)) - 1))
    values = [F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)]
    sides = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], *values, copies.alias("_copy"))
    salted = left.withColumn("_salt", salt.otherwise(F.lit(0)).cast("long"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(ks)]
    met = salted.join(sides, _every([*on, F.col("_salt") == F.col("_copy")]), "left")
    found = [F.col(f"_v{i}") for i in range(len(cols))]
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(c) for v, c in zip(found, cols)])
