"""Distributed union-find: the smallest node that each node can reach over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; `links` has longs `a` and `b`.

    Large-star and small-star turns: in each round every node's larger neighbours are hung
    under its smallest neighbour, then the smaller ones, until all links are stars around
    the smallest node. A node's minimum is an aggregate that each task starts by itself, and
    is joined back to the links, so a node with very many links needs no list. Self links and
    nulls are ignored. Rounds are stored in the shared folder, never in executors alone.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = stored(_star(_star(edges, large=True), large=False), "links")
        new = _state(edges)
        if new == state:  # both turns leave stars, and nothing else, as they are
            break
        state = new
    else:
        raise RuntimeError("the links did not become stars")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One turn. Links come and go as (larger, smaller)."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()
