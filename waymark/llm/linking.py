"""Components of similar nodes from band groups, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored
from waymark.llm.components import components

#: Nodes that a node is compared with in the first round.
PIVOTS = 8
#: Further rounds, each against other nodes of a group's largest component.
ROUNDS = 1
#: Open band groups up to this size become pairs, larger ones meet in blocks of about `BLOCK`.
SMALL, BLOCK = 32, 512


def band_members(banded: DataFrame) -> DataFrame:
    """(key, node, p1, p2) of every node in a band group of two or more different nodes; p1
    and p2 are the group's smallest and largest. `banded` has (node, key), repeats allowed."""
    shared = banded.groupBy("key").agg(F.min("node").alias("p1"), F.max("node").alias("p2")).where("p1 < p2")
    return stored(banded.join(shared, "key"), "band-members")


def sketch_difference(x: str, y: str, words: int) -> Column:
    """Bits in which two sketches (arrays of `words` longs) differ."""
    return sum(
        (F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(words)), F.lit(0)
    )


def link_groups(
    members: DataFrame, light: DataFrame, verify: Callable[[DataFrame], DataFrame],
    may_link: Callable[[str, str], Column], sets: DataFrame | Callable[[DataFrame], DataFrame], percent: int,
) -> DataFrame:
    """(node, component) of every node that a verified link reaches.

    `light` has (node, sketch, …), one row per node of `members`; `verify` keeps the pairs
    (a, b) that are linked; `may_link` is a cheap condition on two structs of the light
    columns that linked pairs fulfil; `sets` has the full sets (node, shingles) that large
    groups are compared by, or makes them for the nodes it is given.

    Every node is first compared with up to `PIVOTS` of the smallest and largest nodes of its
    groups, and the links are closed to components. In `ROUNDS` further rounds nodes outside
    a group's largest component meet other nodes of it. What is then left to compare in a group
    are nodes of different components: those outside its largest component with all others.
    Nothing is left in most groups, and no pair inside a component is looked at again.
    """
    facts = F.struct(*(c for c in light.columns if c != "node"))
    x, y = light.select(F.col("node").alias("a"), facts.alias("x")), light.select(F.col("node").alias("b"), facts.alias("y"))
    picks = members.select("node", F.explode(F.array("p1", "p2")).alias("pivot")).where("node <> pivot").distinct()
    some = Window.partitionBy("node").orderBy(F.xxhash64("pivot"), "pivot")
    stars = picks.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= PIVOTS).select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    ).distinct()
    likely = stars.join(x, "a").join(y, "b").where(may_link("x", "y")).select("a", "b")
    group = components(stored(verify(likely), "star-links"))

    rest = _open_bands(stored(members.select("key", "node").distinct(), "band-nodes"), light, group, facts)
    for turn in range(ROUNDS):
        minors = rest.where("component <> major").select("key", "node", "x")
        salted = F.struct(F.xxhash64("node", F.lit(turn)), "node", F.col("x").alias("y"))
        major = rest.where("component = major").groupBy("key").agg(F.min(salted).alias("lo"), F.max(salted).alias("hi"))
        near = minors.join(major.select("key", F.explode(F.array("lo", "hi")).alias("p")), "key").select(
            "node", "x", F.col("p.node").alias("pivot"), F.col("p.y").alias("y")
        ).where(may_link("x", "y")).select("node", "pivot").distinct()
        near = near.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= PIVOTS)
        new = stored(verify(near.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()), "turn-links")
        if not new.head(1):
            break
        group = stored(_joined(group, new), "groups")
        rest = _open_bands(rest.select("key", "node"), light, group, facts)  # a closed group stays closed

    sizes = rest.groupBy("key").agg(F.count("*").alias("size"))
    rest = rest.join(sizes, "key")
    small = rest.where(F.col("size") <= SMALL)
    m, o = small.where("component <> major").alias("m"), small.withColumnRenamed("x", "y").alias("o")
    differ = (
        (F.col("m.key") == F.col("o.key")) & (F.col("m.component") != F.col("o.component"))
        & ((F.col("o.component") == F.col("o.major")) | (F.col("m.node") < F.col("o.node")))
    )
    pairs = m.join(o, differ & may_link("m.x", "o.y")).select(
        F.least("m.node", "o.node").alias("a"), F.greatest("m.node", "o.node").alias("b")
    ).distinct()
    large = rest.where(F.col("size") > SMALL)
    if callable(sets):
        sets = sets(large.select("node").distinct())
    more = verify(pairs).unionByName(_block_links(large, sets, percent))
    more = stored(more, "rest-links")
    return _joined(group, more) if more.head(1) else group


def _block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of large band groups, which are compared block by block.

    A group's nodes are dealt to blocks of about `BLOCK` by hash, and every two blocks meet in
    one call with their full sets. A call tells the links that join components it sees as
    separate, a forest, and no other pair."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(77)), F.col("blocks")).cast("int")
    dealt = (
        rest.select("key", "node", "component", blocks.alias("blocks")).join(sets, "node")
        .withColumn("mine", mine)
        .select("key", "node", "component", "shingles", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", "node", "component", "shingles", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    )

    def compare(table: pa.Table) -> pa.Table:
        node, comp = np.asarray(table.column("node")), np.asarray(table.column("component"))
        lists = table.column("shingles").combine_chunks()
        n, size = len(node), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        item = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
        owner = np.repeat(np.arange(n), size)
        often = np.bincount(item) > 1
        item, owner = (np.cumsum(often) - 1)[item[often[item]]], owner[often[item]]
        order = np.argsort(item, kind="stable")
        item, owner = item[order], owner[order]
        inter = np.zeros((n, n), np.float32)
        for lo in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(item, [lo, lo + 4096])
            part = np.zeros((n, min(4096, int(often.sum()) - lo)), np.float32)
            part[owner[a:b], item[a:b] - lo] = 1
            inter += part @ part.T
        i, j = np.nonzero(np.triu(100 * inter >= percent * (size[:, None] + size[None, :] - inter), 1))
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for x, y in zip(i.tolist(), j.tolist()):
            one, two = find(comp[x].item()), find(comp[y].item())
            if one != two:
                root[max(one, two)] = min(one, two)
                found.append((x, y))
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": node[x], "b": node[y]})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def _open_bands(where: DataFrame, light: DataFrame, group: DataFrame, facts: Column) -> DataFrame:
    """(key, node, component, major, x) of the band groups that hold several components."""
    known = where.join(group, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    known = stored(known, "band-components")
    major = known.groupBy("key", "component").count().groupBy("key").agg(
        F.max(F.struct("count", "component"))["component"].alias("major"), F.count("*").alias("parts")
    ).where("parts > 1").drop("parts")
    open_rows = known.join(major, "key").join(light, "node")
    return stored(open_rows.select("key", "node", "component", "major", facts.alias("x")), "open-bands")


def _joined(group: DataFrame, links: DataFrame) -> DataFrame:
    """The components of `group` joined by further links between nodes."""
    a = group.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = group.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = group.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    new = merged.join(group.select(F.col("node").alias("component")), "component", "left_anti")
    return old.unionByName(new.select(F.col("component").alias("node"), F.col("root").alias("component")))
