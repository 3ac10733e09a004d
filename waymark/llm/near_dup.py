"""MinHash near-duplicates of documents: SuperMinHash signatures, banding, exact checks.

Documents with equal shingle sets are one node. Nodes that share a band are candidates; every
link is confirmed on the full sets. A band group is never expanded into all its pairs: its
nodes are first compared with two of them, the links found are closed to components, and only
nodes that the group's largest component does not hold are then compared with the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, hash_names, mix, settle, slices, stored
from waymark.llm.linking import band_members, link_groups, sketch_difference

BANDS, ROWS = 40, 7
#: A pair at the least similarity agrees in 90 % of the sketch bits (one of 280 per slot);
#: under 83 % (4 standard deviations less) it is not worth an exact check.
SKETCH_MOST_DIFF = 0.17


# ---------------------------------------------------------------- sets and signatures

def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, rows ascending. A text of fewer than `width`
    words, but one at least, has its whole word sequence as its only shingle."""
    words = Words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = hash_names(words.names)[words.ids]
    first = words.windows(width)
    with np.errstate(over="ignore"):
        def combine(start, n):
            x = np.full(len(start), 0x9E3779B97F4A7C15 + n, np.uint64)
            for k in range(n):
                x = mix(x * np.uint64(31) + h[start + k])
            return x

        rows, keys = [words.doc[first]], [combine(first, width)]
        for n in range(1, width):
            short = np.flatnonzero(words.counts == n)
            rows.append(short)
            keys.append(combine(words.starts[short], n))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[keep], key[keep]


def superminhash(row: np.ndarray, key: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """SuperMinHash signatures, (rows, slots) unsigned 64-bit.

    In turn j an element draws the j-th place of its own random permutation of the slots and
    offers rank j plus a random fraction there (rank in the high half of the value). A set is
    finished when the turn's rank exceeds all its slots, so long sets stop after a turn or
    two. Permutations are kept for unfinished sets only, some elements at a time."""
    sig = np.full((rows, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)

    def draw(h, j):
        with np.errstate(over="ignore"):
            u = mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = j + ((u & np.uint64(0xFFFFFFFF)) % np.uint64(slots - j)).astype(np.int64)
        return place, np.uint64(j << 32) | (u >> np.uint64(32))

    if not len(key):
        return sig
    place0, value = draw(key, 0)
    np.minimum.at(flat, row * slots + place0, value)
    open_rows = sig.max(1) >= np.uint64(1 << 32)
    todo = np.flatnonzero(open_rows[row])
    cuts = [0]
    for edge in np.flatnonzero(np.diff(row[todo])) + 1:  # whole rows, about 40,000 elements
        if edge - cuts[-1] > 40_000:
            cuts.append(int(edge))
    cuts.append(len(todo))
    for lo, hi in zip(cuts, cuts[1:]):
        at = todo[lo:hi]
        if not len(at):
            continue
        perm = np.tile(np.arange(slots, dtype=np.int16), (len(at), 1))
        here = np.arange(len(at))
        perm[here, place0[at]] = 0
        r, h = row[at], key[at]
        for j in range(1, slots):
            place, value = draw(h, j)
            slot = perm[here, place]
            perm[here, place] = perm[here, j]
            np.minimum.at(flat, r * slots + slot, value)
            distinct = np.unique(r)
            still = sig[distinct].max(1) >= np.uint64((j + 1) << 32)
            if not still.all():
                flag = np.zeros(rows, bool)
                flag[distinct[still]] = True
                keep = flag[r]
                r, h, here = r[keep], h[keep], here[keep]
                if not len(r):
                    break
    return sig


def band_keys(sig: np.ndarray, bands: int, width: int) -> np.ndarray:
    grid = sig.reshape(len(sig), bands, width)
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), grid.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(width):
            x = mix(x * np.uint64(31) + grid[:, :, k])
    return x


def _describe(width: int, bands: int, rows_per_band: int):
    """Signature rows of batches (doc_id, content, text)."""
    slots = bands * rows_per_band

    def lists(values, n, each):
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * each)
        return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))

    def describe(batches):
        for batch in slices(batches, "text"):
            n = batch.num_rows
            row, key = shingle_sets(batch.column("text"), width)
            sig = superminhash(row, key, n, slots)
            bits = (mix(sig) & np.uint64(1)).astype(np.uint8)
            padded = np.zeros((n, -(-slots // 64) * 64), np.uint8)
            padded[:, :slots] = bits
            sketch = np.packbits(padded, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), pa.array(np.bincount(row, minlength=n)), pa.array(_node(row, key, n)),
                 lists(band_keys(sig, bands, rows_per_band).view(np.int64), n, bands),
                 lists(np.ascontiguousarray(sketch), n, sketch.shape[1])],
                ["doc_id", "content", "n_shingles", "node", "bands", "sketch"],
            )

    return describe


def _node(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of every set, equal for equal sets."""
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(one, row, mix(key))
        np.bitwise_xor.at(two, row, mix(key + np.uint64(0x632BE59BD9B4E019)))
        return mix(mix(one) + two).view(np.int64)


# ---------------------------------------------------------------- jobs

def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """(doc_id, content, n_shingles, node, bands, sketch) of every document, stored; content is
    a hash of the text."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(
        _describe(width, bands, rows_per_band),
        "doc_id long, content long, n_shingles long, node long, bands array<long>, sketch array<long>",
    )
    return stored(out, "signatures")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, content): one document per node is read again."""
    def sets(batches):
        for batch in slices(batches, "text"):
            n = batch.num_rows
            row, key = shingle_sets(batch.column("text"), width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_node(row, key, n)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))],
                ["node", "shingles"],
            )

    again = wanted.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_c"))
    found = docs.select("doc_id", "text").join(again, same).select("text").mapInArrow(sets, "node long, shingles array<long>")
    return stored(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "full-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
    )
    inter = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - inter
    return both.where(100 * inter >= percent * union).select("a", "b")


def _may_link(x: str, y: str, percent: int, slots: int) -> F.Column:
    """Sizes and sketches that a linked pair can have."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    near = sketch_difference(x, y, -(-slots // 64)) <= int(SKETCH_MOST_DIFF * slots)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & near


def link_components(
    docs: DataFrame, width: int, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Texts link if 100 * shared shingles >= percent * all their shingles. component_id is the
    smallest doc_id of the component. Null, empty and blank texts link with nothing. Rows that
    repeat a doc_id each follow their own text. A pair at the least similarity shares a band
    with a probability of 1 - (1 - 0.8^7)^40 > 0.9999.
    """
    out = linked_rows(docs, width, percent, bands, rows_per_band).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, content) of the one row of every component that stays, and of all texts that
    link with nothing; content is the text's xxhash64. Of a component that is the row with the
    smallest doc_id, nulls last, then the smallest content."""
    rows = linked_rows(docs, width)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content"))
    linked = rows.where("root is not null").groupBy("root").agg(least.alias("row")).select("row.doc_id", "row.content")
    return linked.unionByName(rows.where("root is null").select("doc_id", "content").distinct())


def linked_rows(
    docs: DataFrame, width: int, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS
) -> DataFrame:
    """doc_id, content, n_shingles, root and component_id of every row of `docs`. `root` names
    the component whatever its doc_ids; null for texts that link with nothing."""
    slots = bands * rows_per_band
    signed = signatures(docs, width, bands, rows_per_band)
    filled = signed.where("n_shingles > 0")
    nodes = filled.select("node", "n_shingles", "bands", "sketch").dropDuplicates(["node"])
    members = band_members(nodes.select("node", F.explode("bands").alias("key")))
    settle(docs.sparkSession)
    held = members.select("node").distinct()
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("one")
    wanted = filled.groupBy("node").agg(one).select("node", "one.doc_id", "one.content").join(held, "node")
    sets = _full_sets(docs, wanted, width)
    light = stored(
        nodes.select("node", F.col("n_shingles").alias("n"), "sketch").join(held, "node"), "light-nodes"
    )

    roots = link_groups(
        members, light, lambda pairs: _verified(pairs, sets, percent),
        lambda x, y: _may_link(x, y, percent, slots), sets, percent,
    )
    roots = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("root"))

    rows = filled.select("doc_id", "content", "n_shingles", "node")
    least_doc = rows.groupBy("node").agg(F.min("doc_id").alias("_d")).join(roots, "node")
    by_root = least_doc.groupBy("root").agg(F.min("_d").alias("component_id"))
    answer = least_doc.join(by_root, "root").select("node", "root", "component_id")
    return rows.join(answer, "node").select("doc_id", "content", "n_shingles", "root", "component_id").unionByName(
        signed.where("n_shingles = 0").select(
            "doc_id", "content", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")
        )
    )
