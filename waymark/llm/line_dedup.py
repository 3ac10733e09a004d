"""Fuzzy line dedup: MinHash over character shingles, exact checks, union-find.

A line's key is its text trimmed and in lower case. Lines are near-equal if the Jaccard
similarity of their sets of 8-character shingles is at least 0.8; a shorter key is its own
only shingle, so it is near-equal to its exact repeats alone. Of each component of near-equal
lines over all documents the first one by (doc_id, place) stays. Blank lines take no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, hash_names, mix, slices, stored
from waymark.llm.linking import link_groups

SHINGLE = 8
#: Lines with fewer characters (trimmed) are left alone unless the caller asks for more lines;
#: the query and the pipeline ask for every line that is not blank.
MIN_CHARS = 20
NOT_BLANK = 1
#: The bands use all bins. Short lines fill few bins and the rest are copies, so no sketch is
#: trusted to tell pairs apart: candidates are checked on their full sets, but for those whose
#: shingle bits already differ in more places than similar lines can.
BINS, BANDS, ROWS = 64, 16, 4
#: Words of 64 bits for the shingles that a line holds.
WORDS = 8
#: Turns in which the bands are grouped, and bytes of a band's hash that are kept.
PARTS, KEY = 2, 6
#: Bytes of hashes and nodes that are grouped at a time.
GROUP_BYTES = 4 << 20
#: Documents that are cut into lines at a time.
DOCUMENTS = 1000
#: Lines that are hashed at a time.
LINES = 500
PERCENT = 80

_EMPTY = np.iinfo(np.uint64).max


def key_lines(texts: pa.Array, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place and key of the lines of at least `min_chars` characters."""
    parts = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    place = np.arange(len(row)) - (offsets - offsets[0])[row]
    keys = pc.utf8_lower(pc.utf8_trim_whitespace(parts.flatten()))
    long = np.asarray(pc.greater_equal(pc.utf8_length(keys), max(min_chars, NOT_BLANK)), dtype=bool)
    return row[long], place[long], keys.filter(pa.array(long))


def rolling(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the keys, repeats included, and the key of each. Every
    key has at least `SHINGLE` characters."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.frombuffer("".join(keys.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        power, width = np.uint64(0x9E3779B97F4A7C15), 1
        while width < SHINGLE:  # a power of two
            wider = h[:-width] * power
            wider += h[width:]
            h, power, width = wider, power * power, 2 * width
    line = np.repeat(np.arange(len(keys)), np.asarray(pc.utf8_length(keys), dtype=np.int64) - (SHINGLE - 1))
    return mix(h[np.arange(len(line)) + (SHINGLE - 1) * line]), line


def bin_minima(keys: pa.Array) -> np.ndarray:
    """(lines, BINS): the least hash of a line's shingles in each bin of one permutation.
    An empty bin takes the next filled one's value, mixed with the distance."""
    h, line = rolling(keys)
    out = np.full((len(keys), BINS), _EMPTY, np.uint64)
    np.minimum.at(out.reshape(-1), line * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h >> np.uint64(6))
    row, col = np.nonzero(out == _EMPTY)
    if len(row):
        place = np.where(out == _EMPTY, 2 * BINS, np.arange(BINS))
        twice = np.concatenate([place, place + BINS], axis=1)
        ahead = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][row, col]
        out[row, col] = mix(out[row, ahead % BINS] + ((ahead - col).astype(np.uint64) << np.uint64(32))) >> np.uint64(6)
    return out


def shingle_bits(h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """(lines, WORDS): the bits that a line's shingles set. Two lines differ in at least as many
    shingles as bits, so `_near_bits` loses no pair that reaches the similarity."""
    flags = np.zeros((n, 64 * WORDS), bool)
    flags[line, (h >> np.uint64(48)).astype(np.int64) % (64 * WORDS)] = True
    return np.packbits(flags, axis=1, bitorder="little").view("<i8")


def _near_bits(x: str, y: str) -> Column:
    """True wherever 100 * intersection >= PERCENT * union can hold: the difference of the two sets
    is then at most (100 - PERCENT) / (100 + PERCENT) of their sizes' sum."""
    apart = sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(WORDS)), F.lit(0))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def band_hashes(low: np.ndarray) -> np.ndarray:
    """(lines, BANDS): a hash of the minima of each band."""
    bands = np.zeros((len(low), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(len(low), b + 1, np.uint64)
            for k in range(ROWS):
                x = mix(x * np.uint64(31) + low[:, b * ROWS + k])
            bands[:, b] = x
    return bands


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, content, place, node) of every line that takes part, stored. A line of at least
    `SHINGLE` characters that is the first of its kind in a slice of the texts carries its key
    (`line`) and, turn by turn, its bands (`t0`, …: `KEY` bytes of each hash), so the texts are
    cut into lines once."""
    names = [f"t{k}" for k in range(PARTS)]

    def bands(keys: pa.Array) -> list[pa.Array]:
        parts = [np.zeros((0, BANDS), np.uint64)]
        for lo in range(0, len(keys), LINES):
            parts.append(band_hashes(bin_minima(keys.slice(lo, LINES))))
        hashes = np.concatenate(parts).astype("<u8").view(np.uint8).reshape(len(keys), BANDS, 8)[:, :, :KEY]
        return [_blobs(hashes[:, k::PARTS].reshape(len(keys), BANDS // PARTS * KEY)) for k in range(PARTS)]

    def describe(batches):
        for batch in slices(batches, "text"):
            row, place, keys = key_lines(batch.column("text"), min_chars)
            coded = keys.dictionary_encode()
            kinds, kind = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
            node = hash_names(kinds).view(np.int64)
            banded = np.asarray(pc.greater_equal(pc.utf8_length(kinds), SHINGLE), dtype=bool)
            lead = np.zeros(len(kind), bool)
            lead[np.unique(kind, return_index=True)[1]] = True
            lead &= banded[kind]
            pick = pa.array((np.cumsum(banded) - 1)[kind], mask=~lead)
            kinds, at = kinds.filter(pa.array(banded)), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("content").take(at), pa.array(place.astype(np.int32)),
                 pa.array(node[kind]), kinds.cast(pa.string()).take(pick), *(x.take(pick) for x in bands(kinds))],
                ["doc_id", "content", "place", "node", "line", *names],
            )

    schema = "doc_id long, content long, place int, node long, line string, " + ", ".join(f"{c} binary" for c in names)
    return stored(docs.select("doc_id", "content", "text").mapInArrow(describe, schema), "lines", DOCUMENTS, "zstd")


def _blobs(rows: np.ndarray, cuts: np.ndarray | None = None) -> pa.Array:
    """The bytes of each row, or of the rows between the cuts, as one binary value."""
    rows = np.ascontiguousarray(rows)
    cuts = np.arange(len(rows) + 1) if cuts is None else cuts
    offsets = (cuts * (rows.nbytes // max(1, len(rows)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _joined_bytes(values) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8)


def same_bands(table: pa.Table) -> pa.Table:
    """(key, node, p1, p2) of the nodes that share a hash with another node; `table` has hashes and
    their nodes in packed rows. Hashes that hold the same nodes are told once, so the key is a hash
    of the nodes; p1 and p2 are the smallest and the largest."""
    raw = _joined_bytes(table.column("hashes")).reshape(-1, KEY)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :KEY] = raw
    key, node = wide.reshape(-1).view("<u8"), _joined_bytes(table.column("nodes")).view("<i8")
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = key[1:] == key[:-1]
    near = np.zeros(len(key), bool)
    near[1:] |= again
    near[:-1] |= again
    key, node = key[near], node[order][near]  # most hashes stand alone
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    size = np.diff(np.append(first, len(key)))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix(node.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
        name = mix(name + size.astype(np.uint64))
    told = np.zeros(len(first), bool)
    told[np.unique(name, return_index=True)[1]] = True
    told &= size > 1
    p1, p2, rows = node[first], node[first + size - 1], np.repeat(told, size)
    columns = [np.repeat(x, size)[rows] for x in (name.view(np.int64), p1, p2)]
    return pa.table({"key": columns[0], "node": node[rows], "p1": columns[1], "p2": columns[2]})


def shared_bands(leads: DataFrame, rows: int) -> DataFrame:
    """(key, node, p1, p2) of every node in a band of two or more nodes, stored; p1 and p2 are the
    smallest and largest of the band, and bands of the same nodes are one. `leads` has (node, t0, …),
    about `rows` of them, repeats allowed.

    A band meets no other band, so `PARTS` turns follow each other on the disk. Hashes and nodes
    travel in packed rows, one for each batch and group of hashes."""
    groups = max(1, -(-rows * (BANDS // PARTS) * (KEY + 8) // GROUP_BYTES))

    def packed(column: str):
        def pack(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw = _joined_bytes(batch.column(column)).reshape(-1, KEY)
                node = np.repeat(np.asarray(batch.column("node")), len(raw) // batch.num_rows)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :KEY] = raw
                part = (wide.reshape(-1).view("<u8") % np.uint64(groups)).astype(np.uint16 if groups < 1 << 16 else np.int64)
                order = np.argsort(part, kind="stable")
                size = np.bincount(part)
                held = np.flatnonzero(size)
                cuts = np.concatenate([[0], np.cumsum(size[held])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), _blobs(raw[order], cuts), _blobs(node[order], cuts)], ["part", "hashes", "nodes"]
                )

        return pack

    turns = []
    for column in (f"t{k}" for k in range(PARTS)):
        dealt = leads.select("node", column).mapInArrow(packed(column), "part long, hashes binary, nodes binary")
        found = dealt.groupBy("part").applyInArrow(same_bands, "key long, node long, p1 long, p2 long")
        turns.append(stored(found, "band-turn"))
    members = stored(reduce(DataFrame.unionByName, turns).distinct(), "band-members")
    discard(*turns)
    return members


def _with_bits(texts: DataFrame) -> DataFrame:
    """(node, line, n, s0, …): lines with their number of shingles and the shingles' bits."""
    names = ["n", *(f"s{k}" for k in range(WORDS))]

    def describe(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, LINES):
                some = batch.slice(lo, LINES)
                h, line = rolling(some.column("line"))
                bits = shingle_bits(h, line, some.num_rows)
                n = np.bincount(line, minlength=some.num_rows)
                yield pa.RecordBatch.from_arrays([*some.columns, *map(pa.array, [n, *bits.T])], ["node", "line", *names])

    return texts.mapInArrow(describe, "node long, line string, " + ", ".join(f"{c} long" for c in names))


def distinct_shingles(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of each key's distinct shingles, ascending, one key after the other, and
    where each key's hashes begin (keys + 1 entries)."""
    h, line = rolling(keys)
    ends = np.cumsum(np.bincount(line, minlength=len(keys)))
    for part in np.split(h, ends[:-1]) if len(keys) else []:
        part.sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(line[new], minlength=len(keys)))])


def _line_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): 64-bit hashes of the distinct shingles of the lines."""
    def sets(batches):
        for batch in slices(batches, "line"):
            h, offsets = distinct_shingles(batch.column("line"))
            found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), found], ["node", "shingles"])

    return texts.select("node", "line").mapInArrow(sets, "node long, shingles array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines' full sets of shingles (64-bit hashes) reach the similarity."""
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
    )

    def similar(batches):
        for batch in slices(slices(batches, "la"), "lb"):
            coded = pa.concat_arrays([batch.column("la"), batch.column("lb")]).dictionary_encode()
            sets = []
            for lo in range(0, len(coded.dictionary), LINES):
                h, offsets = distinct_shingles(coded.dictionary.slice(lo, LINES))
                sets += np.split(h, offsets[1:-1])
            pick, keep = coded.indices.to_pylist(), []
            for x, y in zip(pick[:batch.num_rows], pick[batch.num_rows:]):
                one, two = sets[x], sets[y]
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                inter = np.count_nonzero(two[at] == one)
                keep.append(100 * inter >= PERCENT * (len(one) + len(two) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "la", "lb").mapInArrow(similar, "a long, b long")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, content, places): the places of the lines that go, per document. `docs` has
    doc_id, content (a hash of the text) and text."""
    lines = occurrences(docs, min_chars)
    leads = lines.where("line is not null")
    members = shared_bands(leads, lines.count())
    held = leads.select("node", "line").join(members.select("node").distinct(), "node")
    texts = stored(_with_bits(held.dropDuplicates(["node"])), "line-texts")
    group = link_groups(
        members, texts.drop("line"), lambda pairs: _verified(pairs, texts), _near_bits,
        lambda wanted: _line_sets(texts.join(wanted, "node", "left_semi")), PERCENT,
    )
    named = lines.select("doc_id", "content", "place", "node").join(group, "node", "left").select(
        "doc_id", "content", "place", F.coalesce("component", "node").alias("component")
    )
    named = stored(named, "line-groups")
    at = F.struct("doc_id", "content", "place")
    keep = named.groupBy("component").agg(F.min(at).alias("keep"), F.max(at).alias("last")).where("keep <> last").drop("last")
    gone = named.join(keep, "component").where(~at.eqNullSafe(F.col("keep")))
    out = stored(gone.groupBy("doc_id", "content").agg(F.collect_set("place").alias("places")), "dropped-lines")
    discard(lines, members, texts, named)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` without the lines that repeat, with `n_lines` and `n_dropped`.

    Every document stays, if need be with an empty text; null texts stay null. Lines shorter
    than `min_chars` and blank ones stay. Within a document a repeated line goes as well. Rows that are equal
    in doc_id and text count as one document and are cut alike; a null doc_id comes first.
    """
    d, c = "_line_doc", "_line_content"
    keyed = docs.withColumn(d, F.col("doc_id").cast("long")).withColumn(c, F.xxhash64("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    gone = dropped_lines(plain, min_chars).withColumnsRenamed({"doc_id": "_gone_doc", "content": "_gone_content", "places": "_places"})
    same = F.col(d).eqNullSafe(F.col("_gone_doc")) & (F.col(c) == F.col("_gone_content"))
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_places", i)), "\n")
    return (
        keyed.join(gone, same, "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_dropped", F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).cast("long"))
        .withColumn("text", F.when(F.col("_places").isNull(), F.col("text")).otherwise(left))
        .drop(d, c, "_gone_doc", "_gone_content", "_places")
    )
