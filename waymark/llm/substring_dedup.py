"""Exact substring dedup by fixed-block anchors.

Every document is cut into blocks of B words that do not overlap; they are the index. Every
rolling window of B words of every document probes it. A repeat of `width` words holds a whole
block of the document it repeats if B is (width + 1) // 2 or less, so no repeat is missed. A
hit is extended to both sides: the windows of `width` words that hold it are compared by
content, and neighbouring windows that stand in a document with a smaller doc_id chain to
maximal exact repeats, whose words go.

Documents are coded once into chunk files in the shared folder (distinct words and one number
per word). Probes and windows travel as sorted hashes, many to a row, each once per group of
chunks, dealt to buckets by hash; a bucket answers with one bit per hash. So a passage that
stands in every document is one entry per chunk and not one per place, and no pair of places is
ever formed. Bucket and group sizes follow from the number of words.

Words are runs of other than space and the controls from tab to return, unchanged. Windows are
judged on the input, not on what is left. Null and empty texts have no words. Rows that share a
doc_id do not remove from each other; a null doc_id counts as smaller than all others. Repeated
rows each give a row. Texts are read whole; a text longer than a chunk is a chunk by itself. An
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, hash_names, mix, scratch, slices, stored
from waymark.llm.files import make_folder, read_file, write_file

WIDTH = 13
#: Bits of a block's hash. A false hit costs a comparison and changes nothing.
BITS = 48
#: Hashes in a bucket at most, about, and hashes of a group in a bucket at least, about.
BUCKET, ENTRY = 6_000_000, 16


# ---------------------------------------------------------------- chunk files

def pack_chunk(doc_ids: pa.Array, texts: pa.Array) -> tuple[bytes, int]:
    """A chunk file: doc_ids, words per document, word numbers, distinct words."""
    words = Words(texts)
    used, codes = np.unique(words.ids, return_inverse=True)
    columns = {
        "doc_id": doc_ids, "counts": pa.array(words.counts), "codes": pa.array(codes.astype(np.int32)),
        "names": words.names.take(pa.array(used)).cast(pa.large_string()),
    }
    batch = pa.RecordBatch.from_arrays([_one_list(c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), len(codes)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)


class Chunks:
    """The documents of some chunk files: rank of doc_id, codes and hash of every word."""

    def __init__(self, files: list[str]):
        parts = []
        for file in files:
            with pa.ipc.open_stream(read_file(file)) as source:
                batch = source.read_next_batch()
            parts.append({name: batch.column(name).flatten() for name in batch.schema.names})
        self.doc_ids = pa.concat_arrays([p["doc_id"] for p in parts])
        self.counts = np.concatenate([np.asarray(p["counts"], np.int64) for p in parts])
        sizes = [len(p["names"]) for p in parts]
        shift = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.concatenate([np.asarray(p["codes"], np.int64) + s for p, s in zip(parts, shift)])
        self.names = pa.concat_arrays([p["names"] for p in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.order = np.asarray(pc.fill_null(self.doc_ids, np.iinfo(np.int64).min), np.int64)
        h = hash_names(self.names)
        self.hash, self.other = h[self.codes], mix(h)[self.codes]

    def windows(self, width: int) -> np.ndarray:
        """First positions of the windows of `width` words inside a document."""
        n = len(self.codes) - width + 1
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1:]) if n > 0 else np.zeros(0, np.int64)

    @staticmethod
    def rolled(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """A hash of the words of each window."""
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out *= np.uint64(0x9E3779B97F4A7C15)
                out += hashes[at + k]
        return mix(out)

    def probes(self, block: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash and whether it is an indexed block, of every rolling window of `block`
        words. Documents under `width` words take no part."""
        at = self.windows(block)
        at = at[self.counts[self.doc[at]] >= width]
        place = at - self.starts[self.doc[at]]
        return at, self.rolled(self.hash, at, block) >> np.uint64(64 - BITS), place % block == 0


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high bytes are alike and compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


def _cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the buckets of sorted keys of `bits` bits begin (buckets + 1 entries)."""
    top = np.arange(buckets + 1, dtype=object) * (1 << 32)
    edge = np.array([-(-int(t) // buckets) << (bits - 32) for t in top[:-1]], np.uint64)
    return np.concatenate([np.searchsorted(keys, edge), [len(keys)]])


# ---------------------------------------------------------------- anchors

def _anchors(chunks: Chunks, block: int, width: int):
    """Distinct probe hashes of a group, ascending; whether one is an indexed block; whether
    it stands in several documents; places of the probes and each one's distinct hash."""
    at, h, is_block = chunks.probes(block, width)
    keys, which = np.unique(h, return_inverse=True)
    indexed = np.zeros(len(keys), bool)
    indexed[which[is_block]] = True
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
    np.minimum.at(low, which, chunks.doc[at])
    np.maximum.at(high, which, chunks.doc[at])
    return keys, indexed, low < high, at, which


def _match_anchors(table: pa.Table) -> list[bytes]:
    """Per row of a bucket, a bit per hash: it is an indexed block and in several documents."""
    parts = [np.cumsum(_unplaned(b)).astype(np.uint64) for b in table["keys"].to_pylist()]
    sizes = [len(p) for p in parts]
    indexed = np.concatenate([_flags(b, n) for b, n in zip(table["flags"].to_pylist(), sizes)])
    several = np.concatenate([_flags(b, n) for b, n in zip(table["values"].to_pylist(), sizes)])
    which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)[1:]
    shared = count > 1
    shared[which[several]] = True
    known = np.zeros(len(count), bool)
    known[which[indexed]] = True
    hit = (shared & known)[which]
    ends = np.cumsum(sizes)
    return [_bits(hit[e - n:e]) for e, n in zip(ends, sizes)]


# ---------------------------------------------------------------- windows around hits

def _windows(chunks: Chunks, hits: np.ndarray, block: int, width: int):
    """The distinct windows of `width` words that hold a hit: two hashes, ascending by them,
    least rank of their documents; and of all such windows the place and the distinct one."""
    keys, _, _, at, which = _anchors(chunks, block, width)
    hit = np.zeros(len(chunks.codes) + 1, np.int64)
    found = at[hits[which]]
    reach = np.maximum(found - (width - block), chunks.starts[chunks.doc[found]])
    np.add.at(hit, reach, 1)
    np.add.at(hit, found + 1, -1)
    start = chunks.windows(width)
    start = start[np.cumsum(hit)[start] > 0]
    one, two = chunks.rolled(chunks.hash, start, width), chunks.rolled(chunks.other, start, width)
    two = two >> np.uint64(32)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, which, chunks.order[chunks.doc[start]])
    return one[order[new]], two[order[new]], least, start, which


def _match_windows(table: pa.Table) -> list[bytes]:
    """Per row of a bucket, a bit per window: it stands in a document of smaller rank than any
    of the group it comes from."""
    one, two, least, sizes = [], [], [], []
    for keys, other, low in zip(*(table[c].to_pylist() for c in ("keys", "flags", "values"))):
        one.append(np.cumsum(_unplaned(keys)).astype(np.uint64))
        two.append(np.frombuffer(other, "<u4"))
        least.append(_unplaned(low).view(np.int64))
        sizes.append(len(one[-1]))
    one, two, least = np.concatenate(one), np.concatenate(two), np.concatenate(least)
    order = np.lexsort((least, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = least[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    lower = np.zeros(len(order), bool)
    lower[order] = first < least[order]
    ends = np.cumsum(sizes)
    return [_bits(lower[e - n:e]) for e, n in zip(ends, sizes)]


# ---------------------------------------------------------------- jobs

_ENTRIES = "group long, bucket long, n long, keys binary, flags binary, values binary"
_ANSWERS = "group long, bucket long, n long, bits binary"


def write_chunks(docs: DataFrame) -> DataFrame:
    """The documents as chunk files; the manifest has a row (file, words) for each."""
    folder = scratch(docs.sparkSession, "word-chunks")
    make_folder(folder)

    def write(batches):
        for batch in slices(batches, "text"):
            data, words = pack_chunk(batch.column("doc_id"), batch.column("text"))
            file = f"{folder}/{uuid.uuid4().hex}.arrow"
            write_file(file, data)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([words])], ["file", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(write, "file string, words long"), "chunk-manifest")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Groups are few rows with much work behind them: a fixed number of tasks, not merged."""
    return rows.repartition(parts, "group").groupBy("group")


def _answered(groups: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Rows (group, files, step, bucket, n, bits): every group once and the answers to it."""
    none = {"step": F.lit(0), "bucket": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "bits": F.lit(None).cast("binary")}
    rows = groups.withColumns(none)
    for step, answer in enumerate(answers, 1):
        rows = rows.unionByName(answer.withColumns({"files": F.lit(None).cast("array<string>"), "step": F.lit(step)}))
    return rows


def _read_group(table: pa.Table, steps: int) -> tuple[Chunks, list[np.ndarray]]:
    """The chunks of a group and the flags that each step's buckets sent."""
    rows = sorted(table.select(["step", "bucket", "n", "bits", "files"]).to_pylist(), key=lambda r: (r["step"], r["bucket"]))
    flags = []
    for step in range(1, steps + 1):
        flags.append(np.concatenate([np.zeros(0, bool), *(_flags(r["bits"], r["n"]) for r in rows if r["step"] == step)]))
    return Chunks(rows[0]["files"]), flags


def _entry_rows(group: int, cuts: np.ndarray, parts) -> pa.Table:
    """One row per bucket that has entries; `parts` makes its three binaries."""
    rows = [(group, b, int(hi - lo), *parts(lo, hi)) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["group", "bucket", "n", "keys", "flags", "values"])


def _steps_up(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, spans (first word and end of each maximal repeat),
    n_removed, kept_text (the other words, joined by one space)."""
    if width < 1:
        raise ValueError("a window has one word at least")
    block = (width + 1) // 2
    manifest = write_chunks(docs)
    words, files = manifest.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).head()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, -(-words // BUCKET))
    most = max(1, words // (buckets * ENTRY))
    group = F.xxhash64("file") if files <= most else F.pmod(F.xxhash64("file"), F.lit(most))
    files_of = F.sort_array(F.collect_list("file")).alias("files")  # a bounded number of chunks
    groups = stored(manifest.groupBy(group.alias("group")).agg(files_of), "chunk-groups")
    parts = max(parts, min(files, most, 8 * parts))

    def probe(table: pa.Table) -> pa.Table:
        chunks = Chunks(table["files"][0].as_py())
        keys, indexed, several, _, _ = _anchors(chunks, block, width)
        return _entry_rows(table["group"][0].as_py(), _cuts(keys, BITS, buckets), lambda a, b: (
            _planes(_steps_up(keys[a:b])), _bits(indexed[a:b]), _bits(several[a:b])))

    def extend(table: pa.Table) -> pa.Table:
        chunks, (hits,) = _read_group(table, 1)
        one, two, least, _, _ = _windows(chunks, hits, block, width)
        return _entry_rows(table["group"][0].as_py(), _cuts(one, 64, buckets), lambda a, b: (
            _planes(_steps_up(one[a:b])), two[a:b].astype("<u4").tobytes(), _planes(least[a:b].view(np.uint64))))

    def answer(match):
        def bucket(table: pa.Table) -> pa.Table:
            return pa.table({"group": table["group"], "bucket": table["bucket"], "n": table["n"], "bits": pa.array(match(table), pa.binary())})
        return bucket

    def remove(table: pa.Table) -> pa.Table:
        chunks, (hits, lower) = _read_group(table, 2)
        _, _, least, start, which = _windows(chunks, hits, block, width)
        gone = start[lower[which] | (least[which] < chunks.order[chunks.doc[start]])]
        return _removed(chunks, gone, width)

    anchors = _dealt(groups, parts).applyInArrow(probe, _ENTRIES).groupBy("bucket").applyInArrow(answer(_match_anchors), _ANSWERS)
    hits = stored(anchors, "anchor-hits")
    windows = _dealt(_answered(groups, [hits]), parts).applyInArrow(extend, _ENTRIES)
    lower = stored(windows.groupBy("bucket").applyInArrow(answer(_match_windows), _ANSWERS), "window-hits")
    return _dealt(_answered(groups, [hits, lower]), parts).applyInArrow(
        remove, "doc_id long, n_words long, spans array<struct<first:long,end:long>>, n_removed long, kept_text string"
    )


def _removed(chunks: Chunks, gone: np.ndarray, width: int) -> pa.Table:
    """The documents without the words of the windows that start at `gone`."""
    cover = np.zeros(len(chunks.codes) + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + width, -1)
    out = np.cumsum(cover)[:-1] > 0
    edge = np.ones(len(out), bool)
    edge[1:] = (out[1:] != out[:-1]) | (chunks.doc[1:] != chunks.doc[:-1])
    first = np.flatnonzero(edge)
    end = np.append(first[1:], len(out))[out[first]]
    first = first[out[first]]
    doc = chunks.doc[first]
    base = chunks.starts[doc]
    bounds = np.searchsorted(doc, np.arange(len(chunks.counts) + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - base)], ["first", "end"]))
    kept = chunks.doc[~out]
    ends = np.searchsorted(kept, np.arange(len(chunks.counts) + 1))
    words = pa.ListArray.from_arrays(ends.astype(np.int32), chunks.names.take(pa.array(chunks.codes[~out])))
    return pa.table({
        "doc_id": chunks.doc_ids, "n_words": pa.array(chunks.counts), "spans": spans,
        "n_removed": pa.array(np.bincount(chunks.doc[out], minlength=len(chunks.counts)).astype(np.int64)),
        "kept_text": pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string()),
    })
