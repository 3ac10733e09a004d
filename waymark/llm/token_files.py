"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Layout (little-endian):

    magic "PFOR1", u32 documents, u32 blocks, u64 ids
    document index: u64 first id (within the file) per document
    block index:    u64 byte offset of each block (within the body)
    body:           blocks of up to 128 ids each

A block is: u16 ids, u32 minimum, u8 width, u16 exceptions, packed low bits of (id - minimum),
then the exception positions (u16 each) and their high parts (u32 each). The width is the
number of bits that `PERCENTILE` percent of the block's ids need; the ids that need more are
the exceptions, whose low bits stay in the packed part.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import scratch, slices, stored
from waymark.llm.files import make_folder, read_file, write_file

BLOCK = 128
PERCENTILE = 90
#: Ids per file at most, unless one document alone has more.
FILE_IDS = 4 << 20
#: Distinct text pieces whose ids a worker remembers, in each of two generations.
CACHE = 600_000

_MAGIC = b"PFOR1"
_HEAD, _HEAD_SIZE = "<5sIIQ", struct.calcsize("<5sIIQ")
_BLOCK_SIZE = struct.calcsize("<HIBH")
#: Blocks that are packed in one go.
_CHUNK = 8192


# ---------------------------------------------------------------- blocks

_HEADS = np.dtype([("n", "<u2"), ("low", "<u4"), ("width", "u1"), ("odd", "<u2")])


def _bit_words(w: int):
    """For each of a block's values of w bits: its word of 64 bits, its place there, and the
    bits that fit (the others begin the next word)."""
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        yield i, word, np.uint64(shift), min(w, 64 - shift)


def _exceptions(start: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the exceptions of blocks with `odd` ones from byte `start` on: block, byte of the
    position, byte of the high part."""
    block = np.repeat(np.arange(len(odd)), odd)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
    return block, start[block] + 2 * rank, start[block] + 2 * odd[block] + 4 * rank


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The encoded blocks of an id array and the byte offset of each block."""
    step = _CHUNK * BLOCK
    if len(ids) > step:
        parts = [pack_blocks(ids[i:i + step], percentile) for i in range(0, len(ids), step)]
        shift = np.concatenate([[0], np.cumsum([len(b) for b, _ in parts])[:-1]]).astype(np.uint64)
        return b"".join(b for b, _ in parts), np.concatenate([o + s for (_, o), s in zip(parts, shift)])
    n = len(ids)
    count = -(-n // BLOCK)
    if not count:
        return b"", np.zeros(0, np.uint64)
    padded = np.zeros(count * BLOCK, np.int64)
    padded[:n] = ids
    padded[n:] = ids[-1]
    grid = padded.reshape(count, BLOCK)
    low = grid.min(1)
    rest = (grid - low[:, None]).astype(np.uint64)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bit length
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, at, axis=1)[:, at]
    odd = bits > width[:, None]
    heads = np.zeros(count, _HEADS)
    heads["n"] = BLOCK
    heads["n"][-1] = n - (count - 1) * BLOCK
    odd[-1, heads["n"][-1]:] = False
    heads["low"], heads["width"], heads["odd"] = low, width, odd.sum(1)

    packed = BLOCK // 8 * width.astype(np.int64)
    sizes = _BLOCK_SIZE + packed + 6 * heads["odd"].astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[offsets[:, None] + np.arange(_BLOCK_SIZE)] = heads.view(np.uint8).reshape(count, _BLOCK_SIZE)
    for w in np.unique(width[width > 0]).tolist():  # blocks of one width are packed together
        rows = np.flatnonzero(width == w)
        values = np.ascontiguousarray(rest[rows].T) & np.uint64((1 << w) - 1)
        words = np.zeros((2 * w, len(rows)), np.uint64)
        for i, word, shift, fits in _bit_words(w):
            words[word] |= values[i] << shift
            if fits < w:
                words[word + 1] |= values[i] >> np.uint64(fits)
        body = np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8)
        out[(offsets[rows] + _BLOCK_SIZE)[:, None] + np.arange(16 * w)] = body
    row, place = np.nonzero(odd)
    _, at_place, at_high = _exceptions(offsets + _BLOCK_SIZE + packed, heads["odd"].astype(np.int64))
    out[at_place[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    high = (rest[row, place] >> width[row].astype(np.uint64)).astype("<u4")
    out[at_high[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes(), offsets.astype(np.uint64)


def unpack_blocks(body: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the blocks at `offsets`, one after the other, and each block's number of ids.
    Blocks of one width are unpacked together."""
    data = np.frombuffer(body, np.uint8)
    heads = data[offsets[:, None] + np.arange(_BLOCK_SIZE)].reshape(-1).view(_HEADS)
    width = heads["width"].astype(np.int64)
    values = np.zeros((len(offsets), BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = data[(offsets[rows] + _BLOCK_SIZE)[:, None] + np.arange(16 * w)]
        words = np.ascontiguousarray(packed.view("<u8").T)
        mask, got = np.uint64((1 << w) - 1), np.empty((BLOCK, len(rows)), np.uint64)
        for i, word, shift, fits in _bit_words(w):
            got[i] = words[word] >> shift
            if fits < w:
                got[i] |= words[word + 1] << np.uint64(fits)
        values[rows] = (got & mask).T
    odd = heads["odd"].astype(np.int64)
    row, at_place, at_high = _exceptions(offsets + _BLOCK_SIZE + 16 * width, odd)
    place = data[at_place[:, None] + np.arange(2)].view("<u2")[:, 0]
    high = data[at_high[:, None] + np.arange(4)].view("<u4")[:, 0]
    values[row, place] |= high.astype(np.int64) << width[row]
    values += heads["low"].astype(np.int64)[:, None]
    sizes = heads["n"].astype(np.int64)
    return values[np.arange(BLOCK) < sizes[:, None]], sizes


def write_bytes(ids: np.ndarray, starts: np.ndarray) -> bytes:
    body, offsets = pack_blocks(ids)
    head = struct.pack(_HEAD, _MAGIC, len(starts), len(offsets), len(ids))
    return head + starts.astype("<u8").tobytes() + offsets.astype("<u8").tobytes() + body


class TokenFile:
    """Random access to a file's documents: only the blocks that hold them are decoded."""

    def __init__(self, data: bytes):
        magic, docs, blocks, self.n = struct.unpack_from(_HEAD, data, 0)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEAD_SIZE
        self.starts = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 8 * docs).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (docs + blocks):]

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.int64)
        first, last = start // BLOCK, (end - 1) // BLOCK
        got = unpack_blocks(self.body, self.offsets[first:last + 1])[0]
        return got[start - first * BLOCK:end - first * BLOCK]

    def end(self, k: int) -> int:
        return int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), self.end(k))


# ---------------------------------------------------------------- tokenizer

#: White space of Unicode, as the pre-tokenizer's pattern sees it (fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces that the pre-tokenizer never joins or parts otherwise: a run of other characters
#: with one space before it, or white space as the pattern splits it.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
_STEM = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-&(-/:-@\\[-`{-~]+)")
#: Characters that the byte-level vocabulary writes bytes with: printable Latin-1 ones stand
#: for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Pieces(dict):
    """Ids by piece, looked up in the tokenizers library at the first use. `old` holds the
    pieces of the generation before, which move over when they are met again."""

    def __init__(self, tokenizer, old: dict):
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._tokenize(piece)
        self[piece] = ids
        return ids

    def _tokenize(self, piece: str) -> bytes:
        if _LETTERS.fullmatch(piece):  # one word to the pre-tokenizer: straight to the merges
            word = piece.encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.model.tokenize(word)]
        elif cut := _STEM.fullmatch(piece):
            # a run of ASCII punctuation after letters is a token sequence of its own
            return self[cut[1]] + self[cut[2]]
        else:
            return self.tokenize_whole(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def tokenize_whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Ids of texts, piece by piece: the tokenizers library sees each distinct piece once.

    What it has seen is kept in the worker process across tasks, in two generations of about
    `CACHE` pieces: pieces in use stay, others go.

    With `split_special` the texts of special tokens are cut like any other text. Without it
    the library's default holds: an added token's text is that token wherever it stands, so
    texts that hold one go to the library whole."""

    def __init__(self, path: str, split_special: bool = True):
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault("_waymark_pieces", types.ModuleType("_waymark_pieces"))
        if getattr(kept, "path", None) != (path, split_special):
            tokenizer = Tokenizer.from_file(path)
            if split_special:
                tokenizer.encode_special_tokens = True
            added = tokenizer.get_added_tokens_decoder().values()
            whole = [re.escape(t.content) for t in added if not (split_special and t.special)]
            kept.whole = re.compile("|".join(whole)) if whole else None
            kept.cache = _Pieces(tokenizer, {})
            kept.path = (path, split_special)
        self.kept = kept

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        cache = self.kept.cache
        if len(cache) > CACHE:
            cache.old = {}
            cache = self.kept.cache = _Pieces(cache.tokenizer, dict(cache))
        get = cache.__getitem__
        if self.kept.whole is None:
            return [b"".join(map(get, _PIECE.findall(t))) for t in texts]
        held = self.kept.whole.search
        return [cache.tokenize_whole(t) if held(t) else b"".join(map(get, _PIECE.findall(t))) for t in texts]


# ---------------------------------------------------------------- jobs

def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, split_special: bool = True
) -> DataFrame:
    """Encode the documents in ascending doc_id order into token files below `folder`.

    Documents are range-partitioned by doc_id, so no task holds more than its range; a task
    starts a new file at `FILE_IDS` ids. Null texts count as empty and hold the end id alone;
    a null doc_id comes first; rows with the same doc_id stand in text order. Returns the
    manifest, one row per file: (part, piece, file, n_docs, n_ids, doc_ids).
    """
    make_folder(folder)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        encoder = PieceEncoder(tokenizer_path, split_special)
        held, sizes, names, total = [], [], [], 0

        def flush():
            nonlocal held, sizes, names, total, piece
            ids = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            file = f"{folder}/part-{part:06d}-{piece:04d}.pfor"
            write_file(file, write_bytes(ids, starts))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([piece]), pa.array([file]), pa.array([len(sizes)]),
                 pa.array([total]), pa.array([names], pa.list_(pa.int64()))],
                ["part", "piece", "file", "n_docs", "n_ids", "doc_ids"],
            )
            held, sizes, names, total, piece = [], [], [], 0, piece + 1
            return row

        for batch in slices(batches, "text", 1 << 20):
            encoded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoded):
                n = len(data) // 4 + 1
                if held and total + n > FILE_IDS:
                    yield flush()
                held += [data, end]
                sizes.append(n)
                names.append(doc_id)
                total += n
        if held:
            yield flush()

    manifest = ordered.mapInArrow(
        write, "part long, piece long, file string, n_docs long, n_ids long, doc_ids array<long>"
    )
    return stored(manifest, "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), ids (the
    little-endian unsigned 32-bit ids with the end id), n_tokens.

    Offsets of the files are running sums over one manifest row per file."""
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    first = manifest.select("part", "piece", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first"))
    files = manifest.join(first, ["part", "piece"]).select("file", "first", "doc_ids")

    def read(batches):
        for batch in batches:
            for file, first, names in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = TokenFile(read_file(file))
                for at in range(0, len(names), 500):
                    some = range(at, min(at + 500, len(names)))
                    low, high = int(tokens.starts[some.start]), tokens.end(some.stop - 1)
                    block = tokens.ids(low, high).astype("<u4")
                    ids = [block[tokens.starts[k] - low:tokens.end(k) - low] for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k] for k in some], pa.int64()),
                         pa.array(tokens.starts[some.start:some.stop] + first),
                         pa.array([x.tobytes() for x in ids], pa.binary()),
                         pa.array([len(x) for x in ids], pa.int64())],
                        ["doc_id", "start", "ids", "n_tokens"],
                    )

    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "file")
    return spread.mapInArrow(read, "doc_id long, start long, ids binary, n_tokens long")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0, split_special: bool = True) -> DataFrame:
    """Write token files, read them back and describe every document by its ids' crc32.

    For the ids of the library's plain call, `split_special` is False, as in the query."""
    folder = scratch(docs.sparkSession, "tokens")
    tokens = read_tokens(write_tokens(docs, tokenizer_path, end_id, folder, split_special))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
