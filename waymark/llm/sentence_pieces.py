"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length advance together, one character at a time. Hashes of the substrings that
end there probe the sorted piece keys; of the arcs found the best one per word is kept as a
backpointer, and the pieces are read back from the words' ends.

For a unigram model an arc's value is the best sum of scores. For a BPE model sums of scores
do not give the library's result. There the encoding of every prefix of a word is unique, and
a sequence of pieces is an encoding if and only if every two neighbours are one by themselves;
so an arc is worth 1 if its piece may follow the piece that ends the best path so far, else 0,
and exactly one arc per position is worth 1. The search, its arrays and its backpointers are
the same, and the ids are the library's.
"""

from __future__ import annotations

import re
import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from waymark.llm.common import mix, slices

SPACE = "▁"
#: Distinct words whose ids a worker remembers.
CACHE = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words: a run of spaces with what follows it. No piece reaches across their borders, nor
#: across a line end, which is no piece.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_RUN = SPACE * 2
_PRESENT_BITS = 20


@dataclass
class Model:
    """Arrays of a piece model. `rank` numbers of pieces: single characters first, then the
    others by falling score, the order in which pairs merge."""

    kind: str
    ids: np.ndarray         # piece id by rank
    score: np.ndarray       # by rank
    keys: np.ndarray        # sorted hashes of the pieces
    key_rank: np.ndarray    # rank by place in keys
    present: np.ndarray     # whether a hash prefix occurs at all
    left: np.ndarray        # the two pieces that merge into a piece, itself for characters
    right: np.ndarray
    pairs: np.ndarray       # sorted left * 2^32 + right of all pairs that merge
    pair_rank: np.ndarray
    longest: int
    bytes_: np.ndarray      # piece id by byte
    texts: list             # bytes by piece id
    chars: dict             # rank by text, for words with runs of spaces


def _hash_text(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def load(path: str, kind: str = "bpe") -> Model:
    """Read a model file; done once, on the driver. `kind` is the model's type."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    texts, plain, bytes_ = [b""] * n, {}, np.zeros(256, np.int64)
    for i in range(n):
        text = p.id_to_piece(i)
        if p.is_byte(i):
            value = int(text[3:5], 16)
            bytes_[value], texts[i] = i, bytes([value])
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            plain[text] = i
            texts[i] = text.replace(SPACE, " ").encode()
    order = sorted(plain, key=lambda t: (len(t) > 1, -p.get_score(plain[t]) if len(t) > 1 else 0, plain[t]))
    rank = {t: k for k, t in enumerate(order)}
    left, right = np.arange(len(order)), np.arange(len(order))
    pairs = {}
    for t in order:
        for cut in range(1, len(t)):
            a, b = rank.get(t[:cut]), rank.get(t[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank[t]
    if kind == "bpe":
        for t in order:
            if len(t) > 1 and _RUN not in t:
                parts = merge([rank.get(c, -1) for c in t], pairs, stop=rank[t])
                if len(parts) == 2:
                    left[rank[t]], right[rank[t]] = parts
    hashes = np.array([_hash_text(t) for t in order], np.uint64)
    place = np.argsort(hashes)
    present = np.zeros(1 << _PRESENT_BITS, bool)
    present[(hashes >> np.uint64(64 - _PRESENT_BITS)).astype(np.int64)] = True
    sorted_pairs = np.array(sorted(pairs), np.int64)
    return Model(
        kind, np.array([plain[t] for t in order]), np.array([p.get_score(plain[t]) for t in order]),
        hashes[place], place, present, left, right, sorted_pairs, np.array([pairs[k] for k in sorted_pairs.tolist()]),
        max(map(len, order)), bytes_, texts, rank,
    )


def merge(parts: list[int], pairs: dict, stop: int = -1) -> list[int]:
    """Merge the best pair, leftmost first, until none is left or `stop` would be made."""
    while len(parts) > 1:
        best = min((pairs.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a >= 0 and b >= 0) if any(
            x >= 0 for x in parts) and len(parts) > 1 and any(a >= 0 and b >= 0 for a, b in zip(parts, parts[1:])) else (1 << 40, 0)
        if best[0] == 1 << 40 or best[0] == stop:
            break
        parts[best[1]:best[1] + 2] = [best[0]]
    return parts


def _lookup(model: Model, h: np.ndarray) -> np.ndarray:
    """Rank of the piece with each hash, -1 where there is none."""
    out = np.full(len(h), -1, np.int64)
    some = np.flatnonzero(model.present[(h >> np.uint64(64 - _PRESENT_BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(model.keys, h[some]), len(model.keys) - 1)
    hit = model.keys[at] == h[some]
    out[some[hit]] = model.key_rank[at[hit]]
    return out


def follows(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the encoding of the text of pieces a and b is just a and b.

    The two are taken apart, latest merge first; at each stage the pieces that touch must not
    have been a pair that merges earlier than the merges still to undo."""
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(live):
        key = a << 32 | b
        at = np.minimum(np.searchsorted(model.pairs, key), len(model.pairs) - 1)
        made = np.where(model.pairs[at] == key, model.pair_rank[at], np.iinfo(np.int64).max)
        bad = made < limit
        ok[live[bad]] = False
        from_left = a > b
        new_a, new_b = np.where(from_left, model.right[a], a), np.where(from_left, b, model.left[b])
        new_limit = np.where(from_left, a, b + 1)
        stuck = np.where(from_left, new_a == a, new_b == b)
        # the later one is a single character: take the other one apart
        other_a, other_b = np.where(from_left, a, model.right[a]), np.where(from_left, model.left[b], b)
        done = stuck & np.where(from_left, other_b == b, other_a == a)
        new_limit = np.where(stuck, np.where(from_left, b + 1, a), new_limit)
        new_a, new_b = np.where(stuck, other_a, new_a), np.where(stuck, other_b, new_b)
        keep = ~bad & ~done
        live, a, b, limit = live[keep], new_a[keep], new_b[keep], new_limit[keep]
    return ok


class Known:
    """Answers of `follows` by pair, in a table of fixed size that newer pairs overwrite."""

    SIZE = 1 << 20

    def __init__(self, model: Model):
        self.model = model
        self.key, self.value = np.full(self.SIZE, -1, np.int64), np.zeros(self.SIZE, bool)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = (mix(key) & np.uint64(self.SIZE - 1)).astype(np.int64)
        out = self.value[at]
        new = np.flatnonzero(self.key[at] != key)
        if len(new):
            distinct, place = np.unique(key[new], return_inverse=True)
            got = follows(self.model, distinct >> 32, distinct & 0xFFFFFFFF)
            out[new] = got[place]
            slot = at[new]
            self.key[slot], self.value[slot] = key[new], out[new]
            odd = self.key[slot] != key[new]  # two new pairs in one slot: the later one stays
            if odd.any():
                again = slot[odd]
                self.key[again] = -1
        return out


def encode_equal(model: Model, codes: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words of one length, given as code points (words, length).

    Returns flat ranks, words in order, and the number of pieces per word. A character that
    is no piece is -1 - code point."""
    n, length = codes.shape
    prefix = np.zeros((n, length + 1), np.uint64)
    powers = np.ones(model.longest + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
        for i in range(model.longest):
            powers[i + 1] = powers[i] * _BASE
    last = np.full((n, length + 1), -1, np.int64)   # piece of the best arc into a position
    back = np.zeros((n, length + 1), np.int32)      # its length
    total = np.full((n, length + 1), -np.inf)
    total[:, 0] = 0.0
    bpe = model.kind == "bpe"
    for i in range(1, length + 1):
        rest = np.arange(n)  # words whose best arc is open: all, or those without a 1 so far
        for size in range(min(model.longest, i), 0, -1):
            if bpe:
                rest = rest[back[rest, i] == 0]
                if not len(rest):
                    break
            with np.errstate(over="ignore"):
                piece = _lookup(model, prefix[rest, i] - prefix[rest, i - size] * powers[size])
            if size == 1:
                rows = rest
                piece = np.where(piece < 0, -1 - codes[rows, i - 1].astype(np.int64), piece)
            else:
                hit = piece >= 0
                rows, piece = rest[hit], piece[hit]
                if not len(rows):
                    continue
            if bpe:
                before = last[rows, i - size]
                value = np.ones(len(rows))
                touch = np.flatnonzero((before >= 0) & (piece >= 0)) if i > size else np.zeros(0, int)
                value[touch] = known.follows(before[touch], piece[touch])
                value[value == 0] = -np.inf
            else:
                unknown = model.score.min() - 10.0
                value = total[rows, i - size] + np.where(piece >= 0, model.score[np.maximum(piece, 0)], unknown)
            better = value > total[rows, i]
            rows, piece, value = rows[better], piece[better], value[better]
            total[rows, i], last[rows, i], back[rows, i] = value, piece, size
    at = np.full(n, length)
    columns, rows_of = [], []
    open_ = np.arange(n)
    while len(open_):
        columns.append(last[open_, at[open_]])
        rows_of.append(open_)
        at[open_] -= back[open_, at[open_]]
        open_ = open_[at[open_] > 0]
    step = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    row, piece = np.concatenate(rows_of), np.concatenate(columns)
    order = np.lexsort((-step, row))
    return piece[order], np.bincount(row, minlength=n)


def encode_words(model: Model, words: list[str], known: Known) -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.array([len(w) for w in words])
    table = model.ids.astype("<i4")
    merged = None
    for length in np.unique(lengths):
        group = np.flatnonzero(lengths == length)
        step = max(1, 400_000 // int(length))
        for lo in range(0, len(group), step):
            some = group[lo:lo + step]
            text = "".join(words[i] for i in some)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), length)
            pieces, counts = encode_equal(model, codes, known)
            ids = table[np.maximum(pieces, 0)]
            ends = np.cumsum(counts)
            strange = np.add.reduceat(pieces < 0, ends - counts) > 0
            blob = ids.tobytes()
            for k, (i, end, count) in enumerate(zip(some, ends.tolist(), counts.tolist())):
                if model.kind == "bpe" and _RUN in words[i]:
                    # equal scores of runs of spaces tie by place: merged as the rule says
                    merged = merged or dict(zip(model.pairs.tolist(), model.pair_rank.tolist()))
                    part = np.array(merge_runs(model, words[i], merged))
                elif strange[k]:
                    part = pieces[end - count:end]
                else:
                    out[i] = blob[4 * (end - count):4 * end]
                    continue
                out[i] = b"".join(
                    table[x].tobytes() if x >= 0 else model.bytes_[list(chr(-1 - x).encode("utf-8", "replace"))].astype("<i4").tobytes()
                    for x in part.tolist()
                )
    return out


def merge_runs(model: Model, word: str, pairs: dict) -> list[int]:
    """BPE of a word that begins with spaces: scores first, then the leftmost place. The run
    is merged by itself, but for its last space, which the word after it takes if it can."""
    rank, parts = model.chars, [model.chars.get(c, -1 - ord(c)) for c in word]
    score = model.score
    while len(parts) > 1:
        best = None
        for i, (a, b) in enumerate(zip(parts, parts[1:])):
            made = pairs.get(a << 32 | b) if a >= 0 and b >= 0 else None
            if made is not None and (best is None or score[made] > best[0]):
                best = (score[made], i, made)
        if best is None:
            break
        parts[best[1]:best[1] + 2] = [best[2]]
    return parts


class Encoder:
    """Texts to ids and back. Ids of distinct words are kept in the worker process."""

    def __init__(self, model: Model):
        self.model = model
        kept = sys.modules.setdefault("_waymark_words", types.ModuleType("_waymark_words"))
        mark = (model.kind, len(model.ids), int(model.keys[len(model.keys) // 2]))
        if getattr(kept, "mark", None) != mark:
            kept.mark, kept.cache, kept.known = mark, {}, Known(model)
        self.cache, self.known = kept.cache, kept.known

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {w for s in split for w in s}
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [w for w in new if w not in self.cache]
        self.cache.update(zip(new, encode_words(self.model, new, self.known)))
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.model.texts.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` with `tokens`, the ids of its whole text. Null and empty texts have
    no ids. Extra columns pass through; a column of the name tokens is replaced."""
    docs = docs.drop("tokens")
    schema = StructType([*docs.schema.fields, StructField("tokens", ArrayType(IntegerType()))])

    def run(batches):
        encoder = Encoder(model)
        for batch in slices(batches, "text", 8 << 20):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "tokens"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: Model, column: str = "decoded") -> DataFrame:
    """Every row of `tokens` with the text of its ids; null ids give an empty text."""
    schema = StructType([*tokens.schema.fields, StructField(column, tokens.sparkSession.createDataFrame([], "x string").schema["x"].dataType)])

    def run(batches):
        encoder = Encoder(model)
        for batch in batches:
            texts = []
            for ids in batch.column("tokens"):
                values = ids.values
                texts.append(encoder.decode(b"" if values is None else np.asarray(values).astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the little-endian 32-bit ids) and same: whether decoding
    gives the text again (null counts as empty). Ids are decoded where they are made."""
    def run(batches):
        import zlib

        encoder = Encoder(model)
        for batch in slices(batches, "text", 8 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                 pa.array([encoder.decode(x) == t for x, t in zip(ids, texts)])],
                ["doc_id", "n_tokens", "ids_crc32", "same"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, same boolean"
    )
