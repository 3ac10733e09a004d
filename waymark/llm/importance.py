"""Importance resampling towards a target text collection, by an Aho-Corasick dictionary.

The distinct words of a piece of text become the patterns of an automaton, each with a
delimiter on both sides, so that a word inside a longer one is no match. A word's payload is
its CRC-32 and its length in bytes. One scan of the piece emits the payloads in text order;
the CRC of a run of words is composed from the payloads of neighbours, without touching the
text again, and gives the run's bucket. Buckets are counted over all documents and over the
target, and every document is scored by its buckets' gains.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered. A null or
empty text has no words, weight 0 and a score, but is never drawn. Whole texts are read: a
batch is cut by bytes, a single longer text is one piece. Each row is a document of its own;
rows that share a doc_id share the draw's random part, and a null doc_id counts as the text
''. With equal scores the smaller doc_id goes first (null first). An empty target has T = 0.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import slices, stored

BUCKETS = 10_000
LONGEST = 1
SEED = "2024"
LEAST_WORDS, PERCENT = 20, 10

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Stands before every text of a scan; in the texts themselves it is a delimiter and gone.
_NEXT = "\x01"
#: Bytes of text with a dictionary of their own: a small automaton stays in the cache.
PIECE = 1 << 20


# ---------------------------------------------------------------- crc of joined strings

def _crc_steps() -> np.ndarray:
    """(32, 32): what one bit of a CRC becomes after 2^k further bytes of zeros."""
    column = [0xEDB88320] + [1 << (i - 1) for i in range(1, 32)]  # one zero bit (fixed polynomial)

    def twice(m):
        def through(x):
            out = 0
            for i in range(32):
                if x >> i & 1:
                    out ^= m[i]
            return out
        return [through(x) for x in m]

    for _ in range(3):
        column = twice(column)
    steps = []
    for _ in range(32):
        steps.append(column)
        column = twice(column)
    return np.array(steps, np.uint32)


_STEPS = _crc_steps()


def crc_join(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from the CRC-32 of a, that of b and the bytes of b."""
    out, size = left.astype(np.uint32), size.astype(np.int64)
    for k in range(32):
        on = np.flatnonzero(size >> k & 1)
        if not len(on):
            if not (size >> k).any():
                break
            continue
        x, y = out[on], np.zeros(len(on), np.uint32)
        for i in range(32):
            y ^= np.where(x >> np.uint32(i) & np.uint32(1), _STEPS[k, i], np.uint32(0))
        out[on] = y
    return out ^ right.astype(np.uint32)


# ---------------------------------------------------------------- dictionary and scan

def dictionary(words):
    """A trie of the words, each between delimiters, with CRC and length as payload."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for word in words:
        data = word.encode()
        found.add_word(f" {word} ", len(data) << 32 | zlib.crc32(data))
    return found


def scan(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, CRC and bytes of every word of the texts, in text order."""
    plain = ((t or "").encode().translate(_LOWER).decode() for t in texts)
    whole = f" {_NEXT} " + f" {_NEXT} ".join(plain) + " "
    words = set(whole.split(" "))
    words -= {"", _NEXT}
    automaton = dictionary(words)
    automaton.add_word(f" {_NEXT} ", -1)
    automaton.make_automaton()
    payload = np.fromiter(map(itemgetter(1), automaton.iter(whole)), np.int64)
    word = payload >= 0
    row = np.cumsum(~word)[word] - 1
    return row, payload[word] & 0xFFFFFFFF, payload[word] >> 32


def features(texts: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to `longest` words, and the words of each row."""
    row, crc, size = scan(texts)
    rows, found = [row], [crc % buckets]
    run, blank = crc.astype(np.uint32), np.uint32(zlib.crc32(b" "))
    spaced = crc_join(np.full(len(crc), blank), crc, size) if longest > 1 else crc
    for n in range(2, longest + 1):
        if len(row) < n:
            break
        run = crc_join(run[:-1], spaced[n - 1:], size[n - 1:] + 1)
        inside = row[:len(run)] == row[n - 1:]
        rows.append(row[:len(run)][inside])
        found.append(run[inside].astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(texts))


# ---------------------------------------------------------------- jobs

def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of `text`. Tasks hand on one row per bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", PIECE):
            total += np.bincount(features(batch.column("text").to_pylist(), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.collect():  # one row per bucket, however large the table is
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in all documents)."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    pairs = zip(raw.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in pairs], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain) and score (weight and the random
    part) of every document."""
    def weigh(batches):
        for batch in slices(batches, "text", PIECE):
            row, bucket, n_words = features(batch.column("text").to_pylist(), longest, len(gains))
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, gains[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    weights = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long"
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weights.withColumn("score", F.col("weight") + noise)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its rank if it is drawn.

    Of the documents with `least_words` words the highest `percent` in a hundred scores are
    drawn. Scores are whole numbers with a few ten thousand different values (logarithms of
    64-bit counts and of 32-bit draws), so a table of documents per score says how many stand
    above each one; rows are sorted within a score only."""
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = stored(scored(docs, gains, longest, seed), "resampling-scores")
    able = rows.where(F.col("n_words") >= least_words)
    per_score = able.groupBy("score").count()
    above = F.sum("count").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    draws = F.floor(F.sum("count").over(Window.partitionBy()) * percent / F.lit(100)).cast("long")
    places = per_score.select("score", F.coalesce(above, F.lit(0)).alias("_above"), draws.alias("_draws"))
    places = stored(places.where("_above < _draws"), "resampling-places")

    joined = rows.join(places, "score", "left")
    able = F.col("_above").isNotNull() & (F.col("n_words") >= least_words)
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id")))
    high = joined.where(able).withColumn("rank", (F.col("_above") + inside).cast("long"))
    high = high.withColumn("rank", F.when(F.col("rank") <= F.col("_draws"), F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = joined.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return high.select(out).unionByName(rest.select(out))
