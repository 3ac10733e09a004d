"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and a raw corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, duplicated, hash_names, mix, slices, stored

BUCKETS = 1 << 14
#: Mean log ratio per n-gram under which a text is rejected.
THRESHOLD = -0.08

_SYMBOLS = r"[#*$%&|<>]"


def _grams(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every single word and every pair of neighbouring words."""
    h = hash_names(words.names)[words.ids]
    first = words.windows(2)
    with np.errstate(over="ignore"):
        pair = mix(h[first] * np.uint64(3) + h[first + 1]) if len(first) else h[:0]
    keys = np.concatenate([mix(h), pair])
    return np.concatenate([words.doc, words.doc[first]]), (keys % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones.

    `trusted` has one `doc_id` per trusted document (repeats count once). Each task adds up
    its own buckets before the shuffle, so what moves is at most `buckets` rows per task.
    """
    flagged = docs.select("doc_id", "text").join(
        # both grow with the corpus: one plan, merged on doc_id, at every size
        trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("in_target", F.lit(True)).hint("merge"),
        "doc_id", "left",
    ).select("text", F.coalesce("in_target", F.lit(False)).alias("in_target"))

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            row, bucket = _grams(words, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            chosen = np.asarray(batch.column("in_target"), dtype=bool)
            target += np.bincount(bucket[chosen[row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"]
        )

    parts = flagged.mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, alpha: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw per bucket, both smoothed by `alpha`; at most `buckets` rows
    reach the driver. Without trusted documents all ratios are zero."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    logs = [np.log((x + alpha) / (x.sum() + alpha * buckets)) for x in (target, raw)]
    return logs[0] - logs[1]


def _repeat_words(words: Words) -> np.ndarray:
    """Per row, the words inside 3-word windows that the row holds twice or more."""
    first = words.windows(3)
    ids = words.ids
    again = first[duplicated((ids[first + 2], ids[first + 1], ids[first], words.doc[first]))]
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(words.doc[hit], minlength=words.rows)


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    lines = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lines.offsets, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = lines.flatten().dictionary_encode()
    ids = np.asarray(coded.indices, dtype=np.int64)
    worded = np.asarray(pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]"), dtype=bool)
    keep = worded[ids]
    doc, ids = doc[keep], ids[keep]
    distinct = np.unique(doc * np.int64(len(coded.dictionary)) + ids) // max(1, len(coded.dictionary))
    return np.bincount(doc, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def score_rules(
    docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD,
    min_words: int = 50, max_repeat: float = 0.5,
) -> DataFrame:
    """Base counts, mean log ratio and verdict of every document.

    A text without words (null, empty or blank) counts zero everywhere, has ratio 0 and fails
    the base rules. Repeated doc_ids give one row each. Extra columns of `docs` are ignored.
    """
    buckets = len(ratios)

    def score(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            n = words.counts
            lengths = np.asarray(pc.utf8_length(words.names), dtype=np.int64)
            chars = np.bincount(words.doc, weights=lengths[words.ids], minlength=words.rows).astype(np.int64)
            repeat = _repeat_words(words)
            row, bucket = _grams(words, buckets)
            total = np.bincount(row, weights=ratios[bucket], minlength=words.rows)
            mean = total / np.maximum(1, np.bincount(row, minlength=words.rows))
            failed = (n < min_words) | (repeat > max_repeat * n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n), pa.array(chars),
                    pc.count_substring_regex(words.texts, _SYMBOLS).cast(pa.int64()),
                    pa.array(_dup_lines(words.texts)), pa.array(repeat), pa.array(failed),
                    pa.array(mean), pa.array(~failed & (mean >= threshold)),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "llr", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, llr double, kept boolean",
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """Rules and likelihood ratio of every document of `docs` (doc_id, text).

    The trusted target corpus is every document that `labels` marks with quality 1; the raw
    corpus is all documents. Both are counted whole. An empty table gives an empty result.
    """
    counts = stored(ngram_counts(docs, labels.where("quality = 1"), buckets), "ngram-counts")
    return score_rules(docs, log_ratios(counts, buckets), threshold)
