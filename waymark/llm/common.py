"""Helpers of the operators: word arrays of a batch, bounded slices, stored steps."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.files import remove_folder
from waymark.session import shared_folder

#: A word: a run of characters other than space and the controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_GAP = r"[\x20\x09-\x0D]+"

SLICE_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete a query's shuffle files when the query ends (ignored where unknown).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a batch that goes to Python.
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, rows: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write a step once as Parquet into the shared folder and read it from there.

    With the table written nobody reads the step's shuffle files again, so they go at once.
    `rows` bounds the batches that the step's Python functions take."""
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    wanted = {_CLEANUP: "true"} | ({_ROWS: str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        fresh = df.select("*")  # the settings are read when a plan is made
        fresh.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete stored steps that no later step reads."""
    for step in steps:
        remove_folder(step.stored_at)


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Cut Arrow batches into pieces of about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """The words of a batch of texts as numbers.

    `ids` holds one number per word in text order, `doc` its row, `starts` the first word of
    each row (rows + 1 entries), `names` the distinct words by number.
    """

    def __init__(self, texts: pa.Array, gap: str = _GAP):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        parts = pc.split_pattern_regex(texts, gap)
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        names, ids = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        empty = np.asarray(pc.equal(names, ""), dtype=bool) if len(names) else np.zeros(0, bool)
        keep = ~empty[ids] if len(ids) else np.zeros(0, bool)
        self.texts, self.names = texts, names
        self.ids, self.doc, self.rows = ids[keep], doc[keep], len(texts)
        self.counts = np.bincount(self.doc, minlength=self.rows)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def windows(self, width: int) -> np.ndarray:
        """First positions of the windows of `width` words that stay inside a row."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1:])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_names(names: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in names.to_pylist()), np.uint64, len(names))


def duplicated(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """True where the same combination of keys stands at another position too (exact)."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    if n < 2:
        return out
    order = np.lexsort(keys)
    same = np.ones(n - 1, bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps.

    It does so when the driver's objects behind them are collected; between large steps that
    is asked for here, so that a step's files do not lie beside the next one's."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
