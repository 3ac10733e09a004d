"""How far the sources of a language differ in their words: an Arrow pipeline of counts.

Inside the tasks a batch goes through Arrow's kernels alone: `ascii_lower`,
`split_pattern_regex`, `dictionary_encode` and a hash `group_by`, which leaves partial counts
per (language, source, term). Merged counts are dealt to columnar shards of terms, and each
shard adds its share of the divergence of every two sources.

Texts, languages and sources that are null count as ''. Rows are documents, repeated rows
included. An empty table gives no rows. Sources without terms and languages without kept terms
stay in the result of `divergences`. Texts are read whole; a batch is cut by bytes, so one very
long text is one piece. Columns other than lang, source and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import slices, stored

#: What separates terms: all of ASCII but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 30
PRIOR = 5
SCALE = 1_000_000_000
MOST_TERMS = 50
#: Terms of a shard and sources of a tile, on average and at most.
SHARD, TILE = 2048, 256
#: Partial counts that a task gathers before it hands them on.
GATHERED = 400_000


def count_batch(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch; every (lang, source) has a row without term."""
    group = pa.table({k: pc.fill_null(batch.column(k), "") for k in ("lang", "source")})
    coded = [c.dictionary_encode() for c in group.itercolumns()]
    lang, source = (c.combine_chunks() for c in coded)
    width = max(1, len(source.dictionary))
    pair = np.asarray(lang.indices, np.int64) * width + np.asarray(source.indices, np.int64)

    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), GAP)
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets, np.int64)))
    words = parts.flatten().dictionary_encode()
    table = pa.table({"row": row, "term": words.indices})
    table = table.filter(pc.not_equal(pc.take(pc.binary_length(words.dictionary), words.indices), 0))
    per_doc = table.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    per_doc = per_doc.append_column("pair", pa.array(pair[np.asarray(per_doc["row"])]))
    found = per_doc.group_by(["pair", "term"], use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    at = np.asarray(found["pair"])
    kept = pa.table({
        "lang": lang.dictionary.take(pa.array(at // width)), "source": source.dictionary.take(pa.array(at % width)),
        "term": words.dictionary.take(found["term"].combine_chunks()).cast(pa.string()),
        "n": found["count_all_sum"], "docs": found["count_all"],
    })
    seen = np.unique(pair)
    none = np.zeros(len(seen), np.int64)
    groups = pa.table({
        "lang": lang.dictionary.take(pa.array(seen // width)), "source": source.dictionary.take(pa.array(seen % width)),
        "term": pa.nulls(len(seen), pa.string()), "n": none, "docs": none,
    })
    return pa.concat_tables([groups, kept.cast(groups.schema)])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term per source, and a
    row without term for every source."""
    def count(batches):
        held, size = [], 0

        def merged():
            table = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False)
            table = table.aggregate([("n", "sum"), ("docs", "sum")])
            return table.rename_columns(["lang", "source", "term", "n", "docs"])

        for batch in slices(batches, "text"):
            held.append(count_batch(batch))
            size += held[-1].num_rows
            if size > GATHERED:
                yield from merged().to_batches(64_000)
                held, size = [], 0
        if held:
            yield from merged().to_batches(64_000)

    keys = ("lang", "source", "term")
    partial = docs.select("lang", "source", "text").mapInArrow(
        count, "lang string, source string, term string, n long, docs long"
    )
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    A language keeps the terms in at least `least` of its documents. With V kept terms and N
    occurrences of them, a term with count c has the share 1 + floor(SCALE (c + PRIOR) /
    (N + PRIOR V)), exact whole numbers. Part `pair` has the sum of the shares' absolute
    differences to every other source of the language, the farthest first; part `term` the
    terms whose share is above the language's, the largest excess first, `most_terms` of them.
    Ties go by the item's bytes."""
    merged = stored(term_counts(docs), "term-counts")
    kept = merged.where("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("df"), F.sum("n").alias("all_n")
    ).where(F.col("df") >= least).drop("df")
    counts = stored(merged.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")

    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    terms = counts.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    groups = (
        merged.where("term is null").select("lang", "source").join(total, ["lang", "source"], "left")
        .join(terms, "lang", "left").fillna(0, ["group_n", "v", "lang_n"])
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = F.count("*").over(Window.partitionBy("lang"))
    groups = groups.withColumn("place", place).withColumn("tiles", F.ceil(sources / TILE).cast("int"))
    groups = stored(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD)).cast("int")), "term-groups")

    share = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "place", "tiles", "shards",
        _share("n", "group_n").alias("p"), _share("all_n", "lang_n").alias("q"),
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    excess = share.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    value = _pair_sums(share, groups).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "place", "source")
    far = (
        value.join(names.withColumnsRenamed({"place": "a"}), ["lang", "a"])
        .join(names.withColumnsRenamed({"place": "b", "source": "item"}), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(best))
    )
    return far.unionByName(excess)


def _share(count: str, total: str):
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR V)), past 64 bits where need be."""
    return F.expr(f"1 + (cast({SCALE} as decimal(12,0)) * cast({count} + {PRIOR} as decimal(20,0))) div ({total} + {PRIOR} * v)")


def _pair_sums(share: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two different sources of a language, by place: parts of
    their summed differences, one per shard of terms.

    A shard is a matrix of terms by sources. Sources without the term take the share of a
    count of 0, so every shard has a row without term for each source. More than `TILE`
    sources meet tile by tile."""
    zero = F.expr(f"1 + ({SCALE} * {PRIOR}L) div (group_n + {PRIOR} * greatest(v, 1))")
    base = groups.select(
        "lang", "place", "tiles", F.lit(None).cast("string").alias("term"), F.when(F.col("v") > 0, zero).otherwise(0).alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    )
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    rows = base.unionByName(share.select("lang", "place", "tiles", "term", "p", shard.alias("shard")))
    mine = F.floor(F.col("place") / TILE).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "shard", "place", "term", "p", F.least(mine, "other").alias("lo"), F.greatest(mine, "other").alias("hi"))

    def differ(table: pa.Table) -> pa.Table:
        place, p = np.asarray(table["place"]), np.asarray(table["p"])
        term = table["term"].combine_chunks().dictionary_encode()
        known = np.asarray(pc.is_valid(table["term"]))
        names, at = np.unique(place, return_inverse=True)
        shared = np.zeros((len(term.dictionary), len(names)), np.int64)
        none = np.zeros(len(names), np.int64)
        none[at[~known]] = p[~known]
        shared[:] = none
        shared[np.asarray(pc.fill_null(term.indices, 0))[known], at[known]] = p[known]
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        out = []
        for k, one in enumerate(names.tolist()):
            if one // TILE not in (lo, hi):
                continue
            far = np.abs(shared - shared[:, k:k + 1]).sum(0)
            other = (names != one) & ((names // TILE == hi) if one // TILE == lo else (names // TILE == lo))
            out.append((np.full(int(other.sum()), one), names[other], far[other]))
        a, b, value = (np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"lang": pa.repeat(table["lang"][0], len(a)), "a": a, "b": b, "value": value})

    return rows.groupBy("lang", "shard", "lo", "hi").applyInArrow(differ, "lang string, a long, b long, value long")
