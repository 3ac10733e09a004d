"""License scans: phrases, and diagonal voting of word k-grams against licence notices."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Words, hash_names, mix, slices, stored

K = 4
#: Diagonals this near, whose hits are this near in the text, are one span.
DIAGONAL_GAP, WORD_GAP = 4, 24
#: Share of a notice's words that a span must hold, in order.
COVERAGE = 0.6

# Phrases with their labels, and public licence notices by label.
PHRASES = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required "
     "by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or at your option "
     "any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
)

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def notice_words(text: str) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return [w for w in re.split(_GAP, low) if w]


def _grams(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    x = np.full(len(first), k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = mix(x * np.uint64(31) + hashes[first + i])
    return x


def notice_grams(notices=NOTICES, k: int = K) -> list[tuple]:
    """(gram, template, place, length, label) of every k-gram of the notices."""
    out = []
    for number, (label, text) in enumerate(notices):
        words = notice_words(text)
        grams = _grams(hash_names(pa.array(words)), np.arange(max(0, len(words) - k + 1)), k)
        out += [(int(g), number, i, len(words), label) for i, g in enumerate(grams.view(np.int64))]
    return out


def phrase_places(docs: DataFrame, phrases: dict = PHRASES) -> DataFrame:
    """doc_id, _content, n_words, n_base, first_word, last_word, base (list of labels)."""
    wanted = [(notice_words(p), label) for p, label in phrases.items()]

    def find(batches):
        for batch in slices(batches, "text"):
            words = Words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), _GAP)
            n = words.rows
            starts, docs_at, labels = [], [], []
            for phrase, label in wanted:
                codes = [pc.index(words.names, w).as_py() for w in phrase]
                if min(codes) < 0:
                    continue
                first = words.windows(len(phrase))
                for i, c in enumerate(codes):
                    first = first[words.ids[first + i] == c]
                starts.append(first)
                docs_at.append(words.doc[first])
                labels.append(np.full(len(first), label, object))
            at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            doc = np.concatenate(docs_at) if starts else np.zeros(0, np.int64)
            inside = at - words.starts[doc]
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(low, doc, inside)
            np.maximum.at(high, doc, inside)
            names = [[] for _ in range(n)]
            for d, x in zip(doc, np.concatenate(labels) if starts else ()):
                names[d].append(x)
            none = high < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_content"), pa.array(words.counts),
                 pa.array(np.bincount(doc, minlength=n)), pa.array(low, mask=none), pa.array(high, mask=none),
                 pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))],
                ["doc_id", "_content", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return docs.mapInArrow(
        find, "doc_id long, _content long, n_words long, n_base long, first_word long, last_word long, base array<string>"
    )


def rolling_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, _content, pos, gram) of every window of k words of every text."""
    def roll(batches):
        for batch in slices(batches, "text", 1 << 20):
            words = Words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), _GAP)
            first = words.windows(k)
            grams = _grams(hash_names(words.names)[words.ids], first, k).view(np.int64)
            offsets = np.searchsorted(words.doc[first], np.arange(words.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_content"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams))],
                ["doc_id", "_content", "grams"],
            )

    rolled = docs.mapInArrow(roll, "doc_id long, _content long, grams array<long>")
    return rolled.select("doc_id", "_content", F.posexplode("grams").alias("pos", "gram"))


def spans(docs: DataFrame, notices=NOTICES, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, _content, template, label, start, end, coverage): verified notices in the texts.

    All rolling k-grams meet the notices' grams in a join; the notices are a fixed list of a
    few hundred grams, so their side is broadcast. Hits are summed per diagonal (place in the
    text less place in the notice); neighbouring diagonals, as insertions and deletions make
    them, are one span; a span is verified by the notice words that its hits cover.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(notice_grams(notices, k), "gram long, template int, place int, length int, label string")
    text = ["doc_id", "_content"]
    hits = rolling_grams(docs, k).join(F.broadcast(table), "gram")
    diagonals = hits.groupBy(*text, "template", "length", "label", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"), F.collect_set("place").alias("places")
    )
    in_order = Window.partitionBy(*text, "template").orderBy("diagonal", "start")
    apart = (
        (F.col("diagonal") - F.lag("diagonal").over(in_order) > DIAGONAL_GAP)
        | (F.col("start") - F.lag("stop").over(in_order) > WORD_GAP)
        | (F.lag("start").over(in_order) - F.col("stop") > WORD_GAP)
    )
    merged = diagonals.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "_span", F.sum("_new").over(in_order)
    ).groupBy(*text, "template", "length", "label", "_span").agg(
        F.min("start").alias("start"), (F.max("stop") + k).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1)))))
    return (
        merged.withColumn("coverage", covered / F.col("length"))
        .where((F.col("coverage") >= coverage) & (F.col("end") - F.col("start") <= 2 * F.col("length")))
        .select(*text, "template", "label", "start", "end", "coverage")
    )


def scan(docs: DataFrame, phrases: dict = PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    labels are those of phrases and of verified spans; score is 1 with a phrase, else the best
    coverage of a span, else 0. Null and empty texts have no words and empty labels. Rows that
    repeat a doc_id are told apart by their text; extra columns are ignored.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_content"), "text")
    base = phrase_places(text, phrases)
    found = stored(spans(text, notices, k), "license-spans")
    per_text = found.groupBy("doc_id", "_content").agg(
        F.collect_set("label").alias("_more"), F.max("coverage").alias("_best")
    ).withColumnsRenamed({"doc_id": "_d", "_content": "_c"})
    both = base.join(per_text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_content") == F.col("_c")), "left")
    every = F.array_union("base", F.coalesce("_more", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
