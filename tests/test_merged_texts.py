from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.operators.ranking import rank_sorted
from waymark.operators.regions import build_areas
from waymark.operators.reporting import join_unique, joined_texts, merge_by_key, text_parts


@pytest.fixture(scope="module")
def frame(spark):
    """Key 'a' holds most rows and 2,500 different texts; others few; one key is null."""
    n = F.col("id")
    key = F.when(n % 3 < 2, F.lit("a")).when(n % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), n % 5))
    return spark.range(7500).select(key.alias("k"), F.concat(F.lit("t"), n % 2503).alias("t"), "id")


def brute(df):
    out = defaultdict(set)
    for r in df.collect():
        if r["t"] is not None:
            out[r["k"]].add(r["t"])
    return {k: " | ".join(sorted(v)) for k, v in out.items()}


def test_ranks_count_within_keys(frame):
    rows = rank_sorted(frame, ["k"], [F.col("t").asc(), F.col("id").asc()], "r").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["k"]].append((r["t"], r["id"], r["r"]))
    assert len(rows) == 7500
    for g in groups.values():
        assert [x[2] for x in sorted(g)] == list(range(1, len(g) + 1))


def test_parts_are_bounded_and_join_to_the_whole(frame):
    parts = text_parts(frame, ["k"], "t", size=100).cache()
    rows = parts.collect()
    assert max(r["texts_n"] for r in rows) == 100 and all(r["t"].count(" | ") == r["texts_n"] - 1 for r in rows)
    mine = sorted(r["part"] for r in rows if r["k"] == "a")
    assert mine == list(range(len(mine))) and len(mine) > 20
    assert {r["k"]: r["t"] for r in joined_texts(parts, ["k"], "t").collect()} == brute(frame)


def test_texts_per_key_leave_blanks_out(spark, frame):
    assert {r["k"]: r["t"] for r in join_unique(frame, "k", "t").collect()} == brute(frame)
    df = spark.createDataFrame([("x", " "), ("y", None), ("z", "b"), ("z", "a"), ("z", "b")], "k string, t string")
    assert [tuple(r) for r in join_unique(df, "k", "t").collect()] == [("z", "a | b")]
    assert join_unique(df.limit(0), "k", "t").count() == 0


def test_merge_keeps_every_key(spark):
    rows = [("x", "b", "u", 1), ("x", "a", None, 2), ("x", "b", "u", 4), (None, "c", " ", 8), ("y", None, None, None)]
    df = spark.createDataFrame(rows, "k string, t string, s string, n int")
    got = merge_by_key(df, "k", ["n"], ["t", "s"], "t").collect()
    assert {r["k"]: (r["inputs_n"], r["n"], r["t"], r["s"]) for r in got} == {
        "x": (2, 7, "a | b", "u"), None: (1, 8, "c", ""), "y": (0, None, "", ""),
    }
    assert merge_by_key(df.limit(0), "k", ["n"], ["t", "s"], "t").count() == 0


def test_areas_count_units_and_names(spark):
    df = spark.createDataFrame([("l", "b"), ("l", "a"), ("l", "b"), ("m", None), (None, "c")], "label string, eco string")
    got = {r["label"]: (r["names"], r["map_units_n"]) for r in build_areas(df, "label", "eco").collect()}
    assert got == {"l": ("a | b", 3), "m": ("", 1), None: ("c", 1)}
