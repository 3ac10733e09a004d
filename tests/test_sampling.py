import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.ranking import hash_rank, running_total
from waymark.operators.sampling import allocate, balanced_sample, equal_per_stratum, split, stratified_sample


def brute_balanced(caps, n):
    """Hand out one unit at a time, round by round, in label order."""
    out = {k: 0 for k in caps}
    while n:
        for k in sorted(caps):
            if n and out[k] < caps[k]:
                out[k] += 1
                n -= 1
    return out


def test_balanced_allocation_matches_round_robin(spark):
    rng = random.Random(1)
    cases = [({"a": 1, "b": 1, "c": 1}, 2), ({"a": 10, "b": 0, "c": 5}, 15)]
    cases += [({f"s{j}": rng.randrange(0, 9) for j in range(rng.randrange(1, 6))}, None) for _ in range(12)]
    for caps, n in cases:
        n = n or rng.randrange(1, max(2, sum(caps.values()) + 1))
        if n > sum(caps.values()):
            continue
        df = spark.createDataFrame(list(caps.items()), "s string, cap long")
        got = {r["s"]: r["quota"] for r in allocate(df, "s", "cap", n, "balanced").collect()}
        assert got == brute_balanced(caps, n), (caps, n)


def test_proportional_allocation_totals_and_capacity(spark):
    rng = random.Random(2)
    for _ in range(8):
        caps = {f"s{j}": rng.randrange(1, 40) for j in range(rng.randrange(1, 7))}
        n = rng.randrange(1, sum(caps.values()) + 1)
        df = spark.createDataFrame(list(caps.items()), "s string, cap long")
        got = {r["s"]: r["quota"] for r in allocate(df, "s", "cap", n, "proportional").collect()}
        assert sum(got.values()) == n
        for k, cap in caps.items():
            exact = n * cap / sum(caps.values())
            assert got[k] <= cap and abs(got[k] - exact) < 1 + 1e-9


def test_empty_sample_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], "s string, cap long")
    with pytest.raises(ValueError):
        allocate(df, "s", "cap", 0, "proportional")


def test_split_keeps_both_sides(spark):
    rows = [(f"{size}-{i}", str(size)) for size in (1, 2, 3, 10) for i in range(size)]
    df = spark.createDataFrame(rows, "k string, s string")
    got = {}
    for r in split(df, "s", 0.7, ["k"], 9).collect():
        got.setdefault(r["s"], []).append(r["validation_split"])
    assert {s: v.count("calibration") for s, v in got.items()} == {"1": 1, "2": 1, "3": 2, "10": 7}


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("string").alias("s"))
    quotas = spark.createDataFrame([("true", 20), ("false", 7)], "s string, quota long")
    want = None
    for parts in (1, 7, 64):
        got = {r["k"] for r in stratified_sample(df.repartition(parts, F.rand()), "s", quotas, ["k"], 5).collect()}
        want = want or got
        assert got == want and len(got) == 27
    assert equal_per_stratum(df, "s", 11, ["k"], 5).count() == 11


def test_hash_rank_is_a_permutation_per_stratum(spark):
    # one stratum holds most of the rows
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("s"))
    ranks = {}
    for r in hash_rank(df, ["s"], ["k"], 1).collect():
        ranks.setdefault(r["s"], []).append(r["draw_rank"])
    assert {s: sorted(v) == list(range(1, len(v) + 1)) for s, v in ranks.items()} == {"a": True, "b": True}
    assert len(ranks["a"]) == 1800


def test_running_total_with_repeated_leading_value(spark):
    rows = [(i, 5 if i % 3 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(9)
    out = running_total(df, [F.col("v").desc(), F.col("k").asc()], {"rank": F.lit(1), "total": "v"})
    got = [(r["k"], r["rank"], r["total"]) for r in out.orderBy("rank").collect()]
    want, total = [], 0
    for place, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want.append((k, place, total))
    assert got == want


def test_balanced_sample_takes_cells_first(spark):
    rows = [("t", f"{i:03d}", float(i % 4), 0.0) for i in range(40)] + [("u", "x", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t string, h string, lat double, lon double")
    for cap in (2, 4, 10):
        out = balanced_sample(df, ["t"], cap, ["h"]).where("t = 't'").collect()
        assert sorted(r["h"] for r in out) == [f"{i:03d}" for i in range(cap)]
        assert {r["sampling_applied"] for r in out} == {True}


def test_balanced_sample_without_cap_keeps_all_and_counts(spark):
    rows = [("t", f"{i:03d}", float(i % 4), 0.0) for i in range(40)] + [("u", "000", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t string, h string, lat double, lon double")
    out = balanced_sample(df, ["t"], None, ["h"]).collect()
    assert len(out) == 41 and {r["dropped_n"] for r in out} == {0}
    cut = balanced_sample(df, ["t"], 30, ["h"]).where("t = 't'").collect()
    assert len(cut) == 30 and {(r["available_n"], r["dropped_n"]) for r in cut} == {(40, 10)}


@pytest.mark.parametrize("cap", [999, 1001, 5000])
def test_balanced_sample_prunes_a_hot_key_for_any_cap(spark, cap, monkeypatch):
    monkeypatch.setattr("waymark.operators.ranking.BUCKET_ROWS", 100)
    df = spark.range(8000).select(
        F.lit("t").alias("t"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"),
        (F.col("id") % 3).cast("double").alias("lat"), F.lit(0.0).alias("lon"),
    )
    out = balanced_sample(df, ["t"], cap, ["h"]).collect()
    every = sorted(r["h"] for r in df.collect())
    firsts = {min(r["h"] for r in df.collect() if r["lat"] == lat) for lat in (0.0, 1.0, 2.0)}
    want = sorted([*firsts, *[h for h in every if h not in firsts][:cap - 3]])
    assert sorted(r["h"] for r in out) == want
    ranked = balanced_sample(df, ["t"], cap, ["h"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in ranked.split("row_number()")[1].split("\n")[0]


@pytest.mark.parametrize("mode", ["balanced", "proportional"])
def test_sizes_above_capacity_are_refused(spark, mode):
    df = spark.createDataFrame([("a", 3), ("b", 5)], "s string, cap long")
    with pytest.raises(Exception, match="exceeds the total capacity"):
        allocate(df, "s", "cap", 20, mode).collect()


def test_first_rows_for_any_k(spark):
    from waymark.operators.ranking import first_k

    rows = [(None if i % 7 == 0 else i % 3, (i * 7919) % 5003, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    for k in (3, 1000, 1001, 1900):
        got = first_k(df, ["g"], [F.col("v").desc(), F.col("i").asc()], k).collect()
        want = []
        for g in (None, 0, 1, 2):
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_quantiles(spark):
    import numpy as np

    from waymark.operators.ranking import quantiles

    rng = np.random.default_rng(2)
    rows = [(str(rng.integers(3)) if i % 9 else None, float(rng.integers(40)) if i % 4 else None, float(rng.random())) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    for q in (0.5, 0.25, 1.0):
        got = {(r["_all"], r["g"]): (r["a"], r["b"]) for r in quantiles(df, ["a", "b"], q, "g").collect()}
        for g in ("0", "1", "2", None, "all"):
            mine = [r for r in rows if g == "all" or r[0] == g]
            want = [np.quantile([r[k] for r in mine if r[k] is not None], q) for k in (1, 2)]
            assert np.allclose(got[(1, None) if g == "all" else (0, g)], want)
    assert quantiles(df.limit(0), ["a"], 0.5).count() == 0


def test_quotas_meet_buckets_and_not_rows(spark, monkeypatch):
    monkeypatch.setattr("waymark.operators.ranking.BUCKET_ROWS", 50)
    stratum = F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")))
    df = spark.range(6000).select(F.col("id").cast("string").alias("k"), stratum.alias("s"), (F.col("id") % 3).alias("quota"))
    caps = {"s0": 0, "s1": 1, "s2": 700, "s3": 10**9, None: 60, "absent": 4}
    quotas = spark.createDataFrame([*caps.items(), ("s4", None)], "s string, quota long")
    out = stratified_sample(df, "s", quotas, ["k"], 3)
    drawn = hash_rank(df, ["s"], ["k"], 3, "_rank").collect()
    want = sorted((r["k"], r["s"] or "", r["quota"]) for r in drawn if r["s"] != "s4" and r["_rank"] <= caps[r["s"]])
    assert out.columns == ["k", "s", "quota"]
    assert sorted((r["k"], r["s"] or "", r["quota"]) for r in out.collect()) == want
    # one join of limits with buckets, one of buckets with rows, none that gathers rows by stratum
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
