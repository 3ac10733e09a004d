import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.joins import hot_keys, spread_left
from waymark.operators.lookup import enrich, lookup_left, prepare_centroids

PARTS = 8


@pytest.fixture
def plain(spark):
    """No adaptive plans, no small-table broadcasts, no skew flags."""
    want = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    before = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_by_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize("heavy", ["", None, "hot"])
def test_one_key_with_nine_tenths_of_the_rows_is_spread(plain, heavy):
    n = 16000
    which = F.when(F.col("id") % 10 < 9, F.lit(heavy)).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    df = plain.range(n).select("id", which.alias("k"))
    ref = plain.createDataFrame([("", 1), ("hot", 2), *[(f"k{i}", 10 + i) for i in range(0, 500, 2)]], "k string, v int")
    out = spread_left(df, ref, ["k"], ["v"], hot_keys(df, ["k"]) if heavy else None)
    sizes = rows_by_task(out)
    assert len(sizes) == PARTS and max(sizes) < 2 * n / PARTS
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert out.exceptAll(df.join(ref, "k", "left").select("id", "k", "v")).isEmpty() and out.count() == n


def test_equals_the_plain_join_on_any_keys(spark):
    rnd = random.Random(5)
    words = ["", None, "a", "b", "c", "d"]
    rows = [(i % 40, rnd.choice(words), rnd.choice(words), {"m": i}) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, l string, extra map<string,int>")
    ref = spark.createDataFrame([(k, l, f"{k}{l}", None) for k in words for l in words if (k, l) != ("a", "a")], "k string, l string, v string, w int")
    for some in (ref, ref.where("k <> ''"), ref.limit(0)):
        want = df.join(some, ["k", "l"], "left").select("id", "k", "l", F.col("extra.m").alias("m"), "v", "w")
        got = spread_left(df, some, ["k", "l"], ["v", "w"]).select("id", "k", "l", F.col("extra.m").alias("m"), "v", "w")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        salted = spread_left(df, some, ["k", "l"], ["v", "w"], hot_keys(df, ["k", "l"])).select(*want.columns[:3], F.col("extra.m").alias("m"), "v", "w")
        assert sorted(map(str, salted.collect())) == sorted(map(str, want.collect()))
    assert spread_left(df.limit(0), ref, ["k", "l"], ["v"]).count() == 0
    with pytest.raises(ValueError, match="types"):
        spread_left(df, ref.withColumn("k", F.lit(1)), ["k", "l"], ["v"])


def test_hot_keys_are_few_whatever_the_rows(spark):
    df = spark.range(10000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id") % 3000).alias("k"))
    assert [r["_salts"] for r in hot_keys(df, ["k"], 20).collect()] == [8]
    assert hot_keys(df.limit(0), ["k"], 20).count() == 0


def test_lookups_with_blank_and_numeric_keys(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "X  y"), (4, "z")], "id int, site string")
    ref = prepare_centroids(
        spark.createDataFrame([("", 1.0, 2.0), ("x y", 3.0, 4.0)], "site string, latitude double, longitude double"), ["site"]
    )
    out = lookup_left(df, ref, ["site"], ["latitude"])
    assert out.columns == ["id", "site", "latitude"]
    assert [r["latitude"] for r in out.orderBy("id").collect()] == [1.0, 1.0, 3.0, None]
    counted = lookup_left(df, ref, ["site"], ["latitude"], hot=True)
    assert [r["latitude"] for r in counted.orderBy("id").collect()] == [1.0, 1.0, 3.0, None]
    side = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], "id int, tag string")
    tagged = enrich(df, [(side, ["id"], [F.col("tag").asc()])])
    assert [r["tag"] for r in tagged.orderBy("id").collect()] == ["a", None, None, None]
