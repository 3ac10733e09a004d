import pytest
from pyspark.sql import functions as F

from waymark.operators.quality import GateFailed, gate_unique
from waymark.sources.regions import clean_label
from waymark.sources.tables import fan_out, publish, published, read_class, read_classes, resolve_roles, scan, sink, sink_by_class


def test_roles_prefer_the_first_alias(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Country-Name` int, nation int, Site int")
    out = resolve_roles(df, {"country": ["country_name", "nation"], "site": ["SITE"], "x": ["none"]}, optional=["x"])
    assert out.columns == ["country", "site"] and out.first()["country"] == 1
    with pytest.raises(ValueError, match="roles"):
        resolve_roles(df, {"x": ["none"]})


def test_csv_round_trip_keeps_empty_schema_and_null_policy(spark, tmp_path):
    df = spark.createDataFrame([("NA", "x"), ("", None)], "a string, b string")
    sink(df, f"{tmp_path}/t", fmt="csv")
    sink(df.limit(0), f"{tmp_path}/empty", fmt="csv")
    back = scan(spark, f"{tmp_path}/t", schema=df.schema, fmt="csv")
    assert sorted((r["a"] or "") for r in back.collect()) == ["", "NA"]
    nulled = scan(spark, f"{tmp_path}/t", schema=df.schema, fmt="csv", null_words=("", "na"))
    assert [r["a"] for r in nulled.collect()] == [None, None]
    assert scan(spark, f"{tmp_path}/empty", fmt="csv").columns == ["a", "b"]
    with pytest.raises(ValueError):
        scan(spark, f"{tmp_path}/t", schema=df.schema, fmt="csv", cols=["zz"])


def test_failed_gate_leaves_the_published_run_alone(spark, tmp_path):
    good = spark.createDataFrame([(1,), (2,)], "k int")
    publish({"t": good}, str(tmp_path), "r1", {"unique": gate_unique(good, ["k"])})
    bad = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(GateFailed):
        publish({"t": bad}, str(tmp_path), "r2", {"unique": gate_unique(bad, ["k"])})
    assert published(spark, str(tmp_path), "t").count() == 2
    publish({"t": good.where("k = 1")}, str(tmp_path), "r3")
    assert published(spark, str(tmp_path), "t").count() == 1


def test_fan_out_and_labels(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    assert {k: v.count() for k, v in fan_out(df, "c", ["a", "b"]).items()} == {"a": 2, "b": 1}
    labels = spark.createDataFrame([(" Oceania_simplify2",), ("N/A",), ("x",)], "l string")
    assert [r[0] for r in labels.select(clean_label(F.col("l"))).collect()] == ["Oceania", None, "x"]


def test_classes_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "c string, n int")
    wanted = spark.createDataFrame([("a",), ("b",), ("none",)], "c string")
    for frame, counts in ((df, {"a": 2, "b": 1, "none": 0}), (df.limit(0), {"a": 0, "b": 0, "none": 0})):
        path = f"{tmp_path}/{len(counts)}-{sum(counts.values())}"
        sink_by_class(frame, "c", path, wanted)
        assert {r.c: r.rows_n for r in read_classes(spark, path).collect()} == counts
        assert sorted(r.n for r in read_class(spark, path, "a").collect()) == ([1, 3] if counts["a"] else [])
        assert set(read_class(spark, path, "none").columns) == {"c", "n"} and read_class(spark, path, "none").count() == 0
