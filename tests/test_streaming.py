from pyspark.sql import functions as F

from waymark.operators.ranking import pick_one
from waymark.streaming.incremental import absorb, compact, current, outstanding


def test_every_increment_agrees_with_a_batch_run(spark, tmp_path):
    source, state, check = (f"{tmp_path}/{d}" for d in ("in", "state", "check"))
    schema = "query_name string, seq long, request_status string"
    order = [F.col("seq").desc()]
    drops = [
        [("a", 1, "failed"), ("b", 1, "success")], [("a", 2, "success"), ("a", 3, "failed")],
        [("c", 1, "success"), ("a", 2, "success")],
    ]
    seen = []
    for rows in drops:
        batch = spark.createDataFrame(rows, schema)
        batch.coalesce(1).write.mode("append").parquet(source)
        seen += rows
        absorb(spark, source, batch.schema, state, check, lambda df: df, ["query_name"], order, files_per_batch=1)
        got = sorted(map(tuple, current(spark, state, ["query_name"], order).collect()))
        want = sorted(map(tuple, pick_one(spark.createDataFrame(seen, schema), ["query_name"], order).collect()))
        assert got == want
    inputs = spark.createDataFrame([("a",), ("b",), ("d",)], "query_name string")
    left = outstanding(inputs, current(spark, state, ["query_name"], order), ["query_name"])
    assert sorted(r[0] for r in left.collect()) == ["a", "d"]


def test_compaction_keeps_the_latest_rows_and_bounds_the_read(spark, tmp_path):
    source, state, check = (f"{tmp_path}/{d}" for d in ("in", "state", "check"))
    schema, order, ks = "query_name string, seq long, request_status string", [F.col("seq").desc()], ["query_name"]
    seen = []
    for turn in range(4):
        rows = [(f"k{i % 5}", turn * 10 + i, "success") for i in range(turn, turn + 7)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        seen += rows
        absorb(spark, source, spark.createDataFrame([], schema).schema, state, check, lambda df: df, ks, order)
        if turn in (1, 2):
            assert compact(spark, state, ks, order) == turn
            assert compact(spark, state, ks, order) == turn  # nothing new to fold
        want = sorted(map(tuple, pick_one(spark.createDataFrame(seen, schema), ks, order).collect()))
        assert sorted(map(tuple, current(spark, state, ks, order).collect())) == want
    # a replay of a folded batch changes nothing
    spark.createDataFrame([("k0", 10**6, "failed")], schema).write.mode("overwrite").parquet(f"{state}/batch=0")
    assert sorted(map(tuple, current(spark, state, ks, order).collect())) == want
    plan = current(spark, state, ks, order)._jdf.queryExecution().executedPlan().toString()
    assert "batch#" in plan and "> 2)" in plan.split("PartitionFilters: ")[-1].split("]")[0]
