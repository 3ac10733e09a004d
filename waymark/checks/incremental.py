"""Checks of the incremental mode against one batch run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waymark.checks.base import VIEWS, check, table
from waymark.functions.hashing import stable_hash
from waymark.operators.lookup import pending
from waymark.session import shared_folder
from waymark.streaming.incremental import absorb, compact, current, outstanding

ORDER = ["seq"]


def _journal(df):
    return df.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("query_name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("request_status"),
        F.col("event_type").alias("decision"),
    )


def streamed(spark, sf):
    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    order = [F.col("seq").desc()]
    absorb(
        spark, sf, table(spark, sf, "events").schema, f"{base}/state", f"{base}/checkpoint",
        _journal, ["query_name"], order, glob="events.parquet",
    )
    return current(spark, f"{base}/state", ["query_name"], order)


VIEWS["o_last"] = """
SELECT query_name, max(seq) AS seq, arg_max(request_status, seq) AS request_status, arg_max(decision, seq) AS decision
FROM b_journal GROUP BY query_name"""


@check("i01_stream_equals_batch", "SELECT * FROM o_last")
def _(spark, sf):
    return streamed(spark, sf)


@check("i03_compacted_stream_equals_batch", "SELECT * FROM o_last")
def _(spark, sf):
    """Four drops of files, folded into a generation after each but the last."""
    base = f"{shared_folder(spark)}/compacted-{uuid.uuid4().hex}"
    ks, order = ["query_name"], [F.col("seq").desc()]
    events = table(spark, sf, "events")
    for drop in range(4):
        events.where(F.pmod(F.col("event_id"), F.lit(4)) == drop).write.mode("append").parquet(f"{base}/in")
        absorb(spark, f"{base}/in", events.schema, f"{base}/state", f"{base}/checkpoint", _journal, ks, order, glob="*.parquet")
        if drop < 3:
            compact(spark, f"{base}/state", ks, order)
    return current(spark, f"{base}/state", ks, order)


@check(
    "i02_outstanding_after_stream",
    """SELECT CAST(c_custkey AS varchar) AS query_name FROM customer
    WHERE CAST(c_custkey AS varchar) NOT IN (SELECT query_name FROM o_last WHERE request_status = 'success')""",
)
def _(spark, sf):
    inputs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("query_name"))
    return outstanding(inputs, streamed(spark, sf), ["query_name"])


@check(
    "j13_pending_by_signature",
    """SELECT p_partkey, sha256(concat_ws('|', CAST(p_partkey AS varchar), p_name, '1000', '5')) AS signature FROM part
    WHERE p_size % 2 = 0 OR p_partkey % 3 = 0""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    sign = stable_hash("p_partkey", "p_name", F.lit(1000), F.lit(5))
    older = stable_hash("p_partkey", "p_name", F.lit(500), F.lit(5))
    inputs = part.select("p_partkey", sign.alias("signature"))
    results = part.where("p_size % 2 = 1").select(
        F.when(F.col("p_partkey") % 3 == 0, older).otherwise(sign).alias("signature"), F.lit("completed").alias("status")
    )
    return pending(inputs, results, ["signature"], F.col("status") == "completed")
