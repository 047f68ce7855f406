"""The bound of the rate limit against a plain count."""

import random

from pyspark.sql import functions as F

from mercadia.streaming.rules import rate_bound


def test_counts_of_windows(spark):
    rng = random.Random(5)
    # few times, so that many calls fall on a window's ends; null keys and a null time
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", None]), i, rng.choice([None, *range(-40, 60)])) for i in range(400)]
    calls = spark.createDataFrame(rows, "client int, bucket string, call_id int, t long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    got = {r.call_id: r.calls_in_window for r in rate_bound(calls, 7.0).collect()}
    inside = lambda t, u: u is None if t is None else u is not None and t - 7 <= u <= t
    assert got == {i: sum((c, b) == (k, g) and inside(t, u) for c, b, _, u in rows) for k, g, i, t in rows}


def test_no_frame_slides(spark):
    """A sliding frame is counted anew for every row, which is quadratic."""
    calls = spark.range(10).select(F.lit(1).alias("client"), F.lit("a").alias("bucket"), "id", F.timestamp_seconds("id").alias("at"))
    plan = rate_bound(calls, 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan
