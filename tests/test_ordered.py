"""The processor that puts calls in order against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from mercadia.streaming import rules
from mercadia.streaming.ordered import disk_state, rate_limit_in_order


def admitted(df):
    return {r["call_id"]: r["admitted"] for r in df.collect()}


@pytest.mark.parametrize("order", ["in order", "shuffled", "delivered twice"])
def test_calls_that_come_in_any_order_are_decided_as_in_a_batch(spark, tmp_path, order):
    rng = random.Random(order)
    # every client calls until 400 s; a last call far ahead moves the watermark past all of them
    rows = [(rng.randrange(3), "b", i, 1_700_000_000_000_000 + rng.randrange(400_000_000)) for i in range(240)]
    rows += [(9, "b", 1000, 1_700_009_000_000_000)]
    make = lambda some: spark.createDataFrame(some, "client long, bucket string, call_id long, m long").select("client", "bucket", "call_id", F.timestamp_micros("m").alias("at"))
    sent = sorted(rows[:-1], key=lambda r: r[3])
    if order != "in order":
        # none is later than the delay of 120 s
        sent.sort(key=lambda r: r[3] + rng.randrange(100_000_000))
    files = [sent[k : k + 80] for k in range(0, 240, 80)] + [rows[-1:]]
    if order == "delivered twice":
        files[1] += files[1][:30]
    folder = f"{tmp_path}/in"
    made = make(rows)
    with disk_state(spark):
        for n, some in enumerate(files):
            make(some).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(made.schema).parquet(folder)
            # each file is a run of its own: the state outlives it
            q = rate_limit_in_order(stream, 2, 20.0, "120 seconds").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = admitted(rules.rate_limit(made.where("call_id < 1000"), 2, 20.0))
    assert admitted(got) == want and got.count() == len(want)
    assert 40 < sum(want.values()) < 200 and len(want) == 240
