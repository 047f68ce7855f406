"""Streams against their batch twins, and rules that go by order against plain loops."""

from collections import deque

from pyspark.sql import functions as F

from mercadia.operators.billing import first_reservations, subscription_after
from mercadia.operators.merge import upsert
from mercadia.plans.account_queries import calls
from mercadia.plans.catalog import QUERIES
from mercadia.streaming import rules


def brute_limit(rows, most, window):
    held, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["t"], r["call_id"])):
        q = held.setdefault((r["client"], r["bucket"]), deque())
        while q and r["t"] - q[0] > window:
            q.popleft()
        out[r["call_id"]] = len(q) < most
        if out[r["call_id"]]:
            q.append(r["t"])
    return out


def test_rate_limit_is_the_plain_loop(spark, sf):
    rows = calls(spark, sf).withColumn("t", F.col("at").cast("timestamp").cast("double")).collect()
    got = {r["call_id"]: r["admitted"] for r in QUERIES["q_rate_limit"](spark, sf).collect()}
    assert got == brute_limit(rows, 3, 432000.0)
    assert 0 < sum(got.values()) < len(got)


def stream(spark, df, path):
    df.repartition(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_rate_limit_stream_is_the_batch(spark, sf, tmp_path):
    batch = calls(spark, sf)
    out = rules.rate_limit_stream(stream(spark, batch, f"{tmp_path}/in"), 3, 432000.0)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["call_id"]: r["admitted"] for r in spark.table("limited").collect()}
    assert got == {r["call_id"]: r["admitted"] for r in rules.rate_limit(batch, 3, 432000.0).collect()}


def test_payment_stream_is_the_batch(spark, tmp_path):
    names = ["PAYMENT_CONFIRMED", "PAYMENT_OVERDUE", "SUBSCRIPTION_DELETED", "PAYMENT_CREATED"]
    events = spark.range(60).select((F.col("id") % 7).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 864_000).alias("at"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") * 5 % 4 + 1).cast("int")).alias("event"))
    merge = rules.merge_payments(f"{tmp_path}/log", f"{tmp_path}/out")
    for i in range(3):
        merge(events.where(F.col("event_id").between(20 * i, 20 * i + 19)), i)
    merge(events.where("event_id >= 40"), 3)  # delivered again
    got = rules.current_states(spark.read.parquet(f"{tmp_path}/out"))
    expected = subscription_after(events)
    assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_live_totals(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "grp string, value double")
    q = rules.live_totals(stream(spark, df, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["grp"]: (r["rows"], r["value"]) for r in spark.table("live").collect()} == {"a": (2, 3.0), "b": (1, 3.0)}


def finished(df, name, path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_one_time_codes_stay_used(spark, tmp_path):
    rows = [("k", 1, 1_700_000_000, 1), ("k", 2, 1_700_000_100, 2), ("j", 3, 1_700_000_000, 3), ("k", 1, 1_700_000_200, 4), ("k", 2, 1_900_000_000, 5), ("k", 1, 1_900_000_001, 6), ("m", 9, 1_900_000_002, 7)]
    df = spark.createDataFrame(rows, "code string, user_id int, s long, use_id int").select("code", "user_id", F.timestamp_seconds("s").alias("at"), "use_id")
    # the second file comes years later
    for n, some in enumerate((df.where("use_id <= 4"), df.where("use_id > 4"))):
        some.repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = rules.first_use_stream(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
    got = {r["use_id"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["use_id"]: r["outcome"] for r in first_reservations(df).collect()}
    assert got == {1: "created", 2: "refused", 3: "created", 4: "reused", 5: "refused", 6: "reused", 7: "created"}


def test_session_stream_is_the_batch(spark, tmp_path):
    rows = [(u, 1_700_000_000 + 60 * t) for u, t in ((1, 0), (1, 5), (1, 30), (2, 3), (2, 4), (3, 100_000))]
    df = spark.createDataFrame(rows, "user_id int, s long").select("user_id", F.timestamp_seconds("s").alias("at"))
    finished(rules.expiring_sessions(stream(spark, df, f"{tmp_path}/in"), "10 minutes", "1 minute"), "sessions", f"{tmp_path}/ck")
    got = sorted(map(tuple, spark.table("sessions").collect()))
    # the last session is still open
    assert got == sorted(map(tuple, rules.session_counts(df, "10 minutes").where("user_id < 3").collect())) and [r[3] for r in got] == [2, 1, 2]


def test_payments_of_many_batches_read_only_their_users(spark, tmp_path):
    names = ["PAYMENT_CONFIRMED", "PAYMENT_OVERDUE", "SUBSCRIPTION_DELETED"]
    events = spark.range(200).select((F.col("id") % 23).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("at"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") * 7 % 3 + 1).cast("int")).alias("event"))
    merge = rules.merge_payments(f"{tmp_path}/log", f"{tmp_path}/out", 5)
    for i in range(6):
        merge(events.where(F.pmod("event_id", F.lit(6)) == i), i)
    got, expected = rules.current_states(spark.read.parquet(f"{tmp_path}/out")), subscription_after(events)
    assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("a", 2, None), ("c", 2, "w")], "k string, t int, v string")
    once = upsert(old, new, ["k"], "t")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(once) == [("a", 2, "z"), ("b", 1, "y"), ("c", 2, "w")]
    assert rows(upsert(once, new, ["k"], "t")) == rows(once)
