"""Rules with state over streams. Each has a batch twin that gives the same rows when the stream is in order.

Requests, payments and changes are streams of rows; what a rule remembers lives in Spark's state store, so
that it outlives executors and restarts with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from mercadia.operators.billing import subscription_after
from mercadia.operators.matching import latest


# ---- a sliding-window rate limit ----
def _admitted(times: list[float], held: list[float], most: int, window: float) -> tuple[list[bool], list[float]]:
    """Which calls in order of time are admitted; a refused call isn't remembered. held: admitted times so far."""
    held, out, first = list(held), [], 0
    for t in times:
        while first < len(held) and t - held[first] > window:
            first += 1
        ok = len(held) - first < most
        if ok:
            held.append(t)
        out.append(ok)
    return out, held[first:]


def rate_limit(calls: DataFrame, most: int, window: float) -> DataFrame:
    """A batch of calls (client, bucket, call_id, at) with admitted.

    Each (client, bucket) is a sequence that must be taken in order, since a refusal changes what follows. It
    is streamed through a task sorted by time, in Arrow batches of bounded size, with at most `most` times of
    state; a busy client is no group in memory.
    """
    keyed = calls.select("client", "bucket", "call_id", F.col("at").cast("timestamp").cast("double").alias("t"))
    ordered = keyed.repartition("client", "bucket").sortWithinPartitions("client", "bucket", "t", "call_id")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            admitted: list[bool] = []
            runs = (pdf[["client", "bucket"]] != pdf[["client", "bucket"]].shift()).any(axis=1).cumsum()
            for _, part in pdf.groupby(runs, sort=False):
                here = (part["client"].iloc[0], part["bucket"].iloc[0])
                held = held if here == key else []
                key = here
                ok, held = _admitted(part["t"].tolist(), held, most, window)
                admitted += ok
            yield pdf[["client", "bucket", "call_id"]].assign(admitted=admitted)

    types = {f.name: f.dataType.simpleString() for f in calls.schema}
    return ordered.mapInPandas(task, f"client {types['client']}, bucket {types['bucket']}, call_id {types['call_id']}, admitted boolean")


def rate_limit_stream(calls: DataFrame, most: int, window: float) -> DataFrame:
    """The same over a stream: state of at most `most` times a (client, bucket), which is dropped when idle."""
    keyed = calls.select("client", "bucket", "call_id", F.col("at").cast("timestamp").cast("double").alias("t"))
    types = {f.name: f.dataType.simpleString() for f in calls.schema}

    def group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(batches).sort_values(["t", "call_id"])
        ok, held = _admitted(pdf["t"].tolist(), held, most, window)
        state.update((held,))
        state.setTimeoutDuration(int(window * 1000) + 1000)
        yield pdf[["call_id"]].assign(client=key[0], bucket=key[1], admitted=ok)[["client", "bucket", "call_id", "admitted"]]

    return keyed.groupBy("client", "bucket").applyInPandasWithState(
        group, f"client {types['client']}, bucket {types['bucket']}, call_id {types['call_id']}, admitted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


# ---- payment events ----
#: Folders of users that a log of payments is divided into.
BUCKETS = 64


def merge_payments(log_path: str, out_path: str, buckets: int = BUCKETS):
    """A foreachBatch function: appends a batch of payment events to a log and rewrites the users it touches.

    The log is the truth; a batch that is delivered again is recognised by event_id. It is divided by a hash of
    the user, so that a batch reads the folders of the users it touches, not the whole log. `out_path` holds one
    folder a batch, each with the new states of the users touched: read them with `current_states`.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
        written = batch.withColumn("bucket", bucket)
        written.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(log_path)
        users = written.select("bucket", "user_id").distinct()
        # at most `buckets` numbers: they prune the folders that are read
        touched = [r["bucket"] for r in users.select("bucket").distinct().collect()]
        log = spark.read.schema(StructType([*batch.schema.fields, StructField("bucket", IntegerType()), StructField("batch", LongType())])).parquet(log_path).where(F.col("bucket").isin(touched))
        own = log.join(users.select("user_id"), "user_id", "left_semi").dropDuplicates(["event_id"]).select(*batch.columns)
        subscription_after(own).withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/v={batch_id}")

    return merge


def current_states(states: DataFrame) -> DataFrame:
    return latest(states, ["user_id"], "version").drop("version", "v")


def first_use_stream(uses: DataFrame) -> DataFrame:
    """uses (code, user_id, at, use_id) of one-time codes with outcome: created, reused (by the same user) or refused.

    Who used a code first stays in the state store for good: a code is never free again. Of uses that arrive
    together, up to an Arrow batch of them, the earliest comes first; one that comes later doesn't take back
    what was decided before it. Equals billing.first_reservations when the stream is in order.
    """
    types = {f.name: f.dataType.simpleString() for f in uses.schema}

    def group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = state.get[0] if state.exists else pdf.sort_values(["at", "use_id"])["user_id"].iloc[0]
            fresh = None if state.exists else pdf.sort_values(["at", "use_id"])["use_id"].iloc[0]
            state.update((first,))
            outcome = ["created" if fresh is not None and u == fresh else "reused" if w == first else "refused" for u, w in zip(pdf["use_id"], pdf["user_id"])]
            yield pdf[["code", "user_id", "use_id"]].assign(outcome=outcome)

    slim = uses.select("code", "user_id", "at", "use_id")
    return slim.groupBy("code").applyInPandasWithState(group, f"code {types['code']}, user_id {types['user_id']}, use_id {types['use_id']}, outcome string", f"first {types['user_id']}", "append", GroupStateTimeout.NoTimeout)


def expiring_sessions(sessions: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions by user that end after a gap without events: the state goes when the watermark passes their end."""
    return session_counts(sessions.withWatermark("at", delay), gap)


def session_counts(sessions: DataFrame, gap: str) -> DataFrame:
    """The same of a batch: (user_id, first_at, last_at, events), last_at being the gap after the last event."""
    found = sessions.groupBy("user_id", F.session_window("at", gap).alias("session")).agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("session.start").alias("first_at"), F.col("session.end").alias("last_at"), "events")


def live_totals(changes: DataFrame) -> DataFrame:
    """Counts and sums by group over all that came in, to be written in complete mode: a listener's whole result."""
    return changes.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value"))


def rate_bound(calls: DataFrame, window: float) -> DataFrame:
    """calls with how many came in the window up to each, itself included: an upper bound of the limiter's count.

    A sliding frame is counted anew for each row. Here time is cut into slots as long as the window: what counts for a time is
    in its slot, up to it, or in the slot before, from the window's beginning on; both are running sums over a slot's times.
    """
    width = round(window * 1_000_000)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    times = calls.groupBy(F.col("client").alias("__c"), F.col("bucket").alias("__b"), at.alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    if width <= 0:
        counts = times
    else:
        # a time without a value has a slot of its own
        slot = F.floor((F.col("__t") - F.pmod(F.col("__t"), F.lit(width))) / width)
        keys = ("__c", "__b")
        own = times.select(*keys, slot.alias("__s"), F.col("__t").alias("__x"), "__t", "__n", F.lit(0).alias("__probe"))
        probes = times.where("__t IS NOT NULL").select(*keys, (slot - 1).alias("__s"), (F.col("__t") - width).alias("__x"), "__t", F.lit(0).cast("bigint").alias("__n"), F.lit(1).alias("__probe"))
        whole = Window.partitionBy(*keys, "__s")
        # in both directions a probe comes after the call of its time, which counts for it
        upto = F.sum("__n").over(whole.orderBy("__x", "__probe").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        since = F.sum("__n").over(whole.orderBy(F.desc("__x"), "__probe").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        part = own.unionByName(probes).withColumns({"__up": upto, "__since": since})
        part = part.withColumn("__n", F.when(F.col("__probe") == 1, F.col("__since")).otherwise(F.col("__up")))
        counts = part.groupBy(*keys, "__t").agg(F.sum("__n").alias("__n"))
    same = F.col("client").eqNullSafe(F.col("__c")) & F.col("bucket").eqNullSafe(F.col("__b")) & at.eqNullSafe(F.col("__t"))
    return calls.join(counts, same).drop("__c", "__b", "__t").withColumnRenamed("__n", "calls_in_window")
