"""Rules that go by the order of events, over streams whose events come late or in any order.

A processor holds what has come back until the watermark passes it, and then takes it in order of event time: a timer
a held event wakes it. So the rows are those of the batch twin, however the events came, as long as none is later
than the delay. State lives in RocksDB and is dropped when it can change nothing any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mercadia.streaming.rules import _admitted

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Limiter(StatefulProcessor):
    """At most `most` admitted calls a client and bucket in any `window` seconds; a refused call isn't counted."""

    def __init__(self, most: int, window: float, call_type: str):
        self.most, self.window, self.call_type = most, window, call_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"micros long, call_id {self.call_type}")
        self.held = handle.getValueState("held", "times array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {tuple(x) for x in self.waiting.get()}
        fresh = {(r["micros"], r["call_id"]) for r in rows} - known
        self.waiting.appendList(sorted(fresh))
        for ms in {micros // 1000 + 1 for micros, _ in fresh}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        calls = sorted(tuple(x) for x in self.waiting.get())
        due = [c for c in calls if c[0] <= passed]
        state = self.held.get()
        held = list(state[0]) if state else []
        admitted, held = _admitted([micros / 1e6 for micros, _ in due], held, self.most, self.window)
        # an admitted call counts until its window has passed, whoever comes then
        held = [t for t in held if passed / 1e6 - t <= self.window]
        if due:
            self.waiting.put(calls[len(due) :]) if len(due) < len(calls) else self.waiting.clear()
        if held:
            self.held.update((held,))
            self.handle.registerTimer(int((held[-1] + self.window) * 1000) + 2)
        elif state:
            self.held.clear()
        made = Row("client", "bucket", "call_id", "admitted")
        return iter([made(*key, call_id, ok) for (_, call_id), ok in zip(due, admitted)])


def rate_limit_in_order(calls: DataFrame, most: int, window: float, delay: str) -> DataFrame:
    """A stream of calls (client, bucket, call_id, at) with admitted, as rules.rate_limit has them of a batch.

    A call is decided when the watermark, `delay` behind the latest call, has passed it; one that comes later than that is
    dropped. A call that is delivered twice before it is decided counts once. Start the query inside disk_state.
    """
    types = {f.name: f.dataType.simpleString() for f in calls.schema}
    keyed = calls.select("client", "bucket", "call_id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    keyed = keyed.withColumn("micros", F.unix_micros("at"))
    out = f"client {types['client']}, bucket {types['bucket']}, call_id {types['call_id']}, admitted boolean"
    return keyed.groupBy("client", "bucket").transformWithState(Limiter(most, window, types["call_id"]), out, "append", "EventTime")
