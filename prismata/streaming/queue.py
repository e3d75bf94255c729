"""A work queue in which a key waits or runs at most once (N6): keyed state with timers.

A request for a key that is queued or in flight is refused. A key is free again when its work is
done, or when nothing happened to it for the length of a lease (its worker was lost). State
is one small row for each busy key; an event-time timer removes it when the lease ends, so
idle keys cost nothing. A lease is judged by the times of the events, not by when a timer
fires: however the events fall into batches, and after a restart from the checkpoint, the
same rows come out.

One batch's events of a key are sorted in the key's task; bound a batch by
maxBytesPerTrigger of the source. Events of a key must not be later than the watermark's
delay, or they are judged after those that overtook them. Events without a key or a time are
dropped; equal times go by the event's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "event_id bigint, key bigint, action string, outcome string, freed_by string"
STATE = "status string, since bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def judge(status: str | None, since: int, action: str, at: int, lease: int) -> tuple[str, str | None, str | None, int]:
    """(outcome, freed_by, status, since) of one event; at, since and lease in microseconds.

    request: accepted (freed_by: new, done or timeout) or refused. start: of a queued key.
    done: of a busy one. What does not fit is ignored.
    """
    expired = status in ("queued", "running") and at >= since + lease
    now = "timeout" if expired else status
    busy = now in ("queued", "running")
    if action == "request":
        return ("refused", None, now, since) if busy else ("accepted", now or "new", "queued", at)
    if action == "start" and now == "queued":
        return "started", None, "running", at
    if action == "done" and busy:
        return "done", None, "done", at
    return "ignored", None, now, since


class Leases(StatefulProcessor):
    """Input: event_id, key, at (microseconds), action."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, since = self.state.get() if self.state.exists() else (None, 0)
        events = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        out = []
        for event_id, action, at in zip(events["event_id"].tolist(), events["action"].tolist(), events["at"].tolist()):
            outcome, freed, status, since = judge(status, since, action, at, self.lease)
            out.append((event_id, key[0], action, outcome, freed))
        if status is not None:
            self.state.update((status, since))
            if status in ("queued", "running"):
                self.handle.registerTimer((since + self.lease) // 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "key", "action", "outcome", "freed_by"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, since = self.state.get()
            if status in ("queued", "running") and (since + self.lease) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update(("timeout", since))  # the next request says what freed the key
        return iter(())

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, lease_seconds: int, delay: str = "1 minute") -> DataFrame:
    """OUT of each event of a stream. events: event_id, key, ts (timestamp), action (request, start or done)."""
    known = events.filter("key IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = known.withWatermark("ts", delay).selectExpr("event_id", "key", "ts", "unix_micros(ts) AS at", "action")
    return timed.groupBy("key").transformWithStateInPandas(Leases(lease_seconds * 1_000_000), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run_queue(spark: SparkSession, events: DataFrame, sink: str, checkpoint: str, lease_seconds: int) -> None:
    """Judge what is new in events, once, into the Parquet table sink; each event comes out once, after a restart too."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        out = outcomes(events, lease_seconds)
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
