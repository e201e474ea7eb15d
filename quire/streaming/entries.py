"""Key-value entries with a time to live, and status changes, as keyed state of a stream.

Both take events in any order of arrival within a key's batches and keep the last by event time, then by
number. Timers in event time purge what has expired: the watermark is the "now" of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_CHANGE = "cache_key string, value string, expires_ms long, change string"


class Entries(StatefulProcessor):
    """A key's entry: its value, until when, and which write it is from; a timer ends it.

    Rows, not frames, since a key has few of them, and each call to the state is a message: a new key takes one to read, one to write and one for its timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires_ms long, written_ms long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r["written_ms"], r["event_id"]))
        held = self.entry.get()
        if held is not None and (held[2], held[3]) >= (last["written_ms"], last["event_id"]):
            return
        if held is not None and held[1] is not None:  # only such an entry has a timer
            for ms in list(self.handle.listTimers()):
                self.handle.deleteTimer(ms)
        expires = last["expires_ms"]
        self.entry.update((last["value"], expires, last["written_ms"], last["event_id"]))
        if expires is not None:
            self.handle.registerTimer(max(expires, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(cache_key=key[0], value=last["value"], expires_ms=expires, change="set")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.entry.get()
        if held is not None:
            self.entry.clear()
            yield Row(cache_key=key[0], value=held[0], expires_ms=held[1], change="purged")

    def close(self) -> None:
        pass


def entries_stream(writes: DataFrame, late: str = "1 minute") -> DataFrame:
    """Changes of entries from a stream of ``writes`` (``cache_key, value, ttl_s, at, event_id``): each ``set`` that takes effect, and ``purged`` once its time is over.

    A null ``ttl_s`` never ends. Of writes to a key the last by ``at`` counts, then by ``event_id``. Needs the RocksDB state store.
    """
    ms = (F.unix_micros("at") / 1000).cast("long")
    rows = writes.withWatermark("at", late).select("cache_key", "value", "at", "event_id", ms.alias("written_ms"), (ms + F.col("ttl_s") * 1000).alias("expires_ms"))
    return rows.groupBy("cache_key").transformWithState(Entries(), _CHANGE, "Append", "EventTime").select("cache_key", "value", F.timestamp_millis("expires_ms").alias("expires_at"), "change")


def live_entries(writes: DataFrame, now_s: int) -> DataFrame:
    """The batch form at a moment: the last write of each key, those that have not expired (``expires_at`` after now, or none)."""
    last = writes.groupBy("cache_key").agg(F.max_by(F.struct("value", "ttl_s", "at"), F.struct("at", "event_id")).alias("w")).select("cache_key", "w.*")
    expires = F.when(F.col("ttl_s").isNotNull(), F.timestamp_micros(F.unix_micros("at") + F.col("ttl_s") * 1_000_000))
    return last.select("cache_key", "value", expires.alias("expires_at")).filter(F.col("expires_at").isNull() | (F.unix_timestamp("expires_at") > now_s))


_STATUS = "doc_uuid string, before string, status string, at timestamp"


class Status(StatefulProcessor):
    """A document's last status, told when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, at_ms long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else (None, -1, -1)
        changes = []
        for status, ms, event in pd.concat(list(rows)).sort_values(["at_ms", "event_id"])[["status", "at_ms", "event_id"]].itertuples(index=False):
            if (ms, event) <= (held[1], held[2]):
                continue
            if status != held[0]:
                changes.append((key[0], held[0], status, pd.Timestamp(ms, unit="ms")))
            held = (status, int(ms), int(event))
        if held[0] is not None:
            self.last.update(held)
        if changes:
            yield pd.DataFrame(changes, columns=["doc_uuid", "before", "status", "at"])

    def close(self) -> None:
        pass


def status_feed(seen: DataFrame) -> DataFrame:
    """Changes of status (``doc_uuid, before, status, at``) from a stream of what was seen (``doc_uuid, status, at, event_id``); what repeats or is older than the last says nothing."""
    rows = seen.select("doc_uuid", "status", "event_id", (F.unix_micros("at") / 1000).cast("long").alias("at_ms"))
    return rows.groupBy("doc_uuid").transformWithStateInPandas(Status(), _STATUS, "Append", "None")


def status_changes(seen: DataFrame) -> DataFrame:
    """The batch form: of each document's statuses in order of time those that differ from the one before."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("doc_uuid").orderBy("at", "event_id"))  # the statuses of one document
    return seen.withColumn("before", before).filter(~F.col("status").eqNullSafe(F.col("before"))).select("doc_uuid", "before", "status", "at")
