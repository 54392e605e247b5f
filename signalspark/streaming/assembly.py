"""Traces put together from a stream of spans, with state for each trace.

A trace is complete when no span of it has arrived for a while; then it is emitted, once. Spans that come later make it
open again, and after another silence it is emitted anew with all its spans, marked as a correction. The state of a trace
is a handful of numbers, whatever its size, and goes some time after its last span.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: What streams with state of this kind need: the provider that holds several values and timers for a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TRACE = "TraceId string, SpanCount long, ErrorCount long, StartTimeUnixNano long, EndTimeUnixNano long, RootName string, Revision int, Correction boolean"
_STATE = "spans long, errors long, start long, finish long, root string, root_start long, revision int, open boolean, last_ms long"


class Assembly(StatefulProcessor):
    def __init__(self, silence_ms: int, keep_ms: int):
        self.silence, self.keep = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState("trace", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.trace.get() if self.trace.exists() else (0, 0, None, None, None, None, 0, False, 0)
        spans, errors, start, finish, root, root_start, revision, _, last = held
        for row in rows:
            spans, errors = spans + 1, errors + (row.StatusCode == "ERROR")
            start = row.StartTimeUnixNano if start is None else min(start, row.StartTimeUnixNano)
            finish = row.EndTimeUnixNano if finish is None else max(finish, row.EndTimeUnixNano)
            if row.ParentSpanId is None and (root_start is None or (row.StartTimeUnixNano, row.Name or "") < (root_start, root or "")):
                root, root_start = row.Name, row.StartTimeUnixNano
            last = max(last, int(row.ArrivalMs))
        self.trace.update((spans, errors, start, finish, root, root_start, revision, True, last))
        self.again(last + self.silence)
        return iter(())

    def again(self, at: int) -> None:
        """One timer a trace, at a time in milliseconds."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.trace.exists():
            return
        spans, errors, start, finish, root, root_start, revision, open_, last = self.trace.get()
        if not open_:  # emitted, and nothing has come for so long that it goes
            self.trace.clear()
            return
        self.trace.update((spans, errors, start, finish, root, root_start, revision + 1, False, last))
        self.handle.registerTimer(last + self.silence + self.keep)
        yield Row(TraceId=key[0], SpanCount=spans, ErrorCount=errors, StartTimeUnixNano=start, EndTimeUnixNano=finish, RootName=root, Revision=revision, Correction=revision > 0)

    def close(self) -> None:
        """There is nothing to give back."""


def assembled_traces(spans: DataFrame, silence_ms: int = 30_000, keep_ms: int = 24 * 3_600_000, lateness: str = "0 seconds") -> DataFrame:
    """A row for each trace of a stream of ``spans`` when nothing of it has arrived for ``silence_ms``: spans, errors, times, the first
    root's name (null without one), and ``Revision``, 0 at first. Spans that arrive in the ``keep_ms`` after that lead to a row with
    the next revision and ``Correction``; later ones begin the trace anew. The stream has a timestamp ``Arrival``, by which silence
    is measured, so that spans may start at any time; those that are out of order by more than ``lateness`` are dropped by Spark.
    Spans without a trace id take no part. The session needs :data:`PROVIDER` as its state store."""
    named = spans.where("TraceId IS NOT NULL AND Arrival IS NOT NULL").withWatermark("Arrival", lateness)
    rows = named.select("TraceId", "Name", "ParentSpanId", "StatusCode", "StartTimeUnixNano", "EndTimeUnixNano", "Arrival", F.unix_millis("Arrival").alias("ArrivalMs"))
    return rows.groupBy("TraceId").transformWithState(Assembly(silence_ms, keep_ms), TRACE, "Append", "EventTime")


def traces_of(spans: DataFrame) -> DataFrame:
    """The same rows of a batch, in which all of a trace is there at once."""
    root = F.min(F.when(F.col("ParentSpanId").isNull(), F.struct("StartTimeUnixNano", "Name")))
    grouped = spans.where("TraceId IS NOT NULL").groupBy("TraceId").agg(
        F.count("*").alias("SpanCount"), F.count_if(F.col("StatusCode") == "ERROR").alias("ErrorCount"), F.min("StartTimeUnixNano").alias("StartTimeUnixNano"), F.max("EndTimeUnixNano").alias("EndTimeUnixNano"), root["Name"].alias("RootName")
    )
    return grouped.withColumns({"Revision": F.lit(0), "Correction": F.lit(False)})
