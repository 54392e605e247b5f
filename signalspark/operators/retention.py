"""Deletes, as the tables that are left, and what they lost (``removed``), by which a store rewrites the days
concerned (``Store.delete``).

A span takes its events and links with it and a metric its points; exemplars stay. A condition that is null is
not met, so rows without a time survive a range.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.columns import Bound, checked_range, in_range, nanos_of, required
from signalspark.schemas import POINT_TABLES
from signalspark.tables import SignalTables


def survivors(df: DataFrame, gone: Column) -> DataFrame:
    return df.where(~F.coalesce(gone, F.lit(False)))


#: Ids to remove that are broadcast at most (8 bytes each).
BROADCAST = 1_000_000


def _lost(ids: DataFrame, tables: dict[str, DataFrame], column: str) -> dict[str, DataFrame]:
    """The rows of child tables without those of some parents. The parents' ids, counted first, are broadcast if
    they are few, so that the rows that stay are not shuffled."""
    if not tables:
        return {}
    keys = ids.select(F.col("Id").alias(column))
    keys = F.broadcast(keys) if ids.count() <= BROADCAST else keys
    return {name: df.join(keys, column, "left_anti").select(*df.columns) for name, df in tables.items()}


def _without(t: SignalTables, parent: str, gone: Column, column: str, children: tuple[str, ...]) -> SignalTables:
    ids = t.table(parent).where(gone).select("Id")
    left = t.with_tables(**{parent: survivors(t.table(parent), gone)}, **_lost(ids, {c: t.table(c) for c in children}, column))
    left.removed = {c: (column, ids) for c in children} | {parent: ("Id", ids)}  # what refers to others goes first
    return left


def _without_spans(t: SignalTables, gone: Column) -> SignalTables:
    return _without(t, "spans", gone, "SpanId", ("span_events", "span_links"))


def _without_metrics(t: SignalTables, gone: Column) -> SignalTables:
    return _without(t, "metrics", gone, "MetricId", tuple(POINT_TABLES.values()))


def _without_logs(t: SignalTables, gone: Column) -> SignalTables:
    return _without(t, "log_records", gone, "", ())


def checked_ids(*ids: str) -> None:
    for value in ids:
        required(value, "an id")


def delete_trace(t: SignalTables, trace_id: str) -> SignalTables:
    checked_ids(trace_id)
    return _without_spans(t, F.col("TraceId") == trace_id)


def delete_span(t: SignalTables, trace_id: str, span_id: str) -> SignalTables:
    checked_ids(trace_id, span_id)
    return _without_spans(t, (F.col("TraceId") == trace_id) & (F.col("SpanId") == span_id))


def delete_traces_by_time_range(t: SignalTables, start: Bound, end: Bound) -> SignalTables:
    """Removes the spans that start within the range, not whole traces."""
    return _without_spans(t, in_range(F.col("StartTimeUnixNano"), *checked_range(start, end)))


def traces_in_range(t: SignalTables, start: Bound, end: Bound) -> DataFrame:
    """How many traces have a span in the range: what a delete of the range reports."""
    return t.spans.where(in_range(F.col("StartTimeUnixNano"), *checked_range(start, end))).agg(F.countDistinct("TraceId").alias("Deleted"))


def span_retention(t: SignalTables, now: datetime, keep: timedelta = timedelta(days=30)) -> SignalTables:
    """Removes the spans that start before ``now`` less ``keep``."""
    return _without_spans(t, F.col("StartTimeUnixNano") < nanos_of(now - keep))


def delete_log(t: SignalTables, log_id: int) -> SignalTables:
    return _without_logs(t, F.col("Id") == log_id)


def delete_logs_by_time_range(t: SignalTables, start: Bound, end: Bound) -> SignalTables:
    return _without_logs(t, in_range(F.col("TimeUnixNano"), *checked_range(start, end)))


def delete_metric(t: SignalTables, metric_id: int) -> SignalTables:
    return _without_metrics(t, F.col("Id") == metric_id)


def delete_metrics_by_name(t: SignalTables, name: str) -> SignalTables:
    return _without_metrics(t, F.col("Name") == required(name, "metric name"))


def delete_metrics_by_time_range(t: SignalTables, start: datetime, end: datetime) -> SignalTables:
    """Removes metrics stored within the range (both ends included)."""
    if start >= end:
        raise ValueError("the start of a range must lie before its end")
    return _without_metrics(t, F.col("CreatedAt").between(F.lit(start), F.lit(end)))


def delete_old_metrics(t: SignalTables, now: datetime, keep: timedelta) -> SignalTables:
    """Removes metrics stored before ``now`` less ``keep``."""
    return _without_metrics(t, F.col("CreatedAt") < F.lit(now - keep))


def deleted_count(before: SignalTables, after: SignalTables, table: str) -> int:
    """How many rows of a table a delete takes away."""
    return before.table(table).count() - after.table(table).count()
