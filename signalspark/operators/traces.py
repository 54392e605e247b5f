"""Traces: lookups, summaries, service maps and latencies.

Joins with resources and scopes leave the choice of the algorithm to Spark: the tables are small as a rule and are
broadcast where their size allows it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions.attributes import Path, where
from signalspark.functions.columns import NANOS_A_MS, Bound, checked_range, collated, duration_ms, in_range, millis, required, to_time
from signalspark.tables import SignalTables

TOP = 100


def _with_children(t: SignalTables, spans: DataFrame) -> DataFrame:
    """Spans with their resource, scope, and arrays of events and links, empty where there are none."""
    events = t.span_events.join(spans.select(F.col("Id").alias("SpanId")), "SpanId", "left_semi").groupBy("SpanId")
    events = events.agg(F.array_sort(F.collect_list(F.struct("TimeUnixNano", "Id", "Name"))).alias("Events")).withColumnRenamed("SpanId", "Id")
    links = t.span_links.join(spans.select(F.col("Id").alias("SpanId")), "SpanId", "left_semi").groupBy("SpanId")
    links = links.agg(F.array_sort(F.collect_list(F.struct("Id", "LinkedTraceId", "LinkedSpanId"))).alias("Links")).withColumnRenamed("SpanId", "Id")
    joined = spans.join(t.services(), "ResourceId", "left").join(t.scopes(), "ScopeId", "left").join(events, "Id", "left").join(links, "Id", "left")
    return joined.withColumn("Events", F.coalesce("Events", F.array())).withColumn("Links", F.coalesce("Links", F.array()))


def trace_by_id(t: SignalTables, trace_id: str) -> DataFrame:
    """All spans of a trace with resource, scope, events and links, by start."""
    return _with_children(t, t.spans.where(F.col("TraceId") == required(trace_id, "trace id"))).orderBy("StartTimeUnixNano", "SpanId")


def span_by_id(t: SignalTables, trace_id: str, span_id: str) -> DataFrame:
    """One span, or no row. The pair of ids is unique in a store."""
    mine = (F.col("TraceId") == required(trace_id, "trace id")) & (F.col("SpanId") == required(span_id, "span id"))
    return _with_children(t, t.spans.where(mine)).limit(1)


def spans_by_parent(t: SignalTables, trace_id: str, parent_span_id: str) -> DataFrame:
    """The direct children of a span, by start."""
    mine = (F.col("TraceId") == required(trace_id, "trace id")) & (F.col("ParentSpanId") == required(parent_span_id, "parent span id"))
    return _with_children(t, t.spans.where(mine)).orderBy("StartTimeUnixNano", "SpanId")


def _infos(spans: DataFrame) -> DataFrame:
    """One row per trace over the given spans only: a filter in front narrows counts and times as well."""
    return spans.groupBy("TraceId").agg(
        F.count("*").alias("SpanCount"),
        F.min("StartTimeUnixNano").alias("StartNano"),
        F.max("EndTimeUnixNano").alias("EndNano"),
        F.bool_or(F.col("StatusCode") == "ERROR").alias("HasErrors"),
    )


def _shown(infos: DataFrame) -> DataFrame:
    """Times in milliseconds; the duration is that between the cut-off times."""
    kept = [c for c in infos.columns if c not in ("StartNano", "EndNano")]
    return infos.select(*kept, to_time(F.col("StartNano")).alias("StartTime"), to_time(F.col("EndNano")).alias("EndTime"), (millis(F.col("EndNano")) - millis(F.col("StartNano"))).alias("DurationMs"))


def _latest(infos: DataFrame, limit: int) -> DataFrame:
    return _shown(infos.orderBy(F.desc("StartNano"), "TraceId").limit(limit))


def traces_by_time_range(t: SignalTables, start: Bound, end: Bound, limit: int = TOP) -> DataFrame:
    """The latest traces among the spans that start within the range (both ends included)."""
    return _latest(_infos(t.spans.where(in_range(F.col("StartTimeUnixNano"), *checked_range(start, end)))), limit)


def traces_by_service(t: SignalTables, service: str, start: Bound = None, end: Bound = None, limit: int = TOP) -> DataFrame:
    """The latest traces among one service's spans; counts and times are those of these spans."""
    spans = of_service(t, service).where(in_range(F.col("StartTimeUnixNano"), start, end))
    return _latest(_infos(spans).withColumn("ServiceName", F.lit(service)), limit)


def error_traces(t: SignalTables, start: Bound = None, end: Bound = None, limit: int = TOP) -> DataFrame:
    """The latest traces with an error; ``SpanCount`` counts the spans in error."""
    spans = t.spans.where((F.col("StatusCode") == "ERROR") & in_range(F.col("StartTimeUnixNano"), start, end))
    return _latest(_infos(spans), limit)


def slow_traces(t: SignalTables, at_least: timedelta, start: Bound = None, end: Bound = None, limit: int = TOP) -> DataFrame:
    """The longest traces that take ``at_least`` (in nanoseconds, before times are cut off) or more."""
    infos = _infos(t.spans.where(in_range(F.col("StartTimeUnixNano"), start, end))).withColumn("Nano", F.col("EndNano") - F.col("StartNano"))
    least = int(at_least.total_seconds() * 1000 * NANOS_A_MS)
    return _shown(infos.where(F.col("Nano") >= least).orderBy(F.desc("Nano"), "TraceId").limit(limit).drop("Nano"))


def of_service(t: SignalTables, service: str) -> DataFrame:
    """The spans of a service."""
    resources = t.services().where(F.col("ServiceName") == required(service, "service name")).select("ResourceId")
    return t.spans.join(resources, "ResourceId", "left_semi")


def spans_by_attribute(t: SignalTables, path: Path, value: str | float | bool, comparison: str = "=", start: Bound = None, end: Bound = None) -> DataFrame:
    """The spans whose attribute at a path (of keys and places in lists) compares so with a value of its type, by start."""
    mine = t.spans.where(in_range(F.col("StartTimeUnixNano"), start, end))
    return mine.where(where(F.col("AttributesJson"), path, value, comparison)).orderBy("StartTimeUnixNano", "SpanId")


def operation_names(t: SignalTables, collation: str | None = None) -> DataFrame:
    """Spans by name; with a collation names that are equal in it count together, under the smallest of them."""
    return t.spans.groupBy(collated(F.col("Name"), collation).alias("__name")).agg(F.min("Name").alias("Name"), F.count("*").alias("SpanCount")).drop("__name")


def trace_summary(t: SignalTables, hex_id: str | None = None) -> DataFrame:
    """One row per trace and resource. ``TraceIdHex`` is the hex of the id's text."""
    spans = t.spans.withColumn("TraceIdHex", F.hex("TraceId"))
    if hex_id is not None:
        spans = spans.where(F.col("TraceIdHex") == hex_id)
    joined = spans.join(t.resources.select(F.col("Id").alias("ResourceId")), "ResourceId")
    grouped = joined.groupBy("TraceId", "ResourceId", "TraceIdHex")
    return grouped.agg(
        F.count("*").alias("SpanCount"),
        F.min("StartTimeUnixNano").alias("TraceStartTime"),
        F.max("EndTimeUnixNano").alias("TraceEndTime"),
        (F.max("EndTimeUnixNano") - F.min("StartTimeUnixNano")).alias("TraceDurationNs"),
    )


def calls(t: SignalTables, start: Bound = None, end: Bound = None) -> DataFrame:
    """A row per call from one service to another: the child's kind, duration and status with both names. A
    span whose parent is missing, in the same service, or without a service name is no call. The range
    is that of the child's start."""
    services = t.services().where("ServiceName IS NOT NULL").select("ResourceId", "ServiceName")
    named = t.spans.join(services, "ResourceId")
    parent = t.referred_spans.join(services, "ResourceId").select("TraceId", F.col("SpanId").alias("ParentSpanId"), F.col("ServiceName").alias("ParentService"))
    child = named.where(F.col("ParentSpanId").isNotNull() & in_range(F.col("StartTimeUnixNano"), start, end)).select(
        "TraceId", "ParentSpanId", F.col("ServiceName").alias("ChildService"), F.col("Kind").alias("SpanKind"), (F.col("EndTimeUnixNano") - F.col("StartTimeUnixNano")).alias("Nano"), "StatusCode"
    )
    return child.join(parent, ["TraceId", "ParentSpanId"]).where("ParentService <> ChildService")


_EDGE = ("ParentService", "ChildService", "SpanKind")


def service_map(t: SignalTables) -> DataFrame:
    return calls(t).groupBy(*_EDGE).agg(F.count("*").alias("CallCount"))


def service_map_detailed(t: SignalTables, start: Bound = None, end: Bound = None) -> DataFrame:
    """Calls between services with their durations in milliseconds, errors and error rate in percent."""
    ms = lambda c: c / F.lit(NANOS_A_MS)
    errors = F.count_if(F.col("StatusCode") == "ERROR")
    return calls(t, start, end).groupBy(*_EDGE).agg(
        F.count("*").alias("CallCount"),
        ms(F.avg("Nano")).alias("AvgDurationMs"),
        ms(F.min("Nano")).alias("MinDurationMs"),
        ms(F.max("Nano")).alias("MaxDurationMs"),
        errors.alias("ErrorCount"),
        (errors / F.count("*") * 100).alias("ErrorRate"),
    )


def service_dependencies(t: SignalTables, start: Bound = None, end: Bound = None) -> DataFrame:
    """The detailed map, the most frequent calls first."""
    return service_map_detailed(t, start, end).orderBy(F.desc("CallCount"), *_EDGE)


def service_map_by_calls(t: SignalTables) -> DataFrame:
    return service_dependencies(t).select("ParentService", "ChildService", "SpanKind", "CallCount", "AvgDurationMs", "ErrorRate")


def operation_counts(t: SignalTables, service: str, start: Bound = None, end: Bound = None) -> DataFrame:
    """Spans of a service by name."""
    return of_service(t, service).where(in_range(F.col("StartTimeUnixNano"), start, end)).groupBy("Name").agg(F.count("*").alias("SpanCount"))


def average_latencies(t: SignalTables, service: str, start: Bound = None, end: Bound = None) -> DataFrame:
    """Mean duration of a service's spans by name, in milliseconds."""
    spans = of_service(t, service).where(in_range(F.col("StartTimeUnixNano"), start, end))
    return spans.groupBy("Name").agg(F.avg(duration_ms(F.col("StartTimeUnixNano"), F.col("EndTimeUnixNano"))).alias("AvgDurationMs"))


def slow_operations(t: SignalTables, over_ms: float = 1000) -> DataFrame:
    """Span names whose mean duration is over a bound, the slowest first."""
    mean = F.avg(F.col("EndTimeUnixNano") - F.col("StartTimeUnixNano")) / NANOS_A_MS
    return t.spans.groupBy("Name").agg(mean.alias("AvgDurationMs")).where(F.col("AvgDurationMs") > over_ms).orderBy(F.desc("AvgDurationMs"), "Name")


def root_spans(t: SignalTables) -> DataFrame:
    """Name and service of each trace's first span without a parent."""
    roots = t.spans.where("ParentSpanId IS NULL").join(t.services(), "ResourceId", "left")
    first = F.min(F.struct("StartTimeUnixNano", "SpanId", "Name", "ServiceName"))
    return roots.groupBy("TraceId").agg(first.alias("r")).select("TraceId", F.col("r.Name").alias("RootOperationName"), F.col("r.ServiceName").alias("RootService"))


def linked_spans(t: SignalTables) -> DataFrame:
    """Each link with the span it leads from and the one it leads to (null if that is not in the store)."""
    own = t.spans.select(F.col("Id").alias("SpanId"), F.col("TraceId"), F.col("Name").alias("FromName"))
    other = t.referred_spans.select(F.col("TraceId").alias("LinkedTraceId"), F.col("SpanId").alias("LinkedSpanId"), F.col("Name").alias("ToName"))
    return t.span_links.join(own, "SpanId").join(other, ["LinkedTraceId", "LinkedSpanId"], "left").select("Id", "TraceId", "FromName", "LinkedTraceId", "LinkedSpanId", "ToName")
