"""Schemas of the tables. Times are epoch nanoseconds in longs, since Spark's timestamps hold microseconds;
bucket and quantile columns are native arrays; attributes are JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

# The enumerations of the protocol.
SPAN_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUS_CODES = ("UNSET", "OK", "ERROR")
METRIC_TYPES = ("GAUGE", "SUM", "HISTOGRAM", "EXPONENTIAL_HISTOGRAM", "SUMMARY")
TEMPORALITIES = ("UNSPECIFIED", "DELTA", "CUMULATIVE")
BODY_TYPES = ("STRING", "BOOL", "INT", "DOUBLE", "BYTES", "ARRAY", "KVLIST")

_POINT = "Id long, MetricId long, StartTimeUnixNano long, TimeUnixNano long"
_NUMBER = f"{_POINT}, ValueDouble double, ValueInt long, Flags int, ExemplarId long, AttributesJson string"

DDL = {
    "resources": "Id long, ResourceHash string, SchemaUrl string, CreatedAt timestamp, AttributesJson string",
    "instrumentation_scopes": "Id long, Name string, Version string, SchemaUrl string, ScopeHash string, CreatedAt timestamp, AttributesJson string",
    "spans": "Id long, TraceId string, SpanId string, ParentSpanId string, ResourceId long, ScopeId long, Name string, Kind string, "
    "StartTimeUnixNano long, EndTimeUnixNano long, DroppedAttributesCount int, DroppedEventsCount int, DroppedLinksCount int, "
    "TraceState string, StatusCode string, StatusMessage string, CreatedAt timestamp, AttributesJson string",
    "span_events": "Id long, SpanId long, Name string, TimeUnixNano long, DroppedAttributesCount int, AttributesJson string",
    "span_links": "Id long, SpanId long, LinkedTraceId string, LinkedSpanId string, TraceState string, DroppedAttributesCount int, AttributesJson string",
    "metrics": "Id long, ResourceId long, ScopeId long, Name string, Description string, Unit string, Type string, CreatedAt timestamp",
    "gauge_data_points": _NUMBER,
    "sum_data_points": f"{_NUMBER}, AggregationTemporality string, IsMonotonic boolean",
    "histogram_data_points": f"{_POINT}, Count long, SumValue double, BucketCounts array<long>, ExplicitBounds array<double>, "
    "AggregationTemporality string, Flags int, Min_Value double, Max_Value double, ExemplarId long, AttributesJson string",
    "exponential_histogram_data_points": f"{_POINT}, Count long, SumValue double, Scale int, ZeroCount long, PositiveOffset int, "
    "PositiveBucketCounts array<long>, NegativeOffset int, NegativeBucketCounts array<long>, AggregationTemporality string, "
    "Flags int, Min_Value double, Max_Value double, ExemplarId long, AttributesJson string",
    "summary_data_points": f"{_POINT}, Count long, SumValue double, QuantileValues array<struct<Quantile:double,Value:double>>, Flags int, AttributesJson string",
    "exemplars": "Id long, FilteredAttributes string, TimeUnixNano long, ValueDouble double, ValueInt long, SpanId string, TraceId string",
    "log_records": "Id long, ResourceId long, ScopeId long, TimeUnixNano long, ObservedTimeUnixNano long, SeverityNumber int, SeverityText string, "
    "BodyType string, BodyValue string, DroppedAttributesCount int, Flags int, TraceId string, SpanId string, CreatedAt timestamp, AttributesJson string",
    "schema_version": "Version string, AppliedAt timestamp",
}

def schema(table: str) -> T.StructType:
    """The schema of a table."""
    return T.StructType.fromDDL(DDL[table])


#: Columns whose values are enumerated.
ENUMS = {
    ("spans", "Kind"): SPAN_KINDS, ("spans", "StatusCode"): STATUS_CODES, ("metrics", "Type"): METRIC_TYPES,
    ("sum_data_points", "AggregationTemporality"): TEMPORALITIES, ("histogram_data_points", "AggregationTemporality"): TEMPORALITIES,
    ("exponential_histogram_data_points", "AggregationTemporality"): TEMPORALITIES, ("log_records", "BodyType"): BODY_TYPES,
}

#: Table of the points of each metric type.
POINT_TABLES = {
    "GAUGE": "gauge_data_points", "SUM": "sum_data_points", "HISTOGRAM": "histogram_data_points",
    "EXPONENTIAL_HISTOGRAM": "exponential_histogram_data_points", "SUMMARY": "summary_data_points",
}

#: Tables that are stored by the day of a time, and their times: the first that isn't null counts.
DAYS = {"spans": ("StartTimeUnixNano",), "log_records": ("TimeUnixNano", "ObservedTimeUnixNano")} | {t: ("TimeUnixNano",) for t in POINT_TABLES.values()}

#: Tables whose ids are hashes of what their rows say.
DIMENSIONS = ("resources", "instrumentation_scopes")
