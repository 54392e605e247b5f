"""Hand-written cases: bounds, nulls, ties, cascades, ids and attributes."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalspark.functions.columns import in_range, nanos_of, service_name
from signalspark.operators import logs, metrics, retention, traces
from signalspark.schemas import schema
from signalspark.tables import SignalTables

MS = 1_000_000


def table(spark, name, *rows):
    full = schema(name)
    return spark.createDataFrame([tuple(row.get(f.name) for f in full.fields) for row in rows], full)


def span(i, trace, parent=None, resource=1, start=0, end=0, status="UNSET", **more):
    return {"Id": i, "TraceId": trace, "SpanId": f"s{i}", "ParentSpanId": parent, "ResourceId": resource, "ScopeId": 1, "Name": "op", "Kind": "SERVER", "StartTimeUnixNano": start, "EndTimeUnixNano": end, "StatusCode": status} | more


@pytest.fixture(scope="module")
def t(spark):
    data = {
        "resources": [{"Id": 1, "AttributesJson": '{"service.name":"a"}'}, {"Id": 2, "AttributesJson": '{"service.name":"b"}'}, {"Id": 3, "AttributesJson": "{}"}, {"Id": 4, "AttributesJson": None}, {"Id": 5, "AttributesJson": "not json"}],
        "instrumentation_scopes": [{"Id": 1, "Name": "lib"}],
        "spans": [
            span(1, "t1", start=10 * MS, end=20 * MS),
            span(2, "t1", "s1", 2, 11 * MS, 12 * MS, "ERROR"),
            span(3, "t1", "s1", 1, 13 * MS, 13 * MS),  # same service: no call
            span(4, "t1", "gone", 2),  # orphan
            span(5, "t2", "s1", 2),  # the parent's id, in another trace
            span(6, "t1", "s1", 3),  # no service
            span(7, "t3", start=5 * MS, end=3 * MS),  # ends before it starts
        ],
        "span_events": [{"Id": 1, "SpanId": 2, "Name": "exception", "TimeUnixNano": 1}],
        "span_links": [{"Id": 1, "SpanId": 2, "LinkedTraceId": "t9", "LinkedSpanId": "s9"}],
        "metrics": [
            {"Id": 1, "ResourceId": 1, "ScopeId": 1, "Name": "m", "Type": "GAUGE"},
            {"Id": 2, "ResourceId": 1, "ScopeId": 1, "Name": "m", "Type": "SUM"},
            {"Id": 3, "ResourceId": 1, "ScopeId": 1, "Name": "g", "Type": "GAUGE"},
            {"Id": 4, "ResourceId": 4, "ScopeId": 1, "Name": "n", "Type": "SUMMARY"},
            {"Id": 5, "ResourceId": 3, "ScopeId": 1, "Name": "n", "Type": "EXPONENTIAL_HISTOGRAM"},
        ],
        "gauge_data_points": [
            {"Id": 1, "MetricId": 1, "TimeUnixNano": 9, "ValueDouble": 5.0, "AttributesJson": '{"k":true,"n":5,"z":null}'},
            {"Id": 2, "MetricId": 3, "TimeUnixNano": 7, "ValueInt": 1},
            {"Id": 3, "MetricId": 3, "TimeUnixNano": 7},
        ],
        "sum_data_points": [{"Id": 1, "MetricId": 2, "TimeUnixNano": 1, "ValueInt": 3}],
        "exemplars": [{"Id": 1, "TimeUnixNano": 1, "TraceId": "t1", "SpanId": "s1"}],
        "log_records": [
            {"Id": 1, "ResourceId": 1, "ScopeId": 1, "TraceId": "t1", "SeverityNumber": 17, "TimeUnixNano": 5, "BodyValue": "An ERROR_X, here"},
            {"Id": 2, "ResourceId": 1, "ScopeId": 1, "TraceId": "t1", "SeverityNumber": None, "TimeUnixNano": None, "BodyValue": "error"},
        ],
    }
    return SignalTables(**{name: table(spark, name, *data.get(name, [])) for name in SignalTables.names()})


def test_service_map_ignores_orphans_own_service_and_other_traces(t):
    assert [tuple(r) for r in traces.service_map(t).collect()] == [("a", "b", "SERVER", 1)]
    row = traces.service_map_detailed(t).first()
    assert (row["AvgDurationMs"], row["ErrorCount"], row["ErrorRate"]) == (1.0, 1, 100.0)


def test_error_traces_count_only_errors(t):
    row = traces.error_traces(t).first()
    assert (row["TraceId"], row["SpanCount"], row["HasErrors"]) == ("t1", 1, True)


def test_slow_traces_keep_the_bound_itself(t):
    assert [r["TraceId"] for r in traces.slow_traces(t, timedelta(milliseconds=20)).collect()] == ["t1"]
    assert traces.slow_traces(t, timedelta(milliseconds=20, microseconds=1)).count() == 0


def test_negative_durations_are_kept(t):
    assert traces.slow_traces(t, timedelta(0)).where("TraceId = 't3'").count() == 0
    assert traces.traces_by_time_range(t, 5 * MS, 6 * MS).first()["DurationMs"] == -2


def test_ranges(t, spark):
    assert traces.traces_by_time_range(t, 10 * MS, 11 * MS).first()["SpanCount"] == 2
    with pytest.raises(ValueError):
        traces.traces_by_time_range(t, 5, 5)
    with pytest.raises(ValueError):
        traces.trace_by_id(t, "")
    assert nanos_of(datetime(1970, 1, 1, 0, 0, 0, 1999)) == nanos_of(datetime(1970, 1, 1, 0, 0, 0, 1000, tzinfo=UTC)) == MS
    assert spark.range(1).where(in_range(F.col("id"))).count() == 1


def test_trace_has_children(t):
    rows = {r["SpanId"]: r for r in traces.trace_by_id(t, "t1").collect()}
    assert len(rows) == 5 and len(rows["s2"]["Events"]) == len(rows["s2"]["Links"]) == 1 and rows["s1"]["Events"] == []


def test_service_name_of_odd_json(spark):
    df = spark.createDataFrame([('{"service.name":5}',), ('{"service.name":null}',), ("{",), (None,)], "a string")
    assert [r[0] for r in df.select(service_name(F.col("a"))).collect()] == ["5", None, None, None]


def test_logs(t):
    assert [r["Id"] for r in logs.logs_by_trace(t, "t1").collect()] == [2, 1]
    assert [r["Id"] for r in logs.logs_by_severity(t, 1).collect()] == [1]
    assert [r["Id"] for r in logs.log_fulltext_search(t, "ERROR").collect()] == [2]
    with pytest.raises(ValueError):  # no word is long enough
        logs.log_fulltext_search(t, "an")
    assert logs.log_fulltext_search(t, "error nothing", relevance=True).first()["Score"] > 0


def test_latest_values(t):
    assert {r["Name"]: r["Value"] for r in metrics.latest_metric_values(t, "a").collect()} == {"m": 3.0, "g": 0.0}


def test_labels(t):
    assert [tuple(r) for r in metrics.metric_labels(t, "m").collect()] == [("k", "true"), ("n", "5"), ("z", "")]


def test_summaries_name_the_nameless(t):
    rows = {r["ServiceName"]: r for r in metrics.service_metric_summaries(t).collect()}
    assert set(rows) == {"a", "", "unknown"} and rows["unknown"]["HistogramCount"] == 1
    assert metrics.metric_series(t, "nothing").count() == 0
    with pytest.raises(ValueError):
        metrics.metrics_by_type(t, "ODD")


def test_deletes_cascade(t):
    left = retention.delete_span(t, "t1", "s2")
    assert (left.spans.count(), left.span_events.count(), left.span_links.count()) == (6, 0, 0)
    assert retention.delete_trace(t, "none").spans.count() == 7
    gone = retention.delete_metrics_by_name(t, "m")
    assert (gone.metrics.count(), gone.gauge_data_points.count(), gone.sum_data_points.count(), gone.exemplars.count()) == (3, 2, 0, 1)
    assert [r["Id"] for r in retention.delete_logs_by_time_range(t, 1, 10).log_records.collect()] == [2]
    assert retention.deleted_count(t, left, "spans") == 1
