"""Export requests to rows, into a store, and as a stream."""

import json

import pytest

from signalspark.operators import traces
from signalspark.plans import views
from signalspark.plans.ingest import ingest_logs, ingest_metrics, ingest_traces
from signalspark.sources import otlp
from signalspark.sources.store import Store
from signalspark.streaming import ingest as streaming

TRACE, SPAN = "0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331"


def attribute(key, **value):
    return {"key": key, "value": value}


def request(spans, attributes=None, scope=None):
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attributes or [attribute("service.name", stringValue="a")]}, "scopeSpans": [{"scope": scope or {"name": "lib"}, "spans": spans}]}]})


def one(**more):
    return {"traceId": TRACE, "spanId": SPAN, "name": "op", "kind": 2, "startTimeUnixNano": "1700000000000000001", "endTimeUnixNano": "1700000000000000005"} | more


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_attributes(spark):
    attributes = [
        attribute("b", intValue="9007199254740993"), attribute("a", stringValue='x"y'), attribute("a", boolValue=True), attribute("", stringValue="dropped"), attribute("none"),
        attribute("d", doubleValue=0.5), attribute("l", arrayValue={"values": [{"intValue": 1}, {}, {"stringValue": "z"}]}), attribute("m", kvlistValue={"values": [attribute("k", bytesValue="AQI=")]}),
    ]
    row = otlp.spans(frame(spark, request([one(attributes=attributes)]))).first()
    assert json.loads(row["AttributesJson"]) == {"a": True, "b": 9007199254740993, "d": 0.5, "l": [1, "z"], "m": {"k": "AQI="}}
    assert row["AttributesJson"].startswith('{"a":true,"b":9007199254740993')


def test_ids_and_enumerations(spark):
    spans = [one(traceId="AB" * 16), one(traceId="ab" * 15), one(spanId="zz" * 8), one(kind="SPAN_KIND_CLIENT", status={"code": "STATUS_CODE_ERROR", "message": ""}), one(kind=99, status={"code": 2})]
    rows = otlp.spans(frame(spark, request(spans))).collect()
    assert [r["Rejected"] for r in rows] == [None, "trace id", "span id", None, None]
    assert rows[0]["TraceId"] == "ab" * 16 and (rows[3]["Kind"], rows[3]["StatusCode"], rows[3]["StatusMessage"]) == ("CLIENT", "ERROR", None)
    assert (rows[4]["Kind"], rows[4]["StatusCode"]) == ("UNSPECIFIED", "ERROR")


def test_links_and_duplicates(spark):
    links = [{"traceId": TRACE, "spanId": SPAN}, {"traceId": "x", "spanId": SPAN}]
    batch = ingest_traces(frame(spark, request([one(links=links, events=[{"name": "e", "timeUnixNano": "5"}]), one(name="later"), one(traceId="bad")]), "no json"))
    assert [r["Name"] for r in batch.tables["spans"].collect()] == ["op"] and [r["Name"] for r in batch.tables["span_events"].collect()] == ["e"]
    assert tuple(batch.report.first()) == ("traces", 1, 1, 1, 1) and batch.tables["span_links"].count() == 1
    assert all(r["TraceState"] == "unknown" for r in batch.tables["span_links"].collect())
    with pytest.raises(ValueError):
        ingest_traces(frame(spark, request([one(), one()])), strict=True)


def test_attribute_order_makes_no_other_resource(spark):
    a, b = attribute("service.name", stringValue="a"), attribute("host", stringValue="h")
    batch = ingest_traces(frame(spark, request([one()], [a, b]), request([one(spanId="00" * 8)], [b, a])))
    assert batch.tables["resources"].count() == 1
    bare = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [one()]}]}]})
    unknown = ingest_traces(frame(spark, bare))
    assert unknown.tables["resources"].first()["AttributesJson"] == '{"service.name":"unknown"}' and unknown.tables["instrumentation_scopes"].first()["Name"] == "unknown"


def test_logs(spark):
    records = [{"timeUnixNano": "0", "severityNumber": 0, "severityText": "", "body": {"stringValue": "hi"}}, {"timeUnixNano": "7", "body": {"boolValue": True}}, {"body": {"arrayValue": {"values": [{"intValue": "1"}]}}}, {}]
    text = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": records}]}]})
    rows = otlp.log_records(frame(spark, text)).collect()
    assert [(r["TimeUnixNano"], r["BodyType"], r["BodyValue"]) for r in rows] == [(None, "STRING", "hi"), (7, "BOOL", "true"), (None, "ARRAY", "[1]"), (None, "STRING", None)]
    assert rows[0]["SeverityNumber"] is None and rows[0]["SeverityText"] is None
    batch = ingest_logs(frame(spark, text, text, text.replace("hi", "ho")))
    ids = [r["Id"] for r in batch.tables["log_records"].collect()]
    assert len(ids) == len(set(ids)) == 12 and tuple(batch.report.first()) == ("logs", 12, 0, 0, 0)
    again = ingest_logs(frame(spark, text.replace("hi", "ho"), text, text).repartition(3))
    assert sorted(r["Id"] for r in again.tables["log_records"].collect()) == sorted(ids)
    same = [{"body": {"stringValue": "connection refused"}}] * 3
    assert ingest_logs(frame(spark, json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": same}]}]}))).tables["log_records"].select("Id").distinct().count() == 3


def nested(depth):
    value = {"intValue": "7"}
    for k in range(depth):
        value = {"kvlistValue": {"values": [{"key": f"k{k}", "value": value}, {"key": "none", "value": {}}]}} if k % 2 else {"arrayValue": {"values": [value, {}, {"doubleValue": "NaN"}]}}
    return value


def plain(depth):
    value = 7
    for k in range(depth):
        value = {f"k{k}": value} if k % 2 else [value, "NaN"]
    return value


@pytest.mark.parametrize("depth", [1, 2, 4, 30])
def test_values_of_any_depth(spark, depth):
    record = {"body": nested(depth), "attributes": [{"key": "a", "value": nested(depth)}, {"key": "b", "value": {"stringValue": 'q"\n'}}]}
    row = otlp.log_records(frame(spark, json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]}))).first()
    assert json.loads(row["BodyValue"]) == plain(depth) and json.loads(row["AttributesJson"]) == {"a": plain(depth), "b": 'q"\n'}
    assert row["BodyType"] == ("KVLIST" if depth % 2 == 0 else "ARRAY")


def test_spans_without_a_resource_have_that_of_the_first_of_their_trace(spark):
    own = {"resource": {"attributes": [attribute("service.name", stringValue="first")]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [one()]}]}
    bare = {"scopeSpans": [{"spans": [one(spanId="11" * 8), one(traceId="cd" * 16, spanId="22" * 8)]}]}
    tables = ingest_traces(frame(spark, json.dumps({"resourceSpans": [own, bare]}))).tables
    names = {r["Id"]: json.loads(r["AttributesJson"])["service.name"] for r in tables["resources"].collect()}
    scopes = {r["Id"]: r["Name"] for r in tables["instrumentation_scopes"].collect()}
    got = {r["SpanId"]: (names[r["ResourceId"]], scopes[r["ScopeId"]]) for r in tables["spans"].collect()}
    assert got == {SPAN: ("first", "lib"), "11" * 8: ("first", "lib"), "22" * 8: ("unknown", "unknown")}
    alone = ingest_traces(frame(spark, json.dumps({"resourceSpans": [own]}), json.dumps({"resourceSpans": [bare]}))).tables
    own_ids = [r["Id"] for r in alone["resources"].where("AttributesJson LIKE '%unknown%'").collect()]
    assert [r["ResourceId"] for r in alone["spans"].collect()].count(own_ids[0]) == 2


def metric_request():
    point = {"timeUnixNano": "5", "startTimeUnixNano": "0"}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [point | {"asInt": "3", "exemplars": [{"asDouble": 1.5, "timeUnixNano": "4", "traceId": TRACE, "spanId": SPAN}, {}]}]}},
        {"name": "s", "sum": {"dataPoints": [point | {"asDouble": 2.5}], "isMonotonic": True, "aggregationTemporality": 2}},
        {"name": "h", "histogram": {"dataPoints": [point | {"count": "3", "sum": 4.0}], "aggregationTemporality": 1}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [point | {"count": "1", "scale": 2, "positive": {"offset": 1, "bucketCounts": ["1"]}}]}},
        {"name": "y", "summary": {"dataPoints": [point | {"count": "1"}]}},
        {"name": "empty"},
    ]
    return json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]})


def test_metrics(spark):
    batch = ingest_metrics(frame(spark, metric_request()), "export-1")
    rows = {name: df.collect() for name, df in batch.tables.items()}
    assert len(rows["metrics"]) == 5 and rows["histogram_data_points"][0]["BucketCounts"] == [] and rows["summary_data_points"][0]["QuantileValues"] == []
    assert rows["gauge_data_points"][0]["ExemplarId"] == rows["exemplars"][0]["Id"] and len(rows["exemplars"]) == 1
    assert rows["sum_data_points"][0]["AggregationTemporality"] == "CUMULATIVE" and rows["sum_data_points"][0]["StartTimeUnixNano"] is None
    assert tuple(batch.report.first()) == ("metrics", 5, 0, 1, 0)


def test_every_export_has_metrics_of_its_own(spark):
    tables = ingest_metrics(frame(spark, metric_request(), metric_request()), "export-1").tables
    assert tables["metrics"].count() == tables["metrics"].select("Id").distinct().count() == 10
    assert tables["gauge_data_points"].select("Id").distinct().count() == 2
    point = {"attributes": [attribute("k", intValue="1")], "asInt": "3"}
    same = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"gauge": {"dataPoints": [point, point]}}]}]}]})
    tables = ingest_metrics(frame(spark, same), "export-1").tables
    points = tables["gauge_data_points"].collect()
    assert len({p["Id"] for p in points}) == 2 and all(p["TimeUnixNano"] == 0 for p in points) and tables["metrics"].first()["Name"] == ""


def test_store(spark, tmp_path):
    from signalspark.operators import retention

    store = Store(spark, f"file://{tmp_path}/store")
    spans = [one(events=[{"name": "e"}]), one(spanId="00" * 8, startTimeUnixNano="1600000000000000000", events=[{"name": "f"}])]
    texts = frame(spark, request(spans))
    assert store.read().spans.count() == 0
    with store.staging() as stage:
        store.append(ingest_traces(texts, store.read(), stage=stage), "a")
        store.append(ingest_traces(texts, store.read(without="a"), stage=stage), "a")  # run again
        store.append(ingest_traces(texts, store.read(), stage=stage), "b")  # nothing new
    for name in ("c", "d"):
        store.append(ingest_metrics(frame(spark, metric_request()), name, store.read()), name)
    t = store.read()
    assert t.spans.count() == t.span_events.count() == 2 and t.resources.count() == 2 and t.metrics.count() == 10
    assert store.read(start=1650000000000000000).spans.count() == 1
    touched = store.delete(retention.delete_span(store.read(), TRACE, SPAN))
    assert touched == {"span_events": 1, "span_links": 0, "spans": 1}  # one day of two
    t = store.read()
    assert t.spans.count() == 1 and [r["Name"] for r in t.span_events.collect()] == ["f"]
    assert store.delete(retention.delete_metrics_by_name(store.read(), "g"))["gauge_data_points"] == 2 and store.read().gauge_data_points.count() == 0
    store.compact("metrics")
    assert store.read().metrics.count() == 8 and len({r["Batch"] for r in spark.read.parquet(f"{tmp_path}/store/metrics").collect()}) == 1
    assert "service_map" in views.register(spark, store.read()) and spark.sql("SELECT * FROM trace_summary").count() == 1
    assert traces.trace_by_id(store.read(), TRACE).count() == 1


def test_deletes_do_not_shuffle_what_stays(spark):
    from signalspark.operators import retention
    from signalspark.queries import signal_tables

    t = signal_tables(spark, "/root/testdata/sf0.001")
    left = retention.delete_traces_by_time_range(t, 1704844800000000000, 1705104000000000000).span_events
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(request([one()]) + "\n" + request([one(spanId="11" * 8)]) + "\n")
    (source / "b.json").write_text(request([one()]) + "\n")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        writer = streaming.into_store(streaming.requests(spark, str(source)), store, "traces", f"{tmp_path}/check")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert store.read().spans.count() == 2
    batch = ingest_traces(streaming.stored_requests(spark, str(source)))
    assert {r["Id"] for r in batch.tables["spans"].collect()} == {r["Id"] for r in store.read().spans.collect()}
    seen = streaming.unique_spans(streaming.requests(spark, str(source))).select("TraceId", "SpanId")
    query = seen.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 2


def test_windowed_counts_batch_form(spark):
    rows = spark.createDataFrame([(1_000_000_000, "INFO", 9), (59_000_000_000, "INFO", 9), (61_000_000_000, "INFO", 9), (None, "INFO", 9)], "TimeUnixNano long, SeverityText string, SeverityNumber int")
    assert sorted(r["Count"] for r in streaming.severity_counts(rows).collect()) == [1, 2]
    spans = spark.createDataFrame([("t", 0, "OK"), ("t", 10**9, "ERROR"), ("t", 10**12, "OK")], "TraceId string, StartTimeUnixNano long, StatusCode string")
    assert sorted((r["SpanCount"], r["ErrorCount"]) for r in streaming.trace_sessions(spans).collect()) == [(1, 0), (2, 1)]


def wire(*fields):
    """A message of (number, value): bytes, whole numbers, (8 bytes,) or doubles."""
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, str):
            value = value.encode()
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 1) + struct.pack("<d", value)
        elif isinstance(value, tuple):
            out += varint(number << 3 | 1) + struct.pack("<q", value[0])
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(value):
    value &= (1 << 64) - 1
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def test_binary_requests(spark):
    from signalspark.sources.wire import decoded

    pair = wire((1, "k"), (2, wire((5, wire((1, wire((3, -5))), (1, wire((4, 0.5))))))))
    span = wire((1, bytes.fromhex(TRACE)), (2, bytes.fromhex(SPAN)), (5, "öp"), (6, 3), (7, (1700000000000000001,)), (8, (1700000000000000005,)), (9, pair), (15, wire((3, 2))), (99, "new"), (11, wire((1, (5,)), (2, "e"))))
    resource = wire((1, wire((1, "service.name"), (2, wire((1, "a"))))))
    body = wire((1, wire((1, resource), (2, wire((1, wire((1, "lib"))), (2, span))))))
    frame_ = spark.createDataFrame([(bytearray(body),), (bytearray(body[:-3]),), (None,), (bytearray(b""),)], "value binary")
    rows = otlp.spans(decoded(frame_, "traces")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["TraceId"], r["SpanId"], r["Name"], r["Kind"], r["StartTimeUnixNano"], r["StatusCode"], r["AttributesJson"]) == (TRACE, SPAN, "öp", "CLIENT", 1700000000000000001, "ERROR", '{"k":[-5,0.5]}')
    assert r["ResourceAttributesJson"] == '{"service.name":"a"}' and r["Events"][0]["Name"] == "e"
    import struct

    point = wire((3, (9,)), (4, (3,)), (5, 1.5), (6, struct.pack("<qq", 1, 2)), (7, struct.pack("<d", 0.5)), (12, float("nan")))
    exponential = wire((3, (9,)), (6, 3), (8, wire((1, 4), (2, varint(7) + varint(300)))))
    first, second = wire((1, "h"), (9, wire((1, point), (2, 1)))), wire((1, "e"), (10, wire((1, exponential))))
    metrics = wire((1, wire((2, wire((2, first), (2, second))))))
    tables = ingest_metrics(decoded(spark.createDataFrame([(bytearray(metrics),)], "value binary"), "metrics"), "x").tables
    h, e = tables["histogram_data_points"].first(), tables["exponential_histogram_data_points"].first()
    assert (h["Count"], h["BucketCounts"], h["ExplicitBounds"], h["AggregationTemporality"]) == (3, [1, 2], [0.5], "DELTA") and h["Max_Value"] != h["Max_Value"]
    assert (e["Scale"], e["PositiveOffset"], e["PositiveBucketCounts"]) == (-2, 2, [7, 300])
    record = wire((1, (7,)), (2, 9), (5, wire((7, b"ab"))))
    records = wire((1, wire((2, wire((2, record))))))
    log = otlp.log_records(decoded(spark.createDataFrame([(bytearray(records),)], "value binary"), "logs")).first()
    assert (log["TimeUnixNano"], log["SeverityNumber"], log["BodyType"], log["BodyValue"]) == (7, 9, "BYTES", "YWI=")


def test_windowed_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spans = [one(spanId=f"{k:016x}", startTimeUnixNano=str(k * 10**9 + 1), endTimeUnixNano=str(k * 10**9 + 2)) for k in (1, 2, 200, 5000)]
    (source / "a.json").write_text(request(spans))
    rows = otlp.spans(streaming.requests(spark, str(source))).select("TraceId", "StartTimeUnixNano", "StatusCode")
    query = streaming.trace_sessions(rows).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["SpanCount"] for r in spark.table("sessions").collect()) == [1, 2]  # the last one is still open


def test_values_from_the_outside_in_are_those_from_the_inside_out():
    from signalspark.sources.otlp import _DECODER, _ENCODER, _FLAT, _walk, with_plain_lists

    odd = [{"intValue": "007"}, {"stringValue": {"arrayValue": {"values": []}}}, {"boolValue": None}, {"arrayValue": "text"}, {"x": 1, "doubleValue": "NaN"}, 5]
    for value in (nested(1), nested(4), nested(2000), {"arrayValue": {"values": odd[:1] + odd[2:]}}, {"kvlistValue": {"values": [{"key": "k", "value": v} for v in odd]}}):
        try:
            text = json.dumps({"resourceLogs": [{"body": value}]})
        except RecursionError:
            text = '{"body":' + '{"arrayValue":{"values":[' * 600 + "{}" + "]}}" * 600 + "}"
        assert with_plain_lists(text) == _ENCODER.encode(_DECODER.decode(text))
    request = _FLAT.decode(json.dumps({"body": nested(2)}))
    _walk(request)
    assert json.loads(request["body"]["kvlistValue"]) == plain(2)


@pytest.mark.parametrize("table", ["resources", "instrumentation_scopes"])
def test_dimensions_need_no_spans_told_apart(spark, table):
    plan = ingest_traces(frame(spark, request([one()]))).tables[table]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan


def staged_by(spark, store, texts, known=None):
    """The tables that an ingest stages, as columns and rows."""
    seen = []
    with store.staging() as stage:
        def watched(df):
            out = stage(df)
            seen.append((df.columns, out.count()))
            return out

        report = ingest_traces(texts, known, stage=watched).report.first()
    return seen, report


def test_spans_of_one_place_look_up_no_first_span(spark, tmp_path):
    bare = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [one(), one(spanId="22" * 8)]}]}]})
    seen, _ = staged_by(spark, Store(spark, f"file://{tmp_path}/store"), frame(spark, bare))
    assert [n for columns, n in seen if "__first" in columns] == [0]


def test_spans_are_staged_once_and_meet_the_shorter_list(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    texts = frame(spark, request([one(spanId=f"{k:016x}") for k in range(1, 9)]))
    with store.staging() as stage:
        store.append(ingest_traces(texts, stage=stage))
    seen, report = staged_by(spark, store, texts, store.read())
    assert tuple(report) == ("traces", 0, 8, 0, 0)
    assert sum("Events" in columns for columns, _ in seen) == 1 and seen[-1][1] == 0
