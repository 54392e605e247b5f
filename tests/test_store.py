"""The store under failures, ranges, ingests that don't see each other, and streams at once."""

import json
import threading
from datetime import UTC, datetime, timedelta

import pytest

from signalspark.operators import logs, retention, traces
from signalspark.plans.ingest import ingest_logs, ingest_metrics, ingest_traces
from signalspark.sources import otlp
from signalspark.sources.store import Store
from signalspark.streaming import ingest as streaming
from tests.test_ingest import SPAN, TRACE, attribute, frame, metric_request, one, request

DAY = 86_400 * 10**9
NOON = 1_700_000_000 * 10**9 // DAY * DAY + DAY // 2


def log_request(*records):
    return json.dumps({"resourceLogs": [{"resource": {"attributes": [attribute("service.name", stringValue="a")]}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": list(records)}]}]})


def at(nanos):
    return str(nanos)


def test_ranges_go_by_the_time_that_queries_use(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    records = [
        {"timeUnixNano": at(NOON), "observedTimeUnixNano": at(NOON + 1)},
        {"timeUnixNano": at(NOON), "observedTimeUnixNano": at(NOON + 3 * DAY)},  # observed days later
        {"timeUnixNano": at(NOON)},
        {"observedTimeUnixNano": at(NOON)},
        {"timeUnixNano": at(NOON + 2 * DAY), "observedTimeUnixNano": at(NOON)},
        {},
    ]
    store.append(ingest_logs(frame(spark, log_request(*records))))
    assert store.read(NOON - 5, NOON + 5).log_records.count() == 4
    assert logs.logs_by_time_range(store.read(NOON - 5, NOON + 5), NOON - 5, NOON + 5).count() == 3
    assert store.read().log_records.count() == 6
    plan = store.read(NOON - 5, NOON + 5).log_records._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Day" in plan


def test_callers_from_before_a_range(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    caller = request([one(startTimeUnixNano=at(NOON - DAY // 2 - 5))])
    child = request([one(spanId="11" * 8, parentSpanId=SPAN, startTimeUnixNano=at(NOON))], [attribute("service.name", stringValue="b")])
    late = request([one(spanId="22" * 8, parentSpanId=SPAN, startTimeUnixNano=at(NOON + 30 * DAY))], [attribute("service.name", stringValue="b")])
    store.append(ingest_traces(frame(spark, caller, child, late)))
    assert store.read(NOON - 5, NOON + 5).spans.count() == 1
    assert [r["CallCount"] for r in traces.service_dependencies(store.read(NOON - 5, NOON + 5)).collect()] == [1]
    far = NOON + 30 * DAY
    assert traces.service_dependencies(store.read(far - 5, far + 5)).count() == 0  # beyond the default reach
    assert traces.service_dependencies(store.read(far - 5, far + 5, reach=None)).first()["CallCount"] == 1


def test_ingests_that_do_not_see_each_other(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for name in ("a", "b"):
        store.append(ingest_logs(frame(spark, log_request({"timeUnixNano": at(NOON)})), export=name), name)
    t = store.read()
    assert logs.logs_by_time_range(t, NOON - 5, NOON + 5).count() == 2
    assert (t.resources.count(), t.instrumentation_scopes.count()) == (1, 1)


class Broken(RuntimeError):
    pass


def breaking(store, after):
    """Lets the store's writes fail after so many."""
    done = []
    write, drop = store._write, store._drop

    def count(f):
        def run(name, *rest):
            if name.startswith("_staged"):
                return f(name, *rest)
            if len(done) >= after:
                raise Broken
            done.append(name)
            return f(name, *rest)

        return run

    store._write, store._drop = count(write), count(drop)


@pytest.mark.parametrize("after", range(3))
def test_a_delete_that_fails_on_its_way(spark, tmp_path, after):
    path = f"file://{tmp_path}/store"
    store = Store(spark, path)
    link = {"traceId": TRACE, "spanId": SPAN}
    gone = [one(events=[{"name": "e"}], links=[link]), one(spanId="11" * 8, startTimeUnixNano=at(NOON), events=[{"name": "f"}], links=[link])]
    kept = one(traceId="cd" * 16, events=[{"name": "g"}], links=[link])
    store.append(ingest_traces(frame(spark, request([*gone, kept]))))
    breaking(store, after)
    with pytest.raises(Broken):
        store.delete(retention.delete_trace(store.read(), TRACE))
    again = Store(spark, path)
    left = again.read()
    ids = {r["Id"] for r in left.spans.collect()}
    assert {r["SpanId"] for r in left.span_events.collect()} <= ids and {r["SpanId"] for r in left.span_links.collect()} <= ids
    again.delete(retention.delete_trace(again.read(), TRACE))
    left = again.read()
    assert (left.spans.count(), left.span_events.count(), left.span_links.count()) == (1, 1, 1)


@pytest.mark.parametrize("after", [0, 2])
def test_a_delete_of_metrics_that_fails_on_its_way(spark, tmp_path, after):
    path = f"file://{tmp_path}/store"
    store = Store(spark, path)
    store.append(ingest_metrics(frame(spark, metric_request()), "x"))
    breaking(store, after)
    condition = lambda t: retention.delete_metrics_by_time_range(t, datetime(2000, 1, 1), datetime(2100, 1, 1))
    with pytest.raises(Broken):
        store.delete(condition(store.read()))
    again = Store(spark, path)
    again.delete(condition(again.read()))
    t = again.read()
    assert [t.table(n).count() for n in t.names() if n == "metrics" or "points" in n] == [0] * 6


def test_whole_days_expire_unread(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    spans = [one(spanId=f"{k:016x}", startTimeUnixNano=at(NOON + k * DAY), events=[{"name": "e"}]) for k in range(5)]
    spans.append(one(spanId="ff" * 8, startTimeUnixNano=at(NOON + 3 * DAY + 10), events=[{"name": "e"}]))
    store.append(ingest_traces(frame(spark, request(spans))))
    for table in ("spans", "span_events"):  # files of the days that go can't be read any more
        for day in range(3):
            name = datetime.fromtimestamp((NOON + day * DAY) // 10**9, UTC).date()
            for file in (tmp_path / "store" / table / f"Day={name}").rglob("*.parquet"):
                file.write_bytes(b"no parquet")
            for file in (tmp_path / "store" / table / f"Day={name}").rglob(".*.crc"):
                file.unlink()
    now = datetime.fromtimestamp((NOON + 3 * DAY) // 10**9, UTC) + timedelta(days=30, milliseconds=1)
    got = store.expire_spans(now)
    assert got == {"days of span_events": 3, "days of span_links": 0, "days of spans": 3, "span_events": 1, "span_links": 0, "spans": 1}
    left = store.read()
    assert {r["SpanId"] for r in left.spans.collect()} == {f"{4:016x}"} and left.span_events.count() == 1


def test_three_streams_into_one_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    texts = {"traces": request([one()]), "logs": log_request({"timeUnixNano": at(NOON)}), "metrics": metric_request()}
    queries = []
    for signal, text in texts.items():
        (tmp_path / signal).mkdir()
        for k in range(3):
            (tmp_path / signal / f"{k}.json").write_text(text.replace(SPAN, f"{k:016x}") + "\nno json\n")
        writer = streaming.into_store(streaming.requests(spark, str(tmp_path / signal)), store, signal, f"{tmp_path}/check-{signal}")
        queries.append(writer.trigger(availableNow=True))
    started = [None] * 3
    threads = [threading.Thread(target=lambda k=k: started.__setitem__(k, queries[k].start())) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for q in started:
        q.awaitTermination()
        assert q.exception() is None
    t = store.read()
    assert (t.spans.count(), t.log_records.count(), t.metrics.count()) == (3, 3, 15)
    assert t.log_records.join(t.services(), "ResourceId").count() == 3
    assert not list((tmp_path / "store" / "_staged").glob("*"))


def test_staging_of_one_run_leaves_the_others(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.staging("first") as first:
        kept = first(spark.range(3).toDF("a"))
        with store.staging("second") as second:
            second(spark.range(2).toDF("a"))
        assert kept.count() == 3
        with store.staging("second") as again:
            assert again(spark.range(5).toDF("a")).count() == 5


def test_every_request_is_counted(spark):
    odd = ["{", None, "[1]", '{"resourceSpans":"none"}', "5", ""]
    fine = [request([one()]), request([one(traceId="bad"), one()]), "{}", '{"resourceSpans":[]}', '{"resourceSpans":[{}]}']
    batch = ingest_traces(spark.createDataFrame([(x,) for x in odd + fine], "value string"))
    assert tuple(batch.report.first()) == ("traces", 1, 1, 1, len(odd))
    assert sorted(r["Request"] for r in batch.quarantine.collect()) == sorted(x or "" for x in odd)
    for ingest, text in ((ingest_logs, log_request({"timeUnixNano": "1"})), (ingest_metrics, metric_request())):
        batch = ingest(spark.createDataFrame([(x,) for x in [*odd[:3], text]], "value string"))
        report = batch.report.first()
        assert report["Unreadable"] == 3 and report["Accepted"] in (1, 5) and report["Duplicate"] == 0
        assert batch.tables["resources"].count() == 1


def test_report_is_counted_while_rows_are_staged(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.staging() as stage:
        batch = ingest_traces(frame(spark, request([one(), one(spanId="zz")]), request([one()]), "{"), stage=stage)
        assert "ExistingRDD" in batch.report._jdf.queryExecution().executedPlan().toString()  # no job over the requests
        assert tuple(batch.report.first()) == ("traces", 1, 1, 1, 1)


def test_duplicates_are_found_without_moving_the_other_spans(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.staging() as stage:
        parsed = stage(otlp.spans(frame(spark, request([one(), one(name="again"), one(spanId="11" * 8)])).selectExpr("value", "'k' Key"), unreadable=True))
        from signalspark.plans.ingest import told_apart, with_trace_defaults

        found = told_apart(with_trace_defaults(parsed, stage), None, stage)
        assert sorted((r["Name"], r["Duplicate"]) for r in found.collect()) == [("again", True), ("op", False), ("op", False)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_numbers(spark):
    attributes = [attribute("a", intValue="007"), attribute("b", intValue="-0"), attribute("c", intValue=5), attribute("d", doubleValue="NaN"), attribute("e", doubleValue=1.5), attribute("f", intValue="x"), attribute("g", doubleValue="01.5")]
    nested = attribute("n", arrayValue={"values": [{"intValue": "007"}, {"doubleValue": "Infinity"}]})
    row = otlp.spans(frame(spark, request([one(attributes=[*attributes, nested])]))).first()
    assert json.loads(row["AttributesJson"]) == {"a": 7, "b": 0, "c": 5, "d": "NaN", "e": 1.5, "f": "x", "g": "01.5", "n": [7, "Infinity"]}
    bodies = [{"body": {"doubleValue": x}} for x in ("NaN", "-Infinity", 2.5)]
    assert [r["BodyValue"] for r in otlp.log_records(frame(spark, log_request(*bodies))).collect()] == ["NaN", "-Infinity", "2.5"]


def test_a_small_batch_looks_up_its_traces_only(spark, tmp_path, monkeypatch):
    from signalspark.plans import ingest

    store = Store(spark, f"file://{tmp_path}/store")
    texts = [request([one(traceId=f"{k:032x}", spanId=f"{k:016x}")]) for k in range(50)]
    store.append(ingest_traces(frame(spark, *texts)), "old")
    seen = []
    monkeypatch.setattr(ingest, "near_ids", lambda known, ids, f=ingest.near_ids: seen.append(f(known, ids)) or seen[-1])
    for few in (256, 1):
        monkeypatch.setattr(ingest, "LOOKED_UP", few)
        with store.staging() as stage:
            batch = ingest_traces(frame(spark, texts[7], texts[9], request([one(traceId="ff" * 16)])), store.read(), stage=stage)
            report = batch.report.first()
        assert (report["Accepted"], report["Duplicate"]) == (1, 2)
    plans = [df.select("TraceId")._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert "PushedFilters: [Or(" in plans[0] and "Or(" not in plans[1]  # the scan itself looks for the three traces
