"""Traces assembled from a stream: once, after a silence, with corrections, and as a batch has them."""

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from signalspark.queries import signal_tables
from signalspark.streaming import assembly

SCHEMA = "TraceId string, SpanId string, ParentSpanId string, Name string, StatusCode string, StartTimeUnixNano long, EndTimeUnixNano long, Arrival timestamp"


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, assembly.PROVIDER)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


class Replay:
    """A stream over files that are put in place one by one."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.files = spark, folder, options, 0
        (folder / "in").mkdir(parents=True)
        self.out = []

    def put(self, *rows):
        """Rows of (trace, parent, name, status, start, end, arrival in seconds)."""
        full = [(t, "s", p, n, st, a, b, datetime.fromtimestamp(arrival, UTC)) for t, p, n, st, a, b, arrival in rows]
        self.spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"part{self.files}"))
        for f in (self.folder / f"part{self.files}").glob("*.parquet"):
            os.rename(f, self.folder / "in" / f"{self.files}.parquet")
        self.files += 1
        return self.run()

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in"))
        new = []
        q = assembly.assembled_traces(stream, **self.options).writeStream.foreachBatch(lambda df, n: new.extend(df.collect())).option("checkpointLocation", str(self.folder / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["TraceId"], r["SpanCount"], r["ErrorCount"], r["StartTimeUnixNano"], r["EndTimeUnixNano"], r["RootName"], r["Revision"], r["Correction"]) for r in new)


def test_once_after_a_silence_and_corrections(stateful, tmp_path):
    r = Replay(stateful, tmp_path, silence_ms=10_000, keep_ms=100_000)
    assert r.put(("t", None, "root", "OK", 5, 9, 100), ("t", "x", "a", "ERROR", 6, 20, 101), ("u", "x", "b", "OK", 1, 2, 105)) == []
    assert r.put(("t", "x", "c", "OK", 7, 8, 108), (None, None, "n", "OK", 0, 0, 108)) == []  # the silence of t begins anew
    assert r.put(("v", None, "v", "OK", 1, 1, 117)) == [("u", 1, 0, 1, 2, None, 0, False)]
    assert r.put(("w", None, "w", "OK", 1, 1, 120)) == [("t", 3, 1, 5, 20, "root", 0, False)]
    # a span of t that comes late, with an early start: no row is lost, and the trace is corrected
    assert r.put(("t", None, "first", "OK", 1, 2, 125)) == []
    got = r.put(("x", None, "x", "OK", 1, 1, 140))
    assert got == [("t", 4, 1, 1, 20, "first", 1, True), ("v", 1, 0, 1, 1, "v", 0, False), ("w", 1, 0, 1, 1, "w", 0, False)]
    # long after, the state is gone and the trace begins anew
    assert r.put(("y", None, "y", "OK", 1, 1, 400)) == [("x", 1, 0, 1, 1, "x", 0, False)]
    assert r.put(("t", None, "new", "OK", 50, 60, 401)) == []
    assert ("t", 1, 0, 50, 60, "new", 0, False) in r.put(("z", None, "z", "OK", 1, 1, 500))


def test_replayed_events_equal_the_batch(stateful, tmp_path):
    spans = signal_tables(stateful, "/root/testdata/sf0.001").spans.withColumn("Arrival", F.timestamp_micros(F.expr("StartTimeUnixNano div 1000")))
    wanted = {tuple(r) for r in assembly.traces_of(spans).collect()}
    rows = spans.orderBy("Arrival").select("TraceId", "SpanId", "ParentSpanId", "Name", "StatusCode", "StartTimeUnixNano", "EndTimeUnixNano", "Arrival")
    (tmp_path / "in").mkdir()
    days = [r[0] for r in rows.select(F.to_date("Arrival").alias("d")).distinct().orderBy("d").collect()]
    groups = [days[i::1][k * 8 : k * 8 + 8] for i in (0,) for k in range(-(-len(days) // 8))]
    got = []
    for n, group in enumerate(groups):
        some = rows.where(F.to_date("Arrival").isin(group))
        if n == len(groups) - 1:  # long after the last one, so that all traces are complete
            end = spans.sparkSession.createDataFrame([("end", "s", None, "end", "OK", 0, 0, datetime(2030, 1, 1, tzinfo=UTC))], SCHEMA)
            some = some.union(end)
        some.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        for f in (tmp_path / f"part{n}").glob("*.parquet"):
            os.rename(f, tmp_path / "in" / f"{n}.parquet")
        stream = stateful.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = assembly.assembled_traces(stream, silence_ms=86_400_000).writeStream.foreachBatch(lambda df, k: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
