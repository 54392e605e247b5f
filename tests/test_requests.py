"""The data source of export requests: ranges, both framings, streams that are stopped and started again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from signalspark.plans.ingest import ingest_traces
from signalspark.sources.requests import Range, files_of, ranges_of
from signalspark.sources.store import Store
from signalspark.sources.wire import decoded
from signalspark.streaming import ingest as streaming
from tests.test_ingest import one, request, wire


def written_lines(folder, name, texts, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(end.join(texts).encode() + end.encode())


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_lines_in_ranges_of_any_size(spark, tmp_path, width):
    rng = random.Random(3)
    texts = ["é" * rng.randrange(30) + str(k) for k in range(40)] + ["", "x"]
    written_lines(tmp_path / "in", "a.json", texts)
    written_lines(tmp_path / "in", "b.json", ["no end of line"], end="")
    written_lines(tmp_path / "in", "c.json", ["two", "ends"], end="\r\n")
    written_lines(tmp_path / "in", "_part.json", ["in the making"])
    (tmp_path / "in" / "empty.json").write_bytes(b"")
    got = streaming.stored_requests(spark, str(tmp_path / "in"), rangeBytes=str(width))
    rows = got.collect()
    assert sorted(r["value"] for r in rows) == sorted([t for t in texts if t] + ["no end of line", "two", "ends"])
    assert len({r["Key"] for r in rows}) == len(rows)
    assert {r["Key"] for r in rows} == {r["Key"] for r in streaming.stored_requests(spark, str(tmp_path / "in")).collect()}
    if width == 64:
        assert got.rdd.getNumPartitions() > 5  # a file is read by several tasks


def test_a_file_or_a_uri(spark, tmp_path):
    written_lines(tmp_path / "in", "a.json", ["x", "y"])
    assert streaming.stored_requests(spark, str(tmp_path / "in" / "a.json")).count() == 2
    assert streaming.stored_requests(spark, f"file://{tmp_path}/in").count() == 2


def framed(*bodies):
    return b"".join(len(b).to_bytes(4, "big") + b for b in bodies)


def message(k):
    span = wire((1, bytes.fromhex(f"{k + 1:032x}")), (2, bytes.fromhex(f"{k + 1:016x}")), (5, f"op{k}"))
    return wire((1, wire((2, wire((2, span))))))


@pytest.mark.parametrize("width", [40, 1 << 20])
def test_messages_behind_their_lengths(spark, tmp_path, width):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(framed(*map(message, range(30))) + (500).to_bytes(4, "big") + b"cut off")
    parts = ranges_of(str(folder / "a.bin"), os.path.getsize(folder / "a.bin"), "lengths", width)
    assert (len(parts) > 5) == (width == 40) and all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))
    got = streaming.stored_requests(spark, str(folder), "lengths", rangeBytes=str(width))
    assert got.count() == 31
    batch = ingest_traces(decoded(got, "traces"))
    assert tuple(batch.report.first()) == ("traces", 30, 0, 0, 1)
    assert {r["Name"] for r in batch.tables["spans"].collect()} == {f"op{k}" for k in range(30)}


def test_a_stream_that_starts_again_loses_and_repeats_nothing(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    texts = lambda n: [request([one(spanId=f"{n:08x}{k:08x}")]) for k in range(5)]
    seen = 0
    for n in range(3):
        written_lines(source, f"{9 - n}.json", texts(n))  # later files have smaller names
        os.utime(source / f"{9 - n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        writer = streaming.into_store(streaming.requests(spark, str(source), rangeBytes="300"), store, "traces", f"{tmp_path}/check")
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        seen += sum(p["numInputRows"] for p in q.recentProgress)
        assert store.read().spans.count() == 5 * (n + 1)
    assert len(files_of(str(source))) == 3
    batches = {r["Batch"] for r in spark.read.parquet(f"{tmp_path}/store/spans").select("Batch").collect()}
    assert len(batches) == 3


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    source, out = tmp_path / "in", []
    written_lines(source, "a.json", ["1", "2"])
    os.utime(source / "a.json", (1_600_000_000, 1_600_000_000))
    fail = {"now": True}

    def each(df, number):
        rows = [(r["Key"], r["value"], number) for r in df.collect()]
        if fail["now"]:
            raise RuntimeError("killed")
        out.extend(rows)

    start = lambda: streaming.requests(spark, str(source)).writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    written_lines(source, "b.json", ["3"])
    os.utime(source / "b.json", (1_700_000_000, 1_700_000_000))
    fail["now"] = False
    start().awaitTermination()  # the batch that failed
    start().awaitTermination()  # what came since
    assert sorted(v for _, v, _ in out) == ["1", "2", "3"] and len({k for k, _, _ in out}) == 3
    assert {n for _, v, n in out if v in "12"} == {0}  # the batch that failed has the rows it had


def test_ranges_of_a_large_file():
    assert ranges_of("p", 100, "lines", 30) == [Range("p", a, min(a + 30, 100)) for a in (0, 30, 60, 90)] and ranges_of("p", 0, "lines", 30) == []


def test_source_equals_the_table_that_its_files_came_from(spark, tmp_path):
    from signalspark.queries import full_requests

    requests = full_requests(spark, "/root/testdata/sf0.001")
    requests.select("value").repartition(3).write.text(f"{tmp_path}/in")
    back = streaming.stored_requests(spark, f"{tmp_path}/in", rangeBytes="4096")
    both = [sorted(r[0] for r in df.agg(F.array_sort(F.collect_list("value"))).first()[0:1]) for df in (requests, back)]
    assert both[0] == both[1] and back.rdd.getNumPartitions() > 10
