"""Span trees against hand-made traces, deep ones, cycles and orphans; the text index against scans."""

import random

import pytest
from pyspark.sql import functions as F

from signalspark.operators import logs, trees
from signalspark.schemas import schema
from signalspark.sources.textindex import TextIndex, matching
from signalspark.tables import SignalTables


def tree_of(spark, rows):
    """Rows of (trace, span, parent, start, end)."""
    full = schema("spans")
    values = {"TraceId": 0, "SpanId": 1, "ParentSpanId": 2, "StartTimeUnixNano": 3, "EndTimeUnixNano": 4}
    spans = spark.createDataFrame([tuple(r[values[f.name]] if f.name in values else None for f in full.fields) for r in rows], full)
    return {(r["TraceId"], r["SpanId"]): r for r in trees.span_tree(SignalTables(spans=spans)).collect()}


def test_a_trace_by_hand(spark):
    rows = [
        ("t", "root", None, 0, 100), ("t", "a", "root", 10, 40), ("t", "b", "root", 30, 60), ("t", "c", "root", 90, 130), ("t", "a1", "a", 0, 15), ("t", "a2", "a", 20, 20),
        ("t", "lost", "gone", 5, 9), ("t", "below", "lost", 6, 7), ("u", "root", None, 9, 3), ("u", "x", "root", 1, 2), ("u", "y", "root", 1, 2), (None, "n", None, 0, 1),
    ]
    got = tree_of(spark, [r for r in rows if r[0]])
    assert {k: (r["Depth"], r["RootSpanId"]) for k, r in got.items() if k[0] == "t"} == {("t", "root"): (0, "root"), ("t", "a"): (1, "root"), ("t", "b"): (1, "root"), ("t", "c"): (1, "root"), ("t", "a1"): (2, "root"), ("t", "a2"): (2, "root"), ("t", "lost"): (0, "lost"), ("t", "below"): (1, "lost")}
    assert got["t", "a1"]["Path"] == ["root", "a", "a1"]
    assert [got["t", s]["SelfNano"] for s in ("root", "a", "b", "c", "lost", "below")] == [100 - 50 - 10, 30 - 5, 30, 40, 3, 1]
    assert {s for (t, s), r in got.items() if t == "t" and r["Critical"]} == {"root", "c", "lost", "below"}
    assert [s for (_, s), r in got.items() if r["Orphan"]] == ["lost"] and not any(r["Cycle"] for r in got.values())
    assert got["u", "root"]["SelfNano"] == 0 and got["u", "x"]["Critical"] and not got["u", "y"]["Critical"]


def test_cycles(spark):
    rows = [("t", "root", None, 0, 9), ("t", "a", "root", 0, 9), ("t", "b", "d", 0, 9), ("t", "c", "b", 0, 9), ("t", "d", "c", 0, 9), ("t", "e", "d", 0, 9), ("t", "f", "e", 0, 9), ("t", "own", "own", 0, 9)]
    got = tree_of(spark, rows)
    assert {s for (_, s), r in got.items() if r["Cycle"]} == {"b", "c", "d", "e", "f", "own"}
    assert all(r["Depth"] is None and r["Path"] is None and r["RootSpanId"] is None and not r["Critical"] for r in got.values() if r["Cycle"])
    assert got["t", "a"]["Depth"] == 1 and got["t", "own"]["SelfNano"] == 9


def test_random_trees(spark):
    rng = random.Random(4)
    parent = {0: None} | {i: (i - 1 if rng.random() < 0.6 else rng.randrange(i)) for i in range(1, 200)}
    rows = [("t", f"s{i}", None if p is None else f"s{p}", i, 2000 - rng.randrange(1000)) for i, p in parent.items()]
    rng.shuffle(rows)
    got = tree_of(spark, rows)
    for i in parent:
        path, at = [], i
        while at is not None:
            path.append(f"s{at}")
            at = parent[at]
        assert got["t", f"s{i}"]["Path"] == path[::-1]


BODIES = [
    "connection refused by peer", "Connection reset; refused again, refused", None, "", "Žluťoučký kůň úpěl", "接続 拒否 された", "the peer refused the connection", "ошибка Соединения", "error_code=17 connection", "refused refused refused",
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    df = spark.createDataFrame([(i, b, i * 40_000 * 10**9) for i, b in enumerate(BODIES)], "Id long, BodyValue string, TimeUnixNano long")
    index = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", shards=4)
    for part in (0, 1, 0):
        index.add(df.where(F.col("Id") % 2 == part), str(part))
    return index, df


@pytest.mark.parametrize("query", ["refused", "connection PEER", "kůň", "拒否", "соединения nothing", "error_code"])
def test_index_finds_what_a_scan_finds(indexed, query):
    index, df = indexed
    scanned = logs.log_fulltext_search(SignalTables(log_records=df), query, relevance=True, shortest=2)
    found = matching(df, index.search(query, shortest=2))
    key = lambda rows: sorted((r["Id"], r["BodyValue"], round(r["Score"], 9)) for r in rows.collect())
    assert key(found) == key(scanned) and found.count() > 0


def test_phrases(indexed):
    index, _ = indexed
    places = lambda p: {r["Id"]: r["Places"] for r in index.phrase(p).collect()}
    assert places("Connection refused") == {0: [0]} and places("refused refused") == {9: [0, 1]} and places("the peer refused the") == {6: [0]}
    assert places("接続 拒否") == {5: [0]} and places("refused connection") == {} and places("úpěl") == {4: [2]}
    with pytest.raises(ValueError):
        index.phrase("...")


def test_only_the_shards_of_the_terms_are_read(indexed):
    index, _ = indexed
    found = index._of(index._read("postings", "Term string, Id long, Day date, Positions array<int>, Shard int, Batch string"), ["refused"])
    assert len({f.split("Shard=")[1].split("/")[0] for f in found.inputFiles()}) >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Shard" in plan and "PushedFilters: [IsNotNull(Term), EqualTo(Term,refused)]" in plan
