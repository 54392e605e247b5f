"""The tree of spans of each trace: depth, path, self time and critical path.

Spans are led to their roots by pointer doubling: each round every open span takes over the pointer of the span that it
points at, so a tree of depth n takes log2(n) rounds, each one equi-join on (trace id, span id), which spreads evenly
whatever the size of a trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalspark.functions.shared import drop_written, written
from signalspark.tables import SignalTables


def self_times(spans: DataFrame) -> DataFrame:
    """``Covered`` of each span that has children: nanoseconds of its own time in which at least one of them runs."""
    own = spans.select("TraceId", F.col("SpanId").alias("Parent"), F.col("StartTimeUnixNano").alias("s0"), F.col("EndTimeUnixNano").alias("e0"))
    child = spans.where("ParentSpanId IS NOT NULL AND ParentSpanId <> SpanId").select("TraceId", F.col("ParentSpanId").alias("Parent"), F.col("StartTimeUnixNano").alias("s1"), F.col("EndTimeUnixNano").alias("e1"))
    cut = child.join(own, ["TraceId", "Parent"]).select("TraceId", "Parent", F.greatest("s0", "s1").alias("s"), F.least("e0", "e1").alias("e")).where("e > s")
    before = Window.partitionBy("TraceId", "Parent").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = cut.withColumn("upto", F.max("e").over(before))
    length = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("upto", "s")))
    return fresh.groupBy("TraceId", F.col("Parent").alias("SpanId")).agg(F.sum(length).alias("Covered"))


def span_tree(t: SignalTables, trace_id: str | None = None) -> DataFrame:
    """For each span (of one trace, or of all) ``Depth`` (0 for a root), ``RootSpanId``, ``Path`` (the span ids from the root to it),
    ``SelfNano``, ``Critical``, ``Orphan`` and ``Cycle``.

    A span without a parent is a root; so is an orphan, whose parent is not there. Self time is the span's time without the
    moments in which a child runs, where children count only inside it; a span that ends before it starts has 0. A trace's
    critical path leads from each root to the child that ends last (of several the smallest span id), and so on. Spans on a
    cycle of parents, or below one, have no depth, root or path, and are on no critical path."""
    spans = t.spans if trace_id is None else t.spans.where(F.col("TraceId") == trace_id)
    spans = written(spans.select("TraceId", "SpanId", "ParentSpanId", "StartTimeUnixNano", "EndTimeUnixNano"), "tree-spans")
    there = spans.select("TraceId", F.col("SpanId").alias("ParentSpanId"), F.lit(True).alias("there")).distinct()
    last = spans.where("ParentSpanId IS NOT NULL").groupBy("TraceId", "ParentSpanId").agg(F.min_by("SpanId", F.struct(-F.col("EndTimeUnixNano"), "SpanId")).alias("last"))
    sizes = spans.groupBy("TraceId").agg(F.count("*").alias("n"))
    linked = spans.join(there, ["TraceId", "ParentSpanId"], "left").join(last, ["TraceId", "ParentSpanId"], "left").join(sizes, "TraceId")
    open_ = F.when(F.col("there"), F.col("ParentSpanId"))
    state = written(
        linked.select(
            "TraceId", "SpanId", "n", open_.alias("Up"), F.array("SpanId").alias("Path"), (open_.isNull() | (F.col("last") == F.col("SpanId"))).alias("Critical"),
            (F.col("ParentSpanId").isNotNull() & F.col("there").isNull()).alias("Orphan"), F.lit(False).alias("Cycle"),
        ),
        "tree",
    )
    while not (waiting := state.where("Up IS NOT NULL")).isEmpty():
        above = state.select("TraceId", F.col("SpanId").alias("Up"), F.col("Up").alias("Next"), F.col("Path").alias("Above"), F.col("Critical").alias("There"), F.col("Cycle").alias("Lost"))
        joined = waiting.join(above, ["TraceId", "Up"])
        # a path with more spans than its trace comes back to itself
        lost = F.col("Lost") | (F.size("Above") + F.size("Path") > F.col("n"))
        moved = joined.select("TraceId", "SpanId", "n", F.when(~lost, F.col("Next")).alias("Up"), F.when(lost, F.array().cast("array<string>")).otherwise(F.concat("Above", "Path")).alias("Path"), (F.col("Critical") & F.col("There")).alias("Critical"), "Orphan", lost.alias("Cycle"))
        done, state = state, written(state.where("Up IS NULL").union(moved), "tree")
        drop_written(done)
    timed = state.join(spans.select("TraceId", "SpanId", "StartTimeUnixNano", "EndTimeUnixNano"), ["TraceId", "SpanId"]).join(self_times(spans), ["TraceId", "SpanId"], "left")
    held = lambda c: F.when(~F.col("Cycle"), c)
    duration = F.greatest(F.lit(0), F.col("EndTimeUnixNano") - F.col("StartTimeUnixNano"))
    return timed.select(
        "TraceId", "SpanId", held(F.size("Path") - 1).alias("Depth"), held(F.get("Path", F.lit(0))).alias("RootSpanId"), held(F.col("Path")).alias("Path"),
        (duration - F.coalesce("Covered", F.lit(0))).alias("SelfNano"), (F.col("Critical") & ~F.col("Cycle")).alias("Critical"), "Orphan", "Cycle",
    )


def critical_paths(t: SignalTables) -> DataFrame:
    """For each root the spans of its critical path in order, with the self time that they have together."""
    on = span_tree(t).where("Critical")
    return on.groupBy("TraceId", "RootSpanId").agg(F.array_sort(F.collect_list(F.struct("Depth", "SpanId"))).alias("s"), F.sum("SelfNano").alias("SelfNano")).select("TraceId", "RootSpanId", F.transform("s", lambda x: x["SpanId"]).alias("Path"), "SelfNano")
