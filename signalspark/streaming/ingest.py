"""Continuous ingest of export requests, and streaming twins of batch queries."""

from __future__ import annotations

from datetime import timedelta
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from signalspark.functions.columns import to_time
from signalspark.plans.ingest import INGEST
from signalspark.sources import otlp
from signalspark.sources.requests import NAME, registered
from signalspark.sources.store import Store


def requests(spark: SparkSession, path: str, framing: str = "lines", **options: str) -> DataFrame:
    """Files of export requests as they arrive (see :mod:`signalspark.sources.requests`)."""
    return registered(spark).readStream.format(NAME).options(framing=framing, **options).load(path)


def stored_requests(spark: SparkSession, path: str, framing: str = "lines", **options: str) -> DataFrame:
    """The same files as one batch, with the same keys."""
    return registered(spark).read.format(NAME).options(framing=framing, **options).load(path)


def into_store(source: DataFrame, store: Store, signal: str, checkpoint: str, within: timedelta | None = None) -> DataStreamWriter:
    """A stream that stores each micro-batch with the functions of batch ingest, under the batch's number; one that is
    run again after a failure replaces what it wrote. Requests are parsed once for each batch.

    Spans are told apart from all stored ones; only their two ids are read, against those of the batch. ``within``
    narrows that to the days of the batch's spans, give or take so much, where copies are known to come with
    their own start time."""

    stream = sha1(checkpoint.encode()).hexdigest()[:12]

    def each(batch: DataFrame, number: int) -> None:
        name = f"{signal}-{number}"
        with store.staging(f"{signal}-{stream}-{number}") as stage:
            known = store.read(without=name)
            held = stage(batch)
            if within is not None and signal == "traces":
                low, high = otlp.spans(held).agg(F.min("StartTimeUnixNano"), F.max("StartTimeUnixNano")).first()
                if low is not None:
                    slack = int(within.total_seconds()) * 10**9
                    known = known.with_tables(spans=store.table("spans", low - slack, high + slack, name))
            store.append(INGEST[signal](held, known=known, stage=stage, export=name), name)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def unique_spans(source: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Spans of a stream of requests, each once as long as its copies come within ``lateness``."""
    spans = otlp.spans(source).where("Rejected IS NULL").withColumn("StartTime", to_time(F.col("StartTimeUnixNano")))
    return spans.withWatermark("StartTime", lateness).dropDuplicatesWithinWatermark(["TraceId", "SpanId"])


def severity_counts(records: DataFrame, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Records by severity and window of their time; a window closes once the watermark has passed it. Records
    without a time take no part."""
    timed = records.where("TimeUnixNano IS NOT NULL").withColumn("Time", to_time(F.col("TimeUnixNano"))).withWatermark("Time", lateness)
    counted = timed.groupBy(F.window("Time", window).alias("w"), "SeverityText", "SeverityNumber").agg(F.count("*").alias("Count"))
    return counted.select(F.col("w.start").alias("WindowStart"), F.col("w.end").alias("WindowEnd"), "SeverityText", "SeverityNumber", "Count")


def trace_sessions(spans: DataFrame, gap: str = "30 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Traces as sessions: a trace is complete when no span of it has started for ``gap``."""
    timed = spans.withColumn("Time", to_time(F.col("StartTimeUnixNano"))).withWatermark("Time", lateness)
    grouped = timed.groupBy("TraceId", F.session_window("Time", gap).alias("w")).agg(F.count("*").alias("SpanCount"), F.count_if(F.col("StatusCode") == "ERROR").alias("ErrorCount"))
    return grouped.select("TraceId", F.col("w.start").alias("FirstStart"), F.col("w.end").alias("CompleteAt"), "SpanCount", "ErrorCount")
