"""Logs: lookups, filters, severity statistics and token search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions.columns import Bound, any_term, checked_range, collated, in_range, required, terms, words_of
from signalspark.tables import SignalTables


def _with_dimensions(t: SignalTables, logs: DataFrame) -> DataFrame:
    return logs.join(t.services(), "ResourceId", "left").join(t.scopes(), "ScopeId", "left")


def log_by_id(t: SignalTables, log_id: int) -> DataFrame:
    """One record with resource and scope, or no row."""
    return _with_dimensions(t, t.log_records.where(F.col("Id") == log_id))


def logs_by_trace(t: SignalTables, trace_id: str) -> DataFrame:
    """The records of a trace by time; those without a time come first."""
    return _with_dimensions(t, t.log_records.where(F.col("TraceId") == required(trace_id, "trace id"))).orderBy(F.asc_nulls_first("TimeUnixNano"), "Id")


def logs_by_time_range(t: SignalTables, start: Bound, end: Bound) -> DataFrame:
    """Records with a time within the range (both ends included), by time."""
    return _with_dimensions(t, t.log_records.where(in_range(F.col("TimeUnixNano"), *checked_range(start, end)))).orderBy("TimeUnixNano", "Id")


def logs_by_severity(t: SignalTables, least: int, start: Bound = None, end: Bound = None) -> DataFrame:
    """Records of at least a severity number, by time; a missing number is below any."""
    mine = (F.col("SeverityNumber") >= least) & in_range(F.col("TimeUnixNano"), start, end)
    return _with_dimensions(t, t.log_records.where(mine)).orderBy(F.asc_nulls_first("TimeUnixNano"), "Id")


def error_logs_with_trace(t: SignalTables, case_insensitive: bool = False, collation: str | None = None) -> DataFrame:
    """Errors that belong to a trace, the latest first; with a collation (``LOOSE``), whatever is ERROR in it."""
    severity = F.upper("SeverityText") if case_insensitive else collated(F.col("SeverityText"), collation)
    mine = t.log_records.where((severity == "ERROR") & F.col("TraceId").isNotNull())
    return mine.select("BodyValue", "TraceId", "SpanId", "TimeUnixNano").orderBy(F.desc("TimeUnixNano"), "SpanId")


def log_severity_stats(t: SignalTables, collation: str | None = None) -> DataFrame:
    """Records with a time by severity and day (UTC). With a collation, severities whose texts are equal in it count together,
    under the smallest of them."""
    day = F.to_date(F.timestamp_seconds(F.call_function("div", F.col("TimeUnixNano"), F.lit(1_000_000_000))))
    timed = t.log_records.where("TimeUnixNano IS NOT NULL")
    if collation is None:
        return timed.groupBy("SeverityText", "SeverityNumber", day.alias("LogDate")).agg(F.count("*").alias("Count"))
    grouped = timed.groupBy(collated(F.col("SeverityText"), collation).alias("__severity"), "SeverityNumber", day.alias("LogDate"))
    return grouped.agg(F.min("SeverityText").alias("SeverityText"), F.count("*").alias("Count")).select("SeverityText", "SeverityNumber", "LogDate", "Count")


def log_fulltext_search(t: SignalTables, query: str, relevance: bool = False, shortest: int = 3) -> DataFrame:
    """Records whose body has any of the query's terms (runs of letters, digits and underscores of any script, in any case, of
    ``shortest`` characters or more; a query without any is an error). With ``relevance``, a ``Score`` as well: the sum over the terms of
    frequency times the squared log10(records / records with the term), the highest first."""
    wanted = words_of(query, shortest)
    if not relevance:
        return t.log_records.where(any_term(F.col("BodyValue"), wanted))
    found = t.log_records.withColumn("__terms", terms(F.col("BodyValue")))
    has = found.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("__terms", w)).alias(f"n{i}") for i, w in enumerate(wanted)])
    times = lambda w: F.size(F.filter("__terms", lambda x: x == F.lit(w)))
    weight = lambda i: F.pow(F.log10(F.col("__has.n") / F.nullif(F.col(f"__has.n{i}"), F.lit(0))), F.lit(2))
    score = reduce(lambda a, b: a + b, [F.coalesce(times(w) * weight(i), F.lit(0.0)) for i, w in enumerate(wanted)])
    matching = found.where(F.arrays_overlap("__terms", F.array(*map(F.lit, wanted)))).withColumn("__has", has.select(F.struct("*").alias("s")).scalar())
    return matching.withColumn("Score", score).drop("__terms", "__has").orderBy(F.desc("Score"), "Id")


def logs_with_prefix(t: SignalTables, prefix: str) -> DataFrame:
    """Records whose body starts with a text; the test reaches the files as a pushed filter."""
    return t.log_records.where(F.col("BodyValue").startswith(prefix))


def logs_with_spans(t: SignalTables) -> DataFrame:
    """Records with a trace context beside the span they belong to."""
    spans = t.referred_spans.select("TraceId", "SpanId", F.col("Name").alias("SpanName"), "Kind", "StatusCode")
    return t.log_records.join(spans, ["TraceId", "SpanId"]).select("Id", "TraceId", "SpanId", "SpanName", "Kind", "StatusCode", "SeverityText", "BodyValue")
