"""The queries of the signal operators for ``__spark_entry__.py``, each beside its DuckDB form. The tables are
derived from ``events`` by :mod:`signalspark.sources.events`; times are shown as epoch milliseconds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.operators import logs, metrics, retention, traces
from signalspark.plans import constraints, views
from signalspark.sources import events
from signalspark.tables import SignalTables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries.
START, END = 1704844800000000000, 1705104000000000000
START_TIME, END_TIME = datetime(2024, 1, 1, 1, tzinfo=UTC), datetime(2024, 1, 1, 3, tzinfo=UTC)
NOW = datetime(2024, 2, 5, tzinfo=UTC)
SERVICE = "svc_click"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def signal_tables(spark: SparkSession, sf_dir: str) -> SignalTables:
    return events.signal_tables(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as epoch milliseconds."""
    return df.select(*[F.unix_millis(F.col(f.name).cast("timestamp")).alias(f.name) if f.dataType.typeName().startswith("timestamp") else f.name for f in df.schema.fields])


def query(name: str, sql: str | None) -> Callable[[Callable[[SignalTables], DataFrame]], Callable[[SignalTables], DataFrame]]:
    """Registers a function of the tables, with its DuckDB form over the derived tables."""

    def register(f: Callable[[SignalTables], DataFrame]) -> Callable[[SignalTables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(signal_tables(spark, sf_dir)))
        if sql:
            ORACLES[name] = events.duckdb_sql(sql)
        return f

    return register


def one(df: DataFrame, column: str):
    """The smallest value of a column: the parameter of a lookup."""
    return df.agg(F.min(column)).first()[0]


SVC = "(SELECT *, json_extract_string(AttributesJson, '$.\"service.name\"') svc FROM resources)"
INFO = "count(*) SpanCount, min(StartTimeUnixNano) s, max(EndTimeUnixNano) f, bool_or(StatusCode = 'ERROR') HasErrors"
SHOWN = "s // 1000000 StartTime, f // 1000000 EndTime, f // 1000000 - s // 1000000 DurationMs"
EDGES = f"""FROM spans c JOIN spans p ON c.ParentSpanId = p.SpanId AND c.TraceId = p.TraceId
  JOIN {SVC} pr ON p.ResourceId = pr.Id JOIN {SVC} cr ON c.ResourceId = cr.Id WHERE pr.svc <> cr.svc"""
CALLS = f"""SELECT pr.svc ParentService, cr.svc ChildService, c.Kind SpanKind, count(*) CallCount,
  avg(c.EndTimeUnixNano - c.StartTimeUnixNano) / 1000000 AvgDurationMs, min(c.EndTimeUnixNano - c.StartTimeUnixNano) / 1000000 MinDurationMs,
  max(c.EndTimeUnixNano - c.StartTimeUnixNano) / 1000000 MaxDurationMs, count(CASE WHEN c.StatusCode = 'ERROR' THEN 1 END) ErrorCount,
  count(CASE WHEN c.StatusCode = 'ERROR' THEN 1 END) / count(*) * 100 ErrorRate {EDGES}"""
SPAN = """s.Id, s.TraceId, s.SpanId, s.ParentSpanId, s.Name, s.Kind, s.StartTimeUnixNano, s.EndTimeUnixNano, s.StatusCode, r.svc ServiceName, sc.Name ScopeName,
  (SELECT count(*) FROM span_events x WHERE x.SpanId = s.Id) EventCount, (SELECT count(*) FROM span_links x WHERE x.SpanId = s.Id) LinkCount"""
SPANS = f"SELECT {SPAN} FROM spans s JOIN {SVC} r ON s.ResourceId = r.Id JOIN instrumentation_scopes sc ON s.ScopeId = sc.Id"


def spans(df: DataFrame) -> DataFrame:
    columns = ("Id", "TraceId", "SpanId", "ParentSpanId", "Name", "Kind", "StartTimeUnixNano", "EndTimeUnixNano", "StatusCode", "ServiceName", "ScopeName")
    return df.select(*columns, F.size("Events").cast("long").alias("EventCount"), F.size("Links").cast("long").alias("LinkCount"))


# Traces.


@query("trace_by_id", f"{SPANS} WHERE s.TraceId = (SELECT min(TraceId) FROM spans)")
def _(t: SignalTables) -> DataFrame:
    return spans(traces.trace_by_id(t, one(t.spans, "TraceId")))


@query("span_by_id", f"{SPANS} WHERE s.SpanId = (SELECT min(SpanId) FROM spans)")
def _(t: SignalTables) -> DataFrame:
    row = t.spans.where(F.col("SpanId") == one(t.spans, "SpanId")).first()
    return spans(traces.span_by_id(t, row["TraceId"], row["SpanId"]))


@query("spans_by_parent", f"{SPANS} WHERE s.ParentSpanId = (SELECT min(ParentSpanId) FROM spans)")
def _(t: SignalTables) -> DataFrame:
    row = t.spans.where(F.col("ParentSpanId") == one(t.spans, "ParentSpanId")).first()
    return spans(traces.spans_by_parent(t, row["TraceId"], row["ParentSpanId"]))


@query("traces_by_time_range", f"SELECT TraceId, SpanCount, HasErrors, {SHOWN} FROM (SELECT TraceId, {INFO} FROM spans WHERE StartTimeUnixNano BETWEEN {START} AND {END} GROUP BY TraceId ORDER BY s DESC, TraceId LIMIT 100)")
def _(t: SignalTables) -> DataFrame:
    return traces.traces_by_time_range(t, START, END)


@query("traces_by_service", f"SELECT TraceId, SpanCount, HasErrors, '{SERVICE}' ServiceName, {SHOWN} FROM (SELECT TraceId, {INFO} FROM spans s JOIN {SVC} r ON s.ResourceId = r.Id WHERE svc = '{SERVICE}' GROUP BY TraceId ORDER BY s DESC, TraceId LIMIT 100)".replace("min(StartTimeUnixNano) s,", "min(StartTimeUnixNano) AS s,").replace("FROM spans s JOIN", "FROM spans x JOIN").replace("s.ResourceId", "x.ResourceId"))
def _(t: SignalTables) -> DataFrame:
    return traces.traces_by_service(t, SERVICE)


@query("error_traces", f"SELECT TraceId, SpanCount, HasErrors, {SHOWN} FROM (SELECT TraceId, {INFO} FROM spans WHERE StatusCode = 'ERROR' GROUP BY TraceId ORDER BY s DESC, TraceId LIMIT 100)")
def _(t: SignalTables) -> DataFrame:
    return traces.error_traces(t)


@query("slow_traces", f"SELECT TraceId, SpanCount, HasErrors, {SHOWN} FROM (SELECT TraceId, {INFO} FROM spans GROUP BY TraceId HAVING max(EndTimeUnixNano) - min(StartTimeUnixNano) >= 3600000000000 ORDER BY f - s DESC, TraceId LIMIT 100)")
def _(t: SignalTables) -> DataFrame:
    return traces.slow_traces(t, timedelta(hours=1))


@query("trace_summary", "SELECT hex(TraceId) TraceIdHex, TraceId, ResourceId, count(*) SpanCount, min(StartTimeUnixNano) TraceStartTime, max(EndTimeUnixNano) TraceEndTime, max(EndTimeUnixNano) - min(StartTimeUnixNano) TraceDurationNs FROM spans GROUP BY TraceId, ResourceId")
def _(t: SignalTables) -> DataFrame:
    return traces.trace_summary(t)


@query("trace_summary_by_hex", "SELECT hex(TraceId) TraceIdHex, TraceId, ResourceId, count(*) SpanCount, min(StartTimeUnixNano) TraceStartTime, max(EndTimeUnixNano) TraceEndTime, max(EndTimeUnixNano) - min(StartTimeUnixNano) TraceDurationNs FROM spans WHERE TraceId = (SELECT max(TraceId) FROM spans) GROUP BY TraceId, ResourceId")
def _(t: SignalTables) -> DataFrame:
    return traces.trace_summary(t, t.spans.agg(F.hex(F.max("TraceId"))).first()[0])


@query("service_map", f"SELECT pr.svc ParentService, cr.svc ChildService, c.Kind SpanKind, count(*) CallCount {EDGES} GROUP BY ALL")
def _(t: SignalTables) -> DataFrame:
    return traces.service_map(t)


@query("service_map_detailed", f"{CALLS} GROUP BY ALL")
def _(t: SignalTables) -> DataFrame:
    return traces.service_map_detailed(t)


@query("service_dependencies", f"{CALLS} AND c.StartTimeUnixNano BETWEEN {START} AND {END} GROUP BY ALL")
def _(t: SignalTables) -> DataFrame:
    return traces.service_dependencies(t, START, END)


@query("service_map_by_calls", f"SELECT ParentService, ChildService, SpanKind, CallCount, AvgDurationMs, ErrorRate FROM ({CALLS} GROUP BY ALL)")
def _(t: SignalTables) -> DataFrame:
    return traces.service_map_by_calls(t)


@query("operation_counts", f"SELECT x.Name, count(*) SpanCount FROM spans x JOIN {SVC} r ON x.ResourceId = r.Id WHERE svc = '{SERVICE}' GROUP BY x.Name")
def _(t: SignalTables) -> DataFrame:
    return traces.operation_counts(t, SERVICE)


@query("average_latencies", f"SELECT x.Name, round(avg(EndTimeUnixNano - StartTimeUnixNano) / 1000000, 6) AvgDurationMs FROM spans x JOIN {SVC} r ON x.ResourceId = r.Id WHERE svc = '{SERVICE}' GROUP BY x.Name")
def _(t: SignalTables) -> DataFrame:
    return traces.average_latencies(t, SERVICE).withColumn("AvgDurationMs", F.round("AvgDurationMs", 6))


@query("slow_operations", "SELECT Name, avg(EndTimeUnixNano - StartTimeUnixNano) / 1000000 AvgDurationMs FROM spans GROUP BY Name HAVING AvgDurationMs > 49")
def _(t: SignalTables) -> DataFrame:
    return traces.slow_operations(t, 49)


@query("root_spans", f"SELECT TraceId, x.Name RootOperationName, svc RootService FROM spans x LEFT JOIN {SVC} r ON x.ResourceId = r.Id WHERE ParentSpanId IS NULL QUALIFY row_number() OVER (PARTITION BY TraceId ORDER BY StartTimeUnixNano, SpanId) = 1")
def _(t: SignalTables) -> DataFrame:
    return traces.root_spans(t)


@query("linked_spans", "SELECT l.Id, a.TraceId, a.Name FromName, l.LinkedTraceId, l.LinkedSpanId, b.Name ToName FROM span_links l JOIN spans a ON a.Id = l.SpanId LEFT JOIN spans b ON b.TraceId = l.LinkedTraceId AND b.SpanId = l.LinkedSpanId")
def _(t: SignalTables) -> DataFrame:
    return traces.linked_spans(t)


# Logs.

LOG = ("Id", "TimeUnixNano", "SeverityNumber", "SeverityText", "BodyValue", "TraceId", "SpanId", "ServiceName", "ScopeName")
LOGS = f"SELECT l.Id, TimeUnixNano, SeverityNumber, SeverityText, BodyValue, TraceId, SpanId, r.svc ServiceName, sc.Name ScopeName FROM log_records l JOIN {SVC} r ON l.ResourceId = r.Id JOIN instrumentation_scopes sc ON l.ScopeId = sc.Id"


@query("log_by_id", f"{LOGS} WHERE l.Id = (SELECT min(Id) FROM log_records)")
def _(t: SignalTables) -> DataFrame:
    return logs.log_by_id(t, one(t.log_records, "Id")).select(*LOG)


@query("logs_by_trace", f"{LOGS} WHERE TraceId = (SELECT min(TraceId) FROM log_records)")
def _(t: SignalTables) -> DataFrame:
    return logs.logs_by_trace(t, one(t.log_records, "TraceId")).select(*LOG)


@query("logs_by_time_range", f"{LOGS} WHERE TimeUnixNano BETWEEN {START} AND {END}")
def _(t: SignalTables) -> DataFrame:
    return logs.logs_by_time_range(t, START, END).select(*LOG)


@query("logs_by_severity", f"{LOGS} WHERE SeverityNumber >= 17")
def _(t: SignalTables) -> DataFrame:
    return logs.logs_by_severity(t, 17).select(*LOG)


@query("error_logs_with_trace", "SELECT BodyValue, TraceId, SpanId, TimeUnixNano FROM log_records WHERE SeverityText = 'ERROR' AND TraceId IS NOT NULL")
def _(t: SignalTables) -> DataFrame:
    return logs.error_logs_with_trace(t)


@query("log_severity_stats", "SELECT SeverityText, SeverityNumber, strftime(make_timestamp(TimeUnixNano // 1000), '%Y-%m-%d') LogDate, count(*) Count FROM log_records WHERE TimeUnixNano IS NOT NULL GROUP BY ALL")
def _(t: SignalTables) -> DataFrame:
    return logs.log_severity_stats(t).withColumn("LogDate", F.col("LogDate").cast("string"))


@query("log_fulltext_search", "SELECT Id, BodyValue FROM log_records WHERE list_has_any(regexp_split_to_array(lower(BodyValue), '[^a-z0-9_]+'), ['error', 'purchase'])")
def _(t: SignalTables) -> DataFrame:
    return logs.log_fulltext_search(t, "error purchase").select("Id", "BodyValue")


@query("log_fulltext_relevance", """SELECT Id, BodyValue, round(len(list_filter(w, lambda x: x = 'error')) * power(log10(n / ne), 2) + len(list_filter(w, lambda x: x = 'purchase')) * power(log10(n / np), 2), 9) Score
 FROM (SELECT *, count(*) OVER () n, count(CASE WHEN list_contains(w, 'error') THEN 1 END) OVER () ne, count(CASE WHEN list_contains(w, 'purchase') THEN 1 END) OVER () np
       FROM (SELECT Id, BodyValue, regexp_split_to_array(lower(BodyValue), '[^a-z0-9_]+') w FROM log_records)) WHERE list_has_any(w, ['error', 'purchase'])""")
def _(t: SignalTables) -> DataFrame:
    return logs.log_fulltext_search(t, "error purchase", relevance=True).select("Id", "BodyValue", F.round("Score", 9).alias("Score"))


@query("logs_with_prefix", "SELECT Id, BodyValue FROM log_records WHERE starts_with(BodyValue, 'error by')")
def _(t: SignalTables) -> DataFrame:
    return logs.logs_with_prefix(t, "error by").select("Id", "BodyValue")


@query("logs_with_spans", "SELECT l.Id, l.TraceId, l.SpanId, s.Name SpanName, Kind, StatusCode, SeverityText, BodyValue FROM log_records l JOIN spans s ON l.TraceId = s.TraceId AND l.SpanId = s.SpanId")
def _(t: SignalTables) -> DataFrame:
    return logs.logs_with_spans(t)


# Metrics.

METRIC = "m.Id, m.Name, cast(null as varchar) Description, cast(null as varchar) Unit, m.Type, svc ServiceName, epoch_us(CreatedAt) // 1000 FirstSeen, epoch_us(CreatedAt) // 1000 LastSeen"
METRICS = f"SELECT {METRIC} FROM metrics m JOIN {SVC} r ON m.ResourceId = r.Id"
DAY_MS = 86_400_000


@query("metric_by_id", f"SELECT m.Id, m.Name, m.Type, svc ServiceName, (SELECT count(*) FROM gauge_data_points g WHERE g.MetricId = m.Id) GaugePoints FROM metrics m JOIN {SVC} r ON m.ResourceId = r.Id WHERE m.Id = (SELECT min(Id) FROM metrics)")
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_by_id(t, one(t.metrics, "Id")).select("Id", "Name", "Type", "ServiceName", F.size("GaugePoints").cast("long").alias("GaugePoints"))


@query("metrics_by_name", f"{METRICS} WHERE m.Name = 'app.click'")
def _(t: SignalTables) -> DataFrame:
    return metrics.metrics_by_name(t, "app.click")


@query("metrics_by_service", f"{METRICS} WHERE svc = '{SERVICE}'")
def _(t: SignalTables) -> DataFrame:
    return metrics.metrics_by_service(t, SERVICE)


@query("metrics_by_type", f"{METRICS} WHERE m.Type = 'HISTOGRAM'")
def _(t: SignalTables) -> DataFrame:
    return metrics.metrics_by_type(t, "HISTOGRAM")


@query("all_metrics", f"{METRICS} ORDER BY CreatedAt DESC, m.Id LIMIT 10")
def _(t: SignalTables) -> DataFrame:
    return metrics.all_metrics(t, 10)


@query("metric_counts_by_type", "SELECT Type, count(*) MetricCount FROM metrics GROUP BY Type")
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_counts_by_type(t)


@query("unique_metric_names", f"SELECT DISTINCT m.Name FROM metrics m JOIN {SVC} r ON m.ResourceId = r.Id WHERE svc = '{SERVICE}'")
def _(t: SignalTables) -> DataFrame:
    return metrics.unique_metric_names(t, SERVICE)


@query("service_metric_summaries", f"""SELECT coalesce(svc, 'unknown') ServiceName, count(*) TotalMetrics, count(CASE WHEN Type = 'GAUGE' THEN 1 END) GaugeCount,
 count(CASE WHEN Type = 'SUM' THEN 1 END) SumCount, count(CASE WHEN Type IN ('HISTOGRAM', 'EXPONENTIAL_HISTOGRAM') THEN 1 END) HistogramCount,
 count(CASE WHEN Type = 'SUMMARY' THEN 1 END) SummaryCount, epoch_us(max(CreatedAt)) // 1000 LastUpdated FROM metrics m JOIN {SVC} r ON m.ResourceId = r.Id GROUP BY 1""")
def _(t: SignalTables) -> DataFrame:
    return metrics.service_metric_summaries(t)


@query("latest_metric_values", f"""SELECT Name, arg_max(Value, (k, TimeUnixNano, Id)) AS Value FROM (
  SELECT m.Name, 0 k, TimeUnixNano, g.Id, coalesce(ValueDouble, cast(ValueInt as double), 0) AS Value FROM gauge_data_points g JOIN metrics m ON g.MetricId = m.Id JOIN {SVC} r ON m.ResourceId = r.Id WHERE svc = 'svc_error'
  UNION ALL SELECT m.Name, 1, TimeUnixNano, g.Id, coalesce(ValueDouble, cast(ValueInt as double), 0) FROM sum_data_points g JOIN metrics m ON g.MetricId = m.Id JOIN {SVC} r ON m.ResourceId = r.Id WHERE svc = 'svc_error') GROUP BY Name""")
def _(t: SignalTables) -> DataFrame:
    return metrics.latest_metric_values(t, "svc_error")


@query("latest_gauge_values", "SELECT m.Name, g.ValueDouble, g.TimeUnixNano FROM gauge_data_points g JOIN metrics m ON g.MetricId = m.Id ORDER BY g.TimeUnixNano DESC, g.Id DESC LIMIT 100")
def _(t: SignalTables) -> DataFrame:
    return metrics.latest_gauge_values(t)


@query("metric_labels", "SELECT DISTINCT k LabelKey, json_extract_string(AttributesJson, '$.' || k) LabelValue FROM (SELECT AttributesJson, unnest(json_keys(AttributesJson)) k FROM gauge_data_points)")
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_labels(t, "app.click")


def series(name: str, sql_columns: str, table: str, metric: str, first: bool, where: str = "") -> str:
    pick = f"(SELECT min(Id) FROM metrics WHERE Name = '{metric}')"
    rows = f"g.MetricId = {pick}" if first else f"g.MetricId IN (SELECT Id FROM metrics WHERE Name = '{metric}')"
    return f"SELECT TimeUnixNano // 1000000 AS \"Timestamp\", {sql_columns} FROM {table} g WHERE {rows} AND TimeUnixNano BETWEEN {START} AND {END}{where}"


@query("metric_series_gauge", series("gauge", "ValueDouble DoubleValue, ValueInt IntValue", "gauge_data_points", "app.click", True))
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_series(t, "app.click", START, END, all_rows=False, kinds=("GAUGE",)).select("Timestamp", "DoubleValue", "IntValue")


@query("metric_series_sum", series("sum", "ValueDouble DoubleValue, ValueInt IntValue", "sum_data_points", "app.view", True))
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_series(t, "app.view", START, END, all_rows=False, kinds=("SUM",)).select("Timestamp", "DoubleValue", "IntValue")


@query("metric_series_histogram", series("histogram", "Count, SumValue AS \"Sum\", Min_Value AS \"Min\", Max_Value AS \"Max\", BucketCounts, replace(ExplicitBounds, '.0', '') BucketBounds", "histogram_data_points", "app.purchase", False))
def _(t: SignalTables) -> DataFrame:
    found = metrics.metric_series(t, "app.purchase", START, END, kinds=("HISTOGRAM",))
    return found.select("Timestamp", "Count", "Sum", "Min", "Max", F.to_json("BucketCounts").alias("BucketCounts"), F.replace(F.to_json("BucketBounds"), F.lit(".0"), F.lit("")).alias("BucketBounds"))


@query("metric_series_exphistogram", series("exphistogram", "Count, SumValue AS \"Sum\", Min_Value AS \"Min\", Max_Value AS \"Max\"", "exponential_histogram_data_points", "app.error", False))
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_series(t, "app.error", START, END, kinds=("EXPONENTIAL_HISTOGRAM",)).select("Timestamp", "Count", "Sum", "Min", "Max")


@query("metric_series_summary", series("summary", "Count, SumValue AS \"Sum\", cast(json_extract_string(QuantileValues, '$[0].Value') AS double) Lowest, cast(json_extract_string(QuantileValues, '$[1].Value') AS double) Highest, json_array_length(QuantileValues)::int QuantileCount", "summary_data_points", "app.signup", False))
def _(t: SignalTables) -> DataFrame:
    found = metrics.metric_series(t, "app.signup", START, END, kinds=("SUMMARY",))
    return found.select("Timestamp", "Count", "Sum", F.get("QuantileValues", F.lit(0)).alias("Lowest"), F.get("QuantileValues", F.lit(1)).alias("Highest"), F.size("Quantiles").alias("QuantileCount"))


@query("metric_series_labelled", series("gauge", "ValueDouble DoubleValue, ValueInt IntValue", "gauge_data_points", "app.click", False, " AND json_extract_string(AttributesJson, '$.host') = 'h1'"))
def _(t: SignalTables) -> DataFrame:
    return metrics.metric_series(t, "app.click", START, END, where={"host": "h1"}, kinds=("GAUGE",)).select("Timestamp", "DoubleValue", "IntValue")


@query("multiple_metric_series", f"""SELECT m.Name, TimeUnixNano // 1000000 AS "Timestamp", ValueInt IntValue, cast(null as bigint) Count FROM sum_data_points g JOIN metrics m ON g.MetricId = m.Id WHERE m.Name = 'app.view' AND TimeUnixNano BETWEEN {START} AND {END}
 UNION ALL SELECT m.Name, TimeUnixNano // 1000000, null, Count FROM histogram_data_points g JOIN metrics m ON g.MetricId = m.Id WHERE m.Name = 'app.purchase' AND TimeUnixNano BETWEEN {START} AND {END}""")
def _(t: SignalTables) -> DataFrame:
    return metrics.multiple_metric_series(t, ["app.view", "app.purchase", "app.unknown"], START, END).select("Name", "Timestamp", "IntValue", "Count")


@query("exemplars_with_spans", "SELECT e.Id, e.TraceId, e.SpanId, s.Name SpanName, StatusCode, ValueDouble, ValueInt, TimeUnixNano FROM exemplars e JOIN spans s ON e.TraceId = s.TraceId AND e.SpanId = s.SpanId")
def _(t: SignalTables) -> DataFrame:
    return metrics.exemplars_with_spans(t)


@query("histogram_quantile", f"""SELECT TimeUnixNano // 1000000 AS "Timestamp", round(CASE WHEN c1 >= r THEN lo + (10 - lo) * (CASE WHEN c1 > 0 THEN r / c1 ELSE 0 END)
  WHEN c1 + c2 >= r THEN 10 + 40 * (r - c1) / c2 ELSE 50 + (Max_Value - 50) * (r - c1 - c2) / c3 END, 6) AS "Value" FROM (
  SELECT TimeUnixNano, Min_Value lo, Max_Value, 0.5 * Count r, cast(json_extract_string(BucketCounts, '$[0]') AS bigint) c1, cast(json_extract_string(BucketCounts, '$[1]') AS bigint) c2, cast(json_extract_string(BucketCounts, '$[2]') AS bigint) c3
  FROM histogram_data_points WHERE TimeUnixNano BETWEEN {START} AND {END})""")
def _(t: SignalTables) -> DataFrame:
    return metrics.histogram_quantile(t, "app.purchase", 0.5, START, END).select("Timestamp", F.round("Value", 6).alias("Value"))


def all_violations_sql(spans: str = "spans") -> str:
    """Every rule written out here again, so that one the operator drops shows. ``spans`` is what stands for the spans."""
    unique = {"resources": "Id", "instrumentation_scopes": "Id", "metrics": "Id", "log_records": "Id", "exemplars": "Id", "spans": "TraceId, SpanId"}
    points = ("gauge_data_points", "sum_data_points", "histogram_data_points", "exponential_histogram_data_points", "summary_data_points")
    references = [
        ("spans", "ResourceId", "resources"), ("spans", "ScopeId", "instrumentation_scopes"), ("span_events", "SpanId", "spans"), ("span_links", "SpanId", "spans"),
        ("metrics", "ResourceId", "resources"), ("log_records", "ResourceId", "resources"), ("log_records", "ScopeId", "instrumentation_scopes"), *((x, "MetricId", "metrics") for x in points),
    ]
    temporality = ("AggregationTemporality", "'UNSPECIFIED', 'DELTA', 'CUMULATIVE'")
    values = [
        ("spans", "Kind", "'UNSPECIFIED', 'INTERNAL', 'SERVER', 'CLIENT', 'PRODUCER', 'CONSUMER'"), ("spans", "StatusCode", "'UNSET', 'OK', 'ERROR'"),
        ("metrics", "Type", "'GAUGE', 'SUM', 'HISTOGRAM', 'EXPONENTIAL_HISTOGRAM', 'SUMMARY'"), *((x, *temporality) for x in points[1:4]),
        ("log_records", "BodyType", "'STRING', 'BOOL', 'INT', 'DOUBLE', 'BYTES', 'ARRAY', 'KVLIST'"),
    ]
    of = {"spans": spans}
    parts = [f"SELECT '{t}' TableName, 'unique {c}' Rule, count(*) Violations FROM (SELECT 1 FROM {of.get(t, t)} GROUP BY {c} HAVING count(*) > 1)" for t, c in unique.items()]
    parts += [f"SELECT '{t}', '{c} in {parent}', count(*) FROM {of.get(t, t)} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {of.get(parent, parent)} p WHERE p.Id = x.{c})" for t, c, parent in references]
    return " UNION ALL ".join(parts + [f"SELECT '{t}', 'values of {c}', count(*) FROM {of.get(t, t)} WHERE {c} NOT IN ({v})" for t, c, v in values])


@query("all_constraint_violations", all_violations_sql())
def _(t: SignalTables) -> DataFrame:
    return constraints.violations(t)


@query("constraint_violations", all_violations_sql("(SELECT * FROM spans WHERE Id % 10 > 0)"))
def _(t: SignalTables) -> DataFrame:
    """The rules over tables that lack every tenth span, whose events and links are orphans."""
    return constraints.violations(t.with_tables(spans=t.spans.where("Id % 10 > 0")))


# Deletes: what is left.


def left(t: SignalTables) -> DataFrame:
    """Ids that are left of spans, events and links."""
    return t.spans.select(F.lit("spans").alias("TableName"), "Id").union(t.span_events.select(F.lit("span_events"), "Id")).union(t.span_links.select(F.lit("span_links"), "Id"))


def left_sql(gone: str) -> str:
    keep = f"SELECT Id FROM spans WHERE NOT coalesce({gone}, false)"
    return f"SELECT 'spans' TableName, Id FROM spans WHERE Id IN ({keep}) UNION ALL SELECT 'span_events', Id FROM span_events WHERE SpanId IN ({keep}) UNION ALL SELECT 'span_links', Id FROM span_links WHERE SpanId IN ({keep})"


@query("delete_trace", left_sql("TraceId = (SELECT min(TraceId) FROM spans)"))
def _(t: SignalTables) -> DataFrame:
    return left(retention.delete_trace(t, one(t.spans, "TraceId")))


@query("delete_span", left_sql("SpanId = (SELECT min(SpanId) FROM spans)"))
def _(t: SignalTables) -> DataFrame:
    row = t.spans.where(F.col("SpanId") == one(t.spans, "SpanId")).first()
    return left(retention.delete_span(t, row["TraceId"], row["SpanId"]))


@query("delete_traces_by_time_range", left_sql(f"StartTimeUnixNano BETWEEN {START} AND {END}"))
def _(t: SignalTables) -> DataFrame:
    return left(retention.delete_traces_by_time_range(t, START, END))


@query("deleted_traces", f"SELECT count(DISTINCT TraceId) Deleted FROM spans WHERE StartTimeUnixNano BETWEEN {START} AND {END}")
def _(t: SignalTables) -> DataFrame:
    return retention.traces_in_range(t, START, END)


@query("span_retention", left_sql(f"StartTimeUnixNano < {int((NOW - timedelta(days=30)).timestamp()) * 10**9}"))
def _(t: SignalTables) -> DataFrame:
    return left(retention.span_retention(t, NOW))


@query("delete_log", "SELECT Id FROM log_records WHERE Id <> (SELECT min(Id) FROM log_records)")
def _(t: SignalTables) -> DataFrame:
    return retention.delete_log(t, one(t.log_records, "Id")).log_records.select("Id")


@query("delete_logs_by_time_range", f"SELECT Id FROM log_records WHERE NOT coalesce(TimeUnixNano BETWEEN {START} AND {END}, false)")
def _(t: SignalTables) -> DataFrame:
    return retention.delete_logs_by_time_range(t, START, END).log_records.select("Id")


def left_metrics(t: SignalTables) -> DataFrame:
    out = t.metrics.select(F.lit("metrics").alias("TableName"), "Id")
    for name in metrics.METRIC_TYPES:
        out = out.union(t.points(name).select(F.lit(name), "Id"))
    return out


def left_metrics_sql(gone: str) -> str:
    keep = f"SELECT Id FROM metrics WHERE NOT coalesce({gone}, false)"
    parts = [f"SELECT '{kind}', Id FROM {table} WHERE MetricId IN ({keep})" for kind, table in metrics_tables().items()]
    return " UNION ALL ".join([f"SELECT 'metrics' TableName, Id FROM metrics WHERE Id IN ({keep})", *parts])


def metrics_tables() -> dict[str, str]:
    from signalspark.schemas import POINT_TABLES

    return POINT_TABLES


@query("delete_metric", left_metrics_sql("Id = (SELECT min(Id) FROM metrics)"))
def _(t: SignalTables) -> DataFrame:
    return left_metrics(retention.delete_metric(t, one(t.metrics, "Id")))


@query("delete_metrics_by_name", left_metrics_sql("Name = 'app.view'"))
def _(t: SignalTables) -> DataFrame:
    return left_metrics(retention.delete_metrics_by_name(t, "app.view"))


@query("delete_metrics_by_time_range", left_metrics_sql(f"epoch_us(CreatedAt) // 1000 BETWEEN {int(START_TIME.timestamp()) * 1000} AND {int(END_TIME.timestamp()) * 1000}"))
def _(t: SignalTables) -> DataFrame:
    return left_metrics(retention.delete_metrics_by_time_range(t, START_TIME, END_TIME))


@query("delete_old_metrics", left_metrics_sql(f"epoch_us(CreatedAt) // 1000 < {int(END_TIME.timestamp()) * 1000}"))
def _(t: SignalTables) -> DataFrame:
    return left_metrics(retention.delete_old_metrics(t, END_TIME + timedelta(days=7), timedelta(days=7)))


# Ingest: the events as export requests, flattened again.

REQUEST = """to_json(named_struct('resourceSpans', array(named_struct(
  'resource', named_struct('attributes', array(named_struct('key', 'service.name', 'value', named_struct('stringValue', concat('svc_', event_type))))),
  'scopeSpans', array(named_struct('scope', named_struct('name', 'lib', 'version', '1.0'), 'spans', array(named_struct(
    'traceId', md5(cast(user_id AS string)), 'spanId', substr(md5(cast(event_id - event_id % 3 AS string)), 1, 16), 'name', event_type,
    'kind', cast(event_id % 7 AS int), 'startTimeUnixNano', cast(unix_micros(cast(ts AS timestamp)) * 1000 AS string),
    'endTimeUnixNano', cast(unix_micros(cast(ts AS timestamp)) * 1000 + 5 AS string),
    'status', named_struct('code', CASE WHEN event_type = 'error' THEN 2 ELSE 0 END),
    'attributes', array(named_struct('key', 'b', 'value', named_struct('intValue', cast(event_id AS string), 'boolValue', cast(null AS string))), named_struct('key', 'a', 'value', named_struct('intValue', cast(null AS string), 'boolValue', 'true')))))))))))"""


def ingested(spark: SparkSession, sf_dir: str):
    from signalspark.plans.ingest import ingest_traces

    return ingest_traces(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(REQUEST).alias("value")))


def flatten_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.sources import otlp

    spans = otlp.spans(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(REQUEST).alias("value")))
    return spans.select("TraceId", "SpanId", "Name", "Kind", "StartTimeUnixNano", "EndTimeUnixNano", "StatusCode", "AttributesJson", "ResourceAttributesJson", "ResourceHash", "ScopeHash")


QUERIES["flatten_spans"] = flatten_spans
ORACLES["flatten_spans"] = """SELECT md5(cast(user_id AS varchar)) TraceId, substr(md5(cast(event_id - event_id % 3 AS varchar)), 1, 16) SpanId, event_type AS Name,
  CASE event_id % 7 WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'SERVER' WHEN 3 THEN 'CLIENT' WHEN 4 THEN 'PRODUCER' WHEN 5 THEN 'CONSUMER' ELSE 'UNSPECIFIED' END Kind,
  epoch_us(ts) * 1000 StartTimeUnixNano, epoch_us(ts) * 1000 + 5 EndTimeUnixNano, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'UNSET' END StatusCode,
  concat('{"a":true,"b":', event_id, '}') AttributesJson, concat('{"service.name":"svc_', event_type, '"}') ResourceAttributesJson,
  sha256(concat('__{"service.name":"svc_', event_type, '"}')) ResourceHash, sha256('lib__1.0____{}') ScopeHash FROM events"""

#: A log record of every event; some have no time, no severity or a number as their body.
LOG_REQUEST = """to_json(named_struct('resourceLogs', array(named_struct(
  'resource', named_struct('attributes', array(named_struct('key', 'service.name', 'value', named_struct('stringValue', concat('svc_', event_type))))),
  'scopeLogs', array(named_struct('scope', named_struct('name', 'lib'), 'logRecords', array(named_struct(
    'timeUnixNano', CASE WHEN event_id % 5 = 0 THEN '0' ELSE cast(unix_micros(cast(ts AS timestamp)) * 1000 AS string) END,
    'severityNumber', cast(event_id % 25 AS int), 'severityText', CASE WHEN event_id % 4 = 0 THEN '' ELSE upper(event_type) END,
    'body', named_struct('stringValue', CASE WHEN event_id % 3 > 0 THEN event_type END, 'intValue', CASE WHEN event_id % 3 = 0 THEN cast(event_id AS string) END),
    'traceId', CASE WHEN event_id % 2 = 0 THEN md5(cast(user_id AS string)) ELSE 'short' END))))))))"""

#: A metric of every event with one point: a gauge of a double, or a sum of a whole number.
METRIC_REQUEST = """to_json(named_struct('resourceMetrics', array(named_struct('scopeMetrics', array(named_struct('metrics', array(named_struct(
  'name', event_type,
  'gauge', CASE WHEN event_id % 2 = 0 THEN named_struct('dataPoints', array(named_struct('timeUnixNano', cast(event_id AS string), 'asDouble', event_id / 4))) END,
  'sum', CASE WHEN event_id % 2 = 1 THEN named_struct('isMonotonic', event_id % 3 = 0, 'aggregationTemporality', 2, 'dataPoints', array(named_struct('timeUnixNano', cast(event_id AS string), 'asInt', cast(event_id AS string)))) END))))))))"""


def flatten_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.sources import otlp

    records = otlp.log_records(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(LOG_REQUEST).alias("value")))
    return records.select("event_id", "TimeUnixNano", "SeverityNumber", "SeverityText", "BodyType", "BodyValue", "TraceId", "ResourceAttributesJson")


def flatten_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.sources import otlp

    found = otlp.metrics(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("MetricId"), F.expr(METRIC_REQUEST).alias("value")))
    names = found.select("MetricId", "Name", "Type")
    none = {"AggregationTemporality": F.lit(None).cast("string"), "IsMonotonic": F.lit(None).cast("boolean")}
    both = otlp.points(found, "GAUGE").withColumns(none).unionByName(otlp.points(found, "SUM"))
    return both.join(names, "MetricId").select("MetricId", "Name", "Type", "TimeUnixNano", "ValueDouble", "ValueInt", "AggregationTemporality", "IsMonotonic")


QUERIES["flatten_logs"] = flatten_logs
ORACLES["flatten_logs"] = """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN epoch_us(ts) * 1000 END TimeUnixNano, cast(nullif(event_id % 25, 0) AS integer) SeverityNumber,
  CASE WHEN event_id % 4 > 0 THEN upper(event_type) END SeverityText, CASE WHEN event_id % 3 > 0 THEN 'STRING' ELSE 'INT' END BodyType,
  CASE WHEN event_id % 3 > 0 THEN event_type ELSE cast(event_id AS varchar) END BodyValue, CASE WHEN event_id % 2 = 0 THEN md5(cast(user_id AS varchar)) END TraceId,
  concat('{"service.name":"svc_', event_type, '"}') ResourceAttributesJson FROM events"""
QUERIES["flatten_points"] = flatten_points
ORACLES["flatten_points"] = """SELECT event_id MetricId, event_type AS Name, CASE WHEN event_id % 2 = 0 THEN 'GAUGE' ELSE 'SUM' END AS Type, event_id TimeUnixNano,
  CASE WHEN event_id % 2 = 0 THEN event_id / 4 END ValueDouble, CASE WHEN event_id % 2 = 1 THEN event_id END ValueInt,
  CASE WHEN event_id % 2 = 1 THEN 'CUMULATIVE' END AggregationTemporality, CASE WHEN event_id % 2 = 1 THEN event_id % 3 = 0 END IsMonotonic FROM events"""

QUERIES["dedup_resources"] = lambda spark, sf_dir: ingested(spark, sf_dir).tables["resources"].select("ResourceHash", "AttributesJson")
ORACLES["dedup_resources"] = """SELECT DISTINCT sha256(concat('__{"service.name":"svc_', event_type, '"}')) ResourceHash, concat('{"service.name":"svc_', event_type, '"}') AttributesJson FROM events"""


def dedup_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes of requests of several libraries."""
    from signalspark.plans.ingest import ingest_traces

    several = REQUEST.replace("'name', 'lib'", "'name', concat('lib_', cast(event_id % 3 AS string))")
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(several).alias("value"))
    return ingest_traces(requests).tables["instrumentation_scopes"].select("ScopeHash", "Name", "Version")


QUERIES["dedup_scopes"] = dedup_scopes
ORACLES["dedup_scopes"] = "SELECT DISTINCT sha256(concat('lib_', event_id % 3, '__1.0____{}')) ScopeHash, concat('lib_', event_id % 3) AS Name, '1.0' AS Version FROM events"
QUERIES["unique_spans"] = lambda spark, sf_dir: ingested(spark, sf_dir).tables["spans"].select("TraceId", "SpanId")
ORACLES["unique_spans"] = "SELECT DISTINCT md5(cast(user_id AS varchar)) TraceId, substr(md5(cast(event_id - event_id % 3 AS varchar)), 1, 16) SpanId FROM events"

# Ingest of requests with events, links, bad ids, and spans that come twice.

#: Every event as a span; three events of a user share a span id, and the first of them counts. Some trace ids are bad.
FULL_REQUEST = """to_json(named_struct('resourceSpans', array(named_struct('scopeSpans', array(named_struct('spans', array(named_struct(
    'traceId', CASE WHEN event_id % 97 = 0 THEN 'short' ELSE md5(cast(user_id AS string)) END, 'spanId', substr(md5(cast(event_id - event_id % 3 AS string)), 1, 16), 'name', event_type,
    'startTimeUnixNano', cast(unix_micros(cast(ts AS timestamp)) * 1000 AS string),
    'events', array(named_struct('name', concat('first ', cast(event_id AS string)), 'timeUnixNano', cast(event_id AS string)), named_struct('name', 'second', 'timeUnixNano', '5')),
    'links', array(named_struct('traceId', md5(cast(event_id AS string)), 'spanId', substr(md5(event_type), 1, 16), 'traceState', CASE WHEN event_id % 2 = 0 THEN 'on' ELSE '' END),
                   named_struct('traceId', 'short', 'spanId', '', 'traceState', ''))))))))))"""
#: The events whose spans are stored.
FIRSTS = "(SELECT * FROM events WHERE event_id % 97 > 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_id - event_id % 3 ORDER BY event_id) = 1)"


def full_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("Key"), F.expr(FULL_REQUEST).alias("value"))


def ingest_events_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.functions.shared import written
    from signalspark.plans.ingest import ingest_traces

    tables = ingest_traces(full_requests(spark, sf_dir), stage=lambda df: written(df, "ingest")).tables
    spans = tables["spans"].select(F.col("Id").alias("SpanId"), F.col("Name").alias("SpanName"))
    none = F.lit(None).cast("string")
    events_ = tables["span_events"].select("SpanId", "Name", F.col("TimeUnixNano"), none.alias("LinkedTraceId"), none.alias("LinkedSpanId"), none.alias("TraceState"))
    links = tables["span_links"].select("SpanId", none.alias("Name"), F.lit(None).cast("bigint").alias("TimeUnixNano"), "LinkedTraceId", "LinkedSpanId", "TraceState")
    return events_.union(links).join(spans, "SpanId").drop("SpanId")


QUERIES["ingest_events_links"] = ingest_events_links
ORACLES["ingest_events_links"] = f"""SELECT event_type SpanName, concat('first ', event_id) AS Name, event_id TimeUnixNano, cast(null AS varchar) LinkedTraceId, cast(null AS varchar) LinkedSpanId, cast(null AS varchar) TraceState FROM {FIRSTS}
  UNION ALL SELECT event_type, 'second', 5, null, null, null FROM {FIRSTS}
  UNION ALL SELECT event_type, null, null, md5(cast(event_id AS varchar)), substr(md5(event_type), 1, 16), CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'unknown' END FROM {FIRSTS}"""


def broken_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full requests, and for every 50th event one that can't be read: cut off, null, a list, or with a text for a list."""
    events_ = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 50 = 0")
    odd = """CASE event_id div 50 % 4 WHEN 0 THEN '{"resourceSpans":[{"scopeSpans"' WHEN 1 THEN NULL WHEN 2 THEN '[1]' ELSE '{"resourceSpans":"none"}' END"""
    return full_requests(spark, sf_dir).union(events_.select(F.concat(F.lit("odd"), "event_id").alias("Key"), F.expr(odd).alias("value")))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.plans.ingest import ingest_traces

    return ingest_traces(broken_requests(spark, sf_dir)).report


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.plans.ingest import ingest_traces

    return ingest_traces(broken_requests(spark, sf_dir)).quarantine


QUERIES["ingest_report"] = ingest_report
ORACLES["ingest_report"] = f"SELECT 'traces' AS Signal, (SELECT count(*) FROM {FIRSTS}) Accepted, count(*) - (SELECT count(*) FROM {FIRSTS}) - count(CASE WHEN event_id % 97 = 0 THEN 1 END) Duplicate, count(CASE WHEN event_id % 97 = 0 THEN 1 END) Rejected, count(CASE WHEN event_id % 50 = 0 THEN 1 END) Unreadable FROM events"
QUERIES["ingest_quarantine"] = ingest_quarantine
ORACLES["ingest_quarantine"] = """SELECT 'traces' AS Signal, concat('odd', event_id) AS "Key", CASE event_id // 50 % 4 WHEN 0 THEN '{"resourceSpans":[{"scopeSpans"' WHEN 1 THEN '' WHEN 2 THEN '[1]' ELSE '{"resourceSpans":"none"}' END Request
  FROM events WHERE event_id % 50 = 0"""


def twice(df: DataFrame) -> DataFrame:
    return df.union(df)


def ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal records of equal requests stay as many rows, with an id each."""
    from signalspark.plans.ingest import ingest_logs

    requests = twice(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(LOG_REQUEST).alias("value")))
    batch = ingest_logs(requests)
    return batch.tables["log_records"].groupBy("BodyType", "BodyValue", "SeverityText").agg(F.count("*").alias("n"), F.countDistinct("Id").alias("ids"))


QUERIES["ingest_logs"] = ingest_logs
ORACLES["ingest_logs"] = """SELECT CASE WHEN event_id % 3 > 0 THEN 'STRING' ELSE 'INT' END BodyType, CASE WHEN event_id % 3 > 0 THEN event_type ELSE cast(event_id AS varchar) END BodyValue,
  CASE WHEN event_id % 4 > 0 THEN upper(event_type) END SeverityText, 2 * count(*) n, 2 * count(*) ids FROM events GROUP BY ALL"""


def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every export makes a row of its own in ``metrics``; points have ids of their own."""
    from signalspark.plans.ingest import ingest_metrics

    requests = twice(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(METRIC_REQUEST).alias("value")))
    tables = ingest_metrics(requests).tables
    points = tables["gauge_data_points"].select("MetricId", "Id").union(tables["sum_data_points"].select("MetricId", "Id"))
    joined = tables["metrics"].select(F.col("Id").alias("MetricId"), "Name", "Type").join(points, "MetricId")
    return joined.groupBy("Name", "Type").agg(F.count("*").alias("n"), F.countDistinct("MetricId").alias("metric_ids"), F.countDistinct("Id").alias("point_ids"))


QUERIES["ingest_metrics"] = ingest_metrics
ORACLES["ingest_metrics"] = "SELECT event_type AS Name, CASE WHEN event_id % 2 = 0 THEN 'GAUGE' ELSE 'SUM' END AS Type, 2 * count(*) n, 2 * count(*) metric_ids, 2 * count(*) point_ids FROM events GROUP BY ALL"

#: A metric of every event whose point is a histogram, an exponential histogram or a summary.
SHAPE_REQUEST = """to_json(named_struct('resourceMetrics', array(named_struct('scopeMetrics', array(named_struct('metrics', array(named_struct(
  'name', event_type,
  'histogram', CASE WHEN event_id % 3 = 0 THEN named_struct('aggregationTemporality', 1, 'dataPoints', array(named_struct('timeUnixNano', cast(event_id AS string), 'startTimeUnixNano', '0', 'count', '3', 'sum', event_id / 4, 'min', 0.5D,
      'bucketCounts', array('1', cast(event_id AS string)), 'explicitBounds', array(1.5D), 'exemplars', array(named_struct('asInt', cast(event_id AS string), 'timeUnixNano', '7', 'traceId', md5(event_type), 'spanId', 'bad'), named_struct('asInt', '1', 'timeUnixNano', '8', 'traceId', '', 'spanId', ''))))) END,
  'exponentialHistogram', CASE WHEN event_id % 3 = 1 THEN named_struct('aggregationTemporality', 'AGGREGATION_TEMPORALITY_CUMULATIVE', 'dataPoints', array(named_struct('timeUnixNano', cast(event_id AS string), 'count', '9', 'scale', -2, 'zeroCount', cast(event_id AS string),
      'positive', named_struct('offset', cast(event_id % 7 AS int), 'bucketCounts', array('4', '5'))))) END,
  'summary', CASE WHEN event_id % 3 = 2 THEN named_struct('dataPoints', array(named_struct('timeUnixNano', cast(event_id AS string), 'count', '2', 'sum', event_id / 2, 'quantileValues', array(named_struct('quantile', 0.5D, 'value', event_id / 8))))) END))))))))"""


def shaped(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    from signalspark.sources import otlp

    return otlp.points(otlp.metrics(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("MetricId"), F.expr(SHAPE_REQUEST).alias("value"))), kind)


def whole_text(name: str):
    """An array as text in which whole numbers have no fraction, as both engines write them alike."""
    return F.replace(F.to_json(name), F.lit(".0"), F.lit("")).alias(name)


QUERIES["flatten_histogram_points"] = lambda spark, sf_dir: shaped(spark, sf_dir, "HISTOGRAM").select("MetricId", "TimeUnixNano", "StartTimeUnixNano", "Count", "SumValue", "Min_Value", "Max_Value", whole_text("BucketCounts"), whole_text("ExplicitBounds"), "AggregationTemporality", "Flags")
ORACLES["flatten_histogram_points"] = """SELECT event_id MetricId, event_id TimeUnixNano, cast(null AS bigint) StartTimeUnixNano, cast(3 AS bigint) Count, event_id / 4 SumValue, 0.5::double Min_Value, cast(null AS double) Max_Value,
  concat('[1,', event_id, ']') BucketCounts, '[1.5]' ExplicitBounds, 'DELTA' AggregationTemporality, 0 Flags FROM events WHERE event_id % 3 = 0"""
QUERIES["flatten_exponential_points"] = lambda spark, sf_dir: shaped(spark, sf_dir, "EXPONENTIAL_HISTOGRAM").select(
    "MetricId", "TimeUnixNano", "Count", "SumValue", "Scale", "ZeroCount", "PositiveOffset", whole_text("PositiveBucketCounts"), "NegativeOffset", whole_text("NegativeBucketCounts"), "AggregationTemporality"
)
ORACLES["flatten_exponential_points"] = """SELECT event_id MetricId, event_id TimeUnixNano, cast(9 AS bigint) Count, cast(null AS double) SumValue, -2 AS Scale, event_id ZeroCount, cast(event_id % 7 AS integer) PositiveOffset,
  '[4,5]' PositiveBucketCounts, cast(null AS integer) NegativeOffset, '[]' NegativeBucketCounts, 'CUMULATIVE' AggregationTemporality FROM events WHERE event_id % 3 = 1"""
QUERIES["flatten_summary_points"] = lambda spark, sf_dir: shaped(spark, sf_dir, "SUMMARY").select("MetricId", "TimeUnixNano", "Count", "SumValue", F.size("QuantileValues").alias("Quantiles"), F.get("QuantileValues", F.lit(0))["Quantile"].alias("Quantile"), F.get("QuantileValues", F.lit(0))["Value"].alias("QuantileValue"))
ORACLES["flatten_summary_points"] = "SELECT event_id MetricId, event_id TimeUnixNano, cast(2 AS bigint) Count, event_id / 2 SumValue, 1 Quantiles, 0.5::double Quantile, event_id / 8 QuantileValue FROM events WHERE event_id % 3 = 2"
QUERIES["flatten_exemplars"] = lambda spark, sf_dir: shaped(spark, sf_dir, "HISTOGRAM").select("MetricId", "Exemplar.*").drop("FilteredAttributes")
ORACLES["flatten_exemplars"] = "SELECT event_id MetricId, cast(7 AS bigint) TimeUnixNano, cast(null AS double) ValueDouble, event_id ValueInt, cast(null AS varchar) SpanId, md5(event_type) TraceId FROM events WHERE event_id % 3 = 0"

#: A span of every event with an attribute of maps in lists in maps, and a log record with such a body.
NESTED = """concat('{"kvlistValue":{"values":[{"key":"b","value":{"boolValue":true}},{"key":"a","value":{"arrayValue":{"values":[{},{"kvlistValue":{"values":[{"key":"z","value":{"arrayValue":{"values":[{"intValue":"', event_id,
  '"},{"stringValue":"', event_type, '"},{"doubleValue":0.5}]}}}]}}]}}},{"key":"b","value":{"boolValue":false}}]}}')"""


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalspark.sources import otlp

    nested = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(NESTED).alias("v"))
    requests = nested.select("event_id", F.expr("""concat('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":', v, ',"attributes":[{"key":"m","value":', v, '}]}]}]}]}')""").alias("value"))
    return otlp.log_records(requests).select("event_id", "BodyType", "BodyValue", "AttributesJson")


QUERIES["flatten_nested"] = flatten_nested
ORACLES["flatten_nested"] = """SELECT event_id, 'KVLIST' BodyType, v BodyValue, concat('{"m":', v, '}') AttributesJson
  FROM (SELECT event_id, concat('{"a":[{"z":[', event_id, ',"', event_type, '",0.5]}],"b":false}') v FROM events)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two appends of the same spans, one delete and a compaction: rows and ids of each table."""
    from signalspark.functions.shared import new_folder
    from signalspark.plans.ingest import ingest_traces
    from signalspark.sources.store import Store

    store = Store(spark, new_folder(spark, "store"))
    for name in ("first", "again"):
        with store.staging() as stage:
            store.append(ingest_traces(full_requests(spark, sf_dir), store.read(), stage=stage), name)
    store.delete(retention.delete_traces_by_time_range(store.read(), START, END))
    store.compact("span_events")
    t = store.read()
    rows = [t.table(name).agg(F.count("*").alias("n"), F.countDistinct("Id").alias("ids")).select(F.lit(name).alias("TableName"), "n", "ids") for name in ("spans", "span_events", "span_links", "resources", "instrumentation_scopes")]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).union(rows[4])


QUERIES["stored_spans"] = stored
ORACLES["stored_spans"] = f"""SELECT 'spans' TableName, count(*) n, count(*) ids FROM {FIRSTS} WHERE NOT epoch_us(ts) * 1000 BETWEEN {START} AND {END}
  UNION ALL SELECT 'span_events', 2 * count(*), 2 * count(*) FROM {FIRSTS} WHERE NOT epoch_us(ts) * 1000 BETWEEN {START} AND {END}
  UNION ALL SELECT 'span_links', count(*), count(*) FROM {FIRSTS} WHERE NOT epoch_us(ts) * 1000 BETWEEN {START} AND {END}
  UNION ALL SELECT 'resources', cast(1 AS bigint), cast(1 AS bigint) UNION ALL SELECT 'instrumentation_scopes', cast(1 AS bigint), cast(1 AS bigint)"""


def derived_store(spark: SparkSession, sf_dir: str, *names: str):
    """A store of the derived tables, in two batches that don't see each other: both write all resources and scopes."""
    from signalspark.functions.shared import new_folder
    from signalspark.sources.store import Store

    store, t = Store(spark, new_folder(spark, "store")), signal_tables(spark, sf_dir)
    of_parent = t.spans.select(F.col("Id").alias("SpanId"), F.col("StartTimeUnixNano").alias("ParentTime"))
    for part in (0, 1):
        rows = {name: t.table(name).where(F.col("Id") % 2 == part) for name in names}
        rows |= {name: df.join(of_parent, "SpanId") for name, df in rows.items() if name in ("span_events", "span_links")}
        store.append(rows | {name: t.table(name) for name in ("resources", "instrumentation_scopes")}, f"half-{part}")
    return store


def stored_logs_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range read from the store has every log of it, whenever that was observed, once."""
    t = derived_store(spark, sf_dir, "log_records").read(START, END)
    return logs.logs_by_time_range(t, START, END).select(*LOG)


QUERIES["stored_logs_by_range"] = stored_logs_by_range
ORACLES["stored_logs_by_range"] = events.duckdb_sql(f"{LOGS} WHERE TimeUnixNano BETWEEN {START} AND {END}")


#: An hour, so that calls come from before the range.
HOUR_START, HOUR_END = START + 12 * 3600 * 10**9, START + 13 * 3600 * 10**9


def stored_calls_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range read from the store has the calls of its spans, though the callers started before it."""
    return traces.service_dependencies(derived_store(spark, sf_dir, "spans").read(HOUR_START, HOUR_END))


QUERIES["stored_calls_by_range"] = stored_calls_by_range
ORACLES["stored_calls_by_range"] = events.duckdb_sql(f"{CALLS} AND c.StartTimeUnixNano BETWEEN {HOUR_START} AND {HOUR_END} GROUP BY ALL")


def stored_unseen_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingests that see neither each other nor the store: each log has one resource and one scope all the same."""
    from signalspark.functions.shared import new_folder
    from signalspark.plans.ingest import ingest_logs
    from signalspark.sources.store import Store

    store = Store(spark, new_folder(spark, "store"))
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(LOG_REQUEST).alias("value"))
    for part in (0, 1):
        with store.staging() as stage:
            store.append(ingest_logs(requests.where(F.col("event_id") % 2 == part).select("value"), stage=stage, export=str(part)), str(part))
    t = store.read()
    joined = logs.logs_by_severity(t, 0).groupBy("ServiceName", "ScopeName").agg(F.count("*").alias("n"), F.countDistinct("Id").alias("ids"))
    return joined.withColumns({"resources": t.resources.agg(F.count("*")).scalar(), "scopes": t.instrumentation_scopes.agg(F.count("*")).scalar()})


QUERIES["stored_unseen_ingests"] = stored_unseen_ingests
ORACLES["stored_unseen_ingests"] = """SELECT concat('svc_', event_type) ServiceName, 'lib' ScopeName, count(*) n, count(*) ids, (SELECT count(DISTINCT event_type) FROM events) resources, cast(1 AS bigint) scopes
  FROM events WHERE event_id % 25 > 0 GROUP BY event_type"""


def expired_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and links that are left when the store has dropped the days before a time and rewritten the day of it."""
    store = derived_store(spark, sf_dir, "spans", "span_events", "span_links")
    store.expire_spans(datetime.fromtimestamp(HOUR_START // 10**9, UTC) + timedelta(days=30))
    return left(store.read())


QUERIES["expired_spans"] = expired_spans
ORACLES["expired_spans"] = events.duckdb_sql(left_sql(f"StartTimeUnixNano < {HOUR_START}"))


def view_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detailed service map by its view's name."""
    views.register(spark, signal_tables(spark, sf_dir))
    return spark.sql("SELECT ParentService, ChildService, CallCount, ErrorCount FROM service_map_detailed WHERE SpanKind = 'SERVER'")


QUERIES["view_by_sql"] = view_by_sql
ORACLES["view_by_sql"] = events.duckdb_sql(f"SELECT ParentService, ChildService, CallCount, ErrorCount FROM ({CALLS} GROUP BY ALL) WHERE SpanKind = 'SERVER'")


from signalspark import queries_series  # noqa: E402, F401  registers its queries here
