"""The queries of series, full-text index, span trees and attributes, registered beside those of :mod:`signalspark.queries`."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions import attributes
from signalspark.functions.columns import LOOSE
from signalspark.functions.shared import new_folder
from signalspark.operators import logs, metrics, timeseries, traces, trees
from signalspark.queries import END, ORACLES, QUERIES, START, SVC, query, signal_tables
from signalspark.sources import events
from signalspark.sources.textindex import TextIndex, matching
from signalspark.tables import SignalTables

SECOND = 10**9

# Sums that are reset, delta sums, several points at one time, and points that say when they started.
ODD_SUMS = {
    "AggregationTemporality": "CASE WHEN MetricId % 2 = 0 THEN 'DELTA' ELSE 'CUMULATIVE' END",
    "IsMonotonic": "MetricId % 3 > 0",
    "ValueInt": "ValueInt % 700",
    "StartTimeUnixNano": f"CASE WHEN Id % 4 = 0 THEN TimeUnixNano - TimeUnixNano % {600 * SECOND} - {300 * SECOND} END",
    "TimeUnixNano": f"TimeUnixNano - TimeUnixNano % {600 * SECOND}",
}


def odd_sums(t: SignalTables) -> SignalTables:
    own = t.sum_data_points
    return t.with_tables(sum_data_points=own.select(*[c for c in own.columns if c not in ODD_SUMS], *[F.expr(e).alias(c) for c, e in ODD_SUMS.items()]))


RATE = f"""SELECT Name, ResourceId, ScopeId, Attributes, TimeUnixNano, round("Value", 6) AS "Value", Reset, round(Increase, 6) Increase, IntervalNano, round(Increase / (IntervalNano / 1e9), 9) Rate FROM (
  SELECT *, CASE WHEN Delta OR Reset THEN v WHEN t0 IS NULL THEN CASE WHEN st IS NOT NULL AND mono THEN v END ELSE v - v0 END Increase, nullif(greatest(TimeUnixNano - since, 0), 0) IntervalNano, v AS "Value" FROM (
    SELECT *, CASE WHEN Delta OR Reset THEN coalesce(st, t0) ELSE coalesce(t0, st) END since FROM (
      SELECT *, coalesce(NOT Delta AND t0 IS NOT NULL AND mono AND (v < v0 OR (coalesce(st > t0, false) AND st < TimeUnixNano)), false) Reset FROM (
        SELECT *, lag(v) OVER w v0, lag(TimeUnixNano) OVER w t0 FROM (
          SELECT Name, ResourceId, ScopeId, Attributes, Delta, TimeUnixNano, CASE WHEN Delta THEN sum(v) ELSE arg_max(v, Id) END v,
                 CASE WHEN Delta THEN min(st) ELSE struct_extract(arg_max({{'st': st}}, Id), 'st') END st, bool_and(mono) mono
          FROM (SELECT m.Name, m.ResourceId, m.ScopeId, coalesce(AttributesJson, '{{}}') Attributes, p.Id, MetricId % 2 = 0 Delta, cast(ValueInt % 700 AS double) v, MetricId % 3 > 0 mono,
                       CASE WHEN p.Id % 4 = 0 THEN TimeUnixNano - TimeUnixNano % {600 * SECOND} - {300 * SECOND} END st, TimeUnixNano - TimeUnixNano % {600 * SECOND} TimeUnixNano
                FROM sum_data_points p JOIN metrics m ON m.Id = p.MetricId WHERE m.Name = 'app.view')
          GROUP BY Name, ResourceId, ScopeId, Attributes, Delta, TimeUnixNano) WINDOW w AS (PARTITION BY Name, ResourceId, ScopeId, Attributes, Delta ORDER BY TimeUnixNano)))))"""


@query("metric_rate", RATE)
def _(t: SignalTables) -> DataFrame:
    rounded = {"Value": 6, "Increase": 6, "Rate": 9}
    return timeseries.metric_rate(odd_sums(t), "app.view").withColumns({c: F.round(c, n) for c, n in rounded.items()})


STEP, GAP = timedelta(hours=1), timedelta(hours=6)
STEP_NANOS, GAP_NANOS = 3600 * SECOND, 6 * 3600 * SECOND


@query("metric_resampled", f"""WITH pts AS (
  SELECT m.Name, m.ResourceId, m.ScopeId, coalesce(AttributesJson, '{{}}') Attributes, p.TimeUnixNano t, coalesce(ValueDouble, cast(ValueInt AS double), 0) v
  FROM gauge_data_points p JOIN metrics m ON m.Id = p.MetricId WHERE m.Name = 'app.click' AND TimeUnixNano BETWEEN {START} AND {END}
  QUALIFY row_number() OVER (PARTITION BY m.Name, m.ResourceId, m.ScopeId, Attributes, p.TimeUnixNano ORDER BY p.Id DESC) = 1),
 grid AS (SELECT s.*, {START} + k * {STEP_NANOS} g FROM (SELECT DISTINCT Name, ResourceId, ScopeId, Attributes FROM pts) s, (SELECT unnest(range(0, {(END - START) // STEP_NANOS + 1})) k)),
 a AS (SELECT grid.*, b.t t0, b.v v0 FROM grid ASOF LEFT JOIN pts b ON grid.Name = b.Name AND grid.ResourceId = b.ResourceId AND grid.ScopeId = b.ScopeId AND grid.Attributes = b.Attributes AND grid.g >= b.t),
 c AS (SELECT a.*, b.t t1, b.v v1 FROM a ASOF LEFT JOIN pts b ON a.Name = b.Name AND a.ResourceId = b.ResourceId AND a.ScopeId = b.ScopeId AND a.Attributes = b.Attributes AND a.g < b.t)
SELECT Name, ResourceId, ScopeId, Attributes, g TimeUnixNano, round(CASE WHEN g - t0 <= {GAP_NANOS} THEN v0 END, 6) AS "Last",
  round(CASE WHEN g = t0 THEN v0 WHEN t1 - t0 <= {GAP_NANOS} THEN v0 + (v1 - v0) * ((g - t0) / (t1 - t0)) END, 6) AS Linear FROM c""".replace("WITH pts", ", pts"))
def _(t: SignalTables) -> DataFrame:
    found = timeseries.metric_resampled(t, "app.click", START, END, STEP, GAP, ("GAUGE",))
    return found.withColumns({c: F.round(c, 6) for c in ("Last", "Linear")})


WEEK = 7 * 86_400 * SECOND
# Points of three kinds of bounds.
ODD_BOUNDS = {
    "BucketCounts": "CASE Id % 3 WHEN 0 THEN BucketCounts WHEN 1 THEN array(BucketCounts[0], BucketCounts[1] + BucketCounts[2]) ELSE array(BucketCounts[0], BucketCounts[1], BucketCounts[2], Id % 7) END",
    "ExplicitBounds": "CASE Id % 3 WHEN 0 THEN ExplicitBounds WHEN 1 THEN array(10D) ELSE array(10D, 50D, 100D) END",
}
MERGED_HISTOGRAMS = f""", pts AS (
  SELECT svc ServiceName, m.Name, TimeUnixNano // {WEEK} * {WEEK} PeriodStart, p.Id, Count, SumValue, Min_Value, Max_Value, CASE p.Id % 3 WHEN 0 THEN [10.0::double, 50.0] WHEN 1 THEN [10.0::double] ELSE [10.0::double, 50.0, 100.0] END b,
         CASE p.Id % 3 WHEN 0 THEN c WHEN 1 THEN [c[1], c[2] + c[3]] ELSE [c[1], c[2], c[3], p.Id % 7] END c
  FROM (SELECT *, cast(json_extract(BucketCounts, '$') AS bigint[]) c FROM histogram_data_points) p JOIN metrics m ON m.Id = p.MetricId JOIN {SVC} r ON r.Id = m.ResourceId),
 common AS (SELECT ServiceName, Name, PeriodStart, list_sort(list_reduce(list(b), lambda x, y: list_intersect(x, y))) cb FROM pts GROUP BY ALL),
 folded AS (
  SELECT ServiceName, Name, PeriodStart, cb, place, sum(n) n FROM (
    SELECT p.ServiceName, p.Name, p.PeriodStart, cb, p.c[i] n, CASE WHEN i <= len(p.b) THEN len(list_filter(cb, lambda x: x < p.b[i])) ELSE len(cb) END place
    FROM (SELECT *, unnest(range(1, len(c) + 1)) i FROM pts) p JOIN common k ON p.ServiceName IS NOT DISTINCT FROM k.ServiceName AND p.Name = k.Name AND p.PeriodStart = k.PeriodStart) GROUP BY ALL),
 arrays AS (SELECT ServiceName, Name, PeriodStart, array_to_string(cb, ',') BucketBounds, string_agg(cast(cast(n AS bigint) AS varchar), ',' ORDER BY place) BucketCounts FROM folded GROUP BY ServiceName, Name, PeriodStart, cb)
SELECT s.*, BucketBounds, BucketCounts FROM (
  SELECT ServiceName, Name, PeriodStart, cast(sum(Count) AS bigint) Count, round(sum(SumValue), 6) AS "Sum", min(Min_Value) AS "Min", max(Max_Value) AS "Max" FROM pts GROUP BY ALL) s
  JOIN arrays a ON s.ServiceName IS NOT DISTINCT FROM a.ServiceName AND s.Name = a.Name AND s.PeriodStart = a.PeriodStart"""


@query("merged_histograms", MERGED_HISTOGRAMS)
def _(t: SignalTables) -> DataFrame:
    odd = t.with_tables(histogram_data_points=t.histogram_data_points.withColumns({c: F.expr(e) for c, e in ODD_BOUNDS.items()}))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    found = timeseries.merged_histograms(odd, period=timedelta(days=7))
    return found.select("ServiceName", "Name", "PeriodStart", "Count", F.round("Sum", 6).alias("Sum"), "Min", "Max", text("BucketBounds"), text("BucketCounts"))


# Points of three scales, with offsets, and negative numbers in some.
ODD_SCALES = {"Scale": "cast(Id % 3 AS int)", "PositiveOffset": "cast(Id % 5 - 2 AS int)", "NegativeOffset": "cast(Id % 4 AS int)", "NegativeBucketCounts": "CASE WHEN Id % 2 = 0 THEN PositiveBucketCounts END"}
SIDE = """SELECT ServiceName, Name, PeriodStart, Scale, ZeroCount, Count, '{side}' Side, cast(floor(({o} + i) / pow(2, scale - Scale)) AS integer) Bucket, cast(sum(c[i + 1]) AS bigint) BucketCount
  FROM (SELECT ServiceName, Name, PeriodStart, o, o2, scale, c, id, unnest(range(0, len(c))) i FROM pts) JOIN low USING (ServiceName, Name, PeriodStart) WHERE c[i + 1] > 0 AND {where} GROUP BY ALL"""
MERGED_EXPONENTIAL = f""", pts AS (
  SELECT coalesce(svc, '') ServiceName, m.Name, TimeUnixNano // {WEEK} * {WEEK} PeriodStart, p.Id id, Count n, ZeroCount z, cast(p.Id % 3 AS integer) scale, p.Id % 5 - 2 o, p.Id % 4 o2, cast(json_extract(PositiveBucketCounts, '$') AS bigint[]) c
  FROM exponential_histogram_data_points p JOIN metrics m ON m.Id = p.MetricId JOIN {SVC} r ON r.Id = m.ResourceId),
 low AS (SELECT ServiceName, Name, PeriodStart, min(scale) "Scale", cast(sum(z) AS bigint) ZeroCount, cast(sum(n) AS bigint) Count FROM pts GROUP BY ALL)
""" + " UNION ALL ".join(SIDE.replace("scale - Scale", 'pts_scale - "Scale"').replace("o2, scale, c", "o2, scale pts_scale, c").format(side=s, o=o, where=w) for s, o, w in (("Positive", "o", "true"), ("Negative", "o2", "id % 2 = 0")))


@query("merged_exponential_histograms", MERGED_EXPONENTIAL)
def _(t: SignalTables) -> DataFrame:
    odd = t.with_tables(exponential_histogram_data_points=t.exponential_histogram_data_points.withColumns({c: F.expr(e) for c, e in ODD_SCALES.items()}))
    merged = timeseries.merged_exponential_histograms(odd, period=timedelta(days=7))
    sides = [
        merged.select(F.coalesce("ServiceName", F.lit("")).alias("ServiceName"), "Name", "PeriodStart", "Scale", "ZeroCount", "Count", F.lit(s).alias("Side"), F.posexplode(f"{s}BucketCounts").alias("i", "BucketCount"), f"{s}Offset")
        .select("ServiceName", "Name", "PeriodStart", "Scale", "ZeroCount", "Count", "Side", (F.col(f"{s}Offset") + F.col("i")).alias("Bucket"), "BucketCount").where("BucketCount > 0")
        for s in ("Positive", "Negative")
    ]
    return sides[0].union(sides[1])


# Some spans whose parent is gone, and some that are their own parent.
ODD_PARENT = "CASE WHEN Id % 37 = 0 THEN 'gone' WHEN Id % 53 = 0 THEN SpanId ELSE ParentSpanId END"
TREE = f""", s AS (SELECT TraceId, SpanId, {ODD_PARENT} P, StartTimeUnixNano b, EndTimeUnixNano f FROM spans),
 h AS (SELECT s.*, x.SpanId IS NOT NULL there FROM s LEFT JOIN s x ON s.TraceId = x.TraceId AND s.P = x.SpanId),
 l AS (SELECT TraceId, P, arg_min(SpanId, (-f, SpanId)) last FROM h WHERE P IS NOT NULL GROUP BY ALL),
 r AS (
  SELECT TraceId, SpanId, 0 Depth, SpanId Root, SpanId AS Path, true Critical FROM h WHERE P IS NULL OR NOT there
  UNION ALL SELECT c.TraceId, c.SpanId, Depth + 1, Root, concat(Path, '/', c.SpanId), Critical AND l.last = c.SpanId
  FROM r JOIN h c ON c.TraceId = r.TraceId AND c.P = r.SpanId AND c.SpanId <> r.SpanId JOIN l ON l.TraceId = c.TraceId AND l.P = c.P),
 k AS (SELECT c.TraceId, c.P, greatest(c.b, o.b) b, least(c.f, o.f) f FROM s c JOIN s o ON c.TraceId = o.TraceId AND c.P = o.SpanId AND c.P <> c.SpanId WHERE least(c.f, o.f) > greatest(c.b, o.b)),
 v AS (SELECT TraceId, P, cast(sum(greatest(0, f - greatest(b, coalesce(m, b)))) AS bigint) covered
       FROM (SELECT *, max(f) OVER (PARTITION BY TraceId, P ORDER BY b, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM k) GROUP BY ALL)
SELECT h.TraceId, h.SpanId, r.Depth, r.Root RootSpanId, r.Path, greatest(0, h.f - h.b) - coalesce(covered, 0) SelfNano, coalesce(r.Critical, false) Critical, coalesce(h.P IS NOT NULL AND NOT there, false) Orphan, r.SpanId IS NULL "Cycle"
FROM h LEFT JOIN r ON h.TraceId = r.TraceId AND h.SpanId = r.SpanId LEFT JOIN v ON h.TraceId = v.TraceId AND h.SpanId = v.P"""


@query("span_tree", TREE)
def _(t: SignalTables) -> DataFrame:
    odd = t.with_tables(spans=t.spans.withColumn("ParentSpanId", F.expr(ODD_PARENT)))
    return trees.span_tree(odd).withColumn("Path", F.array_join("Path", "/"))


@query("critical_paths", TREE.replace("SELECT h.TraceId, h.SpanId, r.Depth", "SELECT TraceId, RootSpanId, string_agg(SpanId, '/' ORDER BY Depth) AS Path, cast(sum(SelfNano) AS bigint) SelfNano FROM (SELECT h.TraceId, h.SpanId, r.Depth") + ") WHERE Critical GROUP BY TraceId, RootSpanId")
def _(t: SignalTables) -> DataFrame:
    odd = t.with_tables(spans=t.spans.withColumn("ParentSpanId", F.expr(ODD_PARENT)))
    return trees.critical_paths(odd).withColumn("Path", F.array_join("Path", "/"))


for name in ("span_tree", "critical_paths"):
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


def text_index(spark: SparkSession, sf_dir: str) -> tuple[TextIndex, DataFrame]:
    """An index of all logs in two batches, one of them written twice, and the logs."""
    index, logs = TextIndex(spark, new_folder(spark, "index"), shards=8), signal_tables(spark, sf_dir).log_records
    for part in (0, 1, 1):
        index.add(logs.where(F.col("Id") % 2 == part), f"half-{part}")
    return index, logs


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, logs = text_index(spark, sf_dir)
    return matching(logs, index.search("error purchase")).select("Id", "BodyValue", F.round("Score", 9).alias("Score"))


def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, logs = text_index(spark, sf_dir)
    return matching(logs, index.phrase("Error by user 1")).select("Id", "BodyValue", F.array_join("Places", ",").alias("Places"))


QUERIES["indexed_search"], QUERIES["indexed_phrase"] = indexed_search, indexed_phrase
ORACLES["indexed_search"] = ORACLES["log_fulltext_relevance"]
ORACLES["indexed_phrase"] = events.duckdb_sql("SELECT Id, BodyValue, '0' Places FROM log_records WHERE BodyValue LIKE 'error by user 1,%'")


# Collation: names and severities in several cases, with accents and spaces at the end.
ODD_NAME = "CASE Id % 4 WHEN 0 THEN upper({c}) WHEN 1 THEN concat({c}, '  ') WHEN 2 THEN replace({c}, 'e', 'é') ELSE {c} END"
PLAIN = "strip_accents(lower(rtrim({c})))"


def odd_names(t: SignalTables) -> SignalTables:
    changed = {"spans": "Name", "metrics": "Name", "log_records": "SeverityText"}
    return t.with_tables(**{name: t.table(name).withColumn(c, F.expr(ODD_NAME.format(c=c))) for name, c in changed.items()})


def odd_sql(table: str, column: str) -> str:
    return f"(SELECT * REPLACE ({ODD_NAME.format(c=column)} AS {column}) FROM {table})"


@query("error_logs_collated", f"SELECT BodyValue, TraceId, SpanId, TimeUnixNano FROM {odd_sql('log_records', 'SeverityText')} WHERE {PLAIN.format(c='SeverityText')} = 'error' AND TraceId IS NOT NULL")
def _(t: SignalTables) -> DataFrame:
    return logs.error_logs_with_trace(odd_names(t), collation=LOOSE)


@query("log_severity_stats_collated", f"SELECT min(SeverityText) SeverityText, SeverityNumber, strftime(make_timestamp(TimeUnixNano // 1000), '%Y-%m-%d') LogDate, count(*) Count FROM {odd_sql('log_records', 'SeverityText')} WHERE TimeUnixNano IS NOT NULL GROUP BY {PLAIN.format(c='SeverityText')}, SeverityNumber, LogDate")
def _(t: SignalTables) -> DataFrame:
    return logs.log_severity_stats(odd_names(t), LOOSE).withColumn("LogDate", F.col("LogDate").cast("string"))


@query("metrics_by_name_collated", f"SELECT m.Id, m.Name FROM {odd_sql('metrics', 'Name')} m WHERE {PLAIN.format(c='m.Name')} = 'app.purchase'")
def _(t: SignalTables) -> DataFrame:
    return metrics.metrics_by_name(odd_names(t), "APP.Purchasé ", LOOSE).select("Id", "Name")


@query("unique_metric_names_collated", f"SELECT min(Name) AS Name FROM {odd_sql('metrics', 'Name')} GROUP BY {PLAIN.format(c='Name')}")
def _(t: SignalTables) -> DataFrame:
    return metrics.unique_metric_names(odd_names(t), collation=LOOSE)


@query("operation_names_collated", f"SELECT min(Name) AS Name, count(*) SpanCount FROM {odd_sql('spans', 'Name')} GROUP BY {PLAIN.format(c='Name')}")
def _(t: SignalTables) -> DataFrame:
    return traces.operation_names(odd_names(t), LOOSE)


def spans_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with a number over a bound, and a boolean, among their attributes; a text of digits is no number."""
    from signalspark.queries import REQUEST
    from signalspark.sources import otlp

    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(REQUEST).alias("value"))
    over = traces.spans_by_attribute(SignalTables(spans=otlp.spans(requests)), ("b",), 300, ">")
    return over.where(attributes.where(F.col("AttributesJson"), ("a",), True) & ~attributes.where(F.col("AttributesJson"), ("b",), "500")).select("event_id", "SpanId")


def logs_by_nested_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by values deep in maps and lists: a number, a text, and a boolean."""
    from signalspark.queries import flatten_nested

    found, at = flatten_nested(spark, sf_dir), F.col("AttributesJson")
    deep = attributes.where(at, ("m", "a", 0, "z", 0), 400, "<=") & attributes.where(at, ("m", "a", 0, "z", 1), "error") & attributes.where(at, ("m", "b"), False)
    return found.where(deep & ~attributes.has(at, ("m", "a", 1))).select("event_id")


QUERIES["spans_by_attribute"], QUERIES["logs_by_nested_attribute"] = spans_by_attribute, logs_by_nested_attribute
ORACLES["spans_by_attribute"] = "SELECT event_id, substr(md5(cast(event_id - event_id % 3 AS varchar)), 1, 16) SpanId FROM events WHERE event_id > 300"
ORACLES["logs_by_nested_attribute"] = "SELECT event_id FROM events WHERE event_id <= 400 AND event_type = 'error'"
