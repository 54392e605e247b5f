"""Metrics: catalogue, labels, series, latest values and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.columns import Bound, collated, in_range, label_value, required, service_name, to_time
from signalspark.schemas import METRIC_TYPES
from signalspark.tables import SignalTables

TOP = 100


def _infos(t: SignalTables, metrics: DataFrame) -> DataFrame:
    """Catalogue entries: a metric is seen first and last when its row was stored; without attributes the
    service's name is empty."""
    own = t.resources.select(F.col("Id").alias("ResourceId"), F.when(F.col("AttributesJson").isNull(), "").otherwise(service_name(F.col("AttributesJson"))).alias("ServiceName"))
    joined = metrics.join(own, "ResourceId", "left")
    optional = [F.col(c) if c in metrics.columns else F.lit(None).cast("string").alias(c) for c in ("Description", "Unit")]
    return joined.select("Id", "Name", *optional, "Type", "ServiceName", F.col("CreatedAt").alias("FirstSeen"), F.col("CreatedAt").alias("LastSeen"))


def metric_by_id(t: SignalTables, metric_id: int) -> DataFrame:
    """One metric with resource, scope and its gauge points (an empty array for other types), or no row."""
    points = t.gauge_data_points.where(F.col("MetricId") == metric_id).groupBy(F.col("MetricId").alias("Id"))
    points = points.agg(F.array_sort(F.collect_list(F.struct("TimeUnixNano", F.col("Id").alias("PointId"), "ValueDouble", "ValueInt"))).alias("GaugePoints"))
    joined = t.metrics.where(F.col("Id") == metric_id).join(t.services(), "ResourceId", "left").join(t.scopes(), "ScopeId", "left").join(points, "Id", "left")
    return joined.withColumn("GaugePoints", F.coalesce("GaugePoints", F.array()))


def metrics_by_name(t: SignalTables, name: str, collation: str | None = None) -> DataFrame:
    """The metrics of a name; with a collation (``LOOSE``), of all names that are equal to it there."""
    return _infos(t, t.metrics.where(collated(F.col("Name"), collation) == required(name, "metric name")))


def metrics_by_type(t: SignalTables, kind: str) -> DataFrame:
    if kind not in METRIC_TYPES:
        raise ValueError(f"{kind} is no metric type")
    return _infos(t, t.metrics.where(F.col("Type") == kind))


def of_service(t: SignalTables, service: str | None) -> DataFrame:
    """The metrics of a service; all if it is None."""
    if service is None:
        return t.metrics
    return t.metrics.join(t.services().where(F.col("ServiceName") == required(service, "service name")).select("ResourceId"), "ResourceId", "left_semi")


def metrics_by_service(t: SignalTables, service: str) -> DataFrame:
    return _infos(t, of_service(t, required(service, "service name")))


def all_metrics(t: SignalTables, limit: int = TOP) -> DataFrame:
    """The metrics stored last."""
    return _infos(t, t.metrics.orderBy(F.desc("CreatedAt"), "Id").limit(limit)).orderBy(F.desc("FirstSeen"), "Id")


def metric_counts_by_type(t: SignalTables, service: str | None = None) -> DataFrame:
    return of_service(t, service).groupBy("Type").agg(F.count("*").alias("MetricCount"))


def unique_metric_names(t: SignalTables, service: str | None = None, collation: str | None = None) -> DataFrame:
    """The names of a service's metrics; with a collation, the smallest of those that are equal in it."""
    if collation is None:
        return of_service(t, service).select("Name").distinct().orderBy("Name")
    return of_service(t, service).groupBy(collated(F.col("Name"), collation).alias("__name")).agg(F.min("Name").alias("Name")).select("Name").orderBy("Name")


def service_metric_summaries(t: SignalTables) -> DataFrame:
    """Metrics of each service by type; exponential histograms count as histograms. A resource without attributes
    has the empty name, one without a service name is ``unknown``."""
    name = F.when(F.col("AttributesJson").isNull(), "").otherwise(F.coalesce(service_name(F.col("AttributesJson")), F.lit("unknown")))
    joined = t.metrics.join(t.resources.select(F.col("Id").alias("ResourceId"), name.alias("ServiceName")), "ResourceId")
    count = lambda *kinds: F.count_if(F.col("Type").isin(*kinds))
    return joined.groupBy("ServiceName").agg(
        F.count("*").alias("TotalMetrics"),
        count("GAUGE").alias("GaugeCount"),
        count("SUM").alias("SumCount"),
        count("HISTOGRAM", "EXPONENTIAL_HISTOGRAM").alias("HistogramCount"),
        count("SUMMARY").alias("SummaryCount"),
        F.max("CreatedAt").alias("LastUpdated"),
    ).orderBy("ServiceName")


def number() -> Column:
    """A point's value: double, else int, else 0."""
    return F.coalesce("ValueDouble", F.col("ValueInt").cast("double"), F.lit(0.0))


def latest_metric_values(t: SignalTables, service: str) -> DataFrame:
    """The latest value of each gauge and sum of a service by name; where both kinds have a name the sum counts.
    Of points at one time the one with the highest id counts."""
    metrics = of_service(t, service).select(F.col("Id").alias("MetricId"), "Name")

    def latest(points: DataFrame, rank: int) -> DataFrame:
        return points.join(metrics, "MetricId").select("Name", F.lit(rank).alias("Rank"), "TimeUnixNano", "Id", number().alias("Value"))

    both = latest(t.gauge_data_points, 0).union(latest(t.sum_data_points, 1))
    return both.groupBy("Name").agg(F.max_by("Value", F.struct("Rank", "TimeUnixNano", "Id")).alias("Value"))


def latest_gauge_values(t: SignalTables, limit: int = TOP) -> DataFrame:
    """The latest gauge points, the latest first, with their metric's name."""
    latest = t.gauge_data_points.select("MetricId", "Id", "ValueDouble", "TimeUnixNano").orderBy(F.desc("TimeUnixNano"), F.desc("Id")).limit(limit)
    joined = latest.join(t.metrics.select(F.col("Id").alias("MetricId"), "Name"), "MetricId")
    return joined.orderBy(F.desc("TimeUnixNano"), F.desc("Id")).select("Name", "ValueDouble", "TimeUnixNano")


def first_metrics(t: SignalTables, names: list[str]) -> DataFrame:
    """For each name the row that was stored first (the smallest id)."""
    mine = t.metrics.where(F.col("Name").isin(*names))
    return mine.groupBy("Name").agg(F.min_by(F.struct("Id", "Type"), "Id").alias("m")).select("Name", "m.Id", "m.Type")


def types_of(first: DataFrame, among: tuple[str, ...] = METRIC_TYPES) -> list[str]:
    """The types in rows of :func:`first_metrics`: only these types' points need to be read."""
    found = {r["Type"] for r in first.select("Type").distinct().collect()}  # five at most
    return [kind for kind in among if kind in found] or list(among[:1])


def labels(t: SignalTables, points: DataFrame) -> DataFrame:
    """Distinct keys and values of the points' attributes; a JSON null is the empty text."""
    parsed = points.select(F.explode(F.from_json("AttributesJson", "map<string,string>")).alias("LabelKey", "v"))
    return parsed.select("LabelKey", label_value(F.col("v")).alias("LabelValue")).distinct()


def metric_labels(t: SignalTables, name: str) -> DataFrame:
    """Keys and values of the points of a metric, over all its rows of the first row's type."""
    first = first_metrics(t, [required(name, "metric name")]).select("Name", "Type")
    mine = t.metrics.join(first, ["Name", "Type"], "left_semi").select(F.col("Id").alias("MetricId"))
    every = [t.points(kind).select("MetricId", "AttributesJson") for kind in types_of(first)]
    return labels(t, reduce(DataFrame.union, every).join(mine, "MetricId", "left_semi")).orderBy("LabelKey", "LabelValue")


#: What a point of each type shows; the other columns of a series are null.
SERIES = {
    "DoubleValue": ("double", {"GAUGE": "ValueDouble", "SUM": "ValueDouble"}),
    "IntValue": ("bigint", {"GAUGE": "ValueInt", "SUM": "ValueInt"}),
    "Count": ("bigint", {"HISTOGRAM": "Count", "EXPONENTIAL_HISTOGRAM": "Count", "SUMMARY": "Count"}),
    "Sum": ("double", {"HISTOGRAM": "SumValue", "EXPONENTIAL_HISTOGRAM": "SumValue", "SUMMARY": "SumValue"}),
    "Min": ("double", {"HISTOGRAM": "Min_Value", "EXPONENTIAL_HISTOGRAM": "Min_Value"}),
    "Max": ("double", {"HISTOGRAM": "Max_Value", "EXPONENTIAL_HISTOGRAM": "Max_Value"}),
    "BucketCounts": ("array<bigint>", {"HISTOGRAM": "coalesce(BucketCounts, array())"}),
    "BucketBounds": ("array<double>", {"HISTOGRAM": "coalesce(ExplicitBounds, array())"}),
    "Quantiles": ("array<double>", {"SUMMARY": "transform(QuantileValues, x -> x.Quantile)"}),
    "QuantileValues": ("array<double>", {"SUMMARY": "transform(QuantileValues, x -> x.Value)"}),
}


def _shown(points: DataFrame, kind: str) -> DataFrame:
    columns = [F.expr(f"cast({by.get(kind, 'null')} as {type_})").alias(name) for name, (type_, by) in SERIES.items()]
    return points.select("Name", "Type", to_time(F.col("TimeUnixNano")).alias("Timestamp"), "TimeUnixNano", "Id", *columns)


def multiple_metric_series(t: SignalTables, names: list[str], start: Bound = None, end: Bound = None, all_rows: bool = True, where: dict[str, str] | None = None, kinds: tuple[str, ...] = METRIC_TYPES) -> DataFrame:
    """The points of some metrics by name and time, both ends of the range included; unknown names have no rows.

    A metric has a row for every export. With ``all_rows`` the points of all rows of a name that have the type
    of its first row are read, otherwise only the first row's. ``where`` keeps the points with these attribute
    values. ``kinds`` are the types that are looked at."""
    first = first_metrics(t, names)
    rows = t.metrics.join(first.select("Name", "Type"), ["Name", "Type"], "left_semi").select("Id", "Name", "Type") if all_rows else first
    rows = rows.select(F.col("Id").alias("MetricId"), "Name", "Type")
    parts = []
    for kind in types_of(first, kinds):
        points = t.points(kind).where(in_range(F.col("TimeUnixNano"), start, end))
        for key, value in (where or {}).items():
            points = points.where(F.get_json_object("AttributesJson", f"$['{key}']") == value)
        parts.append(_shown(points.join(rows.where(F.col("Type") == kind), "MetricId"), kind))
    return reduce(DataFrame.union, parts).orderBy("Name", "TimeUnixNano", "Id").drop("TimeUnixNano", "Id")


def metric_series(t: SignalTables, name: str, start: Bound = None, end: Bound = None, all_rows: bool = True, where: dict[str, str] | None = None, kinds: tuple[str, ...] = METRIC_TYPES) -> DataFrame:
    """The series of one metric; empty if there is none."""
    return multiple_metric_series(t, [required(name, "metric name")], start, end, all_rows, where, kinds)


def exemplars_with_spans(t: SignalTables) -> DataFrame:
    """Exemplars beside the span they were taken in."""
    spans = t.referred_spans.select("TraceId", "SpanId", F.col("Name").alias("SpanName"), "StatusCode")
    return t.exemplars.join(spans, ["TraceId", "SpanId"]).select("Id", "TraceId", "SpanId", "SpanName", "StatusCode", "ValueDouble", "ValueInt", "TimeUnixNano")


def histogram_quantile(t: SignalTables, name: str, q: float, start: Bound = None, end: Bound = None) -> DataFrame:
    """The q-quantile of each histogram point of a metric, interpolated inside its bucket. A bucket runs from the
    bound before (its minimum in the first, if known, else 0) to its own bound, the last one to the maximum, or
    to the last bound where that is unknown; an empty histogram has none."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    series = metric_series(t, name, start, end, kinds=("HISTOGRAM",)).where((F.size("BucketCounts") == F.size("BucketBounds") + 1) & (F.col("Count") > 0))
    upto = F.transform("BucketCounts", lambda _, i: F.aggregate(F.slice("BucketCounts", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    ranked = series.withColumn("__rank", q * F.col("Count")).withColumn("__upto", upto)
    ranked = ranked.withColumn("__at", F.size(F.filter("__upto", lambda x: x < F.col("__rank"))))
    get = lambda c, i: F.get(F.col(c), i)
    low = F.coalesce(get("BucketBounds", F.col("__at") - 1), F.col("Min"), F.lit(0.0))
    high = F.coalesce(get("BucketBounds", F.col("__at")), F.col("Max"), low)
    below = F.coalesce(get("__upto", F.col("__at") - 1), F.lit(0))
    inside = F.when(get("BucketCounts", F.col("__at")) > 0, (F.col("__rank") - below) / get("BucketCounts", F.col("__at"))).otherwise(0.0)
    return ranked.select("Name", "Timestamp", (low + (high - low) * inside).alias("Value"))
