"""Series over all exports of a metric: rates, resampling, and merges of histograms.

A series is a metric's name, resource, scope and a point's attributes, whichever export stored the point. Nothing here needs a
series in one task: neighbours are found inside the days of a series, and what leads from one day to the next is one row a day.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalspark.functions.columns import Bound, checked_range, in_range, required
from signalspark.operators.metrics import number, of_service
from signalspark.tables import SignalTables

SERIES = ("Name", "ResourceId", "ScopeId", "Attributes")
SECOND = 10**9
#: Most steps of a resampled series.
STEPS = 1_000_000


def series_points(t: SignalTables, name: str, kinds: tuple[str, ...], start: Bound = None, end: Bound = None) -> DataFrame:
    """The points of a metric's name that are numbers, with the columns of :data:`SERIES`, ``Value``, and what says how values add up."""
    metrics = t.metrics.where(F.col("Name") == required(name, "metric name")).select(F.col("Id").alias("MetricId"), "Name", "ResourceId", "ScopeId")
    out = None
    for kind in kinds:
        points = t.points(kind).where(in_range(F.col("TimeUnixNano"), start, end) & F.col("TimeUnixNano").isNotNull())
        optional = [F.col(c) if c in points.columns else F.lit(None).cast(k).alias(c) for c, k in (("StartTimeUnixNano", "long"), ("AggregationTemporality", "string"), ("IsMonotonic", "boolean"))]
        rows = points.select("MetricId", "Id", "TimeUnixNano", number().alias("Value"), F.coalesce("AttributesJson", F.lit("{}")).alias("Attributes"), *optional)
        out = rows if out is None else out.union(rows)
    return out.join(metrics, "MetricId").drop("MetricId")


def with_previous(rows: DataFrame, keys: tuple[str, ...], time: str, what: tuple[str, ...], bucket: int = 86_400 * SECOND) -> DataFrame:
    """Rows with ``Previous``, a struct of ``what`` of the row before in the series; times are unique in a series. Rows are put in order
    inside buckets of time, however long the series; the last row of each bucket leads to the next one that has any."""
    last, carried = [F.struct(*what), F.max_by(F.struct(*what), F.col(time)).alias("__last")]
    dealt = rows.withColumn("__bucket", F.call_function("div", F.col(time), F.lit(bucket)))
    inside = dealt.withColumn("__inside", F.lag(last).over(Window.partitionBy(*keys, "__bucket").orderBy(time)))
    ends = dealt.groupBy(*keys, "__bucket").agg(carried).withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__last")
    joined = beside(inside, ends, (*keys, "__bucket"))
    return joined.select(*rows.columns, F.coalesce("__inside", "__carried").alias("Previous"))


def metric_rate(t: SignalTables, name: str, start: Bound = None, end: Bound = None) -> DataFrame:
    """``Increase`` and ``Rate`` (a second) at each point of the sums of a name, by series.

    Delta points: points of equal time count together, the increase is their sum and the interval runs from their start time, or
    else from the point before. Cumulative points: of equal times that with the largest id counts; the increase is the
    difference from the point before. A monotonic sum that has fallen, or has started anew since the point before, was
    reset (``Reset``), and increases by its whole value. The first point of a cumulative series has no increase unless it says
    when it started; an interval that isn't positive has no rate. A range takes its first neighbours from inside it. Unspecified
    temporality counts as cumulative."""
    points = series_points(t, name, ("SUM",), start, end).withColumn("Delta", F.coalesce(F.col("AggregationTemporality") == "DELTA", F.lit(False)))
    keys = (*SERIES, "Delta")
    latest = lambda c: F.max_by(c, "Id")
    at = points.groupBy(*keys, "TimeUnixNano").agg(
        F.when(F.col("Delta"), F.sum("Value")).otherwise(latest("Value")).alias("Value"),
        F.when(F.col("Delta"), F.min("StartTimeUnixNano")).otherwise(latest("StartTimeUnixNano")).alias("StartTimeUnixNano"),
        F.coalesce(F.bool_and("IsMonotonic"), F.lit(False)).alias("IsMonotonic"),
    )
    rows = with_previous(at, keys, "TimeUnixNano", ("TimeUnixNano", "Value"))
    before = F.col("Previous.TimeUnixNano")
    restarted = F.coalesce(F.col("StartTimeUnixNano") > before, F.lit(False)) & (F.col("StartTimeUnixNano") < F.col("TimeUnixNano"))
    reset = ~F.col("Delta") & before.isNotNull() & F.col("IsMonotonic") & ((F.col("Value") < F.col("Previous.Value")) | restarted)
    since = F.when(F.col("Delta") | reset, F.coalesce("StartTimeUnixNano", before)).otherwise(F.coalesce(before, "StartTimeUnixNano"))
    first = F.when(F.col("StartTimeUnixNano").isNotNull() & F.col("IsMonotonic"), F.col("Value"))
    increase = F.when(F.col("Delta") | reset, F.col("Value")).when(before.isNull(), first).otherwise(F.col("Value") - F.col("Previous.Value"))
    interval = F.when(F.col("TimeUnixNano") > since, F.col("TimeUnixNano") - since)
    shown = rows.select(*SERIES, "TimeUnixNano", "Value", F.coalesce(reset, F.lit(False)).alias("Reset"), increase.alias("Increase"), interval.alias("IntervalNano"))
    return shown.withColumn("Rate", F.col("Increase") / (F.col("IntervalNano") / F.lit(SECOND)))


def metric_resampled(t: SignalTables, name: str, start: Bound, end: Bound, step: timedelta, longest_gap: timedelta | None = None, kinds: tuple[str, ...] = ("GAUGE", "SUM")) -> DataFrame:
    """The series of a name at every ``step`` from ``start`` to ``end``, both ends included: ``Last``, the latest value at or before
    the time, and ``Linear``, the value on the line to the next point (null behind the last one, and where there is none
    before). With ``longest_gap`` a value that is older, or a line over more, is null. Of points of one time that with the
    largest id counts; only points inside the range are known; every series with a point has all steps.

    Points are put in the step that they come up to and joined with the steps by number; no ranges are joined."""
    low, high = checked_range(start, end)
    width = int(step.total_seconds() * 1000) * 1_000_000
    if width <= 0 or (high - low) // width >= STEPS:
        raise ValueError(f"a range has at most {STEPS} steps of a positive length")
    gap = None if longest_gap is None else int(longest_gap.total_seconds() * 1000) * 1_000_000
    points = series_points(t, name, kinds, low, high)
    up = F.call_function("div", F.col("TimeUnixNano") - F.lit(low) + F.lit(width - 1), F.lit(width))
    point = F.struct("TimeUnixNano", "Id", "Value")
    ends = points.groupBy(*SERIES, up.alias("Step")).agg(F.max(point).alias("last"), F.min(F.struct("TimeUnixNano", (-F.col("Id")).alias("Id"), "Value")).alias("first"))
    steps = (high - low) // width
    grid = points.select(*SERIES).distinct().withColumn("Step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    both = beside(grid, ends, (*SERIES, "Step"))
    order = Window.partitionBy(*SERIES).orderBy("Step")  # a series has at most STEPS rows here
    known = both.select(
        *SERIES,
        (F.lit(low) + F.col("Step") * width).alias("TimeUnixNano"),
        F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("n"),
    )
    old, apart = F.col("TimeUnixNano") - F.col("p.TimeUnixNano"), F.col("n.TimeUnixNano") - F.col("p.TimeUnixNano")
    fresh = F.lit(True) if gap is None else old <= gap
    near = F.lit(True) if gap is None else apart <= gap
    line = F.col("p.Value") + (F.col("n.Value") - F.col("p.Value")) * (old / apart)
    linear = F.when(old == 0, F.col("p.Value")).when(near, line)
    return known.select(*SERIES, "TimeUnixNano", F.when(fresh, F.col("p.Value")).alias("Last"), linear.alias("Linear"))


def _of_service(t: SignalTables, points: DataFrame, service: str | None, width: int) -> DataFrame:
    """Points with the name, resource and period that they are merged by."""
    metrics = of_service(t, service).select(F.col("Id").alias("MetricId"), "Name", "ResourceId").join(t.services().select("ResourceId", "ServiceName"), "ResourceId")
    period = (F.call_function("div", F.col("TimeUnixNano"), F.lit(width)) * width).alias("PeriodStart")
    return points.join(metrics, "MetricId").select("ServiceName", "Name", period, *[c for c in points.columns if c != "MetricId"])


_MERGED = ("ServiceName", "Name", "PeriodStart")


def _summed(points: DataFrame) -> DataFrame:
    return points.groupBy(*_MERGED).agg(F.sum("Count").alias("Count"), F.sum("SumValue").alias("Sum"), F.min("Min_Value").alias("Min"), F.max("Max_Value").alias("Max"))


def beside(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Rows of ``a`` with the other columns of ``b``, by keys that may be null."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return a.alias("l").join(b.alias("r"), on, how).select("l.*", *[F.col(f"r.{c}") for c in b.columns if c not in keys])


def merged_histograms(t: SignalTables, service: str | None = None, period: timedelta = timedelta(hours=1)) -> DataFrame:
    """The histogram points of a service (of all without one) merged by service, name and period: ``Count``, ``Sum``, ``Min``, ``Max``,
    ``BucketBounds`` and ``BucketCounts``. Points of other bounds are brought to the bounds that all of them have, where counts
    add up exactly; so the result is the same in whatever order points are merged. Points whose counts don't fit their bounds
    count in the sums only. Counts are summed by bounds and bucket before anything is put together."""
    width = int(period.total_seconds() * SECOND)
    points = _of_service(t, t.histogram_data_points, service, width)
    fitting = points.where(F.size("BucketCounts") == F.size("ExplicitBounds") + 1)
    keys = (*_MERGED, "ExplicitBounds")
    counts = fitting.select(*keys, F.posexplode("BucketCounts").alias("i", "c")).groupBy(*keys, "i").agg(F.sum("c").alias("c"))
    shapes = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("buckets"))
    # one row for each kind of bounds from here on
    common = F.reduce(F.collect_set("ExplicitBounds"), F.first("ExplicitBounds"), F.array_intersect)
    bounds = shapes.groupBy(*_MERGED).agg(F.array_sort(common).alias("BucketBounds"))
    joined = beside(shapes, bounds, _MERGED)
    # bucket i ends at bound i; it belongs to the first common bound that isn't below that, the last to none
    placed = joined.select(*_MERGED, "BucketBounds", "ExplicitBounds", F.explode("buckets").alias("b"))
    at = F.size(F.filter("BucketBounds", lambda x: x < F.get("ExplicitBounds", F.col("b.i"))))
    place = F.when(F.col("b.i") < F.size("ExplicitBounds"), at).otherwise(F.size("BucketBounds"))
    folded = placed.groupBy(*_MERGED, "BucketBounds", place.alias("i")).agg(F.sum("b.c").alias("c"))
    arrays = folded.groupBy(*_MERGED, "BucketBounds").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    whole = arrays.select(*_MERGED, "BucketBounds", F.transform(F.sequence(F.lit(0), F.size("BucketBounds")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("BucketCounts"))
    return beside(_summed(points), whole.select(*_MERGED, "BucketBounds", "BucketCounts"), _MERGED)


def merged_exponential_histograms(t: SignalTables, service: str | None = None, period: timedelta = timedelta(hours=1)) -> DataFrame:
    """The exponential histogram points of a service merged by service, name and period: ``Count``, ``Sum``, ``Min``, ``Max``, ``Scale``,
    ``ZeroCount`` and both sides' offsets and counts (null and empty where nothing counts). Finer points are brought down to the
    lowest scale, at which ``2 ** k`` neighbouring buckets are one; offsets are aligned by the buckets' numbers. The result is
    the same in whatever order points are merged."""
    width = int(period.total_seconds() * SECOND)
    points = _of_service(t, t.exponential_histogram_data_points, service, width)
    optional = {c: F.col(c) if c in points.columns else F.lit(None) for c in ("NegativeOffset", "NegativeBucketCounts", "PositiveOffset", "PositiveBucketCounts")}
    points = points.withColumns({c: v.cast("array<bigint>" if c.endswith("Counts") else "int") for c, v in optional.items()})
    sums = points.groupBy(*_MERGED).agg(F.sum("Count").alias("Count"), F.sum("SumValue").alias("Sum"), F.min("Min_Value").alias("Min"), F.max("Max_Value").alias("Max"), F.min("Scale").alias("Scale"), F.sum("ZeroCount").alias("ZeroCount"))
    out = sums
    for side in ("Positive", "Negative"):
        each = points.select(*_MERGED, "Scale", F.coalesce(f"{side}Offset", F.lit(0)).alias("o"), F.posexplode(f"{side}BucketCounts").alias("i", "c")).where("c > 0")
        fine = each.groupBy(*_MERGED, "Scale", (F.col("o") + F.col("i")).alias("i")).agg(F.sum("c").alias("c"))
        scaled = beside(fine, sums.select(*_MERGED, F.col("Scale").alias("__to")), _MERGED)
        coarse = scaled.groupBy(*_MERGED, F.call_function("shiftright", "i", F.least(F.col("Scale") - F.col("__to"), F.lit(31))).alias("i")).agg(F.sum("c").alias("c"))
        arrays = coarse.groupBy(*_MERGED).agg(F.min("i").alias("low"), F.max("i").alias("high"), F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
        counts = F.transform(F.sequence("low", "high"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
        own = arrays.select(*_MERGED, F.col("low").alias(f"{side}Offset"), counts.alias(f"{side}BucketCounts"))
        out = beside(out, own, _MERGED).withColumn(f"{side}BucketCounts", F.coalesce(f"{side}BucketCounts", F.array().cast("array<bigint>")))
    return out


def exponential_quantile(merged: DataFrame, q: float) -> DataFrame:
    """Rows of :func:`merged_exponential_histograms` with ``Value``, their q-quantile: the bucket in which the rank lies, and inside it
    the place on a logarithmic scale. Negative buckets come first, from their largest number down, then the zeros; the value
    keeps inside the minimum and maximum, where these are known. Null where nothing counts."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -F.col("Scale")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    below, zeros, above = total("NegativeBucketCounts"), F.col("ZeroCount"), total("PositiveBucketCounts")
    rank = F.col("__rank")

    def inside(counts: Column, offset: Column, left: Column) -> Column:
        """The exponent of the base at which ``left`` of the counts, from the first on, end."""
        start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("double").alias("at"))
        step = lambda acc, x, i: F.struct((acc["upto"] + x).alias("upto"), F.coalesce(acc["at"], F.when((x > 0) & (acc["upto"] + x >= left), i + (left - acc["upto"]) / x)).alias("at"))
        numbered = F.transform(counts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.aggregate(numbered, start, lambda acc, e: step(acc, e["x"], e["i"]))["at"] + offset

    up = F.pow(base, inside(F.col("PositiveBucketCounts"), F.col("PositiveOffset"), rank - below - zeros))
    down = -F.pow(base, inside(F.col("NegativeBucketCounts"), F.col("NegativeOffset"), below - rank))
    value = F.when(below + zeros + above <= 0, F.lit(None)).when(rank < below, down).when(rank <= below + zeros, F.lit(0.0)).otherwise(up)
    ranked = merged.withColumn("__rank", F.lit(float(q)) * (below + zeros + above))
    return ranked.withColumn("Value", F.when(value.isNotNull(), F.least(F.greatest(value, "Min"), "Max"))).drop("__rank")
