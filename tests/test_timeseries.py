"""Rates, resampling and merges of histograms against hand-made points and brute force."""

import math
import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from signalspark.operators import timeseries
from signalspark.schemas import schema
from signalspark.tables import SignalTables

S = 10**9
DAY = 86_400 * S


def tables(spark, **rows):
    def table(name):
        full = schema(name)
        return spark.createDataFrame([tuple(r.get(f.name) for f in full.fields) for r in rows.get(name, [])], full)

    metrics = [{"Id": 1, "ResourceId": 1, "ScopeId": None, "Name": "m"}, {"Id": 2, "ResourceId": 1, "ScopeId": None, "Name": "m"}, {"Id": 3, "ResourceId": 2, "ScopeId": 1, "Name": "m"}]
    rows = {"resources": [{"Id": 1, "AttributesJson": '{"service.name":"a"}'}, {"Id": 2, "AttributesJson": None}], "metrics": metrics} | rows
    return SignalTables(**{name: table(name) for name in SignalTables.names()})


def sums(points, temporality="CUMULATIVE", monotonic=True):
    return [{"Id": i, "MetricId": m, "TimeUnixNano": t * S, "ValueDouble": v, "StartTimeUnixNano": None if start is None else start * S, "AggregationTemporality": temporality, "IsMonotonic": monotonic, "AttributesJson": a} for i, (m, t, v, start, a) in enumerate(points)]


def rates(spark, rows):
    got = timeseries.metric_rate(tables(spark, sum_data_points=rows), "m").orderBy("ResourceId", "Attributes", "TimeUnixNano").collect()
    return [(r["TimeUnixNano"] // S, r["Increase"], r["Rate"], r["Reset"]) for r in got]


def test_resets_gaps_and_equal_times(spark):
    points = [(1, 10, 5.0, None, None), (2, 20, 9.0, None, None), (1, 20, 7.0, None, "{}"), (1, 30, 2.0, None, None), (1, 200_000, 12.0, None, None)]  # two exports, one series; over two days
    # of the two points at 20 the one with the larger id counts
    assert rates(spark, sums(points)) == [(10, None, None, False), (20, 2.0, 0.2, False), (30, 2.0, 0.2, True), (200_000, 10.0, 10 / 199_970, False)]
    assert rates(spark, sums(points, monotonic=False))[2] == (30, -5.0, -0.5, False)


def test_a_start_after_the_point_before_is_a_reset(spark):
    points = [(1, 10, 5.0, 0, None), (1, 20, 8.0, 0, None), (1, 40, 9.0, 30, None)]
    assert rates(spark, sums(points)) == [(10, 5.0, 0.5, False), (20, 3.0, 0.3, False), (40, 9.0, 0.9, True)]


def test_delta_sums(spark):
    points = [(1, 10, 5.0, None, None), (1, 20, 4.0, None, None), (2, 20, 6.0, None, None), (1, 30, 3.0, 25, None), (3, 30, 1.0, None, None)]
    assert rates(spark, sums(points, "DELTA")) == [(10, 5.0, None, False), (20, 10.0, 1.0, False), (30, 3.0, 0.6, False), (30, 1.0, None, False)]


def test_rates_do_not_depend_on_the_days_that_a_series_is_cut_into(spark):
    rng = random.Random(1)
    times = sorted(rng.sample(range(10 * 86_400), 200))
    value, rows = 0.0, []
    for t in times:
        value = 0.0 if rng.random() < 0.1 else value + rng.randrange(1, 50)
        rows.append((1, t, value, None, None))
    got = rates(spark, sums(rows))
    expected = [(t1, v1 if v1 < v0 else v1 - v0) for (_, _, v0, *_), (_, t1, v1, *_) in zip(rows, rows[1:], strict=False)]
    assert [(t, i) for t, i, _, _ in got[1:]] == expected


def gauges(points):
    return [{"Id": i, "MetricId": 1, "TimeUnixNano": t * S, "ValueDouble": v} for i, (t, v) in enumerate(points)]


def test_resampling(spark):
    t = tables(spark, gauge_data_points=gauges([(5, 1.0), (10, 2.0), (10, 3.0), (40, 9.0)]))
    got = timeseries.metric_resampled(t, "m", 0, 60 * S, timedelta(seconds=10), timedelta(seconds=25)).orderBy("TimeUnixNano").collect()
    assert [r["Last"] for r in got] == [None, 3.0, 3.0, 3.0, 9.0, 9.0, 9.0]
    assert [r["Linear"] for r in got] == [None, 3.0, None, None, 9.0, None, None]  # the line from 10 to 40 is over the gap
    wide = timeseries.metric_resampled(t, "m", 0, 60 * S, timedelta(seconds=10)).orderBy("TimeUnixNano").collect()
    assert [r["Linear"] for r in wide] == [None, 3.0, 5.0, 7.0, 9.0, None, None]
    with pytest.raises(ValueError):
        timeseries.metric_resampled(t, "m", 0, 10**18, timedelta(milliseconds=1))
    plan = timeseries.metric_resampled(t, "m", 0, 60 * S, timedelta(seconds=10))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def histogram(i, bounds, counts, metric=1):
    return {"Id": i, "MetricId": metric, "TimeUnixNano": i * S, "Count": sum(counts), "SumValue": float(i), "Min_Value": float(i), "Max_Value": float(i + 5), "ExplicitBounds": bounds, "BucketCounts": counts}


def test_merged_histograms_in_any_order(spark):
    points = [histogram(1, [1.0, 5.0, 10.0], [1, 2, 3, 4]), histogram(2, [5.0, 10.0], [3, 3, 4], 2), histogram(3, [2.0, 5.0, 10.0, 20.0], [1, 1, 1, 1, 1]), histogram(4, [5.0], [1, 2, 3])]
    results = set()
    for order in (points, points[::-1], points[2:] + points[:2]):
        t = tables(spark, histogram_data_points=order)
        (r,) = timeseries.merged_histograms(t, "a").collect()
        results.add((r["Count"], r["Sum"], r["Min"], r["Max"], tuple(r["BucketBounds"]), tuple(r["BucketCounts"])))
    assert results == {(31, 10.0, 1.0, 9.0, (5.0, 10.0), (8, 7, 10))}  # the last point doesn't fit its bounds
    (r,) = timeseries.merged_histograms(tables(spark, histogram_data_points=[histogram(1, [1.0], [1, 2]), histogram(2, [3.0], [4, 5])])).collect()
    assert (r["BucketBounds"], r["BucketCounts"]) == ([], [12])


def test_merged_exponential_histograms(spark):
    rng = random.Random(2)
    points, expected, lowest = [], {"Positive": Counter(), "Negative": Counter()}, 0
    for i in range(12):
        scale = rng.randrange(lowest, 5)
        row = {"Id": i, "MetricId": 1, "TimeUnixNano": i * S, "Count": 5, "SumValue": 1.0, "Scale": scale, "ZeroCount": i, "Min_Value": -9.0, "Max_Value": 9.0}
        for side in expected:
            offset, counts = rng.randrange(-20, 20), [rng.randrange(3) for _ in range(rng.randrange(6))]
            row |= {f"{side}Offset": offset, f"{side}BucketCounts": counts}
            for j, c in enumerate(counts):
                expected[side][(offset + j, scale)] += c
        points.append(row)
    least = min(p["Scale"] for p in points)
    for order in (points, points[::-1]):
        (r,) = timeseries.merged_exponential_histograms(tables(spark, exponential_histogram_data_points=order)).collect()
        assert (r["Scale"], r["ZeroCount"], r["Count"]) == (least, sum(range(12)), 60)
        for side, fine in expected.items():
            coarse = Counter()
            for (k, scale), c in fine.items():
                coarse[k >> (scale - least)] += c
            got = {r[f"{side}Offset"] + j: c for j, c in enumerate(r[f"{side}BucketCounts"]) if c}
            assert got == {k: c for k, c in coarse.items() if c}


def test_exponential_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * math.exp(rng.uniform(-3, 3)) for _ in range(400)] + [0.0] * 20
    scale = 4
    base = 2 ** (2**-scale)
    buckets = {side: Counter(math.ceil(math.log(abs(v), base)) - 1 for v in values if v * sign > 0) for side, sign in (("Positive", 1), ("Negative", -1))}
    row = {"Id": 1, "MetricId": 1, "TimeUnixNano": S, "Count": len(values), "Scale": scale, "ZeroCount": 20, "Min_Value": min(values), "Max_Value": max(values)}
    for side, found in buckets.items():
        low, high = min(found), max(found)
        row |= {f"{side}Offset": low, f"{side}BucketCounts": [found[k] for k in range(low, high + 1)]}
    merged = timeseries.merged_exponential_histograms(tables(spark, exponential_histogram_data_points=[row]))
    values.sort()
    for q in (0.0, 0.1, 0.3, 0.5, 0.52, 0.8, 0.99, 1.0):
        got = timeseries.exponential_quantile(merged, q).first()["Value"]
        near = values[min(len(values) - 1, max(0, math.ceil(q * len(values)) - 1))]
        assert got == pytest.approx(near, rel=0.1, abs=1e-9), q
    assert timeseries.exponential_quantile(merged.withColumns({"ZeroCount": F.lit(0), "PositiveBucketCounts": F.array().cast("array<bigint>"), "NegativeBucketCounts": F.array().cast("array<bigint>")}), 0.5).first()["Value"] is None
