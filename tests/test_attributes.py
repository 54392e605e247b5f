"""Typed predicates on attributes, and collations."""

import pytest
from pyspark.sql import functions as F

from signalspark.functions import attributes
from signalspark.functions.columns import LOOSE, collated
from signalspark.operators import metrics, traces
from signalspark.tables import SignalTables

ROWS = [
    (1, '{"a":5,"b":"5","c":true,"d":{"e.f":[1,{"g":"x"}]},"n":null}'), (2, '{"a":5.5,"b":5,"c":"true","d":{"e.f":[2]}}'), (3, "{"), (4, None), (5, "[]"), (6, '{"a":9007199254740993,"it\'s":1}'), (7, '{"a":1e400}'),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "Id int, j string")


def ids(df, condition):
    return [r["Id"] for r in df.where(condition).orderBy("Id").collect()]


def test_types(rows):
    j = F.col("j")
    where = attributes.where
    assert ids(rows, where(j, ("a",), 5)) == [1] and ids(rows, where(j, ("a",), 5.5)) == [2] and ids(rows, where(j, ("a",), 5, ">"))[:2] == [2, 6]
    assert ids(rows, where(j, ("a",), "5")) == [] and ids(rows, where(j, ("b",), "5")) == [1] and ids(rows, where(j, ("b",), 5)) == [2]
    assert ids(rows, where(j, ("c",), True)) == [1] and ids(rows, where(j, ("c",), "true")) == [2] and ids(rows, where(j, ("c",), 1)) == []
    assert ids(rows, where(j, ("n",), "x", "<>")) == [] and ids(rows, where(j, ("it's",), 1)) == [6]
    with pytest.raises(ValueError):
        where(j, ("a",), 1, "~")
    with pytest.raises(ValueError):
        attributes.json_path(("'\"",))


def test_paths(rows):
    j = F.col("j")
    assert ids(rows, attributes.where(j, ("d", "e.f", 0), 2, ">=")) == [2] and ids(rows, attributes.where(j, ("d", "e.f", 1, "g"), "x")) == [1]
    assert ids(rows, attributes.has(j, ("n",))) == [1] and ids(rows, attributes.has(j, ("d", "e.f", 5))) == []


def test_spans_by_attribute(spark):
    spans = spark.createDataFrame([("t", "s1", 5, '{"http":{"status":500}}'), ("t", "s2", 9, '{"http":{"status":"500"}}'), ("t", "s3", 1, '{"http":{"status":503}}')], "TraceId string, SpanId string, StartTimeUnixNano long, AttributesJson string")
    t = SignalTables(spans=spans)
    assert [r["SpanId"] for r in traces.spans_by_attribute(t, ("http", "status"), 500, ">=").collect()] == ["s3", "s1"]
    assert [r["SpanId"] for r in traces.spans_by_attribute(t, ("http", "status"), 500, ">=", start=2).collect()] == ["s1"]


def test_collations(spark):
    names = spark.createDataFrame([(1, "Café"), (2, "CAFE "), (3, "cafe"), (4, "cafes"), (5, None)], "Id long, Name string")
    assert ids(names, collated(F.col("Name"), LOOSE) == "cafÉ") == [1, 2, 3] and ids(names, collated(F.col("Name"), None) == "cafe") == [3]
    t = SignalTables(metrics=names.withColumn("ResourceId", F.lit(1)), resources=spark.createDataFrame([], "Id long, AttributesJson string"))
    assert [r["Name"] for r in metrics.unique_metric_names(t, collation=LOOSE).collect()] == [None, "CAFE ", "cafes"]
    assert len(metrics.unique_metric_names(t).collect()) == 5


def test_a_filter_names_the_attributes_once(spark):
    rows = spark.createDataFrame([('{"a":5}',)], "v string").select(attributes.where(F.col("v"), ("a",), 3, ">").alias("x"))
    assert rows.first()["x"] is True
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
