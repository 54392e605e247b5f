"""What a database would enforce: keys, references and enumerations, as a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.schemas import ENUMS, POINT_TABLES
from signalspark.tables import SignalTables

#: Columns that are unique together.
UNIQUE = {name: ("Id",) for name in ("resources", "instrumentation_scopes", "metrics", "log_records", "exemplars")} | {"spans": ("TraceId", "SpanId")}

#: (table, column) and the table whose ``Id`` it must hold.
REFERENCES = {
    ("spans", "ResourceId"): "resources", ("spans", "ScopeId"): "instrumentation_scopes", ("span_events", "SpanId"): "spans", ("span_links", "SpanId"): "spans",
    ("metrics", "ResourceId"): "resources", ("log_records", "ResourceId"): "resources", ("log_records", "ScopeId"): "instrumentation_scopes",
} | {(table, "MetricId"): "metrics" for table in POINT_TABLES.values()}


def violations(t: SignalTables) -> DataFrame:
    """``TableName``, ``Rule`` and ``Violations`` (rows, or keys that occur more than once) for every rule."""

    def row(table: str, rule: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count("*").alias("Violations")).select(F.lit(table).alias("TableName"), F.lit(rule).alias("Rule"), "Violations")

    out = [row(name, f"unique {', '.join(columns)}", t.table(name).groupBy(*columns).count().where("count > 1")) for name, columns in UNIQUE.items()]
    for (name, column), parent in REFERENCES.items():
        keys = t.table(parent).select(F.col("Id").alias(column))
        out.append(row(name, f"{column} in {parent}", t.table(name).where(F.col(column).isNotNull()).join(keys, column, "left_anti")))
    for (name, column), values in ENUMS.items():
        if column in t.table(name).columns:
            out.append(row(name, f"values of {column}", t.table(name).where(~F.col(column).isin(*values))))
    return reduce(DataFrame.union, out)
