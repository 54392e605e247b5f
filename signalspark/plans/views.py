"""Temporary views: the tables, and the analytic views over them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from signalspark.operators import logs, traces
from signalspark.tables import SignalTables

VIEWS = {
    "trace_summary": traces.trace_summary,
    "service_map": traces.service_map,
    "service_map_detailed": traces.service_map_detailed,
    "log_severity_stats": logs.log_severity_stats,
}


def register(spark: SparkSession, t: SignalTables) -> list[str]:
    """Makes every table and view known to ``spark.sql`` under its name and gives the names."""
    for name in t.names():
        t.table(name).createOrReplaceTempView(name)
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(name)
    return [*t.names(), *VIEWS]
