"""Queries over traces, logs and metrics, as functions from :class:`signalspark.tables.SignalTables` to DataFrames."""
