"""A PySpark engine for observability data: traces, metrics and logs of the OTLP data model."""
