"""Column functions."""

from signalspark.functions.columns import any_term, duration_ms, in_range, label_value, service_name, to_time

__all__ = ["any_term", "duration_ms", "in_range", "label_value", "service_name", "to_time"]
