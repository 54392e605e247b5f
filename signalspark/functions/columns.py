"""Column functions over the signal tables. All are built-in Spark expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_A_MS = 1_000_000

Bound = datetime | int | None


def service_name(attributes: Column) -> Column:
    """``service.name`` of a resource's attributes; null if it is missing, null, or the JSON is malformed."""
    return F.get_json_object(attributes, "$['service.name']")


def millis(nanos: Column) -> Column:
    """Epoch milliseconds, cut off, as all reported times and durations are."""
    return F.call_function("div", nanos, F.lit(NANOS_A_MS))


def to_time(nanos: Column) -> Column:
    return F.timestamp_millis(millis(nanos))


def duration_ms(start: Column, end: Column) -> Column:
    """A duration in fractional milliseconds."""
    return (end - start) / F.lit(NANOS_A_MS)


def nanos_of(bound: Bound) -> int | None:
    """A bound as epoch nanoseconds with millisecond precision. Datetimes without a zone are UTC; whole numbers are
    nanoseconds already."""
    if bound is None or isinstance(bound, int):
        return bound
    from datetime import UTC

    aware = bound if bound.tzinfo else bound.replace(tzinfo=UTC)
    since = aware - datetime(1970, 1, 1, tzinfo=UTC)
    return ((since.days * 86_400 + since.seconds) * 1000 + since.microseconds // 1000) * NANOS_A_MS


def in_range(column: Column, start: Bound = None, end: Bound = None) -> Column:
    """Both bounds are inclusive and either may be missing; a null time is in no bounded range."""
    low, high = nanos_of(start), nanos_of(end)
    out = F.lit(True)
    if low is not None:
        out = column >= low
    if high is not None:
        out = (column <= high) if low is None else out & (column <= high)
    return out


def checked_range(start: Bound, end: Bound) -> tuple[int, int]:
    low, high = nanos_of(start), nanos_of(end)
    if low is None or high is None or low >= high:
        raise ValueError("the start of a range must lie before its end")
    return low, high


def required(value: str | None, what: str) -> str:
    if not value:
        raise ValueError(f"{what} must not be empty")
    return value


#: Case and accents make no difference, nor do spaces at the end.
LOOSE = "UNICODE_CI_AI_RTRIM"


def collated(column: Column, collation: str | None) -> Column:
    """A text as a collation compares it; as it is without one."""
    return column if collation is None else F.collate(column, collation)


def label_value(value: Column) -> Column:
    """The text of a label's value: a missing one is empty."""
    return F.coalesce(value, F.lit(""))


#: A word of any script.
WORD = r"[\p{L}\p{M}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


terms = words


def words_of(query: str, shortest: int = 1) -> list[str]:
    """The distinct words of a query that have ``shortest`` characters or more; a query without any is an error."""
    import regex

    found = sorted({w for w in regex.findall(WORD, query.lower()) if len(w) >= shortest})
    if not found:
        raise ValueError(f"the query has no word of {shortest} characters or more")
    return found


def any_term(text: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(terms(text), F.array(*[F.lit(w.lower()) for w in wanted]))
