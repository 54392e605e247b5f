"""The tables of a signal store as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions.columns import service_name
from signalspark.schemas import DDL, POINT_TABLES


class SignalTables:
    """One DataFrame per table, as an attribute with the table's name. A table may be given as a function that
    makes it, which is called when a query first asks for it. After a delete, ``removed`` has for each table that
    lost rows a column and the values of it that went."""

    removed: dict[str, tuple[str, DataFrame]]

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(self.names())
        if unknown:
            raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
        self._tables = dict(tables)
        self._referred: DataFrame | Callable[[], DataFrame] | None = None
        self.removed = {}

    @staticmethod
    def names() -> list[str]:
        return [name for name in DDL if name != "schema_version"]

    def table(self, name: str) -> DataFrame:
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self.table(name)

    def points(self, kind: str) -> DataFrame:
        """The points of a metric type."""
        return self.table(POINT_TABLES[kind])

    def with_tables(self, **changed: DataFrame) -> SignalTables:
        made = SignalTables(**(self._tables | changed))
        return made if "spans" in changed else made.referring_to(self._referred)

    def referring_to(self, spans: DataFrame | Callable[[], DataFrame] | None) -> SignalTables:
        """These tables, with the spans that their rows may refer to: more than their own where they hold a range of time."""
        self._referred = spans
        return self

    @property
    def referred_spans(self) -> DataFrame:
        """The spans in which callers, and the spans of logs and exemplars, are looked up."""
        if self._referred is None:
            return self.spans
        if not isinstance(self._referred, DataFrame):
            self._referred = self._referred()
        return self._referred

    def services(self) -> DataFrame:
        """ResourceId and ServiceName: the JSON is parsed once per resource, not once per span."""
        return self.resources.select(F.col("Id").alias("ResourceId"), service_name(F.col("AttributesJson")).alias("ServiceName"), F.col("AttributesJson").alias("ResourceAttributes"))

    def scopes(self) -> DataFrame:
        return self.instrumentation_scopes.select(F.col("Id").alias("ScopeId"), F.col("Name").alias("ScopeName"), F.col("Version").alias("ScopeVersion"))
