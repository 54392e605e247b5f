"""A signal store: a folder of Parquet tables, each partitioned by the day of its time (UTC) and by the batch that
wrote it.

Writing a batch again replaces its own partitions and no others (Spark's dynamic partition overwrite), so an
ingest that failed half-way is simply run again. A delete rewrites the days that hold something to delete, the rows that
refer to others first: if it fails on its way, what is left has no orphan and the delete finds the rest again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions.columns import Bound, nanos_of
from signalspark.plans.ingest import Batch
from signalspark.schemas import DAYS, DIMENSIONS, schema
from signalspark.tables import SignalTables

DAY_NANOS = 86_400 * 10**9
#: Children are kept with the day of their span, so that a delete finds both in the same days.
PARENT_TIME = {"span_events": "ParentTime", "span_links": "ParentTime"}
#: Columns that rows are looked up by; files are sorted by them.
NEAR = {"spans": ("TraceId",), "log_records": ("TraceId",), "span_events": ("SpanId",), "span_links": ("SpanId",)}
#: How long before the rows of a range the spans that they refer to (callers, a log's span) have started at most.
REACH = timedelta(days=1)

Stage = Callable[[DataFrame], DataFrame]


def day_of(nanos: Column) -> Column:
    return F.to_date(F.timestamp_seconds(F.call_function("div", F.coalesce(nanos, F.lit(0)), F.lit(10**9))))


def time_of(table: str) -> Column:
    """The time that a row's day and a range go by: the first of the table's times that isn't null."""
    return F.coalesce(*map(F.col, DAYS[table]))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _drop(self, name: str) -> None:
        fs, path = self._place(name)
        fs.delete(path, True)

    def _write(self, name: str, rows: DataFrame) -> None:
        """Spark cuts a day of a batch into tasks, and joins small ones, by the size that it measures while it shuffles."""
        near = NEAR.get(name, ("MetricId",) if "MetricId" in rows.columns else ())
        spread = rows.hint("rebalance", "Day", "Batch").sortWithinPartitions("Day", "Batch", *near, "Id")
        spread.write.partitionBy("Day", "Batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")

    @contextmanager
    def staging(self, run: str | None = None) -> Iterator[Stage]:
        """A function that writes a table beside the store's and reads it again, in a folder of this run alone, which goes at the
        end. What an earlier run of the same name, if it has one, has left goes at the start."""
        folder = f"_staged/{run or uuid.uuid4().hex}"
        self._drop(folder)

        def stage(df: DataFrame) -> DataFrame:
            path = f"{self.path}/{folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield stage
        finally:
            self._drop(folder)

    def append(self, batch: Batch | dict[str, DataFrame], name: str | None = None) -> str:
        """Adds rows to tables under the name of the batch (a new one by default). A batch of the same name that is
        written again replaces what it wrote before."""
        name = name or uuid.uuid4().hex
        for table, df in (batch.tables if isinstance(batch, Batch) else batch).items():
            columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields]
            times = (PARENT_TIME[table],) if table in PARENT_TIME else DAYS.get(table, ())
            known = [F.col(c) for c in times if c in df.columns]
            day = day_of(F.coalesce(*known) if known else F.lit(0)) if times else F.lit("1970-01-01").cast("date")
            self._write(table, df.select(*columns, day.alias("Day"), F.lit(name).alias("Batch")))
        return name

    def delete(self, left: SignalTables, day: date | None = None) -> dict[str, int]:
        """Makes a delete (see ``signalspark.operators.retention``) lasting; gives the number of partitions rewritten in each
        table. The ids to remove are staged before any table changes; tables change in the order of ``removed``, which has
        the rows that others refer to last, so a delete that failed is made whole by asking for it again. ``day`` says that only
        that day can hold something to delete."""
        with self.staging() as stage:
            removed = {table: (column, stage(keys.toDF(column).distinct())) for table, (column, keys) in left.removed.items()}
            return {table: self._without(table, column, keys, stage, day) for table, (column, keys) in removed.items()}

    def _without(self, table: str, column: str, keys: DataFrame, stage: Stage, day: date | None) -> int:
        rows = self._read(table) if day is None else self._read(table).where(F.col("Day") == day)
        hit = [(r["Day"], r["Batch"]) for r in rows.join(keys, column, "left_semi").select("Day", "Batch").distinct().collect()]  # partitions, not rows
        if not hit:
            return 0
        days = F.col("Day").isin(sorted({d for d, _ in hit})) & F.struct("Day", "Batch").isin([F.struct(F.lit(d).alias("Day"), F.lit(b).alias("Batch")) for d, b in hit])
        kept = stage(rows.where(days).join(keys, column, "left_anti").select(*rows.columns))
        full = {(r["Day"], r["Batch"]) for r in kept.select("Day", "Batch").distinct().collect()}
        if full:
            self._write(table, kept)
        for day, batch in set(hit) - full:
            self._drop(f"{table}/Day={day}/Batch={batch}")
        return len(hit)

    def expire_spans(self, now: datetime, keep: timedelta = timedelta(days=30)) -> dict[str, int]:
        """Removes the spans that start before ``now`` less ``keep``, with their events and links. Whole days go with their folders,
        unread, since children lie in the day of their span; only the day of the bound is rewritten. Gives the number of
        days dropped and of partitions rewritten by table. Spans without a time lie in the first day of the epoch and stay."""
        from signalspark.operators import retention

        bound = nanos_of(now - keep)
        first = date(1970, 1, 1) + timedelta(days=bound // DAY_NANOS)
        out = {}
        for table in ("span_events", "span_links", "spans"):
            old = [day for day in self._days(table) if "1970-01-01" < day < str(first)]
            for day in old:
                self._drop(f"{table}/Day={day}")
            out[f"days of {table}"] = len(old)
        edge = self.read(bound // DAY_NANOS * DAY_NANOS, bound).with_tables(**{c: self._read(c).where(F.col("Day") == first) for c in PARENT_TIME})
        return out | self.delete(retention.span_retention(edge, now, keep), first)

    def _days(self, table: str) -> list[str]:
        """The days that a table has folders of."""
        fs, path = self._place(table)
        return [s.getPath().getName().removeprefix("Day=") for s in fs.listStatus(path) if s.getPath().getName().startswith("Day=")] if fs.exists(path) else []

    def compact(self, table: str) -> None:
        """Makes one batch of all batches of each day of a table, for a time when nothing else reads or writes it. If it dies
        half-way rows stand twice, in the old batches and the new one, until it is run again: ids are unique."""
        rows = self._read(table)
        old = [(r["Day"], r["Batch"]) for r in rows.select("Day", "Batch").distinct().collect()]
        if not old:
            return
        with self.staging() as stage:
            twice = stage(rows.groupBy("Id").agg(F.count("*").alias("n")).where("n > 1").select("Id"))  # none, but for one that died
            once = rows.join(twice, "Id", "left_anti").unionByName(rows.join(twice, "Id", "left_semi").dropDuplicates(["Id"]))
            self._write(table, once.select(*rows.columns).withColumn("Batch", F.lit(f"days-{uuid.uuid4().hex}")))
        for day, batch in old:
            self._drop(f"{table}/Day={day}/Batch={batch}")

    def _read(self, name: str) -> DataFrame:
        """A table with the columns of its partitions, in one scan."""
        full = schema(name).add("Day", "date").add("Batch", "string")
        fs, path = self._place(name)
        return self.spark.read.schema(full).parquet(f"{self.path}/{name}") if fs.exists(path) else self.spark.createDataFrame([], full)

    def table(self, name: str, start: Bound = None, end: Bound = None, without: str | None = None) -> DataFrame:
        """A table; a range of its time also prunes the days that can't hold it. ``without`` leaves out a batch. A log's time is
        that at which it was observed only where it has no other; a row without any time is in no range. Of resources
        and scopes, which ingests that don't see each other may both have written, each has one row."""
        df = self._read(name)
        if without is not None:
            df = df.where(F.col("Batch") != without)
        if name in DAYS:
            for bound, after in ((start, True), (end, False)):
                if (nanos := nanos_of(bound)) is not None:
                    day = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(nanos // DAY_NANOS).cast("int"))
                    df = df.where((F.col("Day") >= day) & (time_of(name) >= nanos) if after else (F.col("Day") <= day) & (time_of(name) <= nanos))
        df = df.drop("Day", "Batch")
        return df.dropDuplicates(["Id"]) if name in DIMENSIONS else df

    def read(self, start: Bound = None, end: Bound = None, without: str | None = None, reach: timedelta | None = REACH) -> SignalTables:
        """All tables, those with a time narrowed to a range. The spans that rows of the range refer to (the callers of its spans,
        the spans of its logs) are looked up further back as well, by ``reach``; without one, in the whole store up to the
        range's end."""
        back = None if start is None or reach is None else nanos_of(start) - int(reach.total_seconds()) * 10**9
        tables = SignalTables(**{name: partial(self.table, name, start, end, without) for name in SignalTables.names()})
        return tables.referring_to(partial(self.table, "spans", back, end, without))
