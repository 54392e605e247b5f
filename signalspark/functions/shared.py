"""Tables that are written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a session on one machine (master ``local``), as in
    tests, takes a temporary folder; on a cluster that is an error, as every host would write to its own disk."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(shared_folder, "local", None)
        if folder is None:
            keep = tempfile.TemporaryDirectory(prefix="signalspark-")
            atexit.register(keep.cleanup)
            folder = shared_folder.local = "file://" + keep.name
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/signalspark/{name}-{uuid.uuid4().hex}"


#: Paths that :func:`written` used inside a :func:`scratch`.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what :func:`written` wrote inside it: for work whose result has been written elsewhere by then."""
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for folder in held:
            _delete(spark, folder)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes a table to the shared folder, partitioned ``by`` columns if given, and reads it again: cuts the lineage, and a
    lost executor costs no more than the tasks it ran, since the files are not its own."""
    path = new_folder(df.sparkSession, name)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables from :func:`written` that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        # a folder of a partition lies inside the table's
        for folder in {"/".join(x for x in f.rsplit("/", 1)[0].split("/") if "=" not in x) for f in df.inputFiles()}:
            _delete(spark, folder)
