"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions.shared import drop_written, new_folder, scratch, shared_folder, written

__all__ = ["LOWER_TABLE", "drop_written", "free_names", "lower_ascii", "new_folder", "scratch", "shared_folder", "slices", "table", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z in UTF-8 bytes and nothing else.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lower_ascii(column: Column) -> Column:
    """The text with A-Z lower-cased; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, made of the wanted ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of text that a task works on at once; a longer text is worked on alone.
BYTES = 1 << 22


def slices(column: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most so many bytes together, or are one row."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))])
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield at, upto
        at = upto
