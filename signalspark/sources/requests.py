"""Files of export requests as a data source, ``spark.read.format("otlp_requests")``, batch and stream.

A request is one line of JSON, or, with ``framing=lengths``, a binary message behind its length in four bytes, the first the
highest. Large files are read by several tasks, each a range of bytes; a request belongs to the range in which it begins. Its
``Key`` is the file and the offset in it, so it is the same in every reading. Options: ``framing`` (``lines``), ``rangeBytes`` (32 MB),
``settleSeconds`` (0).

A stream takes files in the order of their times of change and names, and its offset is the last of them; files are put in place
whole and don't change. Where clocks of writers differ, ``settleSeconds`` leaves the newest files for later, so that none comes
in before one that is taken already. A run with ``availableNow`` is one batch; what a window closes by it comes with the next
run. Paths are those that pyarrow opens (local, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "otlp_requests"
RANGE_BYTES = 32 << 20
#: Requests of an Arrow batch, and bytes after which it ends sooner.
ROWS, BATCH_BYTES = 1000, 4 << 20


@dataclass
class Range(InputPartition):
    """The requests of a file that begin from ``start`` on and before ``end``."""

    path: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[int, str, int]]:
    """Time of change, path and size of all files, in the order in which a stream takes them. Hidden ones and those in the making
    (names that begin with a dot or an underscore) don't count."""
    system, root = opened(path)
    scheme = path[: path.index(root)] if ":" in path and root in path else ""
    info = system.get_file_info(root)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    found = [x for x in infos if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return sorted((x.mtime_ns or 0, scheme + x.path, x.size) for x in found)


def framed(file, size: int) -> Iterator[int]:
    """Offsets of the messages of a file: only their lengths are read."""
    at = 0
    while at + 4 <= size:
        yield at
        file.seek(at)
        at += 4 + int.from_bytes(file.read(4), "big")


def ranges_of(path: str, size: int, framing: str, width: int) -> list[Range]:
    """A file of lines is cut anywhere, one of messages at the first that begins behind each ``width`` bytes."""
    if framing == "lines" or size <= width:
        return [Range(path, at, min(at + width, size)) for at in range(0, size, width)]
    system, own = opened(path)
    cuts = []
    with io.BufferedReader(system.open_input_file(own), 1 << 16) as file:
        for at in framed(file, size):
            if not cuts or at >= cuts[-1] + width:
                cuts.append(at)
    return [Range(path, a, b) for a, b in zip(cuts, [*cuts[1:], size], strict=True)]


def lines_of(file, part: Range) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the lines that begin in a range; the last one may end behind it."""
    at = part.start
    if at:  # the line that runs into the range is the one's before
        file.seek(at - 1)
        at += len(file.readline()) - 1
    file.seek(at)
    while at < part.end:
        line = file.readline()
        if not line:
            return
        if text := line.rstrip(b"\r\n"):
            yield at, text
        at += len(line)


def messages_of(file, part: Range) -> Iterator[tuple[int, bytes]]:
    """Offset and body of the messages of a range. One that is cut off gives what there is of it, which can't be read as a request
    and is counted as such."""
    at = part.start
    file.seek(at)
    while at < part.end:
        head = file.read(4)
        body = file.read(int.from_bytes(head, "big")) if len(head) == 4 else head
        yield at, body
        at += 4 + int.from_bytes(head, "big")


class Reading:
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the source needs a path")
        self.path, self.framing = options["path"], options.get("framing", "lines")
        if self.framing not in ("lines", "lengths"):
            raise ValueError(f"no such framing: {self.framing}")
        self.width, self.settle = int(options.get("rangeBytes", RANGE_BYTES)), float(options.get("settleSeconds", 0))

    def ranges(self, files: list[tuple[int, str, int]]) -> list[Range]:
        return [part for _, path, size in files for part in ranges_of(path, size, self.framing, self.width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, own = opened(partition.path)
        each, kind = (lines_of, pa.string()) if self.framing == "lines" else (messages_of, pa.binary())
        keys, values, held = [], [], 0
        with io.BufferedReader(system.open_input_file(own), 1 << 20) as file:
            for at, body in each(file, partition):
                keys.append(f"{partition.path}:{at:015d}")
                values.append(body.decode("utf-8", "replace") if kind == pa.string() else body)
                held += len(body)
                if len(keys) == ROWS or held >= BATCH_BYTES:
                    yield self.batch(keys, values, kind)
                    keys, values, held = [], [], 0
        if keys:
            yield self.batch(keys, values, kind)

    @staticmethod
    def batch(keys: list[str], values: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, kind)], names=["Key", "value"])


class Reader(Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(files_of(self.path))


class StreamReader(Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The last file that is there: a batch takes all that came since the one before. It never goes back, though files may go."""
        before = time.time_ns() - int(self.settle * 1e9)
        there = [f[:2] for f in files_of(self.path) if f[0] <= before]
        self.given = max([*there, getattr(self, "given", (-1, ""))])
        return {"time": self.given[0], "path": self.given[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.ranges([f for f in files_of(self.path) if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are done: files stay where they are."""


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the source from now on."""
    spark.dataSource.register(OtlpRequests)
    return spark


class OtlpRequests(DataSource):
    """``Key`` and ``value`` (a text, or bytes with ``framing=lengths``) of each request."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"Key string, value {'binary' if self.options.get('framing') == 'lengths' else 'string'}"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
