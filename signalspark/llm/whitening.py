"""Embedding whitening by a tiled covariance.

The covariance of d dimensions is cut into tiles, one for each pair of blocks of dimensions. Vectors are gathered in
row-blocks; each row-block's matrix is cut into column blocks, which are shuffled by the row-block's number, multiplied
pair by pair, and the products are summed by tile, first in every task and then over the tasks. The tiles, d * d numbers
whatever the number of vectors, are put together on the driver, where the eigenvectors are taken; the vectors are then
projected where they stand.

Sums are of whole numbers and exact; vectors are centred as (n * x - S) / n, one rounding, before they are multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import written
from signalspark.llm.topk_search import usable

#: Scale and shift of the entries, components that are kept.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Dimensions of a block and bytes of a row-block's column block; numbers of all tiles that the driver takes at most.
TILE, BLOCK_BYTES, MOST = 32, 1 << 18, 1 << 27
#: Entries must stay under this in size, so that x is a whole number that a double holds.
LARGEST = float(1 << 42)

Rows = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: their places and the matrix of their vectors."""
    lists = batch.column(column)
    sizes = np.asarray(pc.list_value_length(lists))
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        own = lists.take(pa.array(at)) if len(at) < len(sizes) else lists
        yield at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of a vector: how many there are, and the exact sum of each of their entries (whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch, 0):
                # halves of 32 bits, so that no sum of a batch runs over
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                n, own = found.get(x.shape[1], (0, [0] * x.shape[1]))
                found[x.shape[1]] = n + len(x), [o + (h << 32) + s for o, h, s in zip(own, high.tolist(), low.tolist(), strict=True)]
        rows = [{"d": d, "n": n, "sums": [str(s) for s in own]} for d, (n, own) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    parts = vectors.select("x").mapInArrow(run, "d int, n long, sums array<string>")
    counts = {r["d"]: r["n"] for r in parts.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    out = {d: (n, [0] * d) for d, n in counts.items()}
    entries = parts.select("d", F.posexplode("sums").alias("i", "s")).groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in entries.collect():  # as many rows as dimensions
        out[r["d"]][1][r["i"]] = int(r["s"])
    return out


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding."""
    if len(x) and n * float(np.abs(x).max(initial=1)) + float(np.abs(total.astype(float)).max(initial=0)) < 2**62:
        return (n * x - total.astype(np.int64)) / n
    return ((n * x.astype(object) - total) / n).astype(float)


def covariances(vectors: DataFrame, column: str, centre: Rows, n: dict[int, int], tile: int = TILE) -> dict[int, np.ndarray]:
    """For each length the covariance (divisor n) of the vectors in ``column``, whose rows ``centre`` centres."""

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for _, x in matrices(batch, 0):
                d = x.shape[1]
                step = max(1, BLOCK_BYTES // (8 * min(d, tile) or 1))
                for at in range(0, len(x), step):
                    rows = centre(x[at : at + step])
                    blocks = [np.ascontiguousarray(rows[:, i : i + tile]).tobytes() for i in range(0, d, tile)]
                    k = len(blocks)
                    yield pa.RecordBatch.from_arrays([pa.array([task] * k), pa.array([count] * k), pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([len(rows)] * k, pa.int32()), pa.array(blocks)], names=["task", "row_block", "d", "block", "height", "numbers"])
                    count += 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int, int], np.ndarray] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for d, block, height, numbers in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                held = held if block else []  # a row-block's column blocks stand in order
                held.append(np.frombuffer(numbers).reshape(height, -1))
                for i, left in enumerate(held):
                    tiles[d, i, block] = tiles.get((d, i, block), 0.0) + left.T @ held[-1]
        yield as_rows(tiles)

    def as_rows(tiles: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
        keys = sorted(tiles)
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([tiles[k].tobytes() for k in keys], pa.binary())], names=["d", "i", "j", "numbers"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, numbers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tiles[tuple(key)] = tiles.get(tuple(key), 0.0) + np.frombuffer(numbers)
        yield as_rows(tiles)

    shape = "task long, row_block long, d int, block int, height int, numbers binary"
    blocks = vectors.select(column).mapInArrow(column_blocks, shape)
    by_row_block = blocks.repartition("task", "row_block").sortWithinPartitions("task", "row_block", "block")
    partial = by_row_block.mapInArrow(products, "d int, i int, j int, numbers binary")
    out = {d: np.zeros((d, d)) for d in n}
    for r in partial.repartition("d", "i", "j").sortWithinPartitions("d", "i", "j", F.hash("numbers")).mapInArrow(summed, "d int, i int, j int, numbers binary").collect():
        d, low, left = r["d"], r["i"] * tile, r["j"] * tile
        part = np.frombuffer(r["numbers"]).reshape(min(tile, d - low), -1) / n[d]
        out[d][low : low + part.shape[0], left : left + part.shape[1]] = part
        out[d][left : left + part.shape[1], low : low + part.shape[0]] = part.T
    return out


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The first eigenvalues, falling, their unit eigenvectors (columns), and the trace. Eigenvalues that are zero but for
    rounding are 0."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most].copy(), vectors[:, ::-1][:, :most]
    values[values <= len(covariance) * np.finfo(float).eps * values.max(initial=0.0)] = 0.0
    return values, vectors, float(np.trace(covariance))


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n * x - S) ** 2, exact; None where that doesn't fit a long."""
    far = n * x.astype(float) - total.astype(float)
    if (far * far).sum(axis=1).max(initial=0.0) < 2**61 and n * np.abs(x).max(initial=1).astype(float) < 2**62:
        far = n * x - total.astype(np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total.tolist(), strict=True)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, tile: int = TILE) -> DataFrame:
    """For each vector and each of its first ``most`` components: the id, ``component`` (from 1, by falling eigenvalue), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``, over the whole numbers x = floor(scale * c) + shift.

    ``deviation`` is the sum over dimensions of (n * x - S) ** 2, exact (null if a long can't hold it), ``whitened`` the centred
    x projected on the component, over the root of its eigenvalue, ``explained`` the eigenvalue over the trace, and
    ``identity_error`` the largest absolute entry of the covariance of ``whitened``, measured over all rows, less the identity.

    Vectors that are null or hold a null or a component that isn't finite take no part, nor those with an entry of 2**42 or
    more in size. Vectors of each length are whitened by themselves. A component whose eigenvalue is 0 (equal vectors, fewer
    vectors than components) has a null ``whitened``, and a null ``explained`` where the trace is 0 too; it counts in no
    ``identity_error`` (null if there is no other). Vectors with fewer dimensions have as many components; empty ones none.
    Null ids stay null; repeated rows count and stay; an empty table gives an empty result; other columns are not read.
    """
    fine = usable(F.col(vector_column)) & F.forall(vector_column, lambda c: F.abs(c.cast("double")) < LARGEST) & (F.size(vector_column) > 0)
    vectors = df.where(fine).select(F.col(id_column), whole_numbers(F.col(vector_column), scale, shift).alias("x"))
    totals = {d: (n, np.array(s, object)) for d, (n, s) in sums(vectors).items()}
    if sum(d * d for d in totals) > MOST:
        raise ValueError("the vectors have too many dimensions for one covariance on the driver")
    counts = {d: n for d, (n, _) in totals.items()}
    sums_sent = df.sparkSession.sparkContext.broadcast(totals)
    models = {d: components(v, most) for d, v in covariances(vectors, "x", lambda x: centred(x, *sums_sent.value[x.shape[1]]), counts, tile).items()}
    sent = df.sparkSession.sparkContext.broadcast({d: (*totals[d], models[d][0], models[d][1]) for d in totals})

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, 1):
                n, total, values, axes = sent.value[x.shape[1]]
                held = values > 0
                white = centred(x, n, total) @ axes[:, held] / np.sqrt(values[held])
                k = int(held.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(white.reshape(-1)))
                d = pa.array(np.full(len(x), x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), d, pa.array(deviations(x, n, total), pa.int64()), lists], names=[id_column, "d", "deviation", "white"])

    kind = df.schema[id_column].dataType.simpleString()
    white = written(vectors.mapInArrow(project, f"`{id_column}` {kind}, d int, deviation long, white array<double>"), "whitened")
    shown = [(d, c + 1, counts[d], float(e / trace) if trace > 0 else None, error) for d, error in errors(white, models, counts).items() for values, _, trace in [models[d]] for c, e in enumerate(values)]
    rows = df.sparkSession.createDataFrame(shown, "d int, component int, n long, explained double, identity_error double")
    whitened = F.get("white", F.col("component") - 1)
    return white.join(rows, "d").select(id_column, "component", "n", "deviation", whitened.alias("whitened"), "explained", "identity_error")


def errors(white: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray, float]], counts: dict[int, int]) -> dict[int, float | None]:
    """For each length of the vectors the largest absolute entry of the covariance of what they became, less the identity."""
    out: dict[int, float | None] = {}
    for d, (values, _, _) in models.items():
        k = int((values > 0).sum())
        if not k:
            out[d] = None
            continue
        own = white.where(F.col("d") == d)
        middle = np.array(own.agg(*[F.avg(F.get("white", F.lit(i))) for i in range(k)]).first())
        spread = covariances(own, "white", lambda x, middle=middle: x - middle, {k: counts[d]})[k]
        out[d] = float(np.abs(spread - np.eye(k)).max())
    return out
