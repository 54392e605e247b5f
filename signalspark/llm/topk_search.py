"""Exact top-k search by inner product.

Vectors are rotated by the right singular vectors of a sample, so that the first coordinates hold most of their
length, and taken in order of descending length. For each query a candidate is out as soon as an upper bound
of its score lies below the k-th best score known: first the product of the two lengths, then, step by step, the sum over
more and more of the first coordinates plus the product of the lengths of the rest (Cauchy-Schwarz). What is left is scored
exactly on the integer components.

Queries and candidates meet block by block, each pair of blocks in one task. Candidates are dealt by ranges of
length and the longest are searched first; from the scores found there follows how long a candidate must be for each
query. Queries are dealt by ranges of that need, so that pairs of ranges, and rows of them, that length alone rules
out are dropped before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalspark.llm.shared import written

#: Scale of the components, neighbours asked for.
SCALE, NEIGHBOURS = 256, 5
#: Rows of a block of candidates and of queries, candidates scored at once, rows of the sample of the rotation.
CANDIDATES, QUERIES, CHUNK, SAMPLE = 8192, 2048, 1024, 10_000
#: Most ranges of candidates' lengths and of queries' needs; fewer where a range would hold less than a block. A range of
#: more rows than a block (equal lengths, say) is dealt to blocks by a hash of the id, so these bound nothing else.
RANGES, NEEDS = 64, 32
#: Share of the ranges that is searched first.
HEAD = 1 / 8
#: Eighths of the coordinates at which the steps of partial sums end.
STEPS = (2, 4, 6, 7)

FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False)))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def rotation(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Right singular vectors of up to ``sample`` vectors, chosen by a hash of their ids, of the most frequent
    dimension among them. The rest of the search holds for any rotation; the sample only makes it fast."""
    rows = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(sample).collect()]
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r) for r in rows]
    d = max(set(sizes), key=lambda x: (sizes.count(x), x))
    matrix = np.array([r for r in rows if len(r) == d], float).reshape(-1, d)
    return np.linalg.svd(matrix.T @ matrix)[0]


def matrix_of(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (by its number), ties by id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], scores[keep]


def full_scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs, given by their rows in ``q`` and in ``c``."""
    some = [np.einsum("ij,ij->i", q[rows[i : i + 65536]], c[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)]
    return np.concatenate(some) if some else np.zeros(0)


def bounded(rq: np.ndarray, rc: np.ndarray, q_rest: list[np.ndarray], c_rest: list[np.ndarray], ends: list[int], floor: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over more and more of the first coordinates, in steps that end at ``ends``, each only for the pairs whose bound, the sum
    and the product of the lengths of the rest, reaches ``floor`` still: the sums, the last bounds, and which pairs are left."""
    sums, low = np.zeros(live.shape), 0
    bounds = sums
    for end, own, other in zip(ends, q_rest, c_rest, strict=True):
        if 4 * np.count_nonzero(live) > live.size:
            sums += rq[:, low:end] @ rc[:, low:end].T
            bounds = sums + own[:, None] * other
            live &= bounds >= floor[:, None]
        else:
            rows, columns = np.nonzero(live)
            sums[rows, columns] += full_scores(rq[:, low:end], rc[:, low:end], rows, columns)
            reach = sums[rows, columns] + own[rows] * other[columns]
            bounds = np.full(live.shape, -np.inf)
            bounds[rows, columns] = reach
            out = reach < floor[rows]
            live[rows[out], columns[out]] = False
        low = end
    return sums, bounds, live


def search_block(queries: pa.Table, candidates: pa.Table, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates for each query of a block, as numbers of queries, ids and scores, and how many pairs
    were scored in full. A query's ``least`` is a score that k other candidates are known to reach. In each chunk of candidates the
    k with the largest sums are scored first, as the bounds of the others are then held against better scores."""
    q, c = matrix_of(queries, "query_v"), matrix_of(candidates, "v")
    q_ids, c_ids = queries.column("query_id").to_numpy(), candidates.column("id").to_numpy()
    least = queries.column("least").to_numpy(zero_copy_only=False).astype(float)
    least[np.isnan(least)] = -np.inf
    d = q.shape[1]
    lengths = np.sqrt((c * c).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    c, c_ids, lengths = c[order], c_ids[order], lengths[order]
    turned = turn.shape[0] == d
    rq, rc = (q @ turn, c @ turn) if turned else (q, c)
    ends = sorted({max(1, d * eighths // 8) for eighths in STEPS}) if d else []
    q_rest, c_rest = ([np.sqrt((x[:, end:] ** 2).sum(axis=1)) for end in ends] for x in (rq, rc))
    q_length = np.sqrt((q * q).sum(axis=1))
    slack = 1e-6 * (1.0 + q_length * (lengths[0] if len(lengths) else 0.0))  # more than rounding can be off
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    scored = 0

    def score(rows: np.ndarray, columns: np.ndarray) -> None:
        nonlocal held, scored
        scored += len(rows)
        scores = full_scores(q, c, rows, columns)
        keep = scores >= least[rows]
        held = best(np.concatenate([held[0], rows[keep]]), np.concatenate([held[1], c_ids[columns[keep]]]), np.concatenate([held[2], scores[keep]]), k)
        last = np.flatnonzero(np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) == k - 1)
        least[held[0][last]] = np.maximum(least[held[0][last]], held[2][last])

    for at in range(0, len(c), CHUNK):
        live = np.flatnonzero(q_length * lengths[at] + slack >= least)
        if not len(live):
            break
        own = slice(at, at + CHUNK)
        others = q_ids[live, None] != c_ids[None, own]
        sums, bounds, left = bounded(rq[live], rc[own], [x[live] for x in q_rest], [x[own] for x in c_rest], ends, least[live] - slack[live], others)
        if left.shape[1] > k:
            promising = np.argpartition(np.where(left, -sums, np.inf), k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(live)), k)
            first = left[rows, promising.reshape(-1)]
            rows, columns = rows[first], promising.reshape(-1)[first]
            left[rows, columns] = False
            score(live[rows], at + columns)
            left &= bounds >= (least[live] - slack[live])[:, None]
        rows, columns = np.nonzero(left)
        if len(rows):
            score(live[rows], at + columns)
    return held[0], held[1], held[2], scored


def cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Values that cut ``column`` into so many ranges of about as many rows each; fewer where values are equal."""
    return sorted(set(df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []


def range_of(value: Column, at: list[float]) -> Column:
    """Number of a value's range; 0 has the largest values."""
    return F.size(F.filter(F.array(*map(F.lit, at)).cast("array<double>"), lambda x: x > value))


def dealt(queries: DataFrame, candidates: DataFrame, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``queries`` (id, v, d, length, need, least) and of ``candidates`` (id, v, d, length, range) by pair of blocks: one
    for each pair that they take part in. A candidate shorter than the least need of a range of queries isn't sent
    to it, nor is a query sent to candidates that are all shorter than it needs."""
    asked = queries.withColumn("needs", range_of(F.col("need"), cuts(queries, "need", min(NEEDS, -(-n_queries // QUERIES)))))
    blocks = lambda size: F.ceil(F.count("*") / size).cast("int")
    q_ranges = asked.groupBy("d", "needs").agg(blocks(QUERIES).alias("q_blocks"), F.min("need").alias("least_need"))
    c_ranges = candidates.groupBy("d", "range").agg(blocks(CANDIDATES).alias("c_blocks"), F.max("length").alias("longest"))
    # at most RANGES * NEEDS rows for each dimension; being written, their size is known to Spark
    pairs = written(q_ranges.join(c_ranges, "d").where("longest >= least_need"), "pairs-of-ranges")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asked.join(pairs, ["d", "needs"]).where("longest >= need")
    right = candidates.join(pairs, ["d", "range"]).where("length >= least_need")
    return (
        left.select(F.col("id").alias("query_id"), F.col("v").alias("query_v"), "least", "d", "needs", "range", own("q_blocks").alias("qb"), each("c_blocks").alias("cb")),
        right.select("id", "v", "d", "needs", "range", each("q_blocks").alias("qb"), own("c_blocks").alias("cb")),
    )


def searched(queries: DataFrame, candidates: DataFrame, turn: np.ndarray, k: int, n_queries: int) -> DataFrame:
    """Each pair of a block of queries and a block of candidates of one dimension in one task."""
    sent = queries.sparkSession.sparkContext.broadcast(turn)
    left, right = dealt(queries, candidates, n_queries)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        rows, ids, scores, _ = search_block(q, c, sent.value, k)
        return pa.table({"query_id": q.column("query_id").to_numpy()[rows], "vec_id": ids, "score": scores.astype(np.int64)})

    by = ("d", "needs", "range", "qb", "cb")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, FOUND)


def top_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best candidates of each row with
    ``is_query``; candidates are all rows with another id. A score is the inner product of the integers
    floor(scale * x); equal scores go to the smaller id. A query with fewer candidates gets all of them.

    Vectors that are null or hold a null or a component that isn't finite take no part, nor do null ids; only
    vectors of one dimension are compared. A repeated candidate row counts as another candidate; a repeated
    query is asked once (its smallest vector). An empty table gives an empty result; other columns are not
    read. Scores are exact while they stay under 2**53.

    Within a range of lengths blocks are dealt by a hash of the id, so equal vectors, however many, spread evenly; the
    results of a query that meet are k for each block.
    """
    usable_rows = df.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    whole = usable_rows.select(F.col(id_column).cast("long").alias("id"), integers(F.col(vector_column), scale).alias("v"), is_query.alias("q"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors = written(whole.withColumns({"d": F.size("v"), "length": length}), "vectors")
    turn = rotation(vectors)
    asked = vectors.where("q").groupBy("id").agg(F.min_by(F.struct("v", "d", "length"), "v").alias("best")).select("id", "best.*")
    n, n_asked = vectors.count(), asked.count()
    if not n_asked:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    at = cuts(vectors, "length", min(RANGES, max(round(1 / HEAD), -(-n // CANDIDATES))))
    ranged = vectors.select("id", "v", "d", "length", range_of(F.col("length"), at).alias("range"))
    first = max(1, int((len(at) + 1) * HEAD))
    open_ = asked.select("*", F.lit(0.0).alias("need"), F.lit(None).cast("double").alias("least"))
    head = written(top_of(searched(open_, ranged.where(F.col("range") < first), turn, k, n_asked), k), "head")
    least = head.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    # a shorter candidate's score is below the k-th known one: |q| |c| < least, less what rounding can be off
    need = F.when((F.col("least") > 0) & (F.col("length") > 0), F.col("least") / F.col("length") * (1 - 1e-9)).otherwise(0.0)
    known = written(asked.join(least, "id", "left").withColumn("need", need), "needs")
    rest = searched(known, ranged.where(F.col("range") >= first), turn, k, n_asked)
    return top_of(head.select("query_id", "vec_id", "score").union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
