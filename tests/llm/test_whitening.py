import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from signalspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, white string"


def by_hand(vectors, most=8):
    """Eigenvalues, whole-number deviations and absolute whitened values, straight from the definition."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    centred = ((n * x - total) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return [sum(int(a) ** 2 for a in row) for row in n * x - total], np.abs(centred @ axes / np.sqrt(values)), values / np.trace(centred.T @ centred / n)


def result(df):
    return {(r["vec_id"], r["component"]): r for r in df.collect()}


@pytest.mark.parametrize("tile", [5, 32, 64])
def test_against_the_definition(spark, tile):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    rows = [r for r in pq.read_table(path).to_pylist() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    ids = [r["vec_id"] for r in rows]
    far, white, explained = by_hand([r["embedding"] for r in rows])
    got = whitening.whiten(spark.read.parquet(path), tile=tile).collect()
    assert len(got) == 8 * len(rows)
    assert sorted((g["vec_id"], g["component"]) for g in got) == sorted((i, c) for i in ids for c in range(1, 9))
    expected = {(i, c + 1): (far[k], white[k, c]) for k, i in enumerate(ids) for c in range(8) if ids.count(i) == 1}
    for g in got:
        assert g["n"] == len(rows) and g["identity_error"] < 1e-9
        assert g["explained"] == pytest.approx(explained[g["component"] - 1], rel=1e-9)
        if (g["vec_id"], g["component"]) in expected:
            deviation, value = expected[g["vec_id"], g["component"]]
            assert g["deviation"] == deviation and abs(g["whitened"]) == pytest.approx(value, rel=1e-8, abs=1e-8)


def test_covariance_does_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=7) * [9, 5, 3, 1, 1, 1, 0.1]).tolist()) for i in range(300)]
    one, many = (spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(k) for k in (1, 9))
    a, b = (result(whitening.whiten(df, tile=t)) for df, t in ((one, 32), (many, 2)))
    assert a.keys() == b.keys() and len(a) == 300 * 7
    for k in a:
        assert abs(a[k]["whitened"]) == pytest.approx(abs(b[k]["whitened"]), rel=1e-9, abs=1e-9)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 5, "w"), (2, [3.0, float("nan")], 5, None), (3, None, 5, None), (4, [None, 1.0], 5, None), (5, [float("inf"), 0.0], 5, None), (6, [], 5, None), (7, [1e30, 0.0], 5, None)]
    rows += [(8, [2.0, 2.0], 5, None), (8, [2.0, 2.0], 5, None), (None, [3.0, 2.0], 5, None), (9, [1.0, 2.0, 3.0], 5, None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    two = [r for r in got if r["vec_id"] != 9]
    assert sorted((r["vec_id"] or 0, r["component"]) for r in two) == [(0, 1), (0, 2), (1, 1), (1, 2), (8, 1), (8, 1), (8, 2), (8, 2)]
    assert {r["n"] for r in two} == {4}
    first = {r["vec_id"]: r for r in two if r["component"] == 1}
    assert first[8]["whitened"] == pytest.approx(0.0, abs=1e-12) and abs(first[1]["whitened"]) == pytest.approx(math.sqrt(2))
    assert first[1]["deviation"] == (4 * 1024) ** 2 and first[1]["explained"] == pytest.approx(1.0)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in two if r["component"] == 2)  # the second entry is the same in all
    alone = [r for r in got if r["vec_id"] == 9]
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)] * 3


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    assert whitening.deviations(np.array([[1 << 50], [1 << 10]]), 2, np.array([(1 << 50) + (1 << 10)], object)) == [None, None]
    assert whitening.deviations(np.array([[1 << 20], [1 << 10]]), 2, np.array([(1 << 20) + (1 << 10)], object)) == [((1 << 20) - (1 << 10)) ** 2] * 2
