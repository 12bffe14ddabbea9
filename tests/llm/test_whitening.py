import math

import numpy as np
import pytest

from framecv.llm.queries import QUERIES
from framecv.llm.whitening import _exact_deviations, _squares, fit_whitening, integer_vectors, whiten

SCHEMA = "vec_id bigint, embedding array<float>, n string, x int"


def by_hand(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    c = (x.astype(object) * n - np.array(sums, object))
    deviation = [sum(int(d) ** 2 for d in row) for row in c]
    c = (c / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, c @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def held_against(rows, want, ids):
    n, deviation, white, explained = want
    table = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(table) == len(ids) * white.shape[1]
    got = np.array([[table[i, c + 1].whitened for c in range(white.shape[1])] for i in ids])
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert [int(table[i, 1].deviation) for i in ids] == deviation and {r.n for r in rows} == {n}
    assert [table[ids[0], c + 1].explained for c in range(white.shape[1])] == pytest.approx(explained.tolist(), rel=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_query_against_a_full_decomposition(spark):
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    out = QUERIES["op11_whitening"](spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    held_against(out.collect(), by_hand([r.embedding for r in raw]), [r.vec_id for r in raw])


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = [(i, v.tolist(), "a", 1) for i, v in enumerate(rng.normal(size=(60, 9)) * np.arange(1, 10))]
    bad = [(100, None, "a", 1), (101, [], "a", 1), (102, [1.0] * 8 + [None], "a", 1), (103, [math.nan] + [0.0] * 8, None, None),
           (104, [math.inf] + [0.0] * 8, "b", 2), (105, [1.0, 2.0], "short", 3), (106, [1e30] + [0.0] * 8, "large", 4)]
    out = whiten(spark.createDataFrame(good + bad, SCHEMA))
    held_against(out.collect(), by_hand([np.float32(v).tolist() for _, v, _, _ in good]), list(range(60)))


def test_few_dimensions_repeated_and_null_ids(spark):
    vectors = [[0.1, 0.9, -0.4], [0.5, 0.2, 0.1], [0.5, 0.2, 0.1], [-0.7, 0.3, 0.9], [0.0, 0.0, 0.0]]
    rows = whiten(spark.createDataFrame([(i, v, "a", 1) for i, v in zip([1, 2, 2, None, 4], vectors)], SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.component) for r in rows) == sorted((i, c) for i in (1, 2, 2, -1, 4) for c in (1, 2, 3))
    assert {r.n for r in rows} == {5} and rows[0].identity_error < 1e-9


def test_rows_without_variance(spark):
    for rows in ([(1, [0.5, 0.25], "a", 1)], [(i, [0.5, 0.25], "a", 1) for i in range(4)]):
        got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == 2 * len(rows) and {(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in got} == {(0.0, 0.0, 0, 0.0)}
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "a", 1) for i in range(9)], SCHEMA)).collect()
    assert {r.component: r.explained for r in line} == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0}, abs=1e-12) and line[0].identity_error < 1e-9


def test_empty(spark):
    for rows in ([], [(1, None, "a", 1)]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_filter_finds_a_clustered_spectrum(spark):
    """40 dimensions, more than the block has columns; the eighth and ninth eigenvalue are 1 percent apart."""
    rng = np.random.default_rng(7)
    spread = np.linspace(1.2, 0.8, 40)
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    vectors = (rng.normal(size=(900, 40)) * spread) @ basis
    rows = integer_vectors(spark.createDataFrame([(i, v.tolist(), "a", 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, n string, x int"))
    fit = fit_whitening(rows, spare=4)
    c = np.floor(1024 * vectors) - np.floor(1024 * vectors).mean(axis=0)
    want = np.linalg.eigvalsh(c.T @ c / 900)[::-1]
    assert fit.values == pytest.approx(want[:8], rel=1e-11) and fit.passes > 13 and fit.trace == pytest.approx(want.sum(), rel=1e-11)
    assert (fit.residuals < 1e-12 * want[0]).all()


def test_exact_squares():
    for most in (3, 1 << 30, (1 << 51) + 12_345):
        d = np.array([[most, -most, 1], [0, most - 1, -7]], np.int64)
        assert _squares(d) == [sum(int(v) ** 2 for v in row) for row in d.tolist()]
    x = np.array([[1 << 52, 5]], np.int64)
    assert _exact_deviations(x, 1 << 20, [3, 4], 1 << 52).tolist() == [[(1 << 72) - 3, (5 << 20) - 4]]
