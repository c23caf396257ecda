"""Whitening against a dense eigendecomposition; odd tables."""

import numpy as np
import pytest

from emberlane.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors: list[list[float]], most: int = 16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    apart = n * x - sums
    return n, (apart**2).sum(axis=1), (apart / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(spark, rows):
    """rows: (vec_id, vector) that stay."""
    got = {(r.vec_id, r.component): r for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    vectors = [[float(np.float32(c)) for c in v] for _, v in rows]
    n, deviation, whitened, explained = dense(vectors)
    assert len(got) == len(rows) * whitened.shape[1]
    made = np.array([[got[i, c + 1].whitened for c in range(whitened.shape[1])] for i, _ in rows])
    signs = np.sign((made * whitened).sum(axis=0))
    np.testing.assert_allclose(made * signs, whitened, rtol=1e-8, atol=1e-8)
    for at, (i, _) in enumerate(rows):
        for c in range(whitened.shape[1]):
            row = got[i, c + 1]
            assert (row.n, row.deviation) == (n, deviation[at])
            assert row.explained == pytest.approx(explained[c], rel=1e-9)
            assert row.identity_error < 1e-9


def random_rows(n: int, dim: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) * np.linspace(3, 0.2, dim)
    return [(i, [float(c) for c in rng.standard_normal(dim) @ mix]) for i in range(n)]


def test_equals_a_dense_decomposition(spark):
    check(spark, random_rows(300, 24))


def test_copies_count_once_in_the_fit_and_keep_their_rows(spark):
    rows = random_rows(60, 8)
    check(spark, rows + [(1000 + i, rows[0][1]) for i in range(200)])


def test_fewer_vectors_than_dimensions_and_constant_dimensions(spark):
    check(spark, [(i, v + [0.5, -2.0]) for i, v in random_rows(7, 12)])


def test_repeated_eigenvalues_are_found(spark):
    # a cross polytope: all six variances are equal, so only the span is determined
    rows = [(2 * d + s, [float(4 * (1 - 2 * s)) * (k == d) for k in range(6)]) for d in range(6) for s in range(2)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 12 * 6 and all(r.identity_error < 1e-9 for r in got)
    assert all(r.explained == pytest.approx(1 / 6, rel=1e-9) for r in got)


def test_odd_rows_go_and_extra_columns_are_ignored(spark):
    rows = random_rows(40, 5)
    inf, nan = float("inf"), float("nan")
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [nan] * 5), (104, [0.0, inf, 0.0, 0.0, 0.0]), (105, [1e30, 0.0, 0.0, 0.0, 0.0]), (106, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd + [(None, rows[0][1]), (3, rows[3][1])], SCHEMA)
    out = whitening.whitened(table.selectExpr("*", "map('a', 1) as n", "1 as component", "2 as `a.b`", "embedding as whitened"))
    kept = [r.vec_id for r in out.where("component = 1").collect()]
    assert sorted(kept, key=lambda i: -1 if i is None else i) == sorted([i for i, _ in rows] + [None, 3], key=lambda i: -1 if i is None else i)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_no_component(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits_is_an_error(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.5, 2.0])]
    with pytest.raises(Exception, match="leave 64 bits|beyond"):
        whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        raise AssertionError("beyond")


def test_wide_entries(spark):
    check(spark, [(i, [float(c) * 2.0**18 for c in v]) for i, v in random_rows(3, 4)])
