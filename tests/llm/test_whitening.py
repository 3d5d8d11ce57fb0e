"""Whitening against numpy's eigenvectors and exact whole-number arithmetic."""

import math

import numpy as np
import pytest

from weighyard.llm import whitening

TYPES = "vec_id long, embedding array<float>"


def expected(vectors, components=4):
    """Grid vectors, eigenvalues, whitened values and deviations of the usable vectors, in order."""
    x = np.floor(256 * np.array(vectors, np.float64))
    fit = np.unique(x, axis=0)
    values, directions = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    sums = [int(s) for s in fit.sum(axis=0)]
    deviations = [sum((len(fit) * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return values, (x - fit.mean(axis=0)) @ directions / np.sqrt(values), deviations, np.trace(np.cov(fit.T, bias=True))


def check(found, ids, vectors):
    values, whitened, deviations, trace = expected(vectors)
    got = sorted(found, key=lambda r: (r.vec_id, r.component))
    order = np.argsort(ids, kind="stable")
    k = len(values)
    assert [r.component for r in got] == list(range(1, k + 1)) * len(ids)
    mine = np.array([r.whitened for r in got]).reshape(-1, k)
    wanted = whitened[order]
    np.testing.assert_allclose(mine * np.sign((mine * wanted).sum(axis=0)), wanted, atol=1e-9)
    assert [int(r.deviation) for r in got[::k]] == [deviations[i] for i in order]
    np.testing.assert_allclose([r.explained for r in got[:k]], values / trace, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    check(whitening.whiten(df).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_close_eigenvalues_and_copies(spark, seed):
    rng = np.random.default_rng(seed)
    scales = np.array([2.0, 1.99, 1.9, 1.8, *np.linspace(1.75, 0.5, 44)])
    vectors = (rng.standard_normal((900, 48)) * scales).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(2000 + k, vectors[0].tolist()) for k in range(500)]
    unusable = [(9001, None), (9002, [math.nan] + [0.0] * 47), (9003, [None] + [0.0] * 47),
                (9004, [math.inf] + [0.0] * 47), (9005, [1.0]), (9006, [])]
    found = whitening.whiten(spark.createDataFrame(rows + unusable, TYPES)).collect()
    assert {r.n for r in found} == {900}
    check(found, [r[0] for r in rows], [r[1] for r in rows])


def test_few_dimensions_and_ranks(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0]), (3, [3.0, 6.0])]
    found = whitening.whiten(spark.createDataFrame(rows, TYPES)).collect()
    assert sorted(r.vec_id for r in found) == [1, 2, 3, 3]
    assert {r.component for r in found} == {1} and {r.n for r in found} == {3}
    assert abs(found[0].explained - 1) < 1e-12


def test_equal_eigenvalues_beyond_the_block(spark):
    rows = [(k, [1.0 if j == k else 0.0 for j in range(40)]) for k in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, TYPES)).collect()
    assert len(found) == 160 and max(r.identity_error for r in found) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_directions(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, TYPES))
    assert found.collect() == []
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact_and_extra_columns_are_ignored(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.standard_normal((30, 3)) * 2.0**34)
    rows = [(k, v.tolist(), 1.0, "x") for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, _x string")
    found = whitening.whiten(df).collect()
    x = [[int(e) * 256 for e in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    wanted = [sum((30 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert {r.vec_id: int(r.deviation) for r in found} == dict(enumerate(wanted))


def test_partial_sums_are_added_in_a_tree(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((200, 5))
    fit = whitening.on_grid(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)],
                                                  "vec_id long, e array<double>"), "e").select("_x").repartition(70)
    total = whitening._summed(fit, 70, lambda x: x.sum(axis=0).astype(float))
    np.testing.assert_array_equal(total, np.floor(256 * vectors).sum(axis=0))
