"""Whitened vectors against numpy over all rows, and the corrected eigenvectors on hard spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], SCHEMA).repartition(3)


def brute(vectors):
    x = np.floor(256.0 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ turn / np.sqrt(values), values / values.sum()


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(400, 12)) * np.linspace(0.1, 1, 12)).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[7]) for i in range(150)] + [(7, vectors[7])]
    n, deviation, white, explained = brute([v for _, v in rows])
    assert n == 400
    bad = [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11)]
    got = whitening.whitened(frame(spark, rows + bad)).collect()
    assert len(got) == 4 * len(rows)
    signs = {}
    by_key = {}
    for k, (key, _) in enumerate(rows):
        by_key.setdefault(key, k)
    for r in got:
        k = by_key[r.vec_id]
        sign = signs.setdefault(r.component, np.sign(r.whitened * white[k, r.component - 1]))
        assert r.n == n and r.deviation == deviation[k]
        assert r.whitened == pytest.approx(sign * white[k, r.component - 1], rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.identity_error < 1e-9


def test_spaces_without_variance(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 3.0, 3.0]), (5, []), (None, [7.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(frame(spark, rows)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), *((k, c) for k in (3, 4) for c in (1, 2, 3)), (None, 1)}
    assert got[1, 1].whitened is None and got[1, 1].explained is None and got[1, 1].n == 1 and got[1, 1].deviation == 0
    assert abs(got[3, 1].whitened) == pytest.approx(1) and got[3, 1].whitened == -got[4, 1].whitened
    assert got[3, 2].whitened is None and got[3, 1].explained == 1 and got[3, 1].n == 2 and got[3, 1].deviation == 256**2
    assert whitening.whitened(frame(spark, [])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 1.0]), (3, [2.0**50, 1.0])]
    x = [[int(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {k: sum((3 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for (k, _), row in zip(rows, x, strict=True)}
    got = {r.vec_id: r.deviation for r in whitening.whitened(frame(spark, rows)).where("component = 1").collect()}
    assert got == {k: v if v < 2**63 else None for k, v in want.items()}


def test_names_of_other_columns_do_not_matter(spark):
    rows = spark.range(9).select(F.col("id").alias("x"), F.array(F.rand(3), F.rand(4)).alias("i"), F.lit(1).alias("dim"))
    assert whitening.whitened(rows, "x", "i").where("whitened is not null").count() == 18


@pytest.mark.parametrize("gap", [1e-3, 1e-6, 1e-8, 1e-10, 0.0])
def test_clustered_eigenvalues(gap):
    """Six eigenvalues ``gap`` apart among others: each vector is right to what the matrix itself determines."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = np.concatenate([np.linspace(5, 2, 20), 1 + gap * np.arange(6), np.linspace(0.9, 0.1, 14)])
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, x = whitening.eigen(matrix)
    assert np.allclose(got, np.sort(values)[::-1], rtol=0, atol=1e-14)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    assert np.abs(matrix @ x - x * got).max() < 2e-15


def test_single_precision_alone_would_not_do():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(64, 200))
    matrix = a @ a.T / 200
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.float64)
    values, x = whitening.eigen(matrix)
    assert np.abs(rough.T @ rough - np.eye(64)).max() > 1e-8
    assert np.abs(matrix @ x - x * values).max() < 1e-14
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=1e-14)
