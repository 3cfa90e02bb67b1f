"""Whitening against a dense eigenvalue decomposition in small tables, and what the contract says of odd rows."""

import math

import numpy as np
import pytest

from shelfmark.llm import whitening
from tests.llm.helpers import table

ROWS = "vec_id long, embedding array<float>, label int, n string, x int, `a.b` string"


def vectors(spark, rows):
    return table(spark, [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "n", 2, "y") for i, v in rows], ROWS)


def plain(rows, most=16):
    """Dense: rows (vec_id, component) -> (n, deviation, |whitened|, explained)."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in fine}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x.items():
        exact = np.array(v, dtype=object) * n - sums
        w = np.abs((exact / n).astype(float) @ u[:, :most] / np.sqrt(e[:most]))
        for k in range(min(most, len(e))):
            out[i, k + 1] = (n, int((exact**2).sum()), w[k], e[k] / e.sum())
    return out


def same(got, expected):
    assert {(r.vec_id, r.component) for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        n, deviation, w, share = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained / share - 1) < 1e-9 and abs(abs(r.whitened) - w) < 1e-7 * max(1, w)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("size", [3, 16, 40])
def test_equal_the_dense_version(spark, size):
    rng = np.random.default_rng(size)
    made = rng.normal(size=(300, size)) * np.linspace(3, 0.5, size) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(400 + i, made[7].tolist()) for i in range(100)]
    odd = [(600, None), (601, []), (602, [1.0] * (size - 1) + [None]), (603, [float("nan")] * size), (604, [float("inf")] * size)]
    got = whitening.whitened(vectors(spark, rows + odd)).collect()
    same(got, plain(rows))


def test_residuals_reach_double_precision_for_close_and_equal_values():
    rng = np.random.default_rng(2)
    for values in (
        np.concatenate([np.full(5, 3.0), np.linspace(2.9999, 2.9, 30), np.zeros(65)]),
        1 / np.arange(1, 301) ** 0.1,
        np.concatenate([[1e6], np.geomspace(1, 1e-9, 99)]),
        np.zeros(20),
    ):
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        v = (q * values) @ q.T
        asked = []
        found, vectors_ = whitening.leading(lambda x, v=v, asked=asked: asked.append(x.shape[1]) or v @ x, len(values))
        assert np.allclose(found, np.sort(values)[::-1][:16], atol=1e-12 * max(1, values.max()))
        assert np.linalg.norm(v @ vectors_ - vectors_ * found, axis=0).max() <= 1e-13 * max(1, values.max())
        assert np.allclose(vectors_.T @ vectors_, np.eye(16), atol=1e-12) and len(asked) < 150


def test_minres_solves_the_projected_equations():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 12))
    v = v @ v.T
    q = np.linalg.qr(rng.normal(size=(12, 2)))[0]
    project = lambda x: x - q @ (q.T @ x)
    right, theta = rng.normal(size=(12, 3)), np.array([1.0, 5.0, 40.0])
    t = whitening.minres(lambda x: v @ x, theta, project, right, steps=12, enough=1e-14)
    assert np.allclose(project(v @ project(t) - t * theta), project(right), atol=1e-8) and np.allclose(q.T @ t, 0)


def test_few_vectors_and_empty_tables(spark):
    one = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]
    assert whitening.whitened(vectors(spark, one)).collect() == []
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).columns[0] == "vec_id"
    got = whitening.whitened(vectors(spark, [*one, (3, [2.0, 2.0]), (4, [9.0]), (3, [2.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got) == [
        ("1", 1, 2, 64 * 64, 1.0, 1.0), ("2", 1, 2, 64 * 64, 1.0, 1.0), ("3", 1, 2, 64 * 64, 1.0, 1.0),
        ("3", 1, 2, 64 * 64, 1.0, 1.0), ("None", 1, 2, 64 * 64, 1.0, 1.0),
    ]


def test_very_large_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.5, 1.0])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert len(got) >= 3 and all(math.isfinite(r.whitened) for r in got)


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same(whitening.whitened(df).collect(), plain(rows))
