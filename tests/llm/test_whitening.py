"""Whitening against exact sums and a double-precision solver."""

import numpy as np
import pytest

from sluiceway.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, x int, n int"


def brute(rows):
    """Whole numbers of the kept rows, sums, and eigenvalues of the distinct vectors' covariance."""
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.stack([v for _, v in kept])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.sum(axis=0) / len(fit)
    return [i for i, _ in kept], x, fit, centred.T @ centred / len(fit)


def made(rng, n, d):
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    return [(i, v) for i, v in enumerate(mixed.astype(np.float32).tolist())]


@pytest.mark.parametrize("n,d", [(300, 20), (40, 64), (500, 3)])
def test_whitened_rows(spark, n, d):
    rng = np.random.default_rng(n)
    rows = made(rng, n, d)
    rows += [(i + n, rows[7][1]) for i in range(n // 2)]  # a third of all rows alike
    rows += [(-1, None), (-2, [None] * d), (-3, [float("nan")] * d), (-4, [float("-inf")] + [0.0] * (d - 1)), (7, rows[3][1]), (None, rows[4][1])]
    rows += [(-5, [1.0] * (d + 1)), (-6, [])]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA)
    got = whitening.whiten(df.repartition(7)).toPandas()
    ids, x, fit, v = brute([r for r in rows if r[1] is None or len(r[1]) == d])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, d, len(fit) - 1)
    assert len(got) == len(ids) * k and set(got.n) == {len(fit)}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for c, part in got.groupby("component"):
        assert np.allclose(part.explained, values[c - 1] / np.trace(v), rtol=1e-9)
        one = {i: (w, dev) for i, w, dev in zip(part.vec_id.fillna(-9), part.whitened, part.deviation)}
        want = (x - fit.sum(axis=0) / len(fit)) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(one[0][0] * want[0])
        deviations = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
        for i, w, dev in zip(ids, want, deviations):
            near = one[-9 if i is None else i]
            if i != 7:  # that id stands twice
                assert abs(near[0] - sign * w) < 1e-7 and near[1] == dev


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [3.0, 4.0])] * 5, [(1, [])]):
        df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA)
        out = whitening.whiten(df)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_far_entries_are_exact(spark):
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.5, 0.25]), (3, [0.5, -7.0])]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA)
    got = whitening.whiten(df).toPandas()
    assert (got.deviation[got.vec_id == 0] == np.iinfo(np.int64).max).all() and np.isfinite(got.whitened).all()


@pytest.mark.parametrize("gap", [0, 1e-5, 1e-8, 1e-11])
def test_clustered_eigenvalues(gap):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(40) - q.T @ q) / 2
    values = np.array([3 + 2 * gap, 3 + gap, 3, 2 + gap, 2, 1, 1, 1, *np.linspace(0.9, 0.1, 32)], dtype=np.longdouble)
    a = (q * values) @ q.T
    got, x = whitening.refined_eigenvectors((a + a.T) / 2)
    assert np.abs(got - values).max() < 1e-15 * 8 and np.abs(x.T @ x - np.eye(40)).max() < 1e-14
    assert np.abs(a @ x - x * got).max() < 1e-14
    if gap:
        assert (1 - np.abs((q * x).sum(axis=0)[:5])).max() < 1e-9
