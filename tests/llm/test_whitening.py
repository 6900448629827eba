import math
import random

import numpy as np
import pytest

from gistmill.llm import whitening


def by_hand(rows, factor=256, k=4):
    """Dense solver over the distinct rows of whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(factor * c) for c in v)) for i, v in kept]
    fit = np.array(sorted({x for _, x in xs}), float)
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    centred = fit - fit.mean(0)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, x in xs:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        z = (np.array(x) - fit.mean(0)) @ u / np.sqrt(e)
        out += [(i, c + 1, n, dev, abs(z[c]), e[c] / np.trace(v)) for c in range(len(e))]
    return sorted(out)


def sample():
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1 + j) + (j if i % 3 else -j) for j in range(6)]) for i in range(300)]
    rows += [(7, rows[0][1])] * 40 + [(900, rows[1][1]), (901, [1e-9, -1e-9, 0.0, -0.0, 0.5, -0.5])]
    nan, inf = float("nan"), float("inf")
    rows += [(902, None), (903, [nan] + [0.0] * 5), (904, [0.0] * 5 + [-inf]), (905, [None] + [1.0] * 5)]
    return rows


@pytest.mark.parametrize("fan", [32, 1])
def test_as_by_hand(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", 64)
    rows = sample()
    table = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, id double, `a.b` string")
    got = sorted(whitening.whiten(table.repartition(5)).collect(), key=lambda r: (r["id"], r["component"], r["deviation"]))
    want = by_hand(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g["id"], g["component"], g["n"], int(g["deviation"])) == w[:4]
        assert abs(g["whitened"]) == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert g["explained"] == pytest.approx(w[5], rel=1e-9)
        assert g["identity_error"] < 1e-9
    by_row = {}
    for g in got:  # one sign for all rows
        by_row.setdefault(g["component"], []).append(g)
    a, b = (np.array([g["whitened"] for g in by_row[c]]) for c in (1, 2))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.5


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, None), (2, []), (3, [float("nan")])]) == []
    one = make([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [0.5, 2.0])])
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 6
    flat = make([(i, [float(i), 3.0]) for i in range(5)])
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert {r["explained"] for r in flat} == {0.0, 1.0} and max(r["identity_error"] for r in flat) < 1e-12
    ragged = make([(1, [1.0]), (2, [2.0, 1.0]), (3, [3.0, 5.0]), (4, [4.0])])
    assert {r["id"] for r in ragged} == {2, 3}


def test_large_entries(spark):
    rows = [(i, [1e14 * i, -1e15 + i]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = by_hand(rows)
    assert sorted((r["id"], r["component"], int(r["deviation"])) for r in got) == [w[:2] + w[3:4] for w in want]


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 0.5, 0.5], [1, 1 - 1e-9, 1 - 2e-9, 1e-7, 1e-8], [3, 3 - 1e-13, 2, 1e-12, 0], [7] * 5,
])
def test_clusters(values):
    values = sorted(values, reverse=True)
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q + q @ (np.eye(5) - q.T @ q) / 2
    e = np.array(values, np.longdouble)
    a = (q * e) @ q.T
    got, x = whitening.refined_eigenvectors((a + a.T) / 2)
    assert np.abs(got - e).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(5)).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-16
    for i in range(5):
        alone = np.abs(e - e[i])[np.arange(5) != i].min()
        if alone > 1e-10:
            assert 1 - abs(x[:, i] @ q[:, i]) < 1e-16


def test_single_precision_alone_is_not_enough():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(500, 40)) * np.linspace(1, 1.5, 40)
    v = y.T @ y / 500
    rough = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1]
    _, x = whitening.refined_eigenvectors(v)
    exact = np.linalg.eigh(v)[1][:, ::-1]
    off = lambda m: 1 - np.abs((m * exact).sum(0)).min()
    assert off(rough.astype(float)) > 1e-13 and np.abs(np.abs(x.astype(float)) - np.abs(exact)).max() < 1e-12
