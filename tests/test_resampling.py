from collections import Counter

import numpy as np
import pytest

from gistmill.operators import resampling as rs
from gistmill.operators.bootstrap import POISSON_1, bootstrap_means

M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * rs.MULTIPLY[0] & M
    x ^= x >> 27
    x = x * rs.MULTIPLY[1] & M
    return x ^ (x >> 31)


def places(b, n, leaf):
    """One draw after another, down the tree."""
    top = 1 << max(n - 1, 0).bit_length()

    def fall(stream, lo, size, m):
        if not m:
            return
        key = mixed((stream + lo * rs.LO_STEP + size * rs.SIZE_STEP) & M)
        word = lambda k: mixed((key + k * rs.STEP) & M)
        if lo >= n:
            yield from fall(key, 0, top, m)
        elif lo + size <= n and size <= leaf:
            yield from (lo + (word(k + 1) & (size - 1)) for k in range(m))
        else:
            left, rest, k = 0, m, 0
            while rest > 0:
                k += 1
                left += (word(k) >> max(64 * k - m, 0)).bit_count()
                rest -= 64
            yield from fall(stream, lo, size // 2, left)
            yield from fall(stream, lo + size // 2, size // 2, m - left)

    return list(fall(mixed((b + 1) * rs.STEP & M), 0, top, n))


@pytest.mark.parametrize("n, bits, words", [(1, 2, 7), (2, 16, 1 << 20), (13, 1, 7), (300, 4, 64), (300, 16, 1 << 20)])
def test_means_as_draw_by_draw(spark, monkeypatch, n, bits, words):
    rows = [(f"k{i:04}", float(i * i % 17), None if i % 3 == 0 else float(i)) for i in range(n)]
    table = spark.createDataFrame(rows, "key string, `a.b` double, y double").repartition(3)
    monkeypatch.setattr(rs, "WORDS", words)
    got = {r["b"]: (r["m0"], r["m1"]) for r in rs.drawn_means(table, ["a.b", "y"], "key", 6, bits).collect()}
    assert sorted(got) == list(range(6))
    for b, (x, y) in got.items():
        at = places(b, n, 1 << bits)
        assert len(at) == n and set(at) <= set(range(n))
        held = [rows[i][2] for i in at if rows[i][2] is not None]
        assert x == pytest.approx(np.mean([rows[i][1] for i in at]))
        assert y == (pytest.approx(np.mean(held)) if held else None)


def test_every_place_alike():
    n, seen = 37, Counter()
    for b, lo, size, keys, draws in rs.leaf_counts(np.arange(3000), n, 1):
        assert (size == 1).all() and (draws > 0).all() and len(keys) == len(b)
        for at, m in zip(lo.tolist(), draws.tolist(), strict=True):
            seen[at] += m
    assert sum(seen.values()) == 3000 * n and sorted(seen) == list(range(n))
    chi = sum((seen[i] - 3000) ** 2 / 3000 for i in range(n))
    assert chi < 75  # 36 degrees of freedom


def test_poisson_weights():
    w = rs.poisson_weights(np.arange(400, dtype=np.int64), np.arange(500), POISSON_1)
    assert w.shape == (400, 500) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (w == rs.poisson_weights(np.arange(400, dtype=np.int64), np.arange(500), POISSON_1)).all()


@pytest.mark.parametrize("method", ["draws", "poisson"])
def test_intervals_of_several_means(spark, method):
    rows = spark.range(2000).selectExpr("id", "cast(id AS double) AS x", "cast(id % 7 AS double) AS y")
    got = {r["metric"]: r for r in bootstrap_means(rows, ["x", "y"], "id", 300, method=method).collect()}
    assert abs(got["x"]["mid"] - 999.5) < 5 and abs(got["y"]["mid"] - 3) < 0.05
    error = 2000 / 12**0.5 / 2000**0.5
    assert 3 * error < got["x"]["high"] - got["x"]["low"] < 5 * error
