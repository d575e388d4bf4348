"""Nearest-neighbour mutual information against all pairs of rows."""

import math

import numpy as np
import pytest

from tidemark.operators import knn_info as K


def psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))


def brute(x, y, k):
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) <= k:
        return len(x), None

    def units(v):
        std = K._digits(v.std())
        return np.rint((v - round(v.mean() / std) * std) * (K.UNIT / std)).astype(np.int64) if std else np.zeros(len(v), np.int64)
    x, y = units(x), units(y)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, K.FAR)
    m = np.maximum(np.sort(d, axis=1)[:, k - 1] - 1, 0)[:, None]
    n = len(x)
    inner = np.mean([psi(a) + psi(b) for a, b in zip((dx <= m).sum(1), (dy <= m).sum(1))])
    return n, max(0.0, psi(n) + psi(k) - inner)


def columns(n, rng):
    y = rng.normal(size=n)
    x = {"line": y * 2 + rng.normal(size=n) * 0.3, "noise": rng.normal(size=n) * 1e-9, "tail": rng.standard_cauchy(n),
         "few": rng.integers(0, 4, n).astype(float), "constant": np.full(n, 7.5), "curve": np.abs(y) + rng.normal(size=n) * 0.05,
         "gaps": np.where(rng.random(n) < 0.3, np.nan, y ** 3)}
    y[: n // 3], x["line"][: n // 3], x["curve"][: n // 3] = 1.25, 3.0, -1.0           # a third of all rows are one place
    return x, y


@pytest.mark.parametrize("k, slab", [(3, 40), (1, 1_000_000), (5, 7)])
def test_equals_all_pairs(spark, k, slab):
    x, y = columns(400, np.random.default_rng(k))
    rows = [tuple(None if math.isnan(v[i]) else float(v[i]) for v in x.values()) + (float(y[i]),) for i in range(len(y))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*x, "f"]))            # the target's name clashes
    got = {r["feature"]: (r["n"], r["mi"]) for r in K.mutual_info_knn(df, list(x), "f", k, slab, bucket_rows=64).collect()}
    for c, v in x.items():
        n, mi = brute(v, y, k)
        assert got[c][0] == n and got[c][1] == pytest.approx(mi, abs=1e-9), c


def test_whole_number_columns_both_axes(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 12, 600), rng.integers(0, 50, 600)
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, b)], "a int, b int")
    r = K.mutual_info_knn(df, ["a"], "b", 3, 16, bucket_rows=50).first()
    assert r["mi"] == pytest.approx(brute(a.astype(float), b.astype(float), 3)[1], abs=1e-9)


def test_one_thin_sweep_after_another():
    """Far more points than ``FEW``, in a line along either axis, with outliers."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 10**9, 1500), rng.integers(0, 50, 1500)
    x[:3] = 10**14
    for p, q in ((x, y), (y, x)):
        p, q = np.unique(np.stack([p, q]), axis=1)
        w = rng.integers(1, 4, len(p))
        top = K._nearest(p, q, w, p, q, np.full((len(p), 3), K.FAR), True)
        d = np.maximum(np.abs(p[:, None] - p), np.abs(q[:, None] - q))
        for i in range(len(p)):
            have = np.repeat(d[i], w - (np.arange(len(p)) == i))
            assert (np.sort(have)[:3] == top[i]).all()


def test_little_and_nothing(spark):
    none = spark.createDataFrame([], "a double, b double, y double")
    assert [tuple(r) for r in K.mutual_info_knn(none, ["a", "b"], "y").orderBy("feature").collect()] == [("a", 0, None), ("b", 0, None)]
    few = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 1.0), (float("nan"), 4.0, 3.0), (4.0, 2.0, float("inf")), (5.0, 7.0, None),
                                 (3.0, 3.0, 3.0), (0.5, 2.0, 9.0)], "a double, b double, y double")
    got = {r["feature"]: (r["n"], r["mi"]) for r in K.mutual_info_knn(few, ["a", "b"], "y", 3).collect()}
    assert got["a"][0] == 4 and got["a"][1] is not None and got["b"][0] == 4
    assert {r["mi"] for r in K.mutual_info_knn(few, ["a", "b"], "y", 4).collect()} == {None}
    with pytest.raises(ValueError):
        K.mutual_info_knn(few, ["a"], "y", 0)
