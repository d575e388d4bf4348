"""Bucketed forms against plain ones, pandas and brute force, on a series with most of the rows."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import buckets as B
from tidemark.operators import features as FE
from tidemark.operators import tests as TS


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(s, int(t), None if rng.random() < gap else float(np.round(10 + 3 * math.sin(t / 3) + rng.normal(), 6)), "clash")
            for s, n, gap in (("hot", 400, 0.2), ("a", 37, 0.0), (None, 20, 0.3), ("one", 1, 0.0), ("void", 5, 1.0))
            for t in range(n)]
    return spark.createDataFrame(rows, "s string, t int, x double, _diff string").repartition(5).cache()


def by_series(pdf):
    return [(k, g.sort_values("t")) for k, g in pdf.groupby("s", dropna=False)]


@pytest.mark.parametrize("bucket_rows", [16, 64, 1024])
def test_exponential_averages_equal_pandas(frame, bucket_rows):
    got = FE.financial_features(frame.drop("_diff"), "x", "s", "t", bucket_rows=bucket_rows).toPandas()
    assert len(got) == frame.count()
    for _, g in by_series(got):
        macd = g.x.ewm(span=12, adjust=False).mean() - g.x.ewm(span=26, adjust=False).mean()
        np.testing.assert_allclose(g.x_macd.astype(float), macd, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(g.x_macd_signal.astype(float), macd.ewm(span=9, adjust=False).mean(), atol=1e-9, equal_nan=True)
        d = g.x.diff()
        gain, loss = (v.clip(lower=0).rolling(14).mean() for v in (d, -d))
        np.testing.assert_allclose(g.x_rsi_14.astype(float), 100 - 100 / (1 + gain / loss), atol=1e-9, equal_nan=True)


def test_affine_scan_climbs_several_levels(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.choice([0.0, 0.5, 0.9, 1.0], p=[0.05, 0.35, 0.3, 0.3])), float(rng.normal())) for k in "ab" for i in range(300)]
    base = B.bucketed(spark.createDataFrame(rows, "k string, i int, a double, b double"), "k", "i", 4)
    from pyspark.sql import functions as F
    got = {(r["k"], r["i"]): r["y"] for r in B.affine_scan(base, {"y": (F.col("a"), F.col("b"))}, "k", 4).collect()}
    for k in "ab":
        y = None
        for _, i, a, b in [r for r in rows if r[0] == k]:
            y = b if a == 0 else None if y is None else a * y + b
            assert (got[k, i] is None) == (y is None) and (y is None or abs(got[k, i] - y) < 1e-9)


@pytest.mark.parametrize("bucket_rows", [3, 1 << 17])
def test_interpolation_equals_pandas(frame, bucket_rows):
    got = FE.interpolate_linear(frame, ["x"], "s", "t", bucket_rows=bucket_rows).toPandas()
    whole = frame.toPandas()
    for (_, g), (_, h) in zip(by_series(got), by_series(whole)):
        want = h.x.astype(float).interpolate(limit_area="inside")
        np.testing.assert_allclose(g.x.astype(float), want, atol=1e-9, equal_nan=True)
    at = FE.interpolate_linear(frame, ["x"], "s", "t", pos_col="t", bucket_rows=bucket_rows).toPandas()
    pd.testing.assert_frame_equal(at.sort_values(["s", "t"]).reset_index(drop=True), got.sort_values(["s", "t"]).reset_index(drop=True))


def test_hot_forms_equal_plain_forms(frame):
    key = ["s", "t"]
    same = lambda a, b: pd.testing.assert_frame_equal(
        *[d.toPandas().sort_values(key).reset_index(drop=True) for d in (a, b)])
    d = frame.drop("_diff")
    same(FE.rolling_moments(d, ["x"], 5, "s", "t", skew_safe=True, bucket_rows=8), FE.rolling_moments(d, ["x"], 5, "s", "t"))
    same(FE.seasonal_features(d, ["x"], [3, 4], "t", "s", "t", skew_safe=True, bucket_rows=8), FE.seasonal_features(d, ["x"], [3, 4], "t", "s", "t"))
    plain = TS.seasonal_decompose(d, "x", 6, "t", "s")
    same(TS.seasonal_decompose(d, "x", 6, "t", "s", bucket_rows=8), plain)
    a, b = (TS.ljung_box(d.where("s in ('hot', 'a')"), "x", "t", "s", 4, skew_safe=k, bucket_rows=8).toPandas().sort_values("s") for k in (True, False))
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
@pytest.mark.parametrize("period", [4, 5])
def test_decomposition_equals_arithmetic(frame, model, period):
    got = TS.seasonal_decompose(frame, "x", period, "t", "s", model, bucket_rows=16).toPandas()
    for k, g in by_series(got):
        x, h = g.x.astype(float).to_numpy(), period // 2
        weight = np.ones(2 * h + 1)
        if period % 2 == 0:
            weight[[0, -1]] = 0.5
        trend = np.array([(x[i - h:i + h + 1] * weight).sum() / period if h <= i < len(x) - h else np.nan for i in range(len(x))])
        left = x - trend if model == "additive" else x / trend
        phase = np.array([np.nanmean(v) if len(v := left[i::period]) and not np.isnan(v).all() else np.nan for i in range(period)])
        level = np.nanmean(phase) if not np.isnan(phase).all() else np.nan
        phase = phase - level if model == "additive" else phase / level
        season = phase[np.arange(len(x)) % period]
        np.testing.assert_allclose(g.x_trend.astype(float), trend, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(g.x_seasonal.astype(float), season, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(g.x_resid.astype(float), x - trend - season if model == "additive" else x / (trend * season), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("regression", ["level", "trend"])
@pytest.mark.parametrize("lags", [None, 0, 7])
def test_kpss_equals_its_definition(frame, regression, lags):
    got = {r["s"]: r for r in TS.kpss(frame, "x", "t", "s", regression, lags, bucket_rows=16).collect()}
    assert set(got) == {"hot", "a", None, "one"}
    for k, g in by_series(frame.toPandas()):
        x = g.x.astype(float).dropna().to_numpy()
        n = len(x)
        if n < 2:
            continue
        t = np.arange(n)
        e = x - x.mean() if regression == "level" else x - np.polyval(np.polyfit(t, x, 1), t)
        m = min(math.ceil(12 * (n / 100) ** 0.25) if lags is None else lags, n - 1)
        cov = [(e[s:] * e[:n - s]).sum() for s in range(m + 1)]
        s2 = (cov[0] + 2 * sum((1 - s / (m + 1)) * cov[s] for s in range(1, m + 1))) / n
        r = got[None if isinstance(k, float) else k]
        assert (r["n"], r["lags"]) == (n, m)
        assert r["kpss_stat"] == pytest.approx((np.cumsum(e) ** 2).sum() / n ** 2 / s2, rel=1e-8)
    assert got["one"]["kpss_stat"] is None and got["one"]["kpss_pvalue"] is None


def test_no_frame_ends_with_its_partition(frame):
    """Spark reads such a frame anew for every row, so a bucket would cost the square of its rows."""
    from tidemark.operators import windows as W
    for df in (FE.interpolate_linear(frame, ["x"], "s", "t", bucket_rows=64),
               W.fill_forward_backward(frame, ["x"], "s", "t", skew_safe=True, bucket_rows=64),
               W.fill_forward_backward(frame, ["x"], "s", "t")):
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
