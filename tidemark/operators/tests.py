"""Statistical tests: A18 Shapiro-Wilk, A19 augmented Dickey-Fuller, G3
normal Q-Q points, K13 Ljung-Box, KPSS and seasonal decomposition.

The data work is distributed (ranks, lagged differences, Gram sums per
series with partial aggregation); the per-series finishing step works on one
small row of sums per series inside ``applyInPandas``, so any number of
series is handled and no group ever holds a series' raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe, q
from ..functions.stats import chi2_sf, norm_cdf, norm_ppf_sql
from ..session import materialize
from .buckets import bucketed, halo, home, over_bucket, prefix_sums
from .windows import _cols, with_row_pos


def _ranked(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Ascending 1-based rank of ``col`` within each group plus the group
    size, from a global consecutive position (no per-group sort window)."""
    d = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    # the tie-break lets range partitioning split equal values; their order does not matter
    d = with_row_pos(d.withColumn("_t", F.monotonically_increasing_id()), [*by, "_x", "_t"], "_pos").drop("_t")
    g = d.groupBy(*by).agg(F.min("_pos").alias("_p0"), F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mean"))
    if by:
        d = join_null_safe(d, g, by)
    else:
        r = g.first()
        d = d.withColumns({"_p0": F.lit(r["_p0"]), "_n": F.lit(r["_n"]), "_mean": F.lit(r["_mean"])})
    return d.withColumn("_i", F.col("_pos") - F.col("_p0") + 1)


# --------------------------------------------------------------------- A18

# Royston (1995) polynomial coefficients (algorithm AS R94).
_C_AN = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_C_AN1 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MU_SMALL = (0.5440, -0.39978, 0.025054, -0.0006714)       # n in [4, 11], powers of n
_SG_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_GAMMA_SMALL = (-2.273, 0.459)
_MU_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)     # n >= 12, powers of log n
_SG_LARGE = (-0.4803, -0.082676, 0.0030302)


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(df: DataFrame, col: str, by=None) -> DataFrame:
    """W statistic and p-value (Royston 1995), per group. Sorting and
    all sums are distributed; normal scores are a column expression.
    The p-value approximation is validated for 4 <= n <= 5000; larger groups
    are flagged (``p_reliable`` false)."""
    by = _cols(by)
    d = _ranked(df, col, by)
    d = d.withColumn("_p", (F.col("_i") - 0.375) / (F.col("_n") + 0.25)).withColumn("_m", F.expr(norm_ppf_sql("_p")))
    # W does not change when a constant is taken off; sums of squares keep their digits
    d = d.withColumn("_x", F.col("_x") - F.col("_mean"))
    s = d.groupBy(*by).agg(
        F.first("_n").alias("n"), F.sum(F.col("_m") * F.col("_m")).alias("mm"),
        F.sum("_x").alias("sx"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"),
        F.sum(F.col("_m") * F.col("_x")).alias("smx"),
        F.max(F.when(F.col("_i") == F.col("_n"), F.col("_m"))).alias("m_n"),
        F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_m"))).alias("m_n1"),
        F.max(F.when(F.col("_i") == F.col("_n"), F.col("_x"))).alias("x_n"),
        F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_x"))).alias("x_n1"),
        F.max(F.when(F.col("_i") == 1, F.col("_x"))).alias("x_1"),
        F.max(F.when(F.col("_i") == 2, F.col("_x"))).alias("x_2"))
    schema = ", ".join([f"{q(b)} {t}" for b, t in zip(by, [df.schema[b].dataType.simpleString()
                                                          for b in by])]
                       + ["n long", "w double", "p_value double", "p_reliable boolean"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            out.append({**{b: r[b] for b in by}, **_sw_from_sums(r)})
        return pd.DataFrame(out, columns=[*by, "n", "w", "p_value", "p_reliable"])

    key = by or [F.lit(0)]
    return s.groupBy(*key).applyInPandas(finish, schema) if by else \
        s.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(
            lambda pdf: finish(pdf.drop(columns=["_g"])), schema)


def _sw_from_sums(r) -> dict:
    n = int(r["n"])
    if n < 3:
        return {"n": n, "w": np.nan, "p_value": np.nan, "p_reliable": False}
    ss = float(r["sxx"]) - float(r["sx"]) ** 2 / n
    if ss <= 0:
        return {"n": n, "w": np.nan, "p_value": np.nan, "p_reliable": False}
    if n == 3:
        a = math.sqrt(0.5)
        w = (a * (float(r["x_n"]) - float(r["x_1"]))) ** 2 / ss
        w = max(w, 0.75)
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return {"n": n, "w": w, "p_value": p, "p_reliable": True}
    mm, m_n, m_n1 = float(r["mm"]), float(r["m_n"]), float(r["m_n1"])
    u = 1 / math.sqrt(n)
    a_n = m_n / math.sqrt(mm) + _poly(_C_AN, u)
    if n > 5:
        a_n1 = m_n1 / math.sqrt(mm) + _poly(_C_AN1, u)
        phi = (mm - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
        # sum a_i x_(i): middle terms m_i / sqrt(phi), the two ends replaced
        mid = (float(r["smx"]) - m_n * (float(r["x_n"]) - float(r["x_1"]))
               - m_n1 * (float(r["x_n1"]) - float(r["x_2"]))) / math.sqrt(phi)
        ax = mid + a_n * (float(r["x_n"]) - float(r["x_1"])) + a_n1 * (float(r["x_n1"]) - float(r["x_2"]))
    else:
        phi = (mm - 2 * m_n ** 2) / (1 - 2 * a_n ** 2)
        mid = (float(r["smx"]) - m_n * (float(r["x_n"]) - float(r["x_1"]))) / math.sqrt(phi)
        ax = mid + a_n * (float(r["x_n"]) - float(r["x_1"]))
    w = min(ax * ax / ss, 1.0)
    if n <= 11:
        gamma = _poly(_GAMMA_SMALL, n)
        y = -math.log(gamma - math.log1p(-w)) if w < 1 else -math.inf
        mu, sg = _poly(_MU_SMALL, n), math.exp(_poly(_SG_SMALL, n))
    else:
        ln = math.log(n)
        y = math.log1p(-w) if w < 1 else -math.inf
        mu, sg = _poly(_MU_LARGE, ln), math.exp(_poly(_SG_LARGE, ln))
    p = 1 - norm_cdf((y - mu) / sg) if math.isfinite(y) else 1.0
    return {"n": n, "w": w, "p_value": p, "p_reliable": 4 <= n <= 5000}


# --------------------------------------------------------------------- G3

def qq_points(df: DataFrame, col: str, by=None) -> DataFrame:
    """Ordered values against normal quantiles of Filliben's order
    statistic medians (m_n = 0.5^(1/n), m_1 = 1 - m_n, else
    (i - 0.3175) / (n + 0.365)); add the least-squares line with
    ``regr_slope`` / ``regr_intercept`` per group."""
    by = _cols(by)
    d = _ranked(df, col, by)
    med = (F.when(F.col("_i") == F.col("_n"), F.pow(F.lit(0.5), 1.0 / F.col("_n")))
           .when(F.col("_i") == 1, 1 - F.pow(F.lit(0.5), 1.0 / F.col("_n")))
           .otherwise((F.col("_i") - 0.3175) / (F.col("_n") + 0.365)))
    pts = d.withColumn("_p", med).select(*by, F.col("_i").alias("rank"), F.col("_x").alias("sample"),
                                         F.expr(norm_ppf_sql("_p")).alias("theoretical"))
    line = pts.groupBy(*by).agg(F.regr_slope("sample", "theoretical").alias("slope"),
                                F.regr_intercept("sample", "theoretical").alias("intercept"))
    return join_null_safe(pts, line, by) if by else pts.withColumns(
        {k: F.lit(v) for k, v in line.first().asDict().items()})


# --------------------------------------------------------------------- A19

# MacKinnon (1994) p-value surface and MacKinnon (2010)
# critical-value polynomials for the constant-only case, one I(1) series.
_ADF_TAU_MAX, _ADF_TAU_MIN, _ADF_TAU_STAR = 2.74, -18.83, -1.61
_ADF_SMALLP = (2.1659, 1.4412, 0.038269)
_ADF_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_CRIT = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
             "5%": (-2.86154, -2.8903, -4.234, -40.040),
             "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def mackinnon_p(stat: float) -> float:
    if stat > _ADF_TAU_MAX:
        return 1.0
    if stat < _ADF_TAU_MIN:
        return 0.0
    c = _ADF_SMALLP if stat <= _ADF_TAU_STAR else _ADF_LARGEP
    return norm_cdf(_poly(c, stat))


def mackinnon_crit(nobs: int) -> dict:
    return {k: _poly(v, 1.0 / nobs) for k, v in _ADF_CRIT.items()}


def _adf_maxlag(n: int) -> int:
    return min(n // 2 - 2, int(math.ceil(12.0 * (n / 100.0) ** 0.25)))


def adf_test(df: DataFrame, col: str, order, series=None, maxlag: int | None = None,
             autolag: bool = True) -> DataFrame:
    """ADF with a constant. Regress dy_t on [y_{t-1}, dy_{t-1..t-p}, 1];
    with ``autolag`` the lag p minimises AIC over 0..maxlag on the common
    sample (maxlag = ceil(12 (n/100)^(1/4)), capped at n//2 - 2), then the
    chosen regression is refit on its own full sample; statistic = t of
    y_{t-1}. Only run for n > 12 (rows with fewer are returned with nulls).
    Per series: lagged differences by one window pass, then one Gram
    aggregate per series; the small solves run in ``applyInPandas``."""
    series = _cols(series)
    order = _cols(order)
    n_by = df.groupBy(*series).agg(F.count(F.col(col)).alias("n")) if series else None
    n_max = (n_by.agg(F.max("n")).first()[0] if series else df.where(F.col(col).isNotNull()).count())
    L = maxlag if maxlag is not None else max(_adf_maxlag(int(n_max)), 0)
    w = Window.partitionBy(*series).orderBy(*order)
    x = F.col(col).cast("double")
    d = df.select(*series, *order, x.alias("_y")).where(F.col("_y").isNotNull())
    d = d.withColumn("_rn", F.row_number().over(w))
    d = d.withColumn("_dy", F.col("_y") - F.lag("_y", 1).over(w)).withColumn("_y1", F.lag("_y", 1).over(w))
    for k in range(1, L + 1):
        d = d.withColumn(f"_d{k}", F.lag("_dy", k).over(w))
    cols = ["_one", "_y1"] + [f"_d{k}" for k in range(1, L + 1)] + ["_dy"]
    d = d.withColumn("_one", F.lit(1.0))
    # Gram sums grouped by (series, bucket): bucket = min(row number, L + 2).
    # Rows with row number r have lags up to r - 2; the Gram matrix of the
    # sample "rows with r >= p + 2" is the sum of buckets >= p + 2. So one
    # aggregate of (L+2)^2/2 sums gives every sample the lag search needs,
    # with at most L + 1 small rows per series.
    d = d.withColumn("_b", F.least(F.col("_rn"), F.lit(L + 2)))
    aggs = [F.expr(f"sum({a} * {b}) AS g_{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    g = (d.where(F.col("_rn") >= 2).groupBy(*series, "_b")
         .agg(F.count(F.lit(1)).alias("_cnt"), *aggs))
    nobs = d.groupBy(*series).agg(F.count(F.lit(1)).alias("nobs"))
    g = join_null_safe(g, nobs, series) if series else g.withColumn("nobs", F.lit(nobs.first()[0]))
    keys_schema = [f"{q(s)} {df.schema[s].dataType.simpleString()}" for s in series]
    schema = ", ".join(keys_schema + ["n long", "used_lag int", "adf_stat double", "p_value double",
                                      "crit_1 double", "crit_5 double", "crit_10 double",
                                      "stationary boolean"])
    k = len(cols)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        base = {s_: pdf[s_].iloc[0] for s_ in series}
        n = int(pdf["nobs"].iloc[0])
        if n <= 12:
            return pd.DataFrame([{**base, "n": n}], columns=[*series, "n", "used_lag", "adf_stat",
                                                              "p_value", "crit_1", "crit_5", "crit_10",
                                                              "stationary"])
        lmax = min(L, max(_adf_maxlag(n), 0)) if maxlag is None else L
        blocks = {}
        for _, r in pdf.iterrows():
            G = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    v = r[f"g_{i}_{j}"]
                    G[i, j] = G[j, i] = 0.0 if v is None or pd.isna(v) else float(v)
            blocks[int(r["_b"])] = (G, int(r["_cnt"]))

        def gram(p):
            G = np.zeros((k, k))
            cnt = 0
            for b, (Gb, c) in blocks.items():
                if b >= p + 2:
                    G += Gb
                    cnt += c
            return G, cnt

        def fit(Gm, lag, nrows):
            idx = [0, 1] + [2 + t for t in range(lag)]
            XtX = Gm[np.ix_(idx, idx)]
            Xty = Gm[idx, k - 1]
            beta = np.linalg.solve(XtX, Xty)
            ssr = max(Gm[k - 1, k - 1] - 2 * beta @ Xty + beta @ XtX @ beta, 1e-300)
            dof = nrows - len(idx)
            llf = -nrows / 2 * (math.log(2 * math.pi) + math.log(ssr / nrows) + 1)
            se = math.sqrt(ssr / dof * np.linalg.inv(XtX)[1, 1])
            return beta[1] / se, -2 * llf + 2 * len(idx)

        if autolag:
            Gc, nc = gram(lmax)
            best = min((fit(Gc, lag, nc)[1], lag) for lag in range(lmax + 1))[1]
        else:
            best = lmax
        Gb, nb = gram(best)
        stat, _ = fit(Gb, best, nb)
        pv = mackinnon_p(stat)
        cv = mackinnon_crit(nb)
        out.append({**base, "n": n, "used_lag": best, "adf_stat": stat, "p_value": pv,
                    "crit_1": cv["1%"], "crit_5": cv["5%"], "crit_10": cv["10%"],
                    "stationary": pv <= 0.05})
        return pd.DataFrame(out, columns=[*series, "n", "used_lag", "adf_stat", "p_value", "crit_1",
                                          "crit_5", "crit_10", "stationary"])

    if series:
        return g.groupBy(*series).applyInPandas(solve, schema)
    return g.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(solve, schema)


# --------------------------------------------------------------------- K13

def ljung_box(df: DataFrame, col: str, order, series=None, lags: int = 10, skew_safe: bool = False,
              bucket_rows: int = 1 << 20) -> DataFrame:
    """Q = n(n+2) sum_k r_k^2 / (n-k) from autocorrelations r_k
    (lagged products by one window pass, sums by one aggregate); p-value
    from the chi-square(lags) tail. ``skew_safe`` runs the pass in halo buckets."""
    series, order = _cols(series), _cols(order)
    w = Window.partitionBy(*series, "_hb").orderBy("_gpos") if skew_safe else Window.partitionBy(*series).orderBy(*order)
    mean = df.groupBy(*series).agg(F.avg(col).alias("_m"), F.count(col).alias("_n"))
    d = df.where(F.col(col).isNotNull())
    d = join_null_safe(d, mean, series) if series else d.withColumns(
        {k: F.lit(v) for k, v in mean.first().asDict().items()})
    d = d.withColumn("_e", F.col(col) - F.col("_m"))
    if skew_safe:
        d = halo(bucketed(d, series, order, bucket_rows), lags, 0, bucket_rows)
    d = d.select(*series, "_n", "_e", *(["_shift"] if skew_safe else []),
                 *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    if skew_safe:
        d = home(d)
    s = d.groupBy(*series).agg(F.first("_n").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_c0"),
                               *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_c{k}")
                                 for k in range(1, lags + 1)])
    qstat = None
    for k in range(1, lags + 1):
        term = F.pow(F.col(f"_c{k}") / F.col("_c0"), 2) / (F.col("n") - k)
        qstat = term if qstat is None else qstat + term
    out = s.select(*series, "n", (F.col("n") * (F.col("n") + 2) * qstat).alias("lb_stat"))

    @F.pandas_udf("double")
    def pval(qs: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(v), lags) if v is not None and not pd.isna(v) else np.nan
                          for v in qs])
    return out.withColumn("lb_pvalue", pval("lb_stat"))


# Upper tail probabilities and critical values of the KPSS statistic
# (Kwiatkowski, Phillips, Schmidt and Shin 1992, table 1).
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_CRIT = {"level": (0.347, 0.463, 0.574, 0.739), "trend": (0.119, 0.146, 0.176, 0.216)}


def kpss(df: DataFrame, col: str, order, series=None, regression: str = "level", lags: int | None = None,
         bucket_rows: int = 1 << 17) -> DataFrame:
    """KPSS test of stationarity around a level or a linear trend, one row per
    series: n, lags, kpss_stat, kpss_pvalue (between 0.01 and 0.1, by interpolation),
    stationary (p > 0.05).

    With S the running sums of the residuals, the statistic is sum(S^2) / n^2 over the
    long-run variance. Bartlett's weights make that variance the mean square of the
    sums of lags + 1 neighbouring residuals, over lags + 1: differences of S, so one
    equi-join on (series, position) serves any number of lags. ``lags``: by default
    ceil(12 (n / 100)^(1/4)), and less than n. Null values are left out; a series without
    spread has no statistic."""
    if regression not in KPSS_CRIT:
        raise ValueError("regression must be level or trend")
    keys = _cols(series)
    base = bucketed(df.where(F.col(col).isNotNull()).select(*keys, *[c for c in _cols(order) if c not in keys],
                                                           F.col(col).cast("double").alias("_y")), series, order, bucket_rows)
    begin = base.groupBy(*keys).agg(F.min("_gpos").alias("_p0"))
    base = (join_null_safe(base, begin, keys) if keys else base.withColumn("_p0", F.lit(0))).withColumn(
        "_t", F.col("_gpos") - F.col("_p0") + 1)
    n = F.count("_y")
    fit = [n.alias("n"), F.avg("_y").alias("_my"), F.avg("_t").alias("_mt"),
           F.try_divide(F.covar_pop("_y", "_t"), F.nullif(F.var_pop(F.col("_t").cast("double")), F.lit(0.0))).alias("_slope"),
           F.least(F.ceil(12 * F.pow(n / 100.0, 0.25)) if lags is None else F.lit(lags), n - 1).cast("long").alias("lags")]
    stats = base.groupBy(*keys).agg(*fit)
    d = join_null_safe(base, stats, keys) if keys else base.withColumns({k: F.lit(v) for k, v in stats.first().asDict().items()})
    e = F.col("_y") - F.col("_my")
    if regression == "trend":
        e = e - F.coalesce("_slope", F.lit(0.0)) * (F.col("_t") - F.col("_mt"))
    d = materialize(prefix_sums(d.withColumn("_e", e), {"_s": F.col("_e")}, keys).select(*keys, "n", "lags", "_t", "_e", "_s"))
    ahead = d.select(*keys, (F.col("_t") + F.col("lags") + 1).alias("_t"), F.col("_s").alias("_before"))
    d = join_null_safe(d, ahead, [*keys, "_t"], "left")
    # beyond the last residual the running sum stays: it is 0 but for rounding
    window = F.pow(F.col("_s") - F.coalesce("_before", F.lit(0.0)), 2) + F.when(
        (F.col("_t") >= F.col("n") - F.col("lags")) & (F.col("_t") < F.col("n")), F.pow("_s", 2)).otherwise(0.0)
    got = d.groupBy(*keys).agg(F.first("n").alias("n"), F.first("lags").alias("lags"), F.sum(F.pow("_s", 2)).alias("_ss"),
                               F.sum(window).alias("_w"), F.sum(F.pow("_e", 2)).alias("_e2"))
    long_run = F.col("_w") / (F.col("n") * (F.col("lags") + 1))
    got = got.withColumn("kpss_stat", F.when(F.col("_e2") > 0, F.try_divide(F.col("_ss") / (F.col("n") * F.col("n")), long_run)))
    c, x = KPSS_CRIT[regression], F.col("kpss_stat")
    p = F.when(x <= c[0], KPSS_P[0])
    for k in range(3):
        p = p.when(x <= c[k + 1], KPSS_P[k] + (KPSS_P[k + 1] - KPSS_P[k]) * (x - c[k]) / (c[k + 1] - c[k]))
    got = got.withColumn("kpss_pvalue", p.when(x.isNotNull(), KPSS_P[3]))
    return got.select(*keys, "n", "lags", "kpss_stat", "kpss_pvalue", (F.col("kpss_pvalue") > 0.05).alias("stationary"))


def seasonal_decompose(df: DataFrame, col: str, period: int, order, series=None, model: str = "additive",
                       bucket_rows: int = 1 << 17) -> DataFrame:
    """``{col}_trend`` (centred moving average over ``period`` rows; for an even
    period the two end rows count half), ``{col}_seasonal`` (mean of what is left at
    each phase, with the mean over all phases taken out) and ``{col}_resid``. The trend
    is null within period // 2 rows of a series' ends and beside nulls. Phases count
    from the series' first row. ``multiplicative`` divides instead of subtracting.
    Buckets carry a halo on both sides; phase means are a partial aggregate."""
    if model not in ("additive", "multiplicative") or period < 2:
        raise ValueError("model must be additive or multiplicative, period at least 2")
    keys, half = _cols(series), period // 2
    d = halo(bucketed(df.withColumn("_y", F.col(col).cast("double")), series, order, bucket_rows), half, half, bucket_rows)
    w = over_bucket(keys)
    inner = f"({w} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    ends = "" if period % 2 else f" - (lag(_y, {half}) OVER ({w}) + lead(_y, {half}) OVER ({w})) / 2"
    d = home(d.select("*", F.expr(f"CASE WHEN count(_y) OVER {inner} = {2 * half + 1} THEN (sum(_y) OVER {inner}{ends}) / {period} END").alias("_m")))
    begin = d.groupBy(*keys).agg(F.min("_gpos").alias("_p0"))
    d = (join_null_safe(d, begin, keys) if keys else d.withColumn("_p0", F.lit(0))).withColumn(
        "_phase", F.col("_gpos") - F.col("_p0")).withColumn("_phase", F.col("_phase") % period)
    additive = model == "additive"
    left = F.col("_y") - F.col("_m") if additive else F.try_divide(F.col("_y"), F.nullif(F.col("_m"), F.lit(0.0)))
    phase = d.groupBy(*keys, "_phase").agg(F.avg(left).alias("_f"))
    level = phase.groupBy(*keys).agg(F.avg("_f").alias("_l"))
    if keys:
        phase = join_null_safe(phase, level, keys)
    else:
        phase = phase.withColumn("_l", F.lit(level.first()[0]))
    phase = phase.select(*keys, "_phase", (F.col("_f") - F.col("_l") if additive else F.try_divide("_f", F.nullif("_l", F.lit(0.0)))).alias("_c"))
    d = join_null_safe(d, phase, [*keys, "_phase"])
    resid = F.col("_y") - F.col("_m") - F.col("_c") if additive else F.try_divide(F.col("_y"), F.nullif(F.col("_m") * F.col("_c"), F.lit(0.0)))
    return d.select(*df.columns, F.col("_m").alias(f"{col}_trend"), F.col("_c").alias(f"{col}_seasonal"), resid.alias(f"{col}_resid"))
