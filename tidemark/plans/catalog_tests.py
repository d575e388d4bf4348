"""Catalog entries for statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..functions.stats import norm_ppf_sql
from ..operators import features as FE
from ..operators import tests as TS
from ..sources import panels as P
from .catalog import register
from .catalog_profile import _panel, _rounded
from .sqlparts import R, with_panel


@register("a18_shapiro_wilk")
def q_a18(spark, sf):
    """A18 per series on the target (Royston 1995 W and p)."""
    return TS.shapiro_wilk(_panel(spark, sf), "y", by="series_id")


_ADF0 = with_panel("""
SELECT series_id, n, CAST(0 AS INTEGER) AS used_lag,
       """ + R("b / sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx)", 8) + """ AS adf_stat,
       """ + R("-2.86154 - 2.8903 / m - 4.234 / (m * m) - 40.040 / (m * m * m)", 8) + """ AS crit_5
FROM (
  SELECT series_id, (SELECT count(*) FROM panel p2 WHERE p2.series_id = d.series_id) AS n,
         count(*) AS m, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy,
         regr_sxy(dy, y1) AS sxy
  FROM (SELECT series_id, y - lag(y) OVER w AS dy, lag(y) OVER w AS y1 FROM panel
        WINDOW w AS (PARTITION BY series_id ORDER BY period)) d
  WHERE dy IS NOT NULL GROUP BY series_id) t""")


@register("a19_adf_lag0", _ADF0)
def q_a19_0(spark, sf):
    """A19 with the lag fixed at 0: t-ratio of y_{t-1} in dy_t = a + g y_{t-1}
    per series (the regression the oracle can write with regr_*)."""
    a = TS.adf_test(_panel(spark, sf), "y", "period", series="series_id", maxlag=0, autolag=False)
    return _rounded(a.select("series_id", "n", "used_lag", "adf_stat", "crit_5"),
                    {"adf_stat": 8, "crit_5": 8})


@register("a19_adf_autolag")
def q_a19(spark, sf):
    """A19 as the reference runs it: AIC lag choice up to ceil(12 (n/100)^1/4),
    MacKinnon p-value and critical values, stationary if p <= 0.05."""
    return TS.adf_test(_panel(spark, sf), "y", "period", series="series_id")


def _qq_sql() -> str:
    """Filliben's medians; the normal quantile by the same published rational approximation."""
    return with_panel(f"""
SELECT series_id, i AS rank, {R("y", 10)} AS sample, {R("z", 8)} AS theoretical,
       {R("regr_slope(y, z) OVER s", 8)} AS slope, {R("regr_intercept(y, z) OVER s", 8)} AS intercept
FROM qs WINDOW s AS (PARTITION BY series_id)""", f"""
rk AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y) AS i,
              CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM panel),
md AS (SELECT *, CASE WHEN i = n THEN power(0.5, 1 / n) WHEN i = 1 THEN 1 - power(0.5, 1 / n)
                      ELSE (i - CAST(0.3175 AS DOUBLE)) / (n + CAST(0.365 AS DOUBLE)) END AS p FROM rk),
qs AS (SELECT *, {norm_ppf_sql("p")} AS z FROM md)""")


@register("g3_qq_points", _qq_sql())
def q_g3(spark, sf):
    """The target of every series against normal quantiles, with the line through the points."""
    return _rounded(TS.qq_points(_panel(spark, sf), "y", by="series_id"), {"sample": 10, "theoretical": 8, "slope": 8, "intercept": 8})


def _lb_sql(lags=10, p_value=False):
    lag_cols = ", ".join(f"lag(e, {k}) OVER (PARTITION BY series_id ORDER BY period) AS l{k}"
                         for k in range(1, lags + 1))
    sums = ", ".join(f"sum(e * l{k}) AS c{k}" for k in range(1, lags + 1))
    q = " + ".join(f"power(c{k} / c0, 2) / (n - {k})" for k in range(1, lags + 1))
    h = f"(n * (n + 2) * ({q}) / 2)"
    # the chi-square tail of ten degrees of freedom is a finite sum
    tail = ", " + R(f"exp(-{h}) * (1 + {h} + power({h}, 2) / 2 + power({h}, 3) / 6 + power({h}, 4) / 24)", 9) + " AS lb_pvalue"
    return with_panel(f"""
SELECT series_id, n, {R(f'n * (n + 2) * ({q})', 8)} AS lb_stat{tail if p_value else ""} FROM (
  SELECT series_id, CAST(count(*) AS BIGINT) AS n, sum(e * e) AS c0, {sums} FROM (
    SELECT series_id, e, {lag_cols} FROM (
      SELECT series_id, period, y - avg(y) OVER (PARTITION BY series_id) AS e FROM panel) a) b
  GROUP BY series_id) c""")


@register("k13_ljung_box_stat", _lb_sql())
def q_k13(spark, sf):
    lb = TS.ljung_box(_panel(spark, sf), "y", "period", series="series_id", lags=10)
    return _rounded(lb.select("series_id", "n", "lb_stat"), {"lb_stat": 8})


@register("k13_ljung_box_pvalue", _lb_sql(p_value=True))
def q_k13p(spark, sf):
    lb = TS.ljung_box(_panel(spark, sf), "y", "period", series="series_id", lags=10)
    return _rounded(lb.select("series_id", "n", "lb_stat", "lb_pvalue"), {"lb_stat": 8, "lb_pvalue": 9})


def _kpss_sql(trend: bool) -> str:
    e = "y - avg(y) OVER s" + (" - regr_slope(y, t) OVER s * (t - avg(t) OVER s)" if trend else "")
    crit = TS.KPSS_CRIT["trend" if trend else "level"]
    p = f"CASE WHEN st <= {crit[0]} THEN 0.1 " + " ".join(
        f"WHEN st <= {b} THEN {pa} + ({pb} - {pa}) * (st - {a}) / ({b} - {a})"
        for a, b, pa, pb in zip(crit, crit[1:], TS.KPSS_P, TS.KPSS_P[1:])) + " ELSE 0.01 END"
    return with_panel(f"""
SELECT series_id, n, lags, {R("st", 8)} AS kpss_stat, {R("p", 8)} AS kpss_pvalue, p > 0.05 AS stationary
FROM (SELECT *, {p} AS p FROM (
  SELECT series_id, n, lags, ss / (n * n) / ((c0 + 2 * c) / n) AS st
  FROM (SELECT series_id, CAST(count(*) AS BIGINT) AS n, any_value(lags) AS lags, sum(cum * cum) AS ss, sum(e * e) AS c0 FROM cums GROUP BY 1) a
  JOIN (SELECT x.series_id, sum(x.e * z.e * (1 - (x.t - z.t) / (x.lags + 1.0))) AS c
        FROM cums x JOIN cums z ON x.series_id = z.series_id AND x.t - z.t BETWEEN 1 AND x.lags GROUP BY 1) b USING (series_id)) u) v""", f"""
num AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY period) AS t FROM panel),
res AS (SELECT series_id, t, {e} AS e, CAST(ceil(12 * power(count(*) OVER s / 100.0, 0.25)) AS BIGINT) AS lags
        FROM num WINDOW s AS (PARTITION BY series_id)),
cums AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY t) AS cum FROM res)""")


def _kpss(spark, sf, regression):
    k = TS.kpss(_panel(spark, sf), "y", "period", series="series_id", regression=regression)
    return _rounded(k, {"kpss_stat": 8, "kpss_pvalue": 8})


@register("k13_kpss_level", _kpss_sql(False))
def q_kpss_level(spark, sf):
    """KPSS around a level; the oracle sums Bartlett-weighted autocovariances lag by lag."""
    return _kpss(spark, sf, "level")


@register("k13_kpss_trend", _kpss_sql(True))
def q_kpss_trend(spark, sf):
    """KPSS around a linear trend."""
    return _kpss(spark, sf, "trend")


def _decompose_sql(source: str, keys: str, key: str, by: str, x: str, m: int, digits: int) -> str:
    h = m // 2
    ends = "" if m % 2 else f" - (lag(x, {h}) OVER o + lead(x, {h}) OVER o) / 2"
    return f"""num AS (SELECT {keys}, {x} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {by}) - 1 AS t FROM {source}),
mov AS (SELECT *, CASE WHEN count(x) OVER r = {2 * h + 1} THEN (sum(x) OVER r{ends}) / {m} END AS tr FROM num
        WINDOW o AS (PARTITION BY {key} ORDER BY t), r AS (PARTITION BY {key} ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
ph AS (SELECT {key}, t % {m} AS k, avg(x - tr) AS f FROM mov GROUP BY 1, 2),
se AS (SELECT {key}, k, f - avg(f) OVER (PARTITION BY {key}) AS s FROM ph),
fin AS (SELECT {keys}, {R("tr", digits)} AS trend, {R("s", digits)} AS seasonal, {R("x - tr - s", digits)} AS resid
        FROM mov JOIN se USING ({key}) WHERE t % {m} = k)"""


@register("k13_seasonal_decompose", with_panel("SELECT series_id, period, trend, seasonal, resid FROM fin", _decompose_sql(
    "panel", "series_id, period", "series_id", "period", "avg_order_value", 12, 4)))
def q_decompose(spark, sf):
    """Yearly decomposition of every segment's monthly order value."""
    d = TS.seasonal_decompose(_panel(spark, sf), "avg_order_value", 12, "period", series="series_id")
    return d.select("series_id", "period", *[rnd(f"avg_order_value_{n}", 4).alias(n) for n in ("trend", "seasonal", "resid")])


@register("k13_seasonal_decompose_hot_series", "WITH " + _decompose_sql(
    "orders", "o_orderstatus, o_orderkey", "o_orderstatus", "o_orderdate, o_orderkey", "o_totalprice", 7, 3) + """
SELECT o_orderstatus, o_orderkey, trend, seasonal, resid FROM fin""")
def q_decompose_hot(spark, sf):
    """Three series of all orders (by status), in buckets with a halo on both sides."""
    o = P.order_sequence(spark, sf, key="o_orderstatus")
    d = TS.seasonal_decompose(o, "o_totalprice", 7, ["o_orderdate", "o_orderkey"], series="o_orderstatus", bucket_rows=4096)
    return d.select("o_orderstatus", "o_orderkey", *[rnd(f"o_totalprice_{n}", 3).alias(n) for n in ("trend", "seasonal", "resid")])


@register("k5_interpolate_hot_series", f"""
SELECT o_orderstatus, o_orderkey, {R("coalesce(v, pv + (nv - pv) * (t - pt) / nullif(nt - pt, 0))", 4)} AS v FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
         first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt FROM (
    SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS t FROM orders) x
  WINDOW b AS (PARTITION BY o_orderstatus ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY o_orderstatus ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) y""")
def q_k5(spark, sf):
    """K5: order values with two of three blanked, interpolated within each status over all orders."""
    o = P.order_sequence(spark, sf, key="o_orderstatus").withColumn(
        "v", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")))
    out = FE.interpolate_linear(o, ["v"], series="o_orderstatus", order=["o_orderdate", "o_orderkey"], bucket_rows=4096)
    return out.select("o_orderstatus", "o_orderkey", rnd("v", 4).alias("v"))
