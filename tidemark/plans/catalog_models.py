"""Catalog entries for models, validation and scoring
(M1-M12, V1-V7, T4-T6, A20, G1, G6, G7, G9, O1-O7, P12, P13, S6-S10)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import models as M
from ..operators import profile as PR
from ..operators import scoring as S
from ..operators import validation as V
from ..operators import windows as W
from ..operators.gram import linear_grid
from ..session import ensure_checkpoint_dir, materialize
from ..sources import panels as P
from .catalog import FEATS, register
from .catalog_profile import CUTOFF, _panel, _rounded, _scen_sql, _scenarios
from .sqlparts import R, with_panel

POS_CTE = ("pos AS (SELECT *, CAST(row_number() OVER (ORDER BY period, series_id) - 1 AS BIGINT) "
           "AS rp FROM panel)")


def _panel_pos(spark, sf):
    return W.with_row_pos(_panel(spark, sf), ["period", "series_id"], "row_pos")


def model_root(spark) -> str:
    """Model packages live beside the shared checkpoint folder, never in a
    machine-local temporary folder."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/tidemark-models"


# ----------------------------------------------------------------- M1 / M2 / M3

@register("m1_ols_lineitem", f"""
SELECT {R('regr_intercept(l_extendedprice, l_quantity)', 6)} AS intercept,
       {R('regr_slope(l_extendedprice, l_quantity)', 6)} AS coef FROM lineitem""")
def q_m1(spark, sf):
    """M1 on every lineitem row: price on quantity (normal equations: one
    aggregate of the Gram matrix, distributed)."""
    li = P.lineitem_frame(spark, sf)
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), li, ["l_quantity"],
                     "l_extendedprice")
    m = fm.model
    return _rounded(spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))],
                                          "intercept double, coef double"),
                    {"intercept": 6, "coef": 6})


RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0)
LASSO_ALPHAS = (0.001, 0.01, 0.1, 1.0)


@register("m2_ridge_panel", with_panel(
    "SELECT alpha, " + R("my - b * mx", 10) + " AS intercept, " + R("b", 10) + """ AS coef FROM (
  SELECT alpha, avg(y) AS my, avg(ret_share) AS mx,
         regr_sxy(y, ret_share) / (regr_sxx(y, ret_share) + alpha) AS b
  FROM panel, (VALUES """ + ", ".join(f"({a}::DOUBLE)" for a in RIDGE_ALPHAS) + """) v(alpha)
  GROUP BY alpha) t"""))
def q_m2(spark, sf):
    """M2 ridge grid on the panel, y on ret_share; closed-form oracle
    b = Sxy / (Sxx + alpha)."""
    fits = linear_grid(_panel(spark, sf), ["ret_share"], "y", "ridge", [{"alpha": a} for a in RIDGE_ALPHAS])
    rows = [(p["alpha"], a, b[0]) for p, a, b in fits]
    return _rounded(spark.createDataFrame(rows, "alpha double, intercept double, coef double"),
                    {"intercept": 10, "coef": 10})


@register("m3_lasso_lineitem", """
SELECT alpha, """ + R("my - b * mx", 5) + " AS intercept, " + R("b", 5) + """ AS coef FROM (
  SELECT alpha, avg(l_extendedprice / 1000) AS my, avg(l_quantity) AS mx,
         sign(covar_pop(l_extendedprice / 1000, l_quantity))
           * greatest(abs(covar_pop(l_extendedprice / 1000, l_quantity)) - alpha, 0)
           / var_pop(l_quantity) AS b
  FROM lineitem, (VALUES """ + ", ".join(f"({a}::DOUBLE)" for a in LASSO_ALPHAS) + """) v(alpha)
  GROUP BY alpha) t""")
def q_m3(spark, sf):
    """M3 lasso grid over every lineitem row (price in thousands on
    quantity); oracle: soft-threshold of cov(x, y) at alpha over var(x)."""
    li = P.lineitem_frame(spark, sf).select(
        (F.col("l_extendedprice") / 1000).alias("price_k"), "l_quantity")
    fits = linear_grid(li, ["l_quantity"], "price_k", "lasso", [{"alpha": a} for a in LASSO_ALPHAS])
    rows = [(p["alpha"], a, b[0]) for p, a, b in fits]
    return _rounded(spark.createDataFrame(rows, "alpha double, intercept double, coef double"),
                    {"intercept": 5, "coef": 5})


ENET_GRID = [(a, l1) for a in (0.1, 1.0) for l1 in (0.1, 0.5, 0.9)]


@register("m4_elastic_net_lineitem", """
SELECT alpha, l1_ratio, """ + R("my - b * mx", 5) + " AS intercept, " + R("b", 5) + """ AS coef FROM (
  SELECT alpha, l1_ratio, avg(l_extendedprice / 1000) AS my, avg(l_quantity) AS mx,
         sign(covar_pop(l_extendedprice / 1000, l_quantity))
           * greatest(abs(covar_pop(l_extendedprice / 1000, l_quantity)) - alpha * l1_ratio, 0)
           / (var_pop(l_quantity) + alpha * (1 - l1_ratio)) AS b
  FROM lineitem, (VALUES """ + ", ".join(f"({a}::DOUBLE, {l1}::DOUBLE)" for a, l1 in ENET_GRID)
    + """) v(alpha, l1_ratio)
  GROUP BY alpha, l1_ratio) t""")
def q_m4(spark, sf):
    """M4 elastic net over every lineitem row, grid alpha x l1_ratio, in
    scikit-learn's parameterisation, from one set of Gram sums; oracle:
    the one-feature closed form soft(cov, alpha*l1) / (var + alpha*(1-l1))."""
    li = P.lineitem_frame(spark, sf).select(
        (F.col("l_extendedprice") / 1000).alias("price_k"), "l_quantity")
    fits = linear_grid(li, ["l_quantity"], "price_k", "enet", [{"alpha": a, "l1_ratio": l1} for a, l1 in ENET_GRID])
    rows = [(p["alpha"], p["l1_ratio"], a, b[0]) for p, a, b in fits]
    return _rounded(spark.createDataFrame(rows, "alpha double, l1_ratio double, intercept double, "
                                                "coef double"), {"intercept": 5, "coef": 5})


# ----------------------------------------------------------------- M7-M10 (group-mean oracle)

GLMS = [("GLM_Gamma_Log", {"family": "gamma", "link": "log"}),
        ("GLM_Gamma_Identity", {"family": "gamma", "link": "identity"}),
        ("GLM_Gaussian_Log", {"family": "gaussian", "link": "log"}),
        ("GLM_Tweedie_1.1", {"family": "tweedie", "var_power": 1.1, "link": "log"}),
        ("GLM_Tweedie_1.5", {"family": "tweedie", "var_power": 1.5, "link": "log"}),
        ("GLM_Tweedie_1.9", {"family": "tweedie", "var_power": 1.9, "link": "log"})]


def _segment_dummies(df):
    levels = sorted(r[0] for r in df.select("series_id").distinct().collect())   # few segments
    cols = {f"is_{lv}": F.expr(f"CAST(series_id = '{lv}' AS DOUBLE)") for lv in levels[1:]}
    return df.withColumns(cols), list(cols)


@register("m7_m10_glm_group_means", with_panel(
    "SELECT model, series_id, " + R("avg(y)", 9) + " AS prediction FROM panel, (VALUES "
    + ", ".join(f"('{n}')" for n, _ in GLMS) + ") v(model) WHERE y > 0 GROUP BY model, series_id"))
def q_m7(spark, sf):
    """GLMs with an intercept and segment dummies fit each segment's
    mean for every family and link, so avg(y) per segment is the exact
    oracle. Tweedie uses linkPower 0 (Spark ignores link='log' there).
    Gamma and log links need a positive label, so cells with y = 0 (they
    occur at the smallest scale) are not part of the fit."""
    return _glm_group_means(spark, sf, GLMS)


def _glm_group_means(spark, sf, glms):
    # build the panel once: the dummy levels and every fit read this cache
    base = _panel(spark, sf).where(F.col("y") > 0).cache()
    base.count()
    p, dums = _segment_dummies(base)

    def fit(item):
        name, params = item
        fm = M.fit_model(M.ModelSpec(name, "glm", params), p, dums, "y")
        if fm.fallback:
            raise RuntimeError(f"{name} fell back: {fm.fallback}")
        return (fm.transform(p).groupBy("series_id").agg(F.avg("prediction").alias("prediction"))
                .withColumn("model", F.lit(name)))
    # the fits are independent Spark jobs on one cached frame: run them side by side
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(4, len(glms))) as ex:
        parts = list(ex.map(fit, glms))
    out = parts[0]
    for pr in parts[1:]:
        out = out.unionByName(pr)
    return _rounded(out.select("model", "series_id", "prediction"), {"prediction": 9})


M8_GLMS = [("GLM_Gamma_Identity", {"family": "gamma", "link": "identity"})]


@register("m8_glm_gamma_identity", with_panel(
    "SELECT 'GLM_Gamma_Identity' AS model, series_id, " + R("avg(y)", 9)
    + " AS prediction FROM panel WHERE y > 0 GROUP BY series_id"))
def q_m8(spark, sf):
    """M8: Gamma GLM with the identity link; with segment dummies it fits
    each segment's mean, so avg(y) per segment is the exact oracle."""
    return _glm_group_means(spark, sf, M8_GLMS)


# ----------------------------------------------------------------- V1 / V2

def _folds_sql(k):
    return with_panel(f"""
SELECT fold, test_start AS train_end, test_start, test_start + ts AS test_end,
       CAST(count(*) FILTER (WHERE rp < test_start) AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE rp >= test_start AND rp < test_start + ts) AS BIGINT) AS n_test,
       min(period) FILTER (WHERE rp >= test_start AND rp < test_start + ts) AS test_first_period
FROM pos, (SELECT CAST(f AS BIGINT) AS fold, n // ({k} + 1) AS ts,
                  n - ({k} - f) * (n // ({k} + 1)) AS test_start
           FROM range({k}) r(f), (SELECT count(*) AS n FROM panel) c) fl
GROUP BY fold, test_start, ts""", POS_CTE)


def _folds_spark(spark, sf, k=None):
    p = _panel_pos(spark, sf)
    n = p.count()
    k = k or V.adaptive_k(n)
    folds = V.expanding_folds(n, k)
    agg = p.agg(*[e for f in folds for e in (
        F.count_if(F.col("row_pos") < f.train_end).alias(f"tr{f.fold}"),
        F.count_if((F.col("row_pos") >= f.test_start) & (F.col("row_pos") < f.test_end)).alias(f"te{f.fold}"),
        F.min(F.when((F.col("row_pos") >= f.test_start) & (F.col("row_pos") < f.test_end),
                     F.col("period"))).alias(f"fp{f.fold}"))]).first()
    rows = [(f.fold, f.train_end, f.test_start, f.test_end, agg[f"tr{f.fold}"], agg[f"te{f.fold}"],
             agg[f"fp{f.fold}"]) for f in folds]
    return spark.createDataFrame(rows, "fold long, train_end long, test_start long, test_end long, "
                                       "n_train long, n_test long, test_first_period long")


register("v1_expanding_folds", _folds_sql(5))(lambda spark, sf: _folds_spark(spark, sf, 5))
register("v2_adaptive_folds", _folds_sql("least(10, greatest(3, (SELECT count(*) FROM panel) // 20))")
         )(lambda spark, sf: _folds_spark(spark, sf))


# ----------------------------------------------------------------- V3 / V4 / V5 / T4 / T5 / G9

def _ridge_cv_sql(k=5):
    names = ", ".join(f"('Ridge_{a}', {a}::DOUBLE, {i})" for i, a in enumerate(RIDGE_ALPHAS))
    return with_panel(f"""
SELECT model, {R('m', 10)} AS cv_rmse_mean, {R('s', 10)} AS cv_rmse_std,
       CAST(row_number() OVER (ORDER BY m, ai) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY m, ai) = 1 AS is_best
FROM (SELECT model, ai, avg(sqrt(mse)) AS m, stddev_pop(sqrt(mse)) AS s FROM mse GROUP BY model, ai) t""",
                      POS_CTE + """,
fl AS (SELECT f AS fold, n - (""" + str(k) + """ - f) * (n // """ + str(k + 1) + """) AS s,
              n - (""" + str(k) + """ - f) * (n // """ + str(k + 1) + """) + n // """ + str(k + 1) + """ AS e
       FROM range(""" + str(k) + """) r(f), (SELECT count(*) AS n FROM panel) c),
al AS (SELECT * FROM (VALUES """ + names + """) v(model, alpha, ai)),
tr AS (SELECT fold, avg(ret_share) AS mx, avg(y) AS my, regr_sxy(y, ret_share) AS sxy,
              regr_sxx(y, ret_share) AS sxx FROM fl JOIN pos ON rp < fl.s GROUP BY fold),
cf AS (SELECT fold, model, ai, sxy / (sxx + alpha) AS b, my - sxy / (sxx + alpha) * mx AS a FROM tr, al),
mse AS (SELECT cf.model, cf.ai, cf.fold, avg(power(y - (a + b * ret_share), 2)) AS mse
        FROM cf JOIN fl USING (fold) JOIN pos ON rp >= fl.s AND rp < fl.e GROUP BY 1, 2, 3)""")


@register("v3_t5_ridge_cv_comparison", _ridge_cv_sql())
def q_v3(spark, sf):
    """A ridge grid scored by expanding-window CV (fit
    per fold, MSE on the next block), CV RMSE mean and population std per
    model, sorted, champion flagged (first in registry order on ties)."""
    p = _panel_pos(spark, sf)
    specs = [M.ModelSpec(f"Ridge_{a}", "ridge", {"alpha": a}) for a in RIDGE_ALPHAS]
    res, champ, _ = V.train_models(specs, p, ["ret_share"], "y", k=5)
    t = V.comparison_table(res).select("model", "cv_rmse_mean", "cv_rmse_std",
                                       F.col("rank").cast("int").alias("rank"), "is_best")
    return _rounded(t, {"cv_rmse_mean": 10, "cv_rmse_std": 10})


_GRIDS = {s.name: s.grid["alpha"] for s in M.linear_registry() if s.name in ("Ridge", "Lasso")}


def _grid_sql(k=5):
    """Ridge and lasso of y on ret_share in closed form, per grid point and fold."""
    points = ", ".join(f"('{m}', {a}::DOUBLE, {i})" for m, grid in _GRIDS.items() for i, a in enumerate(grid))
    slope = ("CASE model WHEN 'Ridge' THEN sxy / (sxx + alpha) "
             "ELSE sign(sxy) * greatest(abs(sxy) / tn - alpha, 0) / (sxx / tn) END")
    return with_panel(f"""
SELECT model, alpha, {R('avg(mse)', 14)} AS cv_mse,
       row_number() OVER (PARTITION BY model ORDER BY avg(mse), ai) = 1 AS is_best
FROM mse GROUP BY model, alpha, ai""", POS_CTE + f""",
fl AS (SELECT f AS fold, n - ({k} - f) * (n // {k + 1}) AS s, n - ({k} - f) * (n // {k + 1}) + n // {k + 1} AS e
       FROM range({k}) r(f), (SELECT count(*) AS n FROM panel) c),
al AS (SELECT * FROM (VALUES {points}) v(model, alpha, ai)),
tr AS (SELECT fold, count(*) AS tn, avg(ret_share) AS mx, avg(y) AS my, regr_sxy(y, ret_share) AS sxy,
              regr_sxx(y, ret_share) AS sxx FROM fl JOIN pos ON rp < fl.s GROUP BY fold),
cf AS (SELECT fold, model, alpha, ai, {slope} AS b, my - ({slope}) * mx AS a FROM tr, al),
mse AS (SELECT cf.model, cf.alpha, cf.ai, cf.fold, avg(power(y - (a + b * ret_share), 2)) AS mse
        FROM cf JOIN fl USING (fold) JOIN pos ON rp >= fl.s AND rp < fl.e GROUP BY 1, 2, 3, 4)""")


@register("v3_grid_search", _grid_sql())
def q_v3_grid(spark, sf):
    """V3 over the registry's ridge and lasso grids: every grid point's mean
    fold MSE, the best of each model flagged (first wins ties)."""
    p = _panel_pos(spark, sf).persist()
    folds = V.expanding_folds(p.count(), 5)
    gram = V.FoldGram(p, ["ret_share"], "y", folds)
    rows = []
    for spec in M.linear_registry():
        if spec.name in _GRIDS:
            best, scored = V.grid_search(spec, p, ["ret_share"], "y", folds, gram=gram)
            rows += [(spec.name, float(g["alpha"]), float(sum(m) / len(m)), g == best) for g, m in scored]
    p.unpersist()
    return _rounded(spark.createDataFrame(rows, "model string, alpha double, cv_mse double, is_best boolean"), {"cv_mse": 14})


# ----------------------------------------------------------------- G1 / A20 / G6

@register("g1_evaluate_ols_panel", with_panel(f"""
SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(power(y - p, 2))', 14)} AS mse,
       {R('sqrt(avg(power(y - p, 2)))', 11)} AS rmse, {R('avg(abs(y - p))', 11)} AS mae,
       {R('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))', 9)} AS r2,
       {R('min(p)', 10)} AS pred_min, {R('max(p)', 10)} AS pred_max,
       {R('min(y)', 10)} AS actual_min, {R('max(y)', 10)} AS actual_max
FROM (SELECT y, regr_intercept(y, ret_share) OVER () + regr_slope(y, ret_share) OVER () * ret_share AS p
      FROM panel) t"""))
def q_g1(spark, sf):
    """Refit on all rows, metrics in one aggregate, and the
    actual / predicted ranges behind the 45-degree plot."""
    p = _panel(spark, sf)
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), p, ["ret_share"], "y")
    pr = fm.transform(p)
    met = V.regression_metrics(pr, "y")
    rng = pr.agg(F.min("prediction").alias("pred_min"), F.max("prediction").alias("pred_max"),
                 F.min("y").alias("actual_min"), F.max("y").alias("actual_max"))
    out = _one_row(met, rng)
    return _rounded(out.select("n", "mse", "rmse", "mae", "r2", "pred_min", "pred_max",
                               "actual_min", "actual_max"),
                    {"mse": 14, "rmse": 11, "mae": 11, "r2": 9, "pred_min": 10, "pred_max": 10,
                     "actual_min": 10, "actual_max": 10})


_RES_CTE = """
res AS (SELECT series_id, period, y, ret_share, y - (regr_intercept(y, ret_share) OVER () + regr_slope(y, ret_share) OVER () * ret_share) AS e
        FROM panel)"""


def _residuals(spark, sf):
    """Least squares of y on ret_share: fitted and residual columns beside the label."""
    p = materialize(_panel(spark, sf))
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), p, ["ret_share"], "y")
    return fm.transform(p).withColumn("e", F.col("y") - F.col("prediction"))


@register("g6_residual_rows", with_panel(
    f"SELECT series_id, period, {R('y - e', 10)} AS fitted, {R('e', 10)} AS residual FROM res", _RES_CTE))
def q_g6(spark, sf):
    """Fitted value and residual of every row."""
    out = _residuals(spark, sf).select("series_id", "period", F.col("prediction").alias("fitted"), F.col("e").alias("residual"))
    return _rounded(out, {"fitted": 10, "residual": 10})


@register("g2_residual_histogram", with_panel(f"""
SELECT bin, {R('mn + (mx - mn) * bin / 20', 9)} AS lower, {R('mn + (mx - mn) * (bin + 1) / 20', 9)} AS upper,
       CAST(count(*) AS BIGINT) AS count
FROM (SELECT CAST(least(floor((e - mn) * 20.0 / (mx - mn)), 19) AS BIGINT) AS bin, mn, mx
      FROM res, (SELECT min(e) AS mn, max(e) AS mx FROM res) s) t GROUP BY bin, mn, mx""", _RES_CTE))
def q_g2_res(spark, sf):
    """The residuals in 20 equal bins."""
    return _rounded(PR.histogram(_residuals(spark, sf), "e", bins=20), {"lower": 9, "upper": 9})


@register("g3_residual_qq")
def q_g3_res(spark, sf):
    """Normal quantiles against the sorted residuals (DuckDB has no normal quantile function)."""
    from ..operators import tests as TS
    return TS.qq_points(_residuals(spark, sf), "e")


@register("g8_actual_vs_predicted", with_panel(f"""
SELECT series_id, period, {R('y', 10)} AS actual, {R('p', 10)} AS predicted FROM (
  SELECT series_id, period, y,
         regr_intercept(y, ret_share) OVER () + regr_slope(y, ret_share) OVER () * ret_share AS p
  FROM panel) t"""))
def q_g8(spark, sf):
    """The target over time beside the model's prediction, per series
    (the data behind the actual-vs-predicted line plots), ordered by series
    and period."""
    p = _panel(spark, sf)
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), p, ["ret_share"], "y")
    out = fm.transform(p).select("series_id", "period", F.col("y").alias("actual"),
                                 F.col("prediction").alias("predicted"))
    return _rounded(out, {"actual": 10, "predicted": 10}).orderBy("series_id", "period")


def _one_row(a, b):
    """Side-by-side of two one-row aggregates (values of the second inlined)."""
    r = b.first().asDict()
    return a.withColumns({k: F.lit(v) for k, v in r.items()})


# ----------------------------------------------------------------- O1 / O2 / O4 / O5 / P12 / P13

def _scored(spark, sf):
    s = _scenarios(spark, sf)
    # a small aggregate of three tables: built once for the statistics, the fit and the scores
    x = materialize(W.add_lag_roll(s, ["ret_share"], (1,), (), series=["scenario", "series_id"], order="period"))
    hist = x.where((F.col("scenario") == 0) & (F.col("period") < CUTOFF))
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), hist.dropna(subset=["ret_share_lag_1"]),
                     ["ret_share_lag_1"], "y")
    fut = x.where(F.col("period") >= CUTOFF)
    return S.with_confidence(fm.transform(fut)).select(
        "scenario", "series_id", "period", "y", "prediction", "confidence")


_O4_CTES = _scen_sql() + """,
lagd AS (SELECT *, lag(ret_share, 1) OVER (PARTITION BY scenario, series_id ORDER BY period) AS l1 FROM scen),
fitc AS (SELECT regr_intercept(y, l1) AS a, regr_slope(y, l1) AS b FROM lagd
         WHERE scenario = 0 AND period < """ + str(CUTOFF) + """ AND l1 IS NOT NULL),
sc AS (SELECT scenario, series_id, period, y, a + b * l1 AS prediction FROM lagd, fitc
       WHERE period >= """ + str(CUTOFF) + ")"


@register("o4_scenario_scoring", with_panel(
    f"SELECT scenario, series_id, period, {R('y', 10)} AS y, {R('prediction', 10)} AS prediction, "
    "0.95::DOUBLE AS confidence FROM sc", _O4_CTES))
def q_o4(spark, sf):
    """Fit on the history block, then score the futures of every
    scenario in ONE plan; lags are per (scenario, series), so blocks never
    read each other's rows (defect D5 fixed)."""
    return _rounded(_scored(spark, sf), {"y": 10, "prediction": 10})


@register("o5_last_prediction_per_series", with_panel(
    f"SELECT scenario, series_id, period, {R('prediction', 10)} AS prediction FROM ("
    "SELECT *, row_number() OVER (PARTITION BY scenario, series_id ORDER BY period DESC) AS rk FROM sc) t "
    "WHERE rk = 1", _O4_CTES))
def q_o5(spark, sf):
    last = S.last_per_series(_scored(spark, sf).select("scenario", "series_id", "period", "prediction"),
                             ["scenario", "series_id"], "period")
    return _rounded(last, {"prediction": 10})


@register("p12_p13_history_check", with_panel(f"""
SELECT scenario, series_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS min_rows,
       count(*) >= 6 AS ok FROM scen WHERE period >= {CUTOFF} GROUP BY scenario, series_id""", _scen_sql()))
def q_p12(spark, sf):
    req = S.prediction_requirements([1, 2], [3, 6], FEATS, FEATS)
    fut = _scenarios(spark, sf).where(F.col("period") >= CUTOFF)
    return S.history_check(fut, ["scenario", "series_id"], req["min_rows"])


# ----------------------------------------------------------------- V6

@register("v6_holdout_split", """
SELECT CASE WHEN u < 0.2 THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM (SELECT o_totalprice, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT)
                            / 4294967296.0::DOUBLE AS u
      FROM orders) t GROUP BY 1""")
def q_v6(spark, sf):
    o = P.read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    tr, te = V.holdout_split(o, "o_orderkey", 0.2)
    agg = lambda d, n: d.agg(F.lit(n).alias("split"), F.count(F.lit(1)).alias("n_rows"),
                             F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("value_cents"))
    return agg(tr, "train").unionByName(agg(te, "test"))


# ----------------------------------------------------------------- rows-only model entries

def _model_frame(spark, sf):
    p = W.add_lag_roll(_panel(spark, sf), FEATS, (1, 2), (3, 6), series="series_id", order="period")
    cols = [c for c in p.columns if c not in ("series_id", "period", "year", "y")]
    return p.dropna(subset=cols + ["y"]), cols


@register("m5_random_forest_predictions")
def q_m5(spark, sf):
    d, cols = _model_frame(spark, sf)
    fm = M.fit_model(M.ModelSpec("Random Forest", "rf", {"seed": 42}), d, cols, "y",
                     {"n_estimators": 50, "max_depth": 10, "min_samples_split": 5})
    return fm.transform(d).select("series_id", "period", "y", "prediction")


@register("m6_gbt_predictions")
def q_m6(spark, sf):
    d, cols = _model_frame(spark, sf)
    fm = M.fit_model(M.ModelSpec("Gradient Boosting", "gbt", {"seed": 42}), d, cols, "y")
    return fm.transform(d).select("series_id", "period", "y", "prediction")


@register("m11_glm_elastic_net")
def q_m11(spark, sf):
    """Penalised Gamma-log GLM (alpha 0.01, L1 weight 0.5) by IRLS with
    one distributed Gram aggregate per iteration."""
    from ..operators.features import fit_standard_scaler
    d, cols = _model_frame(spark, sf)
    sc = fit_standard_scaler(d, cols)
    ds = sc.transform(d)
    fm = M.fit_model(M.ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}),
                     ds, cols, "y", {"alpha": 0.01})
    names = (["intercept"] if fm.fit_intercept else []) + cols
    return spark.createDataFrame(list(zip(names, fm.coef)), "term string, coef double")


@register("m12_glm_fallback")
def q_m12(spark, sf):
    """A Gamma fit on a target containing zeros is refused and falls
    back to least squares, recorded in the ``fallback`` column."""
    p = _panel(spark, sf)
    mn = p.agg(F.min("y")).first()[0]
    p = p.withColumn("y0", F.col("y") - F.lit(mn))          # has a zero now
    fm = M.fit_model(M.ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}),
                     p, ["ret_share", "avg_tax"], "y0")
    return fm.transform(p).select("series_id", "period", "prediction",
                                  F.lit(fm.fallback).alias("fallback"))


@register("o3_forest_uncertainty")
def q_o3(spark, sf):
    d, cols = _model_frame(spark, sf)
    fm = M.fit_model(M.ModelSpec("Random Forest", "rf", {"seed": 42}), d, cols, "y",
                     {"n_estimators": 20, "max_depth": 6})
    return M.predict_with_uncertainty(fm, d).select("series_id", "period", "pred_mean", "pred_std")


@register("g7_feature_importances")
def q_g7(spark, sf):
    d, cols = _model_frame(spark, sf)
    fm = M.fit_model(M.ModelSpec("Random Forest", "rf", {"seed": 42}), d, cols, "y",
                     {"n_estimators": 50, "max_depth": 10})
    imp = M.feature_importances(fm)
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(imp)],
                                 "feature string, importance double, rank int")


@register("v5_o7_train_flow")
def q_v5(spark, sf):
    """The whole training flow on the month panel (impute, lags,
    rolling, select-k, robust scaling, expanding CV of several models,
    champion) and the comparison table (T5/G9)."""
    from .training import TrainConfig, train
    p = _panel(spark, sf).drop("year").where(F.col("period") < CUTOFF)
    cfg = TrainConfig(target="y", time_col="period", series=["series_id"], features=list(FEATS),
                      lags=[1, 2], windows=[3, 6])
    specs = [M.ModelSpec("Linear Regression", "linear"),
             M.ModelSpec("Ridge", "ridge", {"alpha": 1.0}),
             M.ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}),
             M.ModelSpec("GLM_Gaussian_Log", "glm", {"family": "gaussian", "link": "log"})]
    pr = train(p, cfg, specs)
    return V.comparison_table(pr.results).select("model", "cv_rmse_mean", "cv_rmse_std", "rank",
                                                 "is_best")


# Least squares of y on ret_share and its lag 1, fitted on complete history rows;
# when scoring, a series' first lag is carried back from its second row.
_TWO_CTES = f"""
eng AS (SELECT series_id, period, y, ret_share AS x1, lag(ret_share, 1) OVER w AS x2 FROM panel
        WINDOW w AS (PARTITION BY series_id ORDER BY period)),
m AS (SELECT count(*) AS n, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22,
             covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
      FROM eng WHERE x2 IS NOT NULL AND period < {CUTOFF}),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
             (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
two AS (SELECT series_id, period, y, my + b1 * (x1 - m1)
               + b2 * (coalesce(x2, lead(x2) OVER (PARTITION BY series_id ORDER BY period)) - m2) AS prediction
        FROM eng, b)"""


def _two_feature_predictor(p):
    from .training import TrainConfig, fit_single
    cfg = TrainConfig(target="y", time_col="period", series=["series_id"], features=["ret_share"], lags=[1],
                      windows=[], select=False)
    return fit_single(p.where(F.col("period") < CUTOFF), cfg, M.ModelSpec("Linear Regression", "linear"))


@register("o1_predictor_scoring", with_panel(
    f"SELECT series_id, period, {R('y', 10)} AS y, {R('prediction', 9)} AS prediction, 0.95::DOUBLE AS confidence, "
    "CAST(0 AS BIGINT) AS schema_warnings FROM two", _TWO_CTES))
def q_o1(spark, sf):
    """O1 through ``Predictor.predict``: schema check (S5), lags, fill chain (F3),
    robust scaling (F5), stored feature list (P8), model, confidence (O2)."""
    p = _panel(spark, sf).drop("year")
    pr = _two_feature_predictor(p)
    out = _rounded(pr.predict(p, return_confidence=True), {"y": 10, "prediction": 9})
    return out.withColumn("schema_warnings", F.lit(pr.schema_report.count()).cast("long"))


@register("s7_s8_save_load_roundtrip", with_panel(
    f"SELECT series_id, period, {R('y', 10)} AS y, {R('prediction', 9)} AS p_saved, {R('prediction', 9)} AS p_loaded FROM two",
    _TWO_CTES))
def q_s7(spark, sf):
    """Fit, save the package to the shared model folder, load it
    back and score; the loaded predictions must equal the originals."""
    from .training import Predictor
    p = _panel(spark, sf).drop("year")
    pr = _two_feature_predictor(p)
    path = os.path.join(model_root(spark), f"best_model_{uuid.uuid4().hex[:12]}")
    pr.save(path)
    back = Predictor.load(path)
    a = pr.predict(p).withColumnRenamed("prediction", "p_saved")
    b = back.predict(p).select("series_id", "period", F.col("prediction").alias("p_loaded"))
    j = a.join(b, ["series_id", "period"])
    bad = j.where(F.abs(F.col("p_saved") - F.col("p_loaded")) > 1e-12).count()
    if bad:
        raise AssertionError(f"{bad} predictions differ after reload")
    return _rounded(j.select("series_id", "period", "y", "p_saved", "p_loaded"), {"y": 10, "p_saved": 9, "p_loaded": 9})


@register("s6_batch_score_to_parquet", with_panel(
    f"SELECT scenario, series_id, period, {R('y', 10)} AS y, {R('prediction', 10)} AS prediction, "
    "0.95::DOUBLE AS confidence FROM sc", _O4_CTES))
def q_s6(spark, sf):
    """Score a batch and write input columns plus ``prediction``; the
    query returns what was written (read back from the shared folder)."""
    out = _scored(spark, sf)
    path = os.path.join(model_root(spark), f"scored_{uuid.uuid4().hex[:12]}")
    out.write.mode("overwrite").parquet(path)
    return _rounded(spark.read.parquet(path), {"y": 10, "prediction": 10})


@register("o6_monitored_scoring", with_panel(
    f"SELECT scenario, series_id, period, {R('prediction', 10)} AS prediction, "
    f"(SELECT count(*) FROM sc) AS input_rows, "
    f"(SELECT count(*) FROM lagd WHERE period >= {CUTOFF} AND l1 IS NULL) AS input_null_lag FROM sc", _O4_CTES))
def q_o6(spark, sf):
    """Scoring with input null counts observed on the same pass."""
    s = _scenarios(spark, sf)
    x = W.add_lag_roll(s, ["ret_share"], (1,), (), series=["scenario", "series_id"], order="period")
    hist = x.where((F.col("scenario") == 0) & (F.col("period") < CUTOFF)).dropna()
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), hist, ["ret_share_lag_1"], "y")
    out, info = S.monitored(x.where(F.col("period") >= CUTOFF), fm.transform, ["ret_share_lag_1"])
    res = materialize(out.select("scenario", "series_id", "period", "prediction"))     # acting fills the observation
    obs = info["observation"].get
    return _rounded(res, {"prediction": 10}).withColumn("input_rows", F.lit(obs.get("rows"))) \
        .withColumn("input_null_lag", F.lit(obs.get("null_ret_share_lag_1")))

