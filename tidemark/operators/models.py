"""Model registry and fitting.

Every model trains with Spark ML estimators on an assembled vector column,
except the elastic-net-penalised GLM (M11), which is an IRLS loop whose every
iteration is ONE distributed aggregate of X'WX and X'Wz (p <= ~50, so the
(p+1)^2 sums are small) followed by coordinate descent on the driver.

Penalty conversions (scikit-learn loss -> Spark ``LinearRegression``):

* ridge  ||y-Xb||^2 + a||b||^2       -> regParam = a * std_pop(y) / n, elasticNetParam 0
* lasso  1/(2n)||y-Xb||^2 + a|b|_1   -> regParam = a, elasticNetParam 1
* enet   a*l1|b|_1 + a(1-l1)/2||b||^2 -> A = a*l1, B = a(1-l1)*std_pop(y):
  regParam = A + B, elasticNetParam = A / (A + B)

all with ``standardization=False`` (Spark scales its L2 term by the label's
standard deviation; the L1 term is not scaled).
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor,
                                   GeneralizedLinearRegression,
                                   GeneralizedLinearRegressionModel,
                                   LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit

VEC = "_features_vec"


@dataclass
class ModelSpec:
    """A named model and its hyper-parameter grid."""
    name: str
    kind: str                     # linear ridge lasso enet rf gbt glm
    params: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)


# The reference's live registry (names, GLM families) and grids.
def reference_registry() -> list[ModelSpec]:
    """M5, M7, M9, M10 with their grids, as in the reference's live code
    (the GLM grid is alpha x fit_intercept; alpha > 0 uses the penalised GLM)."""
    glm_grid = {"alpha": [0.0, 0.01, 0.1, 1.0], "fit_intercept": [True, False]}
    return [
        ModelSpec("Random Forest", "rf", {"seed": 42},
                  {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20],
                   "min_samples_split": [2, 5]}),
        ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}, dict(glm_grid)),
        ModelSpec("GLM_Gaussian_Log", "glm", {"family": "gaussian", "link": "log"}, dict(glm_grid)),
        ModelSpec("GLM_Tweedie_1.5", "glm", {"family": "tweedie", "var_power": 1.5, "link": "log"},
                  dict(glm_grid)),
        ModelSpec("GLM_Tweedie_1.9", "glm", {"family": "tweedie", "var_power": 1.9, "link": "log"},
                  dict(glm_grid)),
    ]


def linear_registry() -> list[ModelSpec]:
    """M1-M4 and M6 with the older class's grids."""
    return [
        ModelSpec("Linear Regression", "linear"),
        ModelSpec("Ridge", "ridge", {}, {"alpha": [0.1, 1.0, 10.0, 100.0]}),
        ModelSpec("Lasso", "lasso", {}, {"alpha": [0.001, 0.01, 0.1, 1.0]}),
        ModelSpec("Elastic Net", "enet", {"alpha": 1.0, "l1_ratio": 0.5}),
        ModelSpec("Gradient Boosting", "gbt", {"seed": 42}),
    ]


def expand_grid(grid: dict) -> list[dict]:
    """Cartesian product of a parameter grid, in scikit-learn's order
    (sorted keys, last key fastest)."""
    if not grid:
        return [{}]
    keys = sorted(grid)
    out = [{}]
    for k in keys:
        out = [{**o, k: v} for o in out for v in grid[k]]
    return out


@dataclass
class FittedModel:
    spec: ModelSpec
    params: dict
    features: list
    label: str
    model: object = None              # Spark ML model, or None for own GLM
    coef: list | None = None          # own GLM: [intercept?, b1..bp]
    fit_intercept: bool = True
    link: str = "identity"
    clip: float | None = None         # P11: lower clip of GLM predictions
    fallback: str | None = None       # M12: why a fallback model is used
    train_mean: float | None = None

    def transform(self, df: DataFrame, pred: str = "prediction") -> DataFrame:
        if self.model is not None:
            x = VectorAssembler(inputCols=self.features, outputCol=VEC,
                                handleInvalid="keep").transform(df)
            out = self.model.setPredictionCol(pred).transform(x).drop(VEC)
        else:
            off = 1 if self.fit_intercept else 0
            eta = " + ".join([dlit(self.coef[0] if off else 0.0)] +
                             [f"`{c}` * {dlit(b)}" for c, b in zip(self.features, self.coef[off:])])
            out = df.withColumn(pred, F.expr(f"exp({eta})" if self.link == "log" else f"({eta})"))
        if self.clip is not None and not self.fallback:
            p = F.col(pred)
            if self.train_mean is not None:          # M12: an overflowing link gives the training mean
                p = F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(float(self.train_mean))).otherwise(p)
            # A missing input stays missing; greatest() would skip the null
            out = out.withColumn(pred, F.when(F.col(pred).isNotNull(), F.greatest(p, F.lit(self.clip))))
        return out

    # ---------------------------------------------------------------- S7 / S8
    def save(self, path: str) -> None:
        meta = {"spec": self.spec.__dict__, "params": self.params, "features": self.features,
                "label": self.label, "coef": self.coef, "fit_intercept": self.fit_intercept,
                "link": self.link, "clip": self.clip, "fallback": self.fallback,
                "train_mean": self.train_mean,
                "spark_class": type(self.model).__name__ if self.model is not None else None}
        if self.model is not None:
            self.model.write().overwrite().save(os.path.join(path, "spark_model"))
        spark = _active_spark()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "fitted"))

    @staticmethod
    def load(path: str) -> "FittedModel":
        spark = _active_spark()
        meta = json.loads(spark.read.text(os.path.join(path, "fitted")).first()[0])
        loaders = {"LinearRegressionModel": LinearRegressionModel,
                   "GeneralizedLinearRegressionModel": GeneralizedLinearRegressionModel,
                   "RandomForestRegressionModel": RandomForestRegressionModel,
                   "GBTRegressionModel": GBTRegressionModel}
        model = None
        if meta["spark_class"]:
            model = loaders[meta["spark_class"]].load(os.path.join(path, "spark_model"))
        return FittedModel(ModelSpec(**meta["spec"]), meta["params"], meta["features"],
                           meta["label"], model, meta["coef"], meta["fit_intercept"], meta["link"],
                           meta["clip"], meta["fallback"], meta["train_mean"])


def _active_spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def _label_stats(df: DataFrame, label: str):
    lab = f"`{label}`"
    r = df.selectExpr(f"count({lab}) AS n", f"stddev_pop({lab}) AS s", f"avg({lab}) AS m",
                      f"min({lab}) AS mn").first()
    return int(r["n"]), float(r["s"] or 0.0), float(r["m"] or 0.0), r["mn"]


def fit_model(spec: ModelSpec, df: DataFrame, features: list, label: str,
              params: dict | None = None) -> FittedModel:
    """Fit one model. GLM fit failures (e.g. a non-positive label with a log
    link) fall back to ordinary least squares, recorded in ``fallback`` (M12;
    the reference did this silently)."""
    p = {**spec.params, **(params or {})}
    features = list(features)
    x = VectorAssembler(inputCols=features, outputCol=VEC, handleInvalid="skip").transform(
        df.select(*features, label).where(F.col(label).isNotNull()))
    kind = spec.kind
    if kind in ("linear", "ridge", "lasso", "enet"):
        n, s, m, _ = _label_stats(x, label)          # of the rows that the fit uses
        if kind == "linear":
            est = LinearRegression(solver="normal", regParam=0.0)
        elif kind == "ridge":
            est = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False,
                                   regParam=p["alpha"] * s / max(n, 1))
        elif kind == "lasso":
            est = LinearRegression(elasticNetParam=1.0, standardization=False,
                                   regParam=p["alpha"], maxIter=1000, tol=1e-10)
        else:
            a = p.get("alpha", 1.0) * p.get("l1_ratio", 0.5)
            b = p.get("alpha", 1.0) * (1 - p.get("l1_ratio", 0.5)) * s
            est = LinearRegression(elasticNetParam=a / (a + b) if a + b else 0.0,
                                   standardization=False, regParam=a + b, maxIter=1000, tol=1e-10)
        est.setFeaturesCol(VEC).setLabelCol(label)
        return FittedModel(spec, p, features, label, est.fit(x), train_mean=m)
    if kind == "rf":
        depth = p.get("max_depth")
        est = RandomForestRegressor(
            numTrees=int(p.get("n_estimators", 100)),
            maxDepth=30 if depth is None else int(depth),      # None -> Spark's maximum
            minInstancesPerNode=max(1, int(p.get("min_samples_split", 2)) // 2),
            featureSubsetStrategy="all", seed=int(p.get("seed", 42)),
            featuresCol=VEC, labelCol=label)
        return FittedModel(spec, p, features, label, est.fit(x))
    if kind == "gbt":
        est = GBTRegressor(maxIter=int(p.get("n_estimators", 100)),
                           stepSize=float(p.get("learning_rate", 0.1)),
                           maxDepth=int(p.get("max_depth", 3)), seed=int(p.get("seed", 42)),
                           featuresCol=VEC, labelCol=label)
        return FittedModel(spec, p, features, label, est.fit(x))
    if kind == "glm":
        return _fit_glm(spec, p, df, x, features, label)
    raise ValueError(f"unknown model kind {kind!r}")


def is_numeric_failure(e: Exception) -> bool:
    """Whether a fit failed on its numbers (bad label, singular or diverging
    system). Lost executors, full disks and programming errors are not."""
    if isinstance(e, (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException)):
        return True
    text = str(e)
    return any(s in text for s in ("requirement failed", "SingularMatrixException", "singular matrix", "AssertionError"))


def _fit_glm(spec, p, df, x, features, label) -> FittedModel:
    fam, link = p.get("family", "gamma"), p.get("link", "log")
    alpha, icpt = float(p.get("alpha", 0.0)), bool(p.get("fit_intercept", True))
    n, s, m, mn = _label_stats(x, label)
    try:
        if link == "log" and mn is not None and mn <= 0 and fam in ("gamma", "gaussian"):
            raise ValueError(f"{fam} with log link needs a positive label (min {mn})")
        if fam == "gamma" and mn is not None and mn <= 0:
            raise ValueError("gamma family needs a positive label")
        if alpha > 0:
            coef = irls_elastic_net(df, features, label, fam, link, alpha,
                                    float(p.get("l1_wt", 0.5)), icpt, p.get("var_power"))
            return FittedModel(spec, p, features, label, None, coef, icpt, link, clip=0.01,
                               train_mean=m)
        if fam == "tweedie":
            # link='log' is ignored for tweedie in Spark: use linkPower 0.
            est = GeneralizedLinearRegression(family="tweedie", variancePower=p["var_power"],
                                              linkPower=0.0 if link == "log" else 1.0)
        else:
            est = GeneralizedLinearRegression(family=fam, link=link)
        est.setMaxIter(100).setTol(1e-8).setFitIntercept(icpt).setFeaturesCol(VEC) \
            .setLabelCol(label)
        return FittedModel(spec, p, features, label, est.fit(x), link=link, clip=0.01,
                           train_mean=m)
    except Exception as e:
        if not is_numeric_failure(e):
            raise
        ols = LinearRegression(solver="normal", featuresCol=VEC, labelCol=label).fit(x)
        return FittedModel(spec, p, features, label, ols, fallback=f"{type(e).__name__}: {e}"[:300],
                           train_mean=m)


# --------------------------------------------------------------------- M11

def _variance(mu, fam, vp):
    if fam == "gaussian":
        return np.ones_like(mu)
    if fam == "gamma":
        return mu ** 2
    return mu ** float(vp)


def irls_elastic_net(df: DataFrame, features: list, label: str, family: str, link: str,
                     alpha: float, l1_wt: float = 0.5, fit_intercept: bool = True,
                     var_power: float | None = None, max_iter: int = 50, tol: float = 1e-6) -> list:
    """Elastic-net GLM by IRLS. Per iteration one aggregate computes
    X'WX and X'Wz over all rows (working weights/response from the current
    coefficients, as column expressions); the penalised weighted least squares
    step (penalty alpha * ((1 - l1_wt)/2 ||b||^2 + l1_wt ||b||_1), intercept
    penalised too, as statsmodels does) is coordinate descent on the driver."""
    cols = (["_one"] if fit_intercept else []) + list(features)
    d = df.select(*features, label).dropna().withColumn("_one", F.lit(1.0))
    d = d.persist()
    try:
        n = d.count()
        r0 = d.agg(F.avg(label)).first()[0]
        beta = np.zeros(len(cols))
        if fit_intercept:
            beta[0] = math.log(r0) if link == "log" and r0 > 0 else r0
        qc = [f"`{c}`" for c in cols]
        lab = f"`{label}`"
        for _ in range(max_iter):
            eta = " + ".join(f"{c} * {dlit(b)}" for c, b in zip(qc, beta)) or "0D"
            mu = f"exp({eta})" if link == "log" else f"({eta})"
            dmu = mu if link == "log" else "1D"                 # d mu / d eta
            if family == "gaussian":
                var = "1D"
            elif family == "gamma":
                var = f"({mu} * {mu})"
            else:
                var = f"pow({mu}, {dlit(var_power)})"
            wd = d.selectExpr(*qc, f"{dmu} * {dmu} / {var} AS _w",
                              f"({eta}) + ({lab} - {mu}) / {dmu} AS _z")
            # one aggregate: upper triangle of X'WX and X'Wz
            aggs = [f"sum(_w * {a} * {b}) AS g_{i}_{j}"
                    for i, a in enumerate(qc) for j, b in enumerate(qc) if j >= i]
            aggs += [f"sum(_w * {a} * _z) AS h_{i}" for i, a in enumerate(qc)]
            row = wd.selectExpr(*aggs).first()
            k = len(cols)
            G = np.zeros((k, k))
            h = np.zeros(k)
            for i in range(k):
                h[i] = row[f"h_{i}"] / n
                for j in range(i, k):
                    G[i, j] = G[j, i] = row[f"g_{i}_{j}"] / n
            new = _cd_enet(G, h, alpha, l1_wt, beta.copy())
            if not np.all(np.isfinite(new)):
                raise ArithmeticError("the penalised GLM fit diverged")
            if np.max(np.abs(new - beta)) < tol * (1 + np.max(np.abs(beta))):
                return [float(b) for b in new]
            beta = new
        raise ArithmeticError(f"the penalised GLM fit did not converge in {max_iter} iterations")
    finally:
        d.unpersist()


def _cd_enet(G, h, alpha, l1_wt, beta, iters=1000, tol=1e-12):
    """min 1/2 b'Gb - h'b + alpha (l1_wt |b|_1 + (1 - l1_wt)/2 ||b||^2)."""
    l1, l2 = alpha * l1_wt, alpha * (1 - l1_wt)
    for _ in range(iters):
        old = beta.copy()
        for j in range(len(beta)):
            r = h[j] - G[j] @ beta + G[j, j] * beta[j]
            beta[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (G[j, j] + l2) if G[j, j] + l2 > 0 else 0.0
        if np.max(np.abs(beta - old)) < tol:
            break
    return beta


# --------------------------------------------------------------------- O3 / G7

def feature_importances(fm: FittedModel) -> list[tuple[str, float]]:
    """Tree importances (or |coefficient| for linear models), sorted."""
    m = fm.model
    if m is not None and hasattr(m, "featureImportances"):
        vals = list(m.featureImportances.toArray())
    elif m is not None and hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray()]
    else:
        off = 1 if fm.fit_intercept else 0
        vals = [abs(v) for v in (fm.coef or [])[off:]]
    return sorted(zip(fm.features, vals), key=lambda t: -t[1])


def predict_with_uncertainty(fm: FittedModel, df: DataFrame) -> DataFrame:
    """O3: mean and population std of the per-tree predictions of a forest,
    computed per row from the trees' outputs (array column + aggregate)."""
    trees = fm.model.trees
    x = VectorAssembler(inputCols=fm.features, outputCol=VEC, handleInvalid="keep").transform(df)
    names = []
    for i, t in enumerate(trees):
        n = f"_t{i}"
        x = t.setPredictionCol(n).setFeaturesCol(VEC).transform(x)
        names.append(n)
    arr = F.array(*[F.col(n) for n in names])
    k = float(len(names))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / k
    x = x.withColumn("pred_mean", mean)
    var = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - F.col("pred_mean")) ** 2) / k
    return x.withColumn("pred_std", F.sqrt(var)).drop(VEC, *names)
