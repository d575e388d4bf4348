"""Validation, tuning and selection.

Folds are row-position ranges on an explicitly ordered frame (consecutive
positions come from ``with_row_pos``; no single-partition window). Each fit
is a Spark job on a filtered, cached training frame; grid points x folds run
from a small driver thread pool so several short jobs share the cluster.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import LINEAR_KINDS, FoldGram
from .models import FittedModel, ModelSpec, expand_grid, fit_model, is_numeric_failure


@dataclass(frozen=True)
class Fold:
    fold: int
    train_end: int     # train rows: [0, train_end)
    test_start: int
    test_end: int      # test rows: [test_start, test_end)


def expanding_folds(n: int, k: int = 5) -> list[Fold]:
    """V1: scikit-learn ``TimeSeriesSplit(k)``: test size n // (k + 1); fold
    i tests [n - (k - i) ts, n - (k - i - 1) ts) and trains on all earlier
    rows. n = 398, k = 5 -> tests start at 68, 134, 200, 266, 332."""
    ts = n // (k + 1)
    if ts < 1:
        raise ValueError(f"too few rows ({n}) for {k} folds")
    out = []
    for i in range(k):
        s = n - (k - i) * ts
        out.append(Fold(i, s, s, s + ts))
    return out


def adaptive_k(n: int) -> int:
    """V2: min(10, max(3, n // 20))."""
    return min(10, max(3, n // 20))


def regression_metrics(df: DataFrame, label: str, pred: str = "prediction", by=None) -> DataFrame:
    """MSE, RMSE, MAE and R^2 of (label, prediction) in one aggregate."""
    by = [by] if isinstance(by, str) else list(by or [])
    e = F.col(label) - F.col(pred)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), F.var_pop(label).alias("_vy"))
    return (out.withColumn("rmse", F.sqrt("mse"))
            .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n")))
            .drop("_sse", "_vy"))


def _mse(fm: FittedModel, test: DataFrame, label: str) -> float:
    r = fm.transform(test).agg(F.avg((F.col(label) - F.col("prediction")) ** 2)).first()[0]
    return float(r) if r is not None else float("nan")


def cross_validate(spec: ModelSpec, data: DataFrame, features: list, label: str,
                   folds: list[Fold], params: dict | None = None, pos: str = "row_pos",
                   parallelism: int = 4, gram: FoldGram | None = None) -> list[float]:
    """V4 per fold: fit on [0, train_end), MSE on the test range. Linear kinds
    come from Gram sums (``gram``: already gathered ones)."""
    if spec.kind in LINEAR_KINDS:
        gram = gram or FoldGram(data, features, label, folds, pos)
        return [gram.mse(spec.kind, {**spec.params, **(params or {})}, f) for f in folds]

    def one(f: Fold):
        tr = data.where(F.col(pos) < f.train_end)
        te = data.where((F.col(pos) >= f.test_start) & (F.col(pos) < f.test_end))
        return _mse(fit_model(spec, tr, features, label, params), te, label)
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(one, folds))


def grid_search(spec: ModelSpec, data: DataFrame, features: list, label: str,
                folds: list[Fold], pos: str = "row_pos", parallelism: int = 4,
                gram: FoldGram | None = None):
    """V3: every grid point scored by mean fold MSE (score = -MSE); the first
    best wins ties; returns (best params, [(params, fold MSEs)])."""
    grid = expand_grid(spec.grid)
    jobs = [(gi, f) for gi in range(len(grid)) for f in folds]
    if spec.kind in LINEAR_KINDS:
        gram = gram or FoldGram(data, features, label, folds, pos)

    def one(job):
        gi, f = job
        if gram is not None and spec.kind in LINEAR_KINDS:
            try:
                return gram.mse(spec.kind, {**spec.params, **grid[gi]}, f)
            except (ValueError, ArithmeticError):      # numpy's LinAlgError is a ValueError
                return float("inf")
        tr = data.where(F.col(pos) < f.train_end)
        te = data.where((F.col(pos) >= f.test_start) & (F.col(pos) < f.test_end))
        try:
            return _mse(fit_model(spec, tr, features, label, grid[gi]), te, label)
        except Exception as e:
            if not is_numeric_failure(e):
                raise
            return float("inf")                        # a grid point that cannot be fitted loses
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        mses = list(ex.map(one, jobs))
    per = [(grid[gi], [mses[i] for i, (g, _) in enumerate(jobs) if g == gi])
           for gi in range(len(grid))]
    mean = [sum(m) / len(m) for _, m in per]
    if all(map(math.isnan, mean)):
        raise ValueError("no grid point has an error on every fold")
    best = min(range(len(per)), key=lambda i: (math.isnan(mean[i]), mean[i], i))       # NaN loses
    return per[best][0], per


def cv_rmse(fold_mse: list[float]) -> tuple[float, float, list[float]]:
    """V4: sqrt per fold, mean and POPULATION std (numpy default)."""
    r = [math.sqrt(m) for m in fold_mse]
    mean = sum(r) / len(r)
    std = math.sqrt(sum((x - mean) ** 2 for x in r) / len(r))
    return mean, std, r


def train_models(specs: list[ModelSpec], data: DataFrame, features: list, label: str,
                 k: int = 5, pos: str = "row_pos", parallelism: int = 4):
    """V5: tune each model (V3), cross-validate the best params (V4), log
    and skip failures; returns (results DataFrame, champion name, fitted
    champion refit on all rows). Results: model, params, fold, mse, error."""
    spark = data.sparkSession
    data = data.persist()
    n = data.count()
    folds = expanding_folds(n, k)
    gram = FoldGram(data, features, label, folds, pos) if any(s.kind in LINEAR_KINDS for s in specs) else None
    rows, summary = [], []
    for order, spec in enumerate(specs):
        try:
            best, _ = grid_search(spec, data, features, label, folds, pos, parallelism, gram) \
                if spec.grid else ({}, None)
            mses = cross_validate(spec, data, features, label, folds, best, pos, parallelism, gram)
            mean, std, r = cv_rmse(mses)
            for f, m in zip(folds, mses):
                rows.append((spec.name, str(best), order, f.fold, float(m), None))
            summary.append((order, spec, best, mean, std))
        except Exception as e:
            if not is_numeric_failure(e):
                raise
            rows.append((spec.name, None, order, None, None, f"{type(e).__name__}: {e}"[:300]))
    res = spark.createDataFrame(rows, "model string, params string, registry_pos int, fold int, "
                                      "mse double, error string")
    if not summary:
        data.unpersist()
        raise RuntimeError("every model failed")
    if all(math.isnan(t[3]) for t in summary):
        data.unpersist()
        raise RuntimeError("no model has an error on every fold")
    order, spec, best, _, _ = min(summary, key=lambda t: (math.isnan(t[3]), t[3], t[0]))   # T4: first wins ties, NaN loses
    champion = fit_model(spec, data, features, label, best)
    data.unpersist()
    return res, spec.name, champion


def comparison_table(results: DataFrame) -> DataFrame:
    """Per model CV RMSE mean and population std, sorted by the
    mean, with the champion flagged (first in registry order on a tie)."""
    from pyspark.sql import Window
    t = (results.where(F.col("error").isNull())
         .groupBy("model", "registry_pos")
         .agg(F.avg(F.sqrt("mse")).alias("cv_rmse_mean"),
              F.stddev_pop(F.sqrt("mse")).alias("cv_rmse_std")))
    w = Window.orderBy("cv_rmse_mean", "registry_pos")      # one row per model
    return t.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


def holdout_split(df: DataFrame, key: str, test_share: float = 0.2):
    """V6: repeatable hash split on a key of any type, not ``randomSplit``: the
    share is the first 32 bits of the MD5 of the key's text, so the same key
    always lands on the same side, whatever its size or the partitioning. A
    null key counts as the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    flag = u < F.lit(test_share)
    return df.where(~flag), df.where(flag)


def best_experiment(results: DataFrame, metric: str = "r2") -> DataFrame:
    """Best experiment; the direction follows the metric (max for r2,
    min for error metrics), fixing the reference's always-max."""
    higher = metric.lower() in ("r2", "r_squared", "accuracy")
    pick = F.max_by if higher else F.min_by
    return results.agg(pick("experiment", metric).alias("experiment"),
                       (F.max(metric) if higher else F.min(metric)).alias(metric))
