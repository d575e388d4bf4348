"""Statistical tests against brute force, streaming state across
micro-batches, configuration rules, ingest helpers."""

import json
import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import tests as TS
from tidemark.operators import validation as V
from tidemark.plans import config as CF
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import ingest as IN
from tidemark.sources import store as ST
from tidemark.streaming import scoring as SS

from .conftest import SF_SMALL


def _series(n=60):
    rng = np.random.default_rng(7)
    return np.cumsum(rng.normal(size=n)) * 0.3 + np.sin(np.arange(n) / 3.0)


def _adf_brute(x, maxlag):
    """Plain numpy form of the ADF with AIC lag choice on the common sample."""
    dx = np.diff(x)

    def design(lag):
        rows = range(lag, len(dx))
        X = np.array([[1.0, x[i]] + [dx[i - j] for j in range(1, lag + 1)] for i in rows])
        return X, dx[lag:]

    def fit(X, y):
        b, *_ = np.linalg.lstsq(X, y, rcond=None)
        r = y - X @ b
        ssr, n = r @ r, len(y)
        se = math.sqrt(ssr / (n - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1])
        aic = n * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + 2 * X.shape[1]
        return b[1] / se, aic

    Xc, yc = design(maxlag)
    best = min((fit(Xc[:, :2 + lag], yc)[1], lag) for lag in range(maxlag + 1))[1]
    return fit(*design(best))[0], best


def test_adf_matches_brute_force(spark):
    x = _series()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, x double")
    r = TS.adf_test(df, "x", "t").first()
    stat, lag = _adf_brute(x, TS._adf_maxlag(len(x)))
    assert r["used_lag"] == lag
    assert abs(r["adf_stat"] - stat) < 1e-8
    assert 0.0 <= r["p_value"] <= 1.0 and r["crit_1"] < r["crit_5"] < r["crit_10"]


def test_shapiro_normal_scores_give_high_w(spark):
    from statistics import NormalDist
    n = 50
    vals = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = TS.shapiro_wilk(df, "x").first()
    assert r["w"] > 0.98 and r["p_value"] > 0.5
    skewed = spark.createDataFrame([(float(math.exp(i / 5)),) for i in range(n)], "x double")
    assert TS.shapiro_wilk(skewed, "x").first()["p_value"] < 0.01


def test_stream_lags_carry_state_across_batches(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"test_stream_{uuid.uuid4().hex[:8]}")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    mid = ev.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    ev.where(F.col("ts") < mid).coalesce(1).write.parquet(os.path.join(root, "src", "a"))
    ev.where(F.col("ts") >= mid).coalesce(1).write.parquet(os.path.join(root, "src", "b"))
    src = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", True).parquet(os.path.join(root, "src")))
    out = SS.stream_lags(src, "user_id", ["ts", "event_id"], "value", (1, 2))
    SS.run_to_parquet(out, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    got = spark.read.parquet(os.path.join(root, "out"))
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = ev.select("event_id", F.lag("value", 1).over(w).alias("e1"), F.lag("value", 2).over(w).alias("e2"))
    j = got.join(exp, "event_id")
    assert j.count() == ev.count()
    bad = j.where(~F.col("value_lag_1").eqNullSafe(F.col("e1")) | ~F.col("value_lag_2").eqNullSafe(F.col("e2")))
    assert bad.count() == 0


def test_config_rules_and_overrides():
    with pytest.raises(ValueError):
        CF.custom_config("minimal", **{"time_series.lag_periods": [0]})
    with pytest.raises(ValueError):
        CF.custom_config("minimal", **{"time_series.rolling_windows": [1]})
    c = CF.custom_config("basic_timeseries", **{"feature_selection.max_features": 30})
    assert c.feature_selection.max_features == 30
    assert CF.presets()["minimal"].steps() == ["carry_values", "lag_features", "rolling_features", "missing_values", "validation"]
    assert "feature_selection" in CF.presets()["advanced_timeseries"].steps()
    assert CF.SelectionConfig().size(398, 50) == 20
    assert CF.SelectionConfig().size(30, 50) == 5


def test_unnamed_columns_dropped(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Unnamed: 0` int, _c0 int, Annee int")
    assert IN.drop_unnamed(df).columns == ["Annee"]


def test_holdout_split_is_deterministic_and_balanced(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    tr, te = V.holdout_split(o, "o_orderkey", 0.2)
    share = te.count() / o.count()
    assert 0.15 < share < 0.25
    tr2, te2 = V.holdout_split(o.repartition(3), "o_orderkey", 0.2)
    assert te.select("o_orderkey").exceptAll(te2.select("o_orderkey")).count() == 0


def test_reference_metadata_scores(spark):
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test_meta_{uuid.uuid4().hex[:8]}"
    scores = [-4.0e-06, -9.0e-06, -1.6e-05]
    meta = {"model_name": "m", "best_model_name": "Ridge",
            "model_results": {"Ridge": {"model": "Ridge()", "cv_rmse_mean": 0.003,
                                        "cv_rmse_std": 0.000816496580927726,
                                        "cv_scores": "[-4.0e-06 -9.0e-06\n -1.6e-05]"}}}
    # written through Spark, so the folder may be any shared file system URI
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(root)
    r = ST.reference_metadata_scores(spark, root).first()
    rm = [math.sqrt(-s) for s in scores]
    assert r["n_folds"] == 3 and abs(r["mean_recomputed"] - sum(rm) / 3) < 1e-12
    assert abs(r["std_recomputed"] - r["cv_rmse_std"]) < 1e-9
