"""Nulls, offsets, huge keys, late rows, duplicated rows."""

import math
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as FE
from tidemark.operators import iforest as IF
from tidemark.operators import models as M
from tidemark.operators import profile as PR
from tidemark.operators import selection as SE
from tidemark.operators import tests as TS
from tidemark.operators import validation as V
from tidemark.operators import windows as W
from tidemark.plans import config as CF
from tidemark.session import ensure_checkpoint_dir
from tidemark.streaming import scoring as SS


def test_mutual_information_ignores_null_features(spark):
    rows = [(float(i % 5), float(i % 5)) for i in range(100)]
    clean = spark.createDataFrame(rows, "x double, y double")
    dirty = spark.createDataFrame(rows + [(None, float(i % 5)) for i in range(40)], "x double, y double")
    got = [SE.mutual_info_binned(d, ["x"], "y").first()["mi"] for d in (clean, dirty)]
    assert abs(got[0] - math.log(5)) < 1e-12 and abs(got[0] - got[1]) < 1e-12


def test_shapiro_is_unmoved_by_an_offset(spark):
    from statistics import NormalDist
    vals = [NormalDist().inv_cdf((i - 0.375) / 200.25) for i in range(1, 201)]
    a, b = (TS.shapiro_wilk(spark.createDataFrame([(v + off,) for v in vals], "x double"), "x").first() for off in (0.0, 1e9))
    assert abs(a["w"] - b["w"]) < 1e-6 and b["p_value"] > 0.5


def test_shapiro_keeps_the_null_series(spark):
    df = spark.createDataFrame([(k, float(i * i % 17)) for k in ("a", None) for i in range(30)], "k string, x double")
    got = {r["k"]: r["w"] for r in TS.shapiro_wilk(df, "x", by="k").collect()}
    assert set(got) == {"a", None} and abs(got["a"] - got[None]) < 1e-12


def test_penalty_uses_the_fitted_rows(spark):
    rows = [(float(i), 0.03 * i + (i % 3) * 0.1) for i in range(60)]
    clean = spark.createDataFrame(rows, "x double, y double")
    dirty = spark.createDataFrame(rows + [(None, 50.0 * i) for i in range(60)], "x double, y double")
    spec = M.ModelSpec("Ridge", "ridge", {"alpha": 100.0})
    a, b = (M.fit_model(spec, d, ["x"], "y").model.coefficients[0] for d in (clean, dirty))
    assert abs(a - b) < 1e-12


def test_scores_by_series_carry_their_key(spark):
    df = spark.createDataFrame([(k, float(i), float(i * (1 if k == "a" else -1) + i % 2)) for k in ("a", "b") for i in range(20)],
                               "k string, x double, y double")
    got = {r["k"]: r["corr"] for r in SE.univariate_scores(df, ["x"], "y", by="k").collect()}
    assert got["a"] > 0.9 and got["b"] < -0.9


def test_missing_feature_gives_missing_prediction(spark):
    train = spark.createDataFrame([(float(i), math.exp(0.1 * i)) for i in range(1, 30)], "x double, y double")
    fm = M.fit_model(M.ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}), train, ["x"], "y")
    fm2 = M.fit_model(M.ModelSpec("g", "glm", {"family": "gaussian", "link": "identity", "alpha": 0.001}), train, ["x"], "y")
    new = spark.createDataFrame([(None,), (1.0,)], "x double")
    for m in (fm, fm2):
        got = [r["prediction"] for r in m.transform(new).orderBy(F.col("x").asc_nulls_first()).collect()]
        assert (got[0] is None or math.isnan(got[0])) is True or got[0] == pytest.approx(m.train_mean)
        assert got[0] != 0.01 and got[1] is not None


def test_only_numeric_failures_fall_back(spark):
    assert M.is_numeric_failure(ZeroDivisionError()) and not M.is_numeric_failure(RuntimeError("executor lost"))
    bad = spark.createDataFrame([(float(i), float(i - 5)) for i in range(20)], "x double, y double")
    fm = M.fit_model(M.ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}), bad, ["x"], "y")
    assert fm.fallback and fm.fallback.startswith("ValueError")
    with pytest.raises(Exception, match="nowhere"):
        M.fit_model(M.ModelSpec("GLM_Gamma_Log", "glm", {"family": "gamma", "link": "log"}), bad, ["nowhere"], "y")


@pytest.mark.parametrize("keys", [[(2**60 + i,) for i in range(2_000)], [(f"k{i}",) for i in range(2_000)]])
def test_holdout_share_of_any_key(spark, keys):
    df = spark.createDataFrame(keys, "k long" if isinstance(keys[0][0], int) else "k string")
    _, test = V.holdout_split(df, "k", 0.2)
    assert 0.15 < test.count() / len(keys) < 0.25


def test_skew_safe_fill_keeps_rows_without_key(spark):
    rows = [(k, i, float(i) if i % 3 else None) for k in ("a", None) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    plain = W.fill_forward_backward(df, ["x"], series="k", order="t")
    safe = W.fill_forward_backward(df, ["x"], series="k", order="t", skew_safe=True, bucket_rows=5)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, safe.collect()), key=repr)


def test_late_stream_rows_are_flagged(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"test_late_{uuid.uuid4().hex[:8]}")
    first = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0)], "k string, t long, v double")
    first.coalesce(1).write.parquet(f"{root}/src/a")
    src = (spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(f"{root}/src"))
    SS.run_to_parquet(SS.stream_lags(src, "k", ["t"], "v"), f"{root}/out", f"{root}/ckpt")
    spark.createDataFrame([("a", 2, 2.0), ("a", 4, 4.0)], "k string, t long, v double").coalesce(1).write.parquet(f"{root}/src/b")
    SS.run_to_parquet(SS.stream_lags(src, "k", ["t"], "v"), f"{root}/out", f"{root}/ckpt")
    got = {r["t"]: (r["v_lag_1"], r["late"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {1: (None, False), 3: (1.0, False), 2: (None, True), 4: (3.0, False)}


def test_month_phase_and_trend_of_yyyymm(spark):
    rows = [("s", y * 100 + m, float(m + y), float(m)) for y in range(2000, 2004) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "series_id string, period long, x double, y double")
    cfg = CF.custom_config("minimal", **{"time_series.series": ["series_id"], "time_series.time_unit": "yyyymm",
                                         "time_series.seasonal_periods": [12], "time_series.trend_features": True})
    out = CF.FeaturePipeline(cfg).fit(df).transform(df).orderBy("period").toPandas()
    assert out["trend"].tolist() == list(range(48))
    assert out.groupby(out["period"] % 100)["sin_12"].nunique().max() == 1


@pytest.mark.parametrize("method", ["iqr", "zscore", "isolation_forest"])
def test_outlier_handling_has_an_effect(spark, method):
    rows = [("s", i, float(i % 7), float(i % 3)) for i in range(80)] + [("s", 80, 1e6, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, period long, x double, y double")
    base = {"time_series.series": ["series_id"], "preprocessing.outlier_method": method}
    on = CF.custom_config("minimal", **base, **{"preprocessing.handle_outliers": True})
    out = CF.FeaturePipeline(on).fit(df).transform(df)
    last = out.where("period = 80").first()
    assert last["is_outlier"] == 1.0 if method == "isolation_forest" else last["x"] < 1e6


def test_interpolation_comes_before_the_fill(spark):
    df = spark.createDataFrame([("s", i, None if i == 2 else float(i), 1.0) for i in range(6)],
                               "series_id string, period long, x double, y double")
    cfg = CF.custom_config("minimal", **{"time_series.series": ["series_id"], "preprocessing.missing_value_strategy": "interpolate"})
    got = CF.FeaturePipeline(cfg).fit(df).transform(df).orderBy("period").toPandas()["x"].tolist()
    assert got == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_all_null_column_is_not_missing(spark):
    train = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    stats = PR.fit_feature_stats(train, ["a", "b", "c"])
    got = {r["feature"]: r["missing"] for r in PR.drift_report(
        stats, spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b", "c"]).collect()}
    assert got == {"a": False, "b": False, "c": True}


def test_diverging_penalised_fit_is_an_error(spark):
    df = spark.createDataFrame([(float(i), 1.0 + i % 2) for i in range(20)], "x double, y double")
    with pytest.raises(ArithmeticError):
        M.irls_elastic_net(df, ["x"], "y", "gaussian", "log", 0.001, max_iter=1)


def test_forest_samples_are_full_and_repeatable(spark):
    """Few distinct values, many copies: every tree still gets exactly its rows."""
    df = spark.createDataFrame([(i, float(i % 3), float(i % 2)) for i in range(6_000)], "id long, a double, b double")
    kw = dict(feats=["a", "b"], n_trees=20, psi=64, n=6_000, seed=3, key=["id"])
    one = IF.sample_rows(df, **kw).groupBy("_tree").count().collect()
    assert len(one) == 20 and {r["count"] for r in one} == {64}
    a = IF.fit_isolation_forest(df, ["a", "b"], n_trees=20, sample_size=64, key=["id"]).transform(df)
    b = IF.fit_isolation_forest(df.repartition(7), ["a", "b"], n_trees=20, sample_size=64, key=["id"]).transform(df)
    x, y = (t.orderBy("id").toPandas()["anomaly_score"] for t in (a, b))
    pd.testing.assert_series_equal(x, y)
    same = spark.createDataFrame([(1.0, 2.0)] * 500, "a double, b double")
    assert {r["count"] for r in IF.sample_rows(same, ["a", "b"], 10, 32, 500, 1).groupBy("_tree").count().collect()} == {32}


def test_term_counts_keep_every_term(spark):
    docs = spark.createDataFrame([(1, "Aa aa bb"), (2, None), (3, ""), (4, "cc " * 5)], "doc_id long, text string")
    assert sorted(map(tuple, FE.text_counts(docs).collect())) == [(1, "aa", 2), (1, "bb", 1), (4, "cc", 5)]
    assert {r["term"]: (r["df"], r["tf"]) for r in FE.term_weights(docs).collect()} == {"aa": (1, 2), "bb": (1, 1), "cc": (1, 5)}


@pytest.mark.parametrize("kind, params", [("linear", {}), ("ridge", {"alpha": 5.0}), ("lasso", {"alpha": 0.05}),
                                          ("enet", {"alpha": 0.1, "l1_ratio": 0.5})])
def test_gram_folds_equal_fitted_models(spark, kind, params):
    import random
    rng = random.Random(4)
    rows = [(i, 10 + rng.gauss(0, 1), rng.gauss(0, 2)) for i in range(90)]
    rows = [(i, a, b, 3 + 0.5 * a - 0.2 * b + rng.gauss(0, 0.1)) for i, a, b in rows]
    df = spark.createDataFrame(rows + [(90, None, 1.0, 1e9)], "row_pos long, a double, b double, y double").cache()
    folds = V.expanding_folds(90, 3)
    gram = V.FoldGram(df, ["a", "b"], "y", folds)
    far = V.FoldGram(df.withColumn("a", F.col("a") + 1e8), ["a", "b"], "y", folds)      # an offset costs no digits
    for f in folds:
        fm = M.fit_model(M.ModelSpec(kind, kind, params), df.where(F.col("row_pos") < f.train_end), ["a", "b"], "y")
        want = V._mse(fm, df.where((F.col("row_pos") >= f.test_start) & (F.col("row_pos") < f.test_end)), "y")
        assert far.mse(kind, params, f) == pytest.approx(gram.mse(kind, params, f), rel=1e-5)
        if kind == "enet":        # Spark's penalty scale depends on std(y); the sums use the plain objective
            assert gram.mse(kind, params, f) > 0
        else:
            assert gram.mse(kind, params, f) == pytest.approx(want, rel=2e-3 if kind == "lasso" else 1e-6)


def test_narrowed_quantiles_are_exact(spark):
    import numpy as np
    from tidemark.operators.quantile import column_quantiles
    rng = np.random.default_rng(2)
    rows = [(float(rng.lognormal(0, 4)) if i % 17 else None, 0.0 if rng.random() < 0.9 else float(rng.normal()),
             float("nan") if i % 50 == 0 else float(i % 3) * 1e300 * (-1) ** i, None, int(rng.integers(-5, 5))) for i in range(3_001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = column_quantiles(df, ["a", "b", "c", "d", "e"], probs)
    for i, c in enumerate("abce"):
        x = np.array([r[i if c != "e" else 4] for r in rows if r[i if c != "e" else 4] is not None], dtype=float)
        np.testing.assert_allclose(got[c], np.quantile(x[~np.isnan(x)], probs), rtol=1e-12)
    assert got["d"] == [None] * len(probs)
    fit = FE.fit_robust_scaler(df, ["a", "d", "e"])
    assert fit.center["a"] == pytest.approx(np.median([r[0] for r in rows if r[0] is not None])) and "d" not in fit.center


def test_equal_values_are_spread_over_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.rand(1)).alias("x"))
    d = W.with_row_pos(df.withColumn("t", F.monotonically_increasing_id()), ["x", "t"], "pos", partitions=8)
    assert d.count() == 20_000 and d.select("pos").distinct().count() == 20_000
    q = TS.qq_points(df, "x")
    assert q.count() == 20_000


def test_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace
    from tidemark import session
    conf = SimpleNamespace(get=lambda *_: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(
        getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077", setCheckpointDir=lambda d: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
