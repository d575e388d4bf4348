"""Model registry (S10): every saved package's metadata as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_META_SCHEMA = ("champion string, base_features array<string>, selected array<string>, "
                "requirements struct<max_lag:int, min_rows:int, n_selected:int>, "
                "config struct<target:string, time_col:string, lags:array<int>, windows:array<int>, "
                "scaler:string>")


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Read ``<root>/*/metadata`` of all packages written by
    ``Predictor.save`` into one DataFrame (package, champion, target, lags,
    windows, selected features, minimum rows)."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/metadata").withColumn("path", F.col("_metadata.file_path"))
    m = raw.select(F.regexp_extract("path", r"/([^/]+)/metadata/", 1).alias("package"),
                   F.from_json("value", _META_SCHEMA).alias("m"))
    return m.select("package", "m.champion", F.col("m.config.target").alias("target"),
                    F.col("m.config.lags").alias("lags"), F.col("m.config.windows").alias("windows"),
                    F.col("m.selected").alias("selected"),
                    F.col("m.requirements.min_rows").alias("min_rows"))


_REF_RESULT = "map<string, struct<model:string, cv_rmse_mean:double, cv_rmse_std:double, cv_scores:string>>"


def reference_metadata_scores(spark: SparkSession, paths: str) -> DataFrame:
    """Read metadata files in the reference's JSON layout (``model_results``
    maps model name -> {cv_rmse_mean, cv_rmse_std, cv_scores}); the fold
    scores are TEXT like "[-1.0e-05 -2.0e-06 ...]" (negative MSE), parsed
    with ``regexp_extract_all``; RMSE per fold = sqrt(-score), recomputed
    mean and population std beside the stored ones."""
    raw = spark.read.text(paths, wholetext=True)
    j = raw.select(F.col("_metadata.file_path").alias("path"),
                   F.from_json("value", f"model_name string, best_model_name string, "
                                        f"model_results {_REF_RESULT}").alias("m"))
    e = j.select("path", "m.best_model_name", F.explode("m.model_results").alias("model", "r"))
    nums = F.expr(r"transform(regexp_extract_all(r.cv_scores, '(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)', 1), "
                  r"x -> sqrt(-CAST(x AS DOUBLE)))")
    e = e.withColumn("rmse", nums)
    k = F.size("rmse")
    mean = F.aggregate("rmse", F.lit(0.0), lambda a, v: a + v) / k
    e = e.withColumn("mean_recomputed", mean)
    std = F.sqrt(F.aggregate("rmse", F.lit(0.0), lambda a, v: a + (v - F.col("mean_recomputed")) ** 2) / k)
    return e.select("path", "best_model_name", "model", F.col("r.cv_rmse_mean").alias("cv_rmse_mean"),
                    F.col("r.cv_rmse_std").alias("cv_rmse_std"), "mean_recomputed",
                    std.alias("std_recomputed"), k.alias("n_folds"))
