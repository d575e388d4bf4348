"""Scoring helpers."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def validate_schema(df: DataFrame, expected: StructType | dict, required: Sequence[str] | None = None,
                    strict: bool = False) -> DataFrame:
    """Compare the scoring schema with the training schema. Missing
    required columns are errors; type differences are warnings. The target
    is only required with ``strict`` (defect D10). Returns a report
    DataFrame (column, expected, actual, level) and raises on errors."""
    exp = ({f.name: f.dataType.simpleString() for f in expected.fields}
           if isinstance(expected, StructType) else dict(expected))
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    need = list(required) if required is not None else list(exp)
    rows = []
    for c in need:
        if c not in have:
            rows.append((c, exp.get(c), None, "error"))
        elif exp.get(c) and exp[c] != have[c]:
            rows.append((c, exp[c], have[c], "warning"))
    report = df.sparkSession.createDataFrame(
        rows, "column string, expected string, actual string, level string")
    errors = [r[0] for r in rows if r[3] == "error"]
    if errors:
        raise ValueError(f"missing columns for scoring: {errors}")
    return report


def prediction_requirements(lags: Sequence[int], windows: Sequence[int],
                            base_features: Sequence[str], selected: Sequence[str]) -> dict:
    """Max lag, minimum rows = max(max(windows or [1]), max lag)."""
    max_lag = max(lags) if lags else 0
    return {"base_features": list(base_features), "max_lag": max_lag,
            "rolling_windows": list(windows), "lag_periods": list(lags),
            "min_rows": max(max(windows) if windows else 1, max_lag),
            "n_selected": len(selected), "selected_features": list(selected)}


def history_check(df: DataFrame, series, min_rows: int) -> DataFrame:
    """Rows per series against the requirement; series that fail are
    reported beside the others (``ok`` false)."""
    series = [series] if isinstance(series, str) else list(series)
    return (df.groupBy(*series).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("min_rows", F.lit(min_rows).cast("long"))
            .withColumn("ok", F.col("n_rows") >= F.col("min_rows")))


def with_confidence(df: DataFrame, value: float = 0.95) -> DataFrame:
    """O2: the reference's constant placeholder confidence (kept, documented);
    real spread comes from ``predict_with_uncertainty`` (O3)."""
    return df.withColumn("confidence", F.lit(float(value)))


def last_per_series(df: DataFrame, series, order) -> DataFrame:
    """The last row of every series (the prediction for the newest
    period). A per-series ``max_by`` aggregate: partial aggregation, no sort
    of whole series."""
    series = [series] if isinstance(series, str) else list(series)
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in series]
    key = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*series).agg(F.max_by(F.struct(*[F.col(c) for c in others]), key).alias("_r"))
    return agg.select(*series, *[F.col(f"_r.{c}").alias(c) for c in others])


def monitored(df: DataFrame, score_fn, cols: Sequence[str]):
    """Score with null counts observed on the input (``observe``, no
    extra job), elapsed time and errors caught. Returns (scored DataFrame or
    None, info dict); the observation is filled once the result is acted on."""
    from pyspark.sql import Observation
    obs = Observation("input_quality")
    watched = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                         *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
    t0 = time.time()
    try:
        out = score_fn(watched)
        return out, {"observation": obs, "seconds": time.time() - t0, "error": None}
    except Exception as e:  # noqa: BLE001
        return None, {"observation": obs, "seconds": time.time() - t0,
                      "error": f"{type(e).__name__}: {e}"}


def latest_rows(df: DataFrame, series, order, n: int) -> DataFrame:
    """Tail of every series (for history context, O5): rows whose rank from
    the end is <= n. Ranking is per series; for skewed series use
    ``last_per_series`` instead."""
    series = [series] if isinstance(series, str) else list(series)
    w = Window.partitionBy(*series).orderBy(*[F.col(c).desc() for c in
                                              ([order] if isinstance(order, str) else order)])
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")
