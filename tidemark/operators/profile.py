"""Profiling and statistics.

Every statistic over many columns is computed in ONE aggregate (one scan,
partial aggregation before the shuffle) and unpivoted afterwards, instead of
one pass per column. ``by`` runs the same statistics per group (per series).
Exact quantiles (interpolated, equal to pandas ``quantile``) come from radix
selection (``quantile.py``): no task holds a value list of a column or group;
``method="approx"`` is ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe, q, safe_corr, safe_div, sample_skewness
from .quantile import column_quantiles, grouped_quantiles
from .windows import _cols, add_lag_roll

STAT_SEP = "|"


def _k(c: str, stat: str) -> str:
    return f"{c}{STAT_SEP}{stat}"


def _unpivot(wide: DataFrame, cols: Sequence[str], stats: Sequence[str],
             by: Sequence[str], name: str = "column") -> DataFrame:
    """Wide one-row-per-group aggregate -> long rows (by..., column, stats...)."""
    structs = ", ".join(
        "struct(" + ", ".join([f"'{c}' AS {name}"] + [f"{q(_k(c, s))} AS {s}" for s in stats]) + ")"
        for c in cols)
    return wide.select(*by, F.expr(f"inline(array({structs}))"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns minus the excluded ones (schema only, no job)."""
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def feature_columns(df: DataFrame, target: str, time_col: str,
                    keys: Sequence[str] = ()) -> list[str]:
    """Every column except target, time and keys."""
    drop = {target, time_col, *keys}
    return [c for c in df.columns if c not in drop]


# ------------------------------------------------------------------- A1/A2

def shape(df: DataFrame) -> DataFrame:
    """A1: (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, by=None) -> DataFrame:
    """A2: null count per column, long form, one aggregate."""
    cols, by = list(cols or df.columns), _cols(by)
    wide = df.groupBy(*by).agg(*[F.expr(f"CAST(count_if({q(c)} IS NULL) AS BIGINT) AS {q(_k(c, 'n_null'))}")
                                 for c in cols])
    return _unpivot(wide, cols, ["n_null"], by)


# ------------------------------------------------------------------- quantiles

def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
              by=None, method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """A4/A5: quantiles with linear interpolation, long form
    (by..., column, q0, q1, ...) in the order of ``probs``.

    ``exact`` (``rank`` is the same) — radix selection over all columns and
    groups at once; ``approx`` — ``percentile_approx``."""
    by, cols = _cols(by), list(cols)
    names = [f"q{i}" for i in range(len(probs))]
    if method == "approx":
        wide = df.groupBy(*by).agg(*[F.percentile_approx(F.col(c), list(probs), accuracy)[i].alias(_k(c, n))
                                     for c in cols for i, n in enumerate(names)])
        return _unpivot(wide, cols, names, by)
    if by:
        return grouped_quantiles(df, cols, probs, by)
    found = column_quantiles(df, cols, probs)
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in cols],
                                           "column string, " + ", ".join(f"{n} double" for n in names))


# ------------------------------------------------------------------- A3

DESCRIBE_STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def describe(df: DataFrame, cols: Sequence[str] | None = None, by=None,
             method: str = "exact") -> DataFrame:
    """A3: pandas ``describe`` per column (count, mean, sample std, min,
    quartiles, max), long form: one aggregate and one selection for all columns."""
    by = _cols(by)
    cols = list(cols or numeric_columns(df, exclude=by))
    exprs = []
    for c in cols:
        x = q(c)
        exprs += [f"CAST(count({x}) AS BIGINT) AS {q(_k(c, 'count'))}",
                  f"avg({x}) AS {q(_k(c, 'mean'))}", f"stddev_samp({x}) AS {q(_k(c, 'std'))}",
                  f"CAST(min({x}) AS DOUBLE) AS {q(_k(c, 'min'))}",
                  f"CAST(max({x}) AS DOUBLE) AS {q(_k(c, 'max'))}"]
    wide = df.groupBy(*by).agg(*[F.expr(e) for e in exprs])
    plain = _unpivot(wide, cols, ["count", "mean", "std", "min", "max"], by)
    got = quantiles(df, cols, (0.25, 0.5, 0.75), by, method)
    got = got.select(*by, "column", *[F.col(f"q{i}").cast("double").alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return join_null_safe(plain, got, [*by, "column"], "left").select(*by, "column", *DESCRIBE_STATS)


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """A5 as fitted state: exact medians of all columns (a few numbers reach the driver)."""
    return {c: v[0] for c, v in column_quantiles(df, cols, (0.5,)).items()}


# ------------------------------------------------------------------- A7/A8/G5

def corr_matrix(df: DataFrame, cols: Sequence[str], by=None, lower_only: bool = False) -> DataFrame:
    """Pearson correlation of every pair (pairwise-complete rows), long
    form (col_a, col_b, corr); null for a constant column. With
    ``lower_only`` only pairs with index(col_a) > index(col_b) (G5)."""
    by, cols = _cols(by), list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))
             if (i > j if lower_only else True)]
    sym = {}
    exprs = []
    for i, j in pairs:
        key = (min(i, j), max(i, j))
        if key in sym:
            continue
        sym[key] = f"_c{key[0]}_{key[1]}"
        exprs.append(_pair_corr(cols[key[0]], cols[key[1]]).alias(sym[key]))
    wide = df.groupBy(*by).agg(*exprs)
    rows = F.array(*[F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                              F.col(sym[(min(i, j), max(i, j))]).alias("corr"))
                     for i, j in pairs])
    return wide.select(*by, F.inline(rows))


def _pair_corr(a: str, b: str) -> Column:
    return F.expr(_pair_corr_sql(a, b))


def _pair_corr_sql(a: str, b: str) -> str:
    """Pairwise-complete Pearson correlation; null for a constant column."""
    if a == b:
        return f"CASE WHEN stddev_pop({q(a)}) > 0 THEN 1.0D END"
    m = f"({q(a)} IS NOT NULL AND {q(b)} IS NOT NULL)"
    x, y = f"CASE WHEN {m} THEN {q(a)} END", f"CASE WHEN {m} THEN {q(b)} END"
    sx, sy = f"stddev_pop({x})", f"stddev_pop({y})"
    return f"try_divide(covar_pop({x}, {y}), nullif({sx} * {sy}, 0D))"


def target_correlations(df: DataFrame, cols: Sequence[str], target: str, by=None) -> DataFrame:
    """(feature, corr, abs_corr) with the target, one aggregate; sort by
    ``abs_corr`` descending for the ranking."""
    by = _cols(by)
    wide = df.groupBy(*by).agg(*[_pair_corr(c, target).alias(_k(c, "corr")) for c in cols])
    return (_unpivot(wide, cols, ["corr"], by, name="feature")
            .withColumn("abs_corr", F.abs("corr")))


# ------------------------------------------------------------------- A9/A10/X1

def distinct_profile(df: DataFrame, cols: Sequence[str], max_values: int = 10,
                     approx_first: bool = False) -> DataFrame:
    """Distinct count (nulls skipped), min, max, range; the sorted
    distinct values only for columns with at most ``max_values`` of them
    (``collect_set`` is bounded by first checking the count)."""
    cnt = F.approx_count_distinct if approx_first else F.count_distinct
    wide = df.agg(*[e for c in cols for e in (
        cnt(F.col(c)).cast("long").alias(_k(c, "n_distinct")),
        F.min(F.col(c)).cast("double").alias(_k(c, "min")),
        F.max(F.col(c)).cast("double").alias(_k(c, "max")))])
    out = _unpivot(wide, cols, ["n_distinct", "min", "max"], [])
    return out.withColumn("range", F.col("max") - F.col("min"))


def distinct_values(df: DataFrame, cols: Sequence[str], max_values: int = 10) -> dict:
    """Sorted distinct values of the columns that have at most
    ``max_values`` distinct values; checked first so no large set is built."""
    prof = {r["column"]: r["n_distinct"] for r in distinct_profile(df, cols).collect()}
    small = [c for c in cols if prof[c] <= max_values]
    if not small:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(c))).alias(c) for c in small]).first()
    return {c: list(row[c]) for c in small}


def dummy_advisor(df: DataFrame, target: str, time_col: str, series=None,
                  indicators: Sequence[str] | None = None, max_unique: int = 10,
                  min_year_span: int = 5, vol_window: int = 12) -> DataFrame:
    """Recommendation rows (variable, unique_values, reason): numeric
    columns with few distinct values, a year span above ``min_year_span``,
    and volatility regimes (A21) of the chosen indicators."""
    feats = [c for c in numeric_columns(df, exclude=[target, time_col, *_cols(series)])]
    prof = distinct_profile(df, feats + [time_col])
    few = (prof.where((F.col("column") != time_col) & (F.col("n_distinct") <= max_unique))
           .select(F.col("column").alias("variable"), F.col("n_distinct").alias("unique_values"),
                   F.lit("few_unique_numeric").alias("reason")))
    span = (prof.where((F.col("column") == time_col) & (F.col("range") > min_year_span))
            .select(F.col("column").alias("variable"), F.col("n_distinct").alias("unique_values"),
                    F.lit("time_span_period_dummies").alias("reason")))
    inds = [c for c in (indicators or feats) if c in feats]
    vol = (volatility_regimes(df, inds, series=series, order=time_col, window=vol_window)
           .where("high_variation")
           .select(F.concat(F.col("feature"), F.lit("_regime")).alias("variable"),
                   F.lit(None).cast("long").alias("unique_values"),
                   F.lit("volatility_regime").alias("reason")))
    return few.unionByName(span).unionByName(vol)


# ------------------------------------------------------------------- A11/A12

def target_profile(df: DataFrame, target: str, by=None) -> DataFrame:
    """Min, max, mean, sample std, cv, bias-corrected skewness, zero
    count and percentage of the non-null target, per group."""
    by = _cols(by)
    y = F.col(target)
    d = df.where(y.isNotNull())
    return (d.groupBy(*by).agg(
        F.min(y).alias("min_value"), F.max(y).alias("max_value"), F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"), sample_skewness(target).alias("skewness"),
        F.count_if(y == 0).cast("long").alias("n_zeros"),
        (F.avg(F.when(y == 0, 1.0).otherwise(0.0)) * 100).alias("percent_zeros"))
        .withColumn("cv", safe_div("std", "mean")))


def glm_recommendations(profile: DataFrame) -> DataFrame:
    """Both rule sets of the reference on an A11 profile.

    ``primary``: no zeros and cv > 1 -> Gamma-log; any zero -> Tweedie 1.5;
    else Gaussian-log. ``ranked``: no zeros: cv > 1 -> [Gamma-log, Tweedie
    1.9] else [Gaussian-log, Gamma-log]; zeros -> [Tweedie 1.5, Tweedie 1.1]."""
    # Model names used by the reference's registry.
    gamma, gauss = "GLM_Gamma_Log", "GLM_Gaussian_Log"
    tw19, tw15, tw11 = "GLM_Tweedie_1.9", "GLM_Tweedie_1.5", "GLM_Tweedie_1.1"
    zeros = F.col("n_zeros") > 0
    high = F.col("cv") > 1
    primary = (F.when(~zeros & high, F.lit(gamma)).when(zeros, F.lit(tw15))
               .otherwise(F.lit(gauss)))
    ranked = (F.when(F.col("percent_zeros") == 0,
                     F.when(high, F.array(F.lit(gamma), F.lit(tw19)))
                     .otherwise(F.array(F.lit(gauss), F.lit(gamma))))
              .otherwise(F.array(F.lit(tw15), F.lit(tw11))))
    return profile.withColumn("primary", primary).withColumn("ranked", ranked)


# ------------------------------------------------------------------- A17

def jarque_bera(df: DataFrame, col: str, by=None) -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) with population skewness S and excess
    kurtosis K; p = exp(-JB/2) (chi-square, 2 df)."""
    by = _cols(by)
    x = F.col(col)
    out = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(x).cast("long").alias("n"), F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("kurt"))
    jb = F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4.0)
    return out.withColumn("jb_stat", jb).withColumn("jb_pvalue", F.exp(-F.col("jb_stat") / 2.0))


# ------------------------------------------------------------------- P7/G4

def iqr_outliers(df: DataFrame, cols: Sequence[str], by=None, k: float = 1.5,
                 method: str = "exact") -> DataFrame:
    """Rows outside [Q1 - k IQR, Q3 + k IQR], count and percentage per
    column. Quartiles come from one aggregate; the second pass joins the
    per-group bounds (one row per group)."""
    by = _cols(by)
    q = quantiles(df, cols, (0.25, 0.75), by=by, method=method)
    bounds = q.select(*by, "column", F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    wide = _bounds_wide(bounds, cols, by)
    d = _attach(df, wide, by)
    exprs = []
    for c in cols:
        lo = F.col(_k(c, "q1")) - k * (F.col(_k(c, "q3")) - F.col(_k(c, "q1")))
        hi = F.col(_k(c, "q3")) + k * (F.col(_k(c, "q3")) - F.col(_k(c, "q1")))
        out = (F.col(c) < lo) | (F.col(c) > hi)
        exprs += [F.count_if(out).cast("long").alias(_k(c, "n_outliers")),
                  (F.count_if(out) / F.count(F.lit(1)) * 100).alias(_k(c, "pct_outliers")),
                  F.first(F.col(_k(c, "q1"))).alias(_k(c, "q1")),
                  F.first(F.col(_k(c, "q3"))).alias(_k(c, "q3"))]
    agg = d.groupBy(*by).agg(*exprs)
    return _unpivot(agg, cols, ["q1", "q3", "n_outliers", "pct_outliers"], by)


def _bounds_wide(long: DataFrame, cols, by) -> DataFrame:
    stats = [c for c in long.columns if c not in (*by, "column")]
    return long.groupBy(*by).agg(*[F.first(F.when(F.col("column") == c, F.col(s)), True)
                                   .alias(_k(c, s)) for c in cols for s in stats])


def _attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Attach per-group statistics to every row: a join on the group keys
    (AQE broadcasts it when the measured size is small); for a global
    statistic the single row is fetched and inlined as literals."""
    if by:
        return join_null_safe(df, stats, by)
    row = stats.first().asDict()
    return df.withColumns({k: F.lit(v) for k, v in row.items()})


def boxplot_stats(df: DataFrame, cols: Sequence[str], by=None, whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside Q1/Q3 -+ whis IQR)
    and number of fliers per column."""
    by = _cols(by)
    q = quantiles(df, cols, (0.25, 0.5, 0.75), by=by)
    wide = _bounds_wide(q.select(*by, "column", F.col("q0").alias("q1"),
                                 F.col("q1").alias("med"), F.col("q2").alias("q3")), cols, by)
    d = _attach(df, wide, by)
    exprs = []
    for c in cols:
        q1, q3 = F.col(_k(c, "q1")), F.col(_k(c, "q3"))
        lo, hi = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
        x = F.col(c)
        exprs += [F.first(q1).alias(_k(c, "q1")), F.first(F.col(_k(c, "med"))).alias(_k(c, "median")),
                  F.first(q3).alias(_k(c, "q3")),
                  F.min(F.when(x >= lo, x)).cast("double").alias(_k(c, "whisker_low")),
                  F.max(F.when(x <= hi, x)).cast("double").alias(_k(c, "whisker_high")),
                  F.count_if((x < lo) | (x > hi)).cast("long").alias(_k(c, "n_fliers"))]
    agg = d.groupBy(*by).agg(*exprs)
    return _unpivot(agg, cols, ["q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers"], by)


# ------------------------------------------------------------------- G2

def histogram(df: DataFrame, col: str, bins: int = 30, by=None) -> DataFrame:
    """Equal-width bins between min and max (last bin closed on the
    right), counts per bin; empty bins are omitted."""
    by = _cols(by)
    x = F.col(col)
    mm = df.groupBy(*by).agg(F.min(x).cast("double").alias("_mn"),
                             F.max(x).cast("double").alias("_mx"))
    d = _attach(df.where(x.isNotNull()), mm, by)
    width = F.col("_mx") - F.col("_mn")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_mn")) * F.lit(float(bins)) / width).cast("long"),
                F.lit(bins - 1)))
    out = d.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                            F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx"))
    return out.select(*by, "bin",
                      (F.col("_mn") + (F.col("_mx") - F.col("_mn")) * F.col("bin") / bins)
                      .alias("lower"),
                      (F.col("_mn") + (F.col("_mx") - F.col("_mn")) * (F.col("bin") + 1) / bins)
                      .alias("upper"), "count")


# ------------------------------------------------------------------- A21/A22

def volatility_regimes(df: DataFrame, cols: Sequence[str], series=None, order=None,
                       window: int = 12, ratio: float = 0.5) -> DataFrame:
    """Rolling sample std over ``window`` rows per series; a feature has
    regimes when std(rolling_std) > ratio * mean(rolling_std)."""
    series = _cols(series)
    r = add_lag_roll(df, cols, (), (window,), series=series, order=order, stats=("std",))
    names = [f"{c}_roll_std_{window}" for c in cols]
    wide = r.groupBy(*series).agg(*[e for c, n in zip(cols, names) for e in (
        F.stddev_samp(n).alias(_k(c, "std_of_vol")), F.avg(n).alias(_k(c, "mean_of_vol")))])
    out = _unpivot(wide, cols, ["std_of_vol", "mean_of_vol"], series, name="feature")
    return out.withColumn("high_variation",
                          F.coalesce(F.col("std_of_vol") > ratio * F.col("mean_of_vol"),
                                     F.lit(False)))


def fit_feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sample std, min, max per feature (training statistics)."""
    wide = df.agg(*[F.expr(e) for c in cols for e in (
        f"avg({q(c)}) AS {q(_k(c, 'mean'))}", f"stddev_samp({q(c)}) AS {q(_k(c, 'std'))}",
        f"CAST(min({q(c)}) AS DOUBLE) AS {q(_k(c, 'min'))}",
        f"CAST(max({q(c)}) AS DOUBLE) AS {q(_k(c, 'max'))}")])
    return _unpivot(wide, cols, ["mean", "std", "min", "max"], [], name="feature")


def drift_report(train_stats: DataFrame, new: DataFrame, cols: Sequence[str],
                 threshold: float = 0.1) -> DataFrame:
    """Flag features whose mean moved by more than ``threshold`` times
    the absolute training mean; missing features are reported too (J3)."""
    present = [c for c in cols if c in new.columns]
    wide = new.agg(*[F.expr(f"avg({q(c)}) AS {q(_k(c, 'mean_new'))}") for c in present])
    now = _unpivot(wide, present, ["mean_new"], [], name="feature")
    j = train_stats.select("feature", F.col("mean").alias("mean_train")).join(
        F.broadcast(now), "feature", "left")  # both sides have one row per feature
    return j.select("feature", "mean_train", "mean_new",
                    (~F.col("feature").isin(present) if present else F.lit(True)).alias("missing"),
                    (F.abs(F.col("mean_new") - F.col("mean_train"))
                     > threshold * F.abs(F.col("mean_train"))).alias("drift"))


def missing_features(expected: DataFrame, actual_cols: Sequence[str], spark=None) -> DataFrame:
    """Names in ``expected`` (a one-column ``feature`` table) that are
    not among ``actual_cols`` — a left anti join of two name lists."""
    spark = spark or expected.sparkSession
    have = spark.createDataFrame([(c,) for c in actual_cols], "feature string")
    return expected.join(F.broadcast(have), "feature", "left_anti")
