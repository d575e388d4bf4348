"""Feature scoring and selection.

Scores for all p features come from ONE aggregate over the data (pairwise
moments per feature); everything after that runs on a p-row table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.exprs import dlit, q, safe_corr, safe_div
from .profile import _k, _unpivot
from .windows import _cols


# --------------------------------------------------------------------- A13 / A14

def univariate_scores(df: DataFrame, features: Sequence[str], target: str, by=None) -> DataFrame:
    """Per feature: n (complete pairs), r, |r|, F = r^2/(1-r^2)(n-2)
    (scikit-learn ``f_regression``: a constant feature scores 0, r = +-1
    gives +inf) and univariate R^2 (A14: null for a constant feature, 1 for
    a constant target, else r^2). Adds ``idx``, the feature's position, for
    stable tie-breaking.

    Two cheap passes of plain sums instead of p central-moment aggregates:
    pass 1 counts and means; pass 2 the centred sums Sxx, Syy, Sxy (centring
    by the pass-1 means keeps them accurate). Pairwise null masking is only
    generated when pass 1 finds nulls."""
    by = _cols(by)
    features = list(features)
    y = F.col(target)
    if by:
        return _grouped_scores(df, features, target, by)
    t = q(target)
    first = df.agg(F.expr("count(1) AS _n"), F.expr(f"count({t}) AS _ny"), F.expr(f"avg({t}) AS _my"),
                   *[F.expr(f"count({q(c)}) AS {q(_k(c, 'cnt'))}") for c in features],
                   *[F.expr(f"avg({q(c)}) AS {q(_k(c, 'mean'))}") for c in features]).first()
    n_all = first["_n"]
    complete = first["_ny"] == n_all and all(first[_k(c, "cnt")] == n_all for c in features)
    my = dlit(first["_my"] or 0.0)
    exprs = []
    for c in features:
        mx = dlit(first[_k(c, "mean")] or 0.0)
        if complete:
            xc, yc, n = f"({q(c)} - {mx})", f"({t} - {my})", "count(1)"
        else:
            m = f"({q(c)} IS NOT NULL AND {t} IS NOT NULL)"
            xc, yc = f"(CASE WHEN {m} THEN {q(c)} - {mx} END)", f"(CASE WHEN {m} THEN {t} - {my} END)"
            n = f"count_if({m})"
        for nm, e in (("n", n), ("sx", f"sum({xc})"), ("sy", f"sum({yc})"),
                      ("sxx", f"sum({xc} * {xc})"), ("syy", f"sum({yc} * {yc})"),
                      ("sxy", f"sum({xc} * {yc})")):
            exprs.append(F.expr(f"{e} AS {q(_k(c, nm))}"))
    wide = df.agg(*exprs)
    long = _unpivot(wide, features, ["n", "sx", "sy", "sxx", "syy", "sxy"], [], name="feature")
    return _finish_scores(long, features)


def _grouped_scores(df, features, target, by):
    exprs = []
    for c in features:
        m = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(m, F.col(c)), F.when(m, F.col(target))
        exprs += [F.count_if(m).alias(_k(c, "n")), F.lit(0.0).alias(_k(c, "sx")),
                  F.lit(0.0).alias(_k(c, "sy")),
                  (F.var_pop(x) * F.count_if(m)).alias(_k(c, "sxx")),
                  (F.var_pop(y) * F.count_if(m)).alias(_k(c, "syy")),
                  (F.covar_pop(x, y) * F.count_if(m)).alias(_k(c, "sxy"))]
    long = _unpivot(df.groupBy(*by).agg(*exprs), features,
                    ["n", "sx", "sy", "sxx", "syy", "sxy"], by, name="feature")
    return _finish_scores(long, features, by)


def _finish_scores(long: DataFrame, features, by: Sequence[str] = ()) -> DataFrame:
    idx = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(features)) + " END"
    keys = [q(b) for b in by]
    t = long.selectExpr(
        *keys, "feature", "CAST(n AS BIGINT) AS n",
        # centred sums about the true pairwise means
        "sxx - sx * sx / n AS _sxx", "syy - sy * sy / n AS _syy", "sxy - sx * sy / n AS _sxy",
        f"CAST({idx} AS INT) AS idx")
    t = t.selectExpr("*", "CASE WHEN _sxx > 0 AND _syy > 0 THEN _sxy / sqrt(_sxx * _syy) END AS corr")
    return t.selectExpr(
        *keys, "feature", "n", "corr",
        "CASE WHEN NOT (_sxx > 0) THEN CAST(NULL AS DOUBLE) WHEN NOT (_syy > 0) THEN 1.0D "
        "ELSE corr * corr END AS r2",
        "idx", "abs(corr) AS abs_corr",
        "CASE WHEN coalesce(corr, 0D) * coalesce(corr, 0D) >= 1 THEN double('inf') "
        "ELSE coalesce(corr, 0D) * coalesce(corr, 0D) / (1 - coalesce(corr, 0D) * coalesce(corr, 0D)) "
        "* (n - 2) END AS f_stat")


def _betacf(a, b, x, iters=300, eps=3e-16):
    """Continued fraction for the regularised incomplete beta (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def reg_inc_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + \
        b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F(d1, d2) distribution."""
    if f is None or d2 <= 0 or (isinstance(f, float) and math.isnan(f)):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return reg_inc_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of the univariate F statistic, F(1, n-2) tail (Arrow batch;
    runs on the p-row score table only)."""
    return pd.Series([f_sf(float(a), 1.0, float(b) - 2.0) if a is not None and not pd.isna(a)
                      else np.nan for a, b in zip(f, n)])


def with_pvalues(scores: DataFrame) -> DataFrame:
    return scores.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("n").cast("double")))


# --------------------------------------------------------------------- T1 / T2 / T7

def harrell_k(n_rows: int, n_features: int, lo: int = 5, hi: int = 20, div: int = 15) -> int:
    """k = min(max(lo, min(hi, n // div)), p)."""
    return min(max(lo, min(hi, n_rows // div)), n_features)


def top_k(scores: DataFrame, k: int, score_col: str = "f_stat") -> list[str]:
    """Names of the k best features, in ORIGINAL column order. Ties go to
    the later column, as a stable ascending sort keeps it last. The score
    table has one row per feature, so only p names reach the driver."""
    rows = (scores.orderBy(F.col(score_col).desc_nulls_last(), F.col("idx").desc())
            .limit(k).select("feature", "idx").collect())
    return [r["feature"] for r in sorted(rows, key=lambda r: r["idx"])]


def select_k_best(df: DataFrame, features: Sequence[str], target: str,
                  k: int | None = None) -> tuple[list[str], DataFrame]:
    """SelectKBest by F-score with the sample-size rule; no selection
    when k >= p; zero features is an error. Returns (names, score table)."""
    features = list(features)
    if not features:
        raise ValueError("no features available after feature engineering")
    # one row per feature: cached, so the top-k pick and the caller's read of
    # the scores share one pass over the data
    scores = univariate_scores(df, features, target).cache()
    if k is None:
        n = df.count()
        k = harrell_k(n, len(features))
    if k >= len(features):
        return features, scores
    return top_k(scores, k), scores


def select_keep_dummies(df: DataFrame, features: Sequence[str], dummies: Sequence[str],
                        target: str) -> list[str]:
    """k = max(10, min(25, n // 12)); dummies always kept; the others
    are the best max(5, k - n_dummies) by F (if that is fewer than them)."""
    features = list(features)
    n = df.count()
    k = min(max(10, min(25, n // 12)), len(features))
    if k >= len(features):
        return features
    dum = [c for c in features if c in set(dummies)]
    if not dum:
        return select_k_best(df, features, target, k)[0]
    rest = [c for c in features if c not in set(dum)]
    k_rest = max(5, k - len(dum))
    if not 0 < k_rest < len(rest):
        return features
    return select_k_best(df, rest, target, k_rest)[0] + dum


def top_correlated(df: DataFrame, features: Sequence[str], target: str,
                   n: int | None = None) -> list[str]:
    """The min(5, floor(sqrt(p)), p) features with the largest |r|."""
    p = len(features)
    n = n if n is not None else min(5, int(math.sqrt(p)), p)
    s = univariate_scores(df, features, target)
    rows = s.orderBy(F.col("abs_corr").desc_nulls_last(), "idx").limit(n).collect()
    return [r["feature"] for r in rows]


# --------------------------------------------------------------------- A15 / A16

def mutual_info_binned(df: DataFrame, features: Sequence[str], target: str,
                       bins: int = 10) -> DataFrame:
    """A15 (scalable estimator): equal-width bins of each feature and the
    target, joint counts from one ``groupBy(feature, bx, by)`` over an
    exploded long form, MI = sum p_xy ln(p_xy / (p_x p_y)) in nats.
    Differs numerically from the k-nearest-neighbour estimator (Kraskov et
    al. 2004) that scikit-learn uses; it is consistent, distributed and
    exact to reproduce."""
    cols = list(features) + [target]
    mm = df.agg(*[e for c in cols for e in (F.min(c).cast("double").alias(f"{c}|mn"),
                                            F.max(c).cast("double").alias(f"{c}|mx"))]).first()

    def b(c):
        mn, mx = mm[f"{c}|mn"], mm[f"{c}|mx"]
        if mn is None or mx == mn:
            return F.when(F.col(c).isNotNull(), F.lit(0).cast("long"))
        at = F.floor((F.col(c) - F.lit(mn)) * F.lit(float(bins)) / F.lit(mx - mn)).cast("long")
        return F.when(F.col(c).isNotNull(), F.least(at, F.lit(bins - 1)))     # least() skips nulls

    d = df.where(F.col(target).isNotNull())
    long = d.select(b(target).alias("by"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), b(c).alias("bx")) for c in features])).alias("s"))
    cnt = (long.where(F.col("s.bx").isNotNull())
           .groupBy(F.col("s.feature").alias("feature"), F.col("s.bx").alias("bx"), "by")
           .agg(F.count(F.lit(1)).cast("double").alias("c")))
    wf = Window.partitionBy("feature")   # p x bins x bins rows in total
    cnt = (cnt.withColumn("n", F.sum("c").over(wf))
           .withColumn("cx", F.sum("c").over(Window.partitionBy("feature", "bx")))
           .withColumn("cy", F.sum("c").over(Window.partitionBy("feature", "by"))))
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    return cnt.groupBy("feature").agg(F.sum(term).alias("mi"))


def composite_ranking(df: DataFrame, features: Sequence[str], target: str,
                      bins: int = 10, scores: DataFrame | None = None,
                      mi: DataFrame | None = None) -> DataFrame:
    """Min-max normalise |r|, MI, F and R^2 over the features, average
    them with equal weights, rank descending. A measure whose max equals its
    min gives null (pandas gives NaN). Score tables already computed (one
    row per feature) can be passed in so the data is not scanned again."""
    s = univariate_scores(df, features, target) if scores is None else scores
    mi = mutual_info_binned(df, features, target, bins) if mi is None else mi
    t = s.join(F.broadcast(mi), "feature")          # both p rows
    w = Window.partitionBy(F.lit(1))                # p rows only
    norm = {}
    for m in ["abs_corr", "mi", "f_stat", "r2"]:
        norm[f"norm_{m}"] = safe_div(F.col(m) - F.min(m).over(w), F.max(m).over(w) - F.min(m).over(w))
    t = t.withColumns(norm)
    comp = (F.col("norm_abs_corr") + F.col("norm_mi") + F.col("norm_f_stat") + F.col("norm_r2")) / 4
    t = t.withColumn("composite", comp)
    return t.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("composite").desc_nulls_last(), "idx")).cast("long"))


# --------------------------------------------------------------------- G10

def top_lists(df: DataFrame, features: Sequence[str], target: str, n: int = 10,
              alpha: float = 0.05, bins: int = 10) -> DataFrame:
    """The feature-analysis top-``n`` lists, one long table
    (list, rank, feature, score): |correlation|, binned mutual information,
    F statistic among features with p < ``alpha``, and the A16 composite.
    The data is scanned once for the moments and once for the MI bins; the
    rest runs on p-row tables. Ties go to the earlier column."""
    s = univariate_scores(df, features, target).cache()
    mi = mutual_info_binned(df, features, target, bins).cache()
    idx = s.select("feature", "idx")
    comp = composite_ranking(df, features, target, bins, scores=s, mi=mi)
    parts = [
        s.select(F.lit("correlation").alias("list"), "feature", "idx", F.col("abs_corr").alias("score")),
        mi.join(idx, "feature").select(F.lit("mutual_info").alias("list"), "feature", "idx",
                                       F.col("mi").alias("score")),
        with_pvalues(s).where(F.col("p_value") < alpha).select(
            F.lit("f_test").alias("list"), "feature", "idx", F.col("f_stat").alias("score")),
        comp.select(F.lit("composite").alias("list"), "feature", "idx",
                    F.col("composite").alias("score")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("list").orderBy(F.col("score").desc_nulls_last(), "idx")
    return (u.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
            .select("list", "rank", "feature", "score"))


# --------------------------------------------------------------------- K3 / K4 / K12

def feature_checks(df: DataFrame, features: Sequence[str], max_missing: float = 0.1,
                   max_corr: float = 0.95, min_variance: float = 0.01) -> DataFrame:
    """Per feature missing share, sample variance and the largest |r|
    with another feature; flags for the three thresholds."""
    features = list(features)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[e for c in features for e in (
        F.count_if(F.col(c).isNull()).alias(_k(c, "nnull")),
        F.var_samp(c).alias(_k(c, "variance")))])
    long = _unpivot(wide.withColumns({_k(c, "missing_share"): F.col(_k(c, "nnull")) / F.col("_n")
                                      for c in features}),
                    features, ["missing_share", "variance"], [], name="feature")
    from .profile import corr_matrix
    cm = (corr_matrix(df, features).where(F.col("col_a") != F.col("col_b"))
          .groupBy(F.col("col_a").alias("feature")).agg(F.max(F.abs("corr")).alias("max_abs_corr")))
    out = long.join(F.broadcast(cm), "feature", "left")
    return out.select("feature", "missing_share", "variance", "max_abs_corr",
                      (F.col("missing_share") > max_missing).alias("too_many_missing"),
                      F.coalesce(F.col("max_abs_corr") > max_corr, F.lit(False)).alias("too_correlated"),
                      F.coalesce(F.col("variance") < min_variance, F.lit(True)).alias("low_variance"))
