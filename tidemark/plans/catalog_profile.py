"""Catalog entries for profiling, statistics and set operations
(A1-A12, A17, A21, A22, P3-P7, U1, U2, G2, G4, G5, X1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import profile as PR
from ..operators import windows as W
from ..sources import panels as P
from .catalog import FEATS, LAGS, WINS, register
from .sqlparts import R, with_panel

COLS = FEATS + ["y"]
CUTOFF = 200001          # history / future split of the month panel
FACTORS = (0.9, 1.0, 1.1)


def _panel(spark, sf_dir):
    return P.month_segment_panel(spark, sf_dir)


def _rounded(df, spec: dict):
    return df.withColumns({c: rnd(c, d) for c, d in spec.items()})


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------- A1 / A2

register("a1_shape", with_panel(
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(10 AS BIGINT) AS n_cols FROM panel"))(
    lambda spark, sf: PR.shape(_panel(spark, sf)))


def _feat_sql():
    w = "PARTITION BY series_id ORDER BY period"
    e = []
    for c in FEATS:
        for k in LAGS:
            e.append(f"lag({c}, {k}) OVER ({w}) AS {c}_lag_{k}")
        for n in WINS:
            fr = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            e.append(f"CASE WHEN count({c}) OVER {fr} = {n} THEN avg({c}) OVER {fr} END "
                     f"AS {c}_roll_mean_{n}")
    return f"feat AS (SELECT *, {', '.join(e)} FROM panel)"


FEAT_NAMES = [f"{c}_lag_{k}" for c in FEATS for k in LAGS] + \
             [f"{c}_roll_mean_{n}" for c in FEATS for n in WINS]


def _features(spark, sf):
    return W.add_lag_roll(_panel(spark, sf), FEATS, LAGS, WINS, series="series_id",
                          order="period")


@register("a2_null_counts", with_panel(_union(
    [f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM feat"
     for c in FEAT_NAMES]), _feat_sql()))
def q_a2(spark, sf):
    return PR.null_counts(_features(spark, sf), FEAT_NAMES)


# ----------------------------------------------------------------- A3 / A4

_DSC = {"n_orders": 6, "n_customers": 6, "avg_order_value": 4, "avg_qty": 8,
        "avg_tax": 10, "ret_share": 10, "y": 10}


def _describe_sql():
    parts = []
    for c in COLS:
        d = _DSC[c]
        parts.append(
            f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, "
            f"{R(f'avg({c})', d)} AS mean, {R(f'stddev_samp({c})', d)} AS std, "
            f"{R(f'CAST(min({c}) AS DOUBLE)', d)} AS min, "
            f"{R(f'quantile_cont({c}, 0.25)', d)} AS q25, {R(f'quantile_cont({c}, 0.5)', d)} AS q50, "
            f"{R(f'quantile_cont({c}, 0.75)', d)} AS q75, {R(f'CAST(max({c}) AS DOUBLE)', d)} AS max "
            f"FROM panel")
    return with_panel(_union(parts))


def _round_long(df, stats, key="column", digits=None):
    digits = digits or _DSC
    out = df
    for s in stats:
        expr = None
        for c, d in digits.items():
            r = rnd(s, d)
            expr = F.when(F.col(key) == c, r) if expr is None else expr.when(F.col(key) == c, r)
        out = out.withColumn(s, expr)
    return out


@register("a3_describe", _describe_sql())
def q_a3(spark, sf):
    d = PR.describe(_panel(spark, sf), COLS)
    return _round_long(d, ["mean", "std", "min", "q25", "q50", "q75", "max"])


@register("a4_quantiles_rank", _union([
    f"SELECT 'l_extendedprice' AS column, {R('quantile_cont(l_extendedprice, 0.25)', 4)} AS q0, "
    f"{R('quantile_cont(l_extendedprice, 0.5)', 4)} AS q1, "
    f"{R('quantile_cont(l_extendedprice, 0.9)', 4)} AS q2 FROM lineitem"]))
def q_a4(spark, sf):
    """Exact quantiles over every lineitem row by distributed rank
    selection (the scalable exact path)."""
    li = P.lineitem_frame(spark, sf)
    q = PR.quantiles(li, ["l_extendedprice"], (0.25, 0.5, 0.9))
    return _rounded(q, {"q0": 4, "q1": 4, "q2": 4})


@register("a5_median_by_series", with_panel(
    "SELECT series_id, " + ", ".join(f"{R(f'median({c})', _DSC[c])} AS {c}" for c in COLS)
    + " FROM panel GROUP BY series_id"))
def q_a5(spark, sf):
    m = PR.quantiles(_panel(spark, sf), COLS, (0.5,), by="series_id")
    out = m.groupBy("series_id").pivot("column", COLS).agg(F.first("q0"))
    return _rounded(out, _DSC)


# ----------------------------------------------------------------- A7 / A8 / G5

def _corr_sql(a, b):
    if a == b:
        return f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
    m = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    x, y = f"CASE WHEN {m} THEN {a} END", f"CASE WHEN {m} THEN {b} END"
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) <> 0 THEN covar_pop({x}, {y}) / "
            f"(stddev_pop({x}) * stddev_pop({y})) END")


def _corr_matrix_sql(lower=False):
    parts = []
    for i, a in enumerate(COLS):
        for j, b in enumerate(COLS):
            if lower and not i > j:
                continue
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(_corr_sql(a, b), 9)} AS corr "
                         f"FROM panel")
    return with_panel(_union(parts))


@register("a7_corr_matrix", _corr_matrix_sql())
def q_a7(spark, sf):
    return PR.corr_matrix(_panel(spark, sf), COLS).withColumn("corr", rnd("corr", 9))


@register("g5_corr_lower_triangle", _corr_matrix_sql(lower=True))
def q_g5(spark, sf):
    return PR.corr_matrix(_panel(spark, sf), COLS, lower_only=True).withColumn("corr", rnd("corr", 9))


@register("a8_target_corr_ranked", with_panel(
    "SELECT feature, " + R("corr", 9) + " AS corr, " + R("abs(corr)", 9) + " AS abs_corr, "
    "CAST(row_number() OVER (ORDER BY abs(corr) DESC, feature) AS BIGINT) AS rank FROM ("
    + _union([f"SELECT '{c}' AS feature, {_corr_sql(c, 'y')} AS corr FROM panel" for c in FEATS])
    + ") t"))
def q_a8(spark, sf):
    t = PR.target_correlations(_panel(spark, sf), FEATS, "y")
    # p rows only: a single-partition window over the feature list is bounded.
    t = t.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("abs_corr").desc(), "feature")).cast("long"))
    return t.withColumn("corr", rnd("corr", 9)).withColumn("abs_corr", rnd("abs_corr", 9))


# ----------------------------------------------------------------- A9 / A10

@register("a9_a10_distinct_range", with_panel(_union([
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"{R(f'CAST(min({c}) AS DOUBLE)', _DSC[c])} AS min, {R(f'CAST(max({c}) AS DOUBLE)', _DSC[c])} AS max, "
    f"{R(f'CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)', _DSC[c])} AS range FROM panel"
    for c in COLS])))
def q_a9(spark, sf):
    d = PR.distinct_profile(_panel(spark, sf), COLS)
    return _round_long(d, ["min", "max", "range"])


# ----------------------------------------------------------------- A11 / A12

_A11_SQL = with_panel("""
SELECT series_id, min_value, max_value, mean, std, skewness, n_zeros, percent_zeros, cv,
  CASE WHEN n_zeros = 0 AND cv_raw > 1 THEN 'GLM_Gamma_Log'
       WHEN n_zeros > 0 THEN 'GLM_Tweedie_1.5' ELSE 'GLM_Gaussian_Log' END AS primary,
  CASE WHEN pz_raw = 0 THEN CASE WHEN cv_raw > 1 THEN 'GLM_Gamma_Log,GLM_Tweedie_1.9'
                                 ELSE 'GLM_Gaussian_Log,GLM_Gamma_Log' END
       ELSE 'GLM_Tweedie_1.5,GLM_Tweedie_1.1' END AS ranked
FROM (
  SELECT series_id, """ + R("min(y)", 10) + " AS min_value, " + R("max(y)", 10) + """ AS max_value,
    """ + R("avg(y)", 10) + " AS mean, " + R("stddev_samp(y)", 10) + """ AS std,
    """ + R("skewness(y)", 8) + """ AS skewness,
    CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_zeros,
    """ + R("avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) * 100", 8) + """ AS percent_zeros,
    """ + R("stddev_samp(y) / avg(y)", 9) + """ AS cv,
    stddev_samp(y) / avg(y) AS cv_raw, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS pz_raw
  FROM panel WHERE y IS NOT NULL GROUP BY series_id) t""")


@register("a11_a12_target_profile", _A11_SQL)
def q_a11(spark, sf):
    prof = PR.glm_recommendations(PR.target_profile(_panel(spark, sf), "y", by="series_id"))
    prof = prof.withColumn("ranked", F.concat_ws(",", "ranked"))
    return _rounded(prof, {"min_value": 10, "max_value": 10, "mean": 10, "std": 10,
                           "skewness": 8, "percent_zeros": 8, "cv": 9})


# ----------------------------------------------------------------- A17

_JB_SQL = with_panel("""
SELECT series_id, n, """ + R("skew", 8) + " AS skew, " + R("kurt", 8) + """ AS kurt,
       """ + R("n / 6.0 * (skew * skew + kurt * kurt / 4.0)", 8) + """ AS jb_stat,
       """ + R("exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4.0)) / 2.0)", 8) + """ AS jb_pvalue
FROM (
  SELECT p.series_id, CAST(count(*) AS BIGINT) AS n,
         avg(power(y - m, 3)) / power(avg(power(y - m, 2)), 1.5) AS skew,
         avg(power(y - m, 4)) / power(avg(power(y - m, 2)), 2) - 3 AS kurt
  FROM panel p JOIN (SELECT series_id, avg(y) AS m FROM panel GROUP BY 1) a USING (series_id)
  GROUP BY p.series_id) t""")


@register("a17_jarque_bera", _JB_SQL)
def q_a17(spark, sf):
    jb = PR.jarque_bera(_panel(spark, sf), "y", by="series_id")
    return _rounded(jb, {"skew": 8, "kurt": 8, "jb_stat": 8, "jb_pvalue": 8})


# ----------------------------------------------------------------- A21

def _a21_sql(w=12):
    parts = []
    for c in FEATS:
        fr = f"(PARTITION BY series_id ORDER BY period ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        rs = f"CASE WHEN count({c}) OVER {fr} = {w} THEN stddev_samp({c}) OVER {fr} END"
        parts.append(f"SELECT series_id, '{c}' AS feature, {rs} AS rs FROM panel")
    return with_panel(
        "SELECT series_id, feature, " + R("stddev_samp(rs)", 8) + " AS std_of_vol, "
        + R("avg(rs)", 8) + " AS mean_of_vol, "
        "coalesce(stddev_samp(rs) > 0.5 * avg(rs), false) AS high_variation FROM ("
        + _union(parts) + ") t GROUP BY series_id, feature")


@register("a21_volatility_regimes", _a21_sql())
def q_a21(spark, sf):
    v = PR.volatility_regimes(_panel(spark, sf), FEATS, series="series_id", order="period")
    return _rounded(v, {"std_of_vol": 8, "mean_of_vol": 8})


# ----------------------------------------------------------------- A22 / A6

@register("a22_drift", with_panel(_union([
    f"SELECT '{c}' AS feature, {R(f'avg({c}) FILTER (WHERE period < {CUTOFF})', 8)} AS mean_train, "
    f"{R(f'avg({c}) FILTER (WHERE period >= {CUTOFF})', 8)} AS mean_new, false AS missing, "
    f"abs(avg({c}) FILTER (WHERE period >= {CUTOFF}) - avg({c}) FILTER (WHERE period < {CUTOFF})) "
    f"> 0.1 * abs(avg({c}) FILTER (WHERE period < {CUTOFF})) AS drift FROM panel" for c in COLS])))
def q_a22(spark, sf):
    p = _panel(spark, sf)
    stats = PR.fit_feature_stats(p.where(F.col("period") < CUTOFF), COLS)
    rep = PR.drift_report(stats, p.where(F.col("period") >= CUTOFF), COLS)
    return _rounded(rep, {"mean_train": 8, "mean_new": 8})


# ----------------------------------------------------------------- P7 / G4 / G2

def _iqr_sql():
    parts = []
    for c in COLS:
        d = _DSC[c]
        parts.append(f"""SELECT '{c}' AS column, {R('q1', d)} AS q1, {R('q3', d)} AS q3,
  CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers,
  {R(f'count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) * 100', 8)} AS pct_outliers
FROM panel, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM panel) q
GROUP BY q1, q3""")
    return with_panel(_union(parts))


@register("p7_iqr_outliers", _iqr_sql())
def q_p7(spark, sf):
    o = PR.iqr_outliers(_panel(spark, sf), COLS)
    o = _round_long(o, ["q1", "q3"])
    return o.withColumn("pct_outliers", rnd("pct_outliers", 8))


def _box_sql():
    parts = []
    for c in COLS:
        d = _DSC[c]
        lo, hi = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
        parts.append(f"""SELECT '{c}' AS column, {R('q1', d)} AS q1, {R('med', d)} AS median, {R('q3', d)} AS q3,
  {R(f'CAST(min({c}) FILTER (WHERE {c} >= {lo}) AS DOUBLE)', d)} AS whisker_low,
  {R(f'CAST(max({c}) FILTER (WHERE {c} <= {hi}) AS DOUBLE)', d)} AS whisker_high,
  CAST(count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS BIGINT) AS n_fliers
FROM panel, (SELECT quantile_cont({c}, 0.25) AS q1, median({c}) AS med,
                    quantile_cont({c}, 0.75) AS q3 FROM panel) q
GROUP BY q1, med, q3""")
    return with_panel(_union(parts))


@register("g4_boxplot_stats", _box_sql())
def q_g4(spark, sf):
    b = PR.boxplot_stats(_panel(spark, sf), COLS)
    return _round_long(b, ["q1", "median", "q3", "whisker_low", "whisker_high"])


def _hist_sql(src, col, bins, digits, by=None):
    return f"""
SELECT bin, {R(f'mn + (mx - mn) * bin / {bins}', digits)} AS lower,
       {R(f'mn + (mx - mn) * (bin + 1) / {bins}', digits)} AS upper, CAST(count(*) AS BIGINT) AS count
FROM (
  SELECT CASE WHEN mx - mn = 0 THEN 0
              ELSE least(CAST(floor(({col} - mn) * {float(bins)} / (mx - mn)) AS BIGINT), {bins - 1}) END AS bin,
         mn, mx
  FROM {src}, (SELECT CAST(min({col}) AS DOUBLE) AS mn, CAST(max({col}) AS DOUBLE) AS mx FROM {src}) s
  WHERE {col} IS NOT NULL) t
GROUP BY bin, mn, mx"""


@register("g2_histogram_target", with_panel(_hist_sql("panel", "y", 30, 10)))
def q_g2(spark, sf):
    h = PR.histogram(_panel(spark, sf), "y", bins=30)
    return _rounded(h, {"lower": 10, "upper": 10})


@register("g2_histogram_lineitem_price", _hist_sql("lineitem", "l_extendedprice", 20, 4))
def q_g2b(spark, sf):
    h = PR.histogram(P.lineitem_frame(spark, sf), "l_extendedprice", bins=20)
    return _rounded(h, {"lower": 4, "upper": 4})


# ----------------------------------------------------------------- U1 / U2 / P3 / P4 / P5

def _scen_sql():
    facs = ", ".join(f"({i}, {f})" for i, f in enumerate(FACTORS))
    cols = []
    for c in FEATS:
        cols.append(f"CASE WHEN period >= {CUTOFF} THEN {c} * factor ELSE CAST({c} AS DOUBLE) END AS {c}")
    return (f"scen AS (SELECT CAST(s.scenario AS BIGINT) AS scenario, series_id, period, year, "
            f"{', '.join(cols)}, y FROM panel, (VALUES {facs}) s(scenario, factor))")


def _scen_out_sql(where):
    cols = ", ".join(f"{R(c, _DSC[c])} AS {c}" for c in COLS)
    return with_panel(f"SELECT scenario, series_id, period, {cols} FROM scen WHERE {where}",
                      _scen_sql())


def _scenarios(spark, sf):
    return P.scenario_panel(_panel(spark, sf), CUTOFF, FACTORS)


@register("u2_history_once_plus_futures",
          _scen_out_sql(f"(period < {CUTOFF} AND scenario = 0) OR period >= {CUTOFF}"))
def q_u2(spark, sf):
    """One pass over the stacked scenario panel keeps the history once
    (first block) and every block's future; U1 (futures only) is the
    second disjunct, P3 the cutoff predicate."""
    s = _scenarios(spark, sf)
    keep = ((F.col("period") < CUTOFF) & (F.col("scenario") == 0)) | (F.col("period") >= CUTOFF)
    return _rounded(s.where(keep).select("scenario", "series_id", "period", *COLS), _DSC)


@register("p4_positional_blocks", with_panel("""
SELECT row_pos, row_pos // n_block AS block, scenario, series_id, period
FROM (SELECT scenario, series_id, period,
             CAST(row_number() OVER (ORDER BY scenario, series_id, period) - 1 AS BIGINT) AS row_pos,
             CAST(count(*) OVER () / 3 AS BIGINT) AS n_block FROM scen) t""", _scen_sql()))
def q_p4(spark, sf):
    """Blocks by file position (block = row_pos // block length) with
    the length check ``count % n_blocks == 0``; the consecutive position is
    computed without a single-partition window."""
    s = _scenarios(spark, sf).select("scenario", "series_id", "period")
    s = W.with_row_pos(s, ["scenario", "series_id", "period"], "row_pos")
    n = s.count()
    if n % len(FACTORS):
        raise ValueError(f"{n} rows are not {len(FACTORS)} equal blocks")
    return s.withColumn("block", (F.col("row_pos") / F.lit(n // len(FACTORS))).cast("long"))


@register("p5_dropna_features", with_panel(
    "SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows, min(period) AS first_period FROM feat "
    "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEAT_NAMES + ["y"])
    + " GROUP BY series_id", _feat_sql()))
def q_p5(spark, sf):
    f = _features(spark, sf).dropna(subset=FEAT_NAMES + ["y"])
    return f.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.min("period").alias("first_period"))


# ----------------------------------------------------------------- X1 (rows only)

@register("x1_dummy_advisor")
def q_x1(spark, sf):
    p = _panel(spark, sf).drop("year")
    return PR.dummy_advisor(p, "y", "period", series="series_id")


_A9_COLS = ["l_linenumber", "l_tax", "l_quantity"]


@register("a9_sorted_distinct_values", "SELECT * FROM (" + _union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem GROUP BY {c}" for c in _A9_COLS])
    + """) t WHERE "column" IN (SELECT "column" FROM (""" + _union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM lineitem" for c in _A9_COLS]) + ") u WHERE n <= 10)")
def q_a9_values(spark, sf):
    """The distinct values of columns that have at most ten."""
    li = P.read_table(spark, sf, "lineitem", _A9_COLS)
    rows = [(c, float(v)) for c, vs in PR.distinct_values(li, _A9_COLS).items() for v in vs]
    return spark.createDataFrame(rows, "column string, value double")


@register("j3_missing_names", with_panel(
    "SELECT feature FROM (" + _union([f"SELECT '{c}' AS feature, count({c}) AS n FROM panel" for c in ["avg_tax", "ret_share"]])
    + ") t WHERE n > 0"))
def q_j3(spark, sf):
    """The training features that a scoring frame lacks (it has no avg_tax and no ret_share)."""
    p = _panel(spark, sf)
    stats = PR.fit_feature_stats(p.where(F.col("period") < CUTOFF), FEATS).select("feature")
    return PR.missing_features(stats, p.drop("avg_tax", "ret_share").columns)
