"""Catalog entries for feature preparation and selection
(W4, W5, F1, F3, F5-F7, F9, A13-A16, T1-T3, T7, K1, K7, K12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import features as FE
from ..operators import selection as SE
from ..operators import windows as W
from ..operators.knn_info import mutual_info_knn
from ..sources import panels as P
from ..sources.tables import read_table
from .catalog import FEATS, register
from .catalog_profile import (_DSC, CUTOFF, FEAT_NAMES, _feat_sql,
                              _features, _panel, _rounded, _union)
from .sqlparts import R, with_panel

COLS = FEATS + ["y"]
SEL = FEAT_NAMES  # engineered candidate features (24)


def _dg(name):
    base = name.split("_lag_")[0].split("_roll_")[0]
    return _DSC[base]


# ----------------------------------------------------------------- W4 / W5

def _w4_sql():
    w = "PARTITION BY series_id ORDER BY period"
    e = []
    for c in SEL:
        e.append(R(f"coalesce(last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING "
                   f"AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW "
                   f"AND UNBOUNDED FOLLOWING))", _dg(c)) + f" AS {c}")
    return with_panel(f"SELECT series_id, period, {', '.join(e)} FROM feat", _feat_sql())


@register("w4_fill_forward_backward", _w4_sql())
def q_w4(spark, sf):
    f = _features(spark, sf)
    out = W.fill_forward_backward(f, SEL, series="series_id", order="period")
    return _rounded(out.select("series_id", "period", *SEL), {c: _dg(c) for c in SEL})


@register("w4_fill_hot_series_halo", """
SELECT o_orderstatus, o_orderkey,
  coalesce(last_value(l2 IGNORE NULLS) OVER w1, first_value(l2 IGNORE NULLS) OVER w2) AS lag_2_filled
FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL
                     ELSE lag(o_totalprice, 2) OVER (PARTITION BY o_orderstatus
                          ORDER BY o_orderdate, o_orderkey) END AS l2 FROM orders) t
WINDOW w1 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       w2 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def q_w4_hot(spark, sf):
    """Forward/backward fill over three hot series (order status) in the
    two-pass skew-safe form; every 7th order's value is blanked so that
    gaps exist inside every bucket."""
    o = P.order_sequence(spark, sf, key="o_orderstatus")
    l2 = W.add_lag_roll(o, ["o_totalprice"], (2,), (), series="o_orderstatus",
                        order=["o_orderdate", "o_orderkey"], skew_safe=True, bucket_rows=1000)
    l2 = l2.withColumn("l2", F.when(F.col("o_orderkey") % 7 == 0, None)
                       .otherwise(F.col("o_totalprice_lag_2")))
    out = W.fill_forward_backward(l2, ["l2"], series="o_orderstatus",
                                  order=["o_orderdate", "o_orderkey"], skew_safe=True,
                                  bucket_rows=1000)
    return out.select("o_orderstatus", "o_orderkey", F.col("l2").alias("lag_2_filled"))


@register("w5_trend_from_training", with_panel(
    f"SELECT series_id, period, CAST(year - (SELECT min(year) FROM panel WHERE period < {CUTOFF}) "
    f"AS BIGINT) AS trend FROM panel"))
def q_w5(spark, sf):
    p = _panel(spark, sf)
    base = W.fit_base_year(p.where(F.col("period") < CUTOFF))
    return W.add_trend(p, base).select("series_id", "period", "trend")


# ----------------------------------------------------------------- F1 / F3

@register("f1_median_impute", with_panel(
    "SELECT series_id, period, " + ", ".join(
        f"{R(f'coalesce({c}, (SELECT median({c}) FROM feat))', _dg(c))} AS {c}" for c in SEL)
    + " FROM feat", _feat_sql()))
def q_f1(spark, sf):
    f = _features(spark, sf)
    imp = FE.fit_imputer(f, SEL + ["y"], "median")
    return _rounded(imp.transform(f).select("series_id", "period", *SEL), {c: _dg(c) for c in SEL})


def _f3_sql():
    w = "PARTITION BY series_id ORDER BY period"
    fills = []
    for c in SEL:
        fills.append(f"coalesce(last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED "
                     f"PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER ({w} ROWS "
                     f"BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")
    fut = (f"fut AS (SELECT series_id, period, {', '.join(fills)} FROM "
           f"(SELECT * FROM feat WHERE period >= {CUTOFF}) t)")
    med = f"trm AS (SELECT {', '.join(f'median({c}) AS {c}' for c in SEL)} FROM feat WHERE period < {CUTOFF})"
    cur = f"cur AS (SELECT {', '.join(f'median({c}) AS {c}' for c in SEL)} FROM fut)"
    sel = ", ".join(f"{R(f'coalesce(fut.{c}, trm.{c}, cur.{c})', _dg(c))} AS {c}" for c in SEL)
    return with_panel(f"SELECT series_id, period, {sel} FROM fut, trm, cur",
                      _feat_sql() + ",\n" + fut + ",\n" + med + ",\n" + cur)


@register("f3_scoring_fill_chain", _f3_sql())
def q_f3(spark, sf):
    """Scoring rows (after the cutoff): ffill -> bfill -> training median ->
    current median. Medians of the training rows are fitted state."""
    f = _features(spark, sf)
    train_med = FE.fit_imputer(f.where(F.col("period") < CUTOFF), SEL).values
    out = FE.fill_chain(f.where(F.col("period") >= CUTOFF), SEL, train_med,
                        series="series_id", order="period")
    return _rounded(out.select("series_id", "period", *SEL), {c: _dg(c) for c in SEL})


# ----------------------------------------------------------------- F5 / F6

def _scale_sql(kind):
    if kind == "robust":
        st = ", ".join(f"median({c}) AS {c}_c, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s"
                       for c in FEATS)
    elif kind == "standard":
        st = ", ".join(f"avg({c}) AS {c}_c, stddev_pop({c}) AS {c}_s" for c in FEATS)
    else:
        st = ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_c, CAST(max({c}) AS DOUBLE) - min({c}) AS {c}_s"
                       for c in FEATS)
    sel = ", ".join(R(f"({c} - {c}_c) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END", 9) + f" AS {c}"
                    for c in FEATS)
    return with_panel(f"SELECT series_id, period, {sel} FROM panel, st",
                      f"st AS (SELECT {st} FROM panel WHERE period < {CUTOFF})")


def _scaled(spark, sf, kind):
    p = _panel(spark, sf)
    sc = FE.fit_scaler(p.where(F.col("period") < CUTOFF), FEATS, kind)
    return _rounded(sc.transform(p).select("series_id", "period", *FEATS), {c: 9 for c in FEATS})


register("f5_robust_scale", _scale_sql("robust"))(lambda s, sf: _scaled(s, sf, "robust"))
register("f6_standard_scale", _scale_sql("standard"))(lambda s, sf: _scaled(s, sf, "standard"))
register("f6_minmax_scale", _scale_sql("minmax"))(lambda s, sf: _scaled(s, sf, "minmax"))


# ----------------------------------------------------------------- F7

# Periods inside the panel's years (the reference's defaults, 2008-2024,
# lie outside 1995-2001 and would give all-zero flags).
F7_PERIODS = {"crisis_1997": (1997, 1998), "crisis_2000": (2000, 2001)}
F7_REGIMES = {"post_1997_regime": 1997, "post_2000_regime": 2000}
F7_TRENDS = {"trend_post_1997": "post_1997_regime", "trend_post_2000": "post_2000_regime"}


@register("f7_structural_breaks", with_panel(f"""
SELECT series_id, period,
  CAST(year BETWEEN 1997 AND 1998 AS INTEGER) AS crisis_1997,
  CAST(year BETWEEN 2000 AND 2001 AS INTEGER) AS crisis_2000,
  CAST(year >= 1997 AS INTEGER) AS post_1997_regime, CAST(year >= 2000 AS INTEGER) AS post_2000_regime,
  CAST(year - b AS BIGINT) AS trend,
  CAST(year >= 1997 AS BIGINT) * CAST(year - b AS BIGINT) AS trend_post_1997,
  CAST(year >= 2000 AS BIGINT) * CAST(year - b AS BIGINT) AS trend_post_2000,
  CAST(year BETWEEN 1997 AND 1998 OR year BETWEEN 2000 AND 2001 AS INTEGER) AS high_volatility
FROM panel, (SELECT min(year) AS b FROM panel WHERE period < {CUTOFF}) t"""))
def q_f7(spark, sf):
    p = _panel(spark, sf)
    sb = FE.StructuralBreaks(F7_PERIODS, F7_REGIMES, F7_TRENDS).fit(p.where(F.col("period") < CUTOFF))
    return sb.transform(p).select("series_id", "period", *sb.names())


# ----------------------------------------------------------------- F8

F8_BASE = ["ret_share", "avg_qty"]
F8_FLAGS = ["crisis_1997", "crisis_2000", "post_1997_regime", "post_2000_regime", "trend",
            "trend_post_1997", "trend_post_2000", "high_volatility"]
F8_ENG = [f"{c}_lag_{k}" for c in F8_BASE for k in (1, 2)] + [f"{c}_roll_mean_3" for c in F8_BASE]


def _f8_sql():
    w = "PARTITION BY series_id ORDER BY period"
    eng = []
    for c in F8_BASE:
        eng += [f"lag({c}, {k}) OVER ({w}) AS {c}_lag_{k}" for k in (1, 2)]
        fr = f"({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
        eng.append(f"CASE WHEN count({c}) OVER {fr} = 3 THEN avg({c}) OVER {fr} END AS {c}_roll_mean_3")
    flags = f"""CAST(year BETWEEN 1997 AND 1998 AS INTEGER) AS crisis_1997,
  CAST(year BETWEEN 2000 AND 2001 AS INTEGER) AS crisis_2000,
  CAST(year >= 1997 AS INTEGER) AS post_1997_regime, CAST(year >= 2000 AS INTEGER) AS post_2000_regime,
  CAST(year - b AS BIGINT) AS trend,
  CAST(year >= 1997 AS BIGINT) * CAST(year - b AS BIGINT) AS trend_post_1997,
  CAST(year >= 2000 AS BIGINT) * CAST(year - b AS BIGINT) AS trend_post_2000,
  CAST(year BETWEEN 1997 AND 1998 OR year BETWEEN 2000 AND 2001 AS INTEGER) AS high_volatility"""
    ff = (f"ff AS (SELECT series_id, period, y, {', '.join(F8_BASE)}, {', '.join(eng)}, {flags} "
          f"FROM panel, (SELECT min(year) AS b FROM panel WHERE period < {CUTOFF}) t)")
    sel = [f"{R(f'coalesce({c}, (SELECT median({c}) FROM ff))', _dg(c))} AS {c}"
           for c in F8_BASE + F8_ENG]
    sel += [f"coalesce({c}, 0) AS {c}" for c in F8_FLAGS]
    return with_panel(f"SELECT series_id, period, {R('y', 10)} AS y, {', '.join(sel)} FROM ff", ff)


@register("f8_feature_flow_dummies", _f8_sql())
def q_f8(spark, sf):
    """F8: structural-break flags (F7) beside lag / rolling columns of the
    base features only; flags null -> 0, numeric columns median-filled."""
    from .training import feature_flow_with_dummies
    p = _panel(spark, sf)
    sb = FE.StructuralBreaks(F7_PERIODS, F7_REGIMES, F7_TRENDS).fit(p.where(F.col("period") < CUTOFF))
    x = sb.transform(p).select("series_id", "period", "year", "y", *F8_BASE, *sb.names())
    out, eng, _ = feature_flow_with_dummies(x, F8_BASE, sb.names(), (1, 2), (3,), "series_id", "period")
    return _rounded(out.select("series_id", "period", "y", *F8_BASE, *eng, *sb.names()),
                    {"y": 10, **{c: _dg(c) for c in F8_BASE + eng}})


# ----------------------------------------------------------------- A13 / A14 / T1 / T3

def _scores_sql(src, feats, where=""):
    parts = []
    for i, c in enumerate(feats):
        m = f"({c} IS NOT NULL AND y IS NOT NULL)"
        x, y = f"CASE WHEN {m} THEN {c} END", f"CASE WHEN {m} THEN y END"
        corr = (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) <> 0 THEN covar_pop({x}, {y}) / "
                f"(stddev_pop({x}) * stddev_pop({y})) END")
        parts.append(f"SELECT '{c}' AS feature, {i} AS idx, CAST(count(*) FILTER (WHERE {m}) AS BIGINT) AS n, "
                     f"{corr} AS corr, regr_r2({y}, {x}) AS r2 FROM {src} {where}")
    return ("sc AS (SELECT *, abs(corr) AS abs_corr, CASE WHEN coalesce(corr, 0) * coalesce(corr, 0) >= 1 "
            "THEN 'inf'::DOUBLE ELSE coalesce(corr, 0) * coalesce(corr, 0) / "
            "(1 - coalesce(corr, 0) * coalesce(corr, 0)) * (n - 2) END AS f_stat FROM ("
            + _union(parts) + ") u)")


_CLEAN = "clean AS (SELECT * FROM feat WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in SEL + ["y"]) + ")"


def _clean(spark, sf):
    return _features(spark, sf).dropna(subset=SEL + ["y"])


@register("a13_a14_univariate_scores", with_panel(
    f"SELECT feature, CAST(idx AS INTEGER) AS idx, n, {R('corr', 9)} AS corr, {R('r2', 9)} AS r2, "
    f"{R('abs_corr', 9)} AS abs_corr, {R('f_stat', 6)} AS f_stat FROM sc",
    _feat_sql() + ",\n" + _CLEAN + ",\n" + _scores_sql("clean", SEL)))
def q_a13(spark, sf):
    s = SE.univariate_scores(_clean(spark, sf), SEL, "y")
    return _rounded(s, {"corr": 9, "r2": 9, "abs_corr": 9, "f_stat": 6})


@register("a13_f_pvalues")
def q_a13p(spark, sf):
    """F-test p-values, F(1, n-2) tail by a pandas UDF on the p-row table."""
    return SE.with_pvalues(SE.univariate_scores(_clean(spark, sf), SEL, "y")).select(
        "feature", "f_stat", "p_value")


@register("t1_select_k_best", with_panel(f"""
SELECT feature, CAST(idx AS INTEGER) AS idx, {R('f_stat', 6)} AS f_stat FROM (
  SELECT *, row_number() OVER (ORDER BY f_stat DESC NULLS LAST, idx DESC) AS rk,
         least(greatest(5, least(20, (SELECT count(*) FROM clean) // 15)), {len(SEL)}) AS k
  FROM sc) t WHERE rk <= k""", _feat_sql() + ",\n" + _CLEAN + ",\n" + _scores_sql("clean", SEL)))
def q_t1(spark, sf):
    c = _clean(spark, sf)
    names, scores = SE.select_k_best(c, SEL, "y")
    return _rounded(scores.where(F.col("feature").isin(names)).select("feature", "idx", "f_stat"),
                    {"f_stat": 6})


@register("t3_top5_by_f", with_panel(f"""
SELECT feature, {R('f_stat', 6)} AS f_stat,
       CAST(row_number() OVER (ORDER BY f_stat DESC NULLS LAST, idx DESC) AS BIGINT) AS rank
FROM sc ORDER BY f_stat DESC NULLS LAST, idx DESC LIMIT 5""",
    _feat_sql() + ",\n" + _CLEAN + ",\n" + _scores_sql("clean", SEL)))
def q_t3(spark, sf):
    s = SE.univariate_scores(_clean(spark, sf), SEL, "y")
    # top-n is the feature itself; ranking runs on the p-row score table
    top = s.orderBy(F.col("f_stat").desc_nulls_last(), F.col("idx").desc()).limit(5)
    top = top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("f_stat").desc_nulls_last(), F.col("idx").desc())).cast("long"))
    return _rounded(top.select("feature", "f_stat", "rank"), {"f_stat": 6})


@register("t7_top_correlated", with_panel(f"""
SELECT feature FROM sc ORDER BY abs_corr DESC NULLS LAST, idx LIMIT {min(5, int(len(FEATS) ** 0.5))}""",
    _scores_sql("panel", FEATS)))
def q_t7(spark, sf):
    names = SE.top_correlated(_panel(spark, sf), FEATS, "y")
    return spark.createDataFrame([(n,) for n in names], "feature string")


# ----------------------------------------------------------------- T2

_DUMMIES = ["crisis_1997", "crisis_2000", "post_1997_regime", "post_2000_regime", "trend",
            "trend_post_1997", "trend_post_2000", "high_volatility"]


def _t2_frame(spark, sf):
    c = _clean(spark, sf)
    sb = FE.StructuralBreaks(F7_PERIODS, F7_REGIMES, F7_TRENDS).fit(c.where(F.col("period") < CUTOFF))
    return sb.transform(c)


@register("t2_select_keep_dummies", with_panel(f"""
SELECT feature FROM (
  SELECT feature, row_number() OVER (ORDER BY f_stat DESC NULLS LAST, idx DESC) AS rk FROM sc) t
WHERE rk <= greatest(5, least(greatest(10, least(25, (SELECT count(*) FROM clean) // 12)),
                              {len(SEL) + len(_DUMMIES)}) - {len(_DUMMIES)})
UNION ALL SELECT * FROM (VALUES {', '.join(f"('{d}')" for d in _DUMMIES)}) v(feature)""",
    _feat_sql() + ",\n" + _CLEAN + ",\n" + _scores_sql("clean", SEL)))
def q_t2(spark, sf):
    d = _t2_frame(spark, sf)
    names = SE.select_keep_dummies(d, SEL + _DUMMIES, _DUMMIES, "y")
    return spark.createDataFrame([(n,) for n in names], "feature string")


# ----------------------------------------------------------------- A15 / A16

def _mi_sql(src, feats, bins=10):
    mm = ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_mn, CAST(max({c}) AS DOUBLE) AS {c}_mx"
                   for c in feats + ["y"])

    def b(c):
        return (f"CASE WHEN {c}_mx = {c}_mn THEN 0 ELSE least(CAST(floor(({c} - {c}_mn) * {float(bins)} "
                f"/ ({c}_mx - {c}_mn)) AS BIGINT), {bins - 1}) END")
    parts = [f"SELECT '{c}' AS feature, {b(c)} AS bx, {b('y')} AS bt FROM {src}, mm WHERE y IS NOT NULL "
             f"AND {c} IS NOT NULL" for c in feats]
    return (f"mm AS (SELECT {mm} FROM {src}),\n"
            f"cnt AS (SELECT feature, bx, bt, CAST(count(*) AS DOUBLE) AS c FROM ({_union(parts)}) u "
            f"GROUP BY 1, 2, 3),\n"
            "mic AS (SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM ("
            "SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bx) AS cx, "
            "sum(c) OVER (PARTITION BY feature, bt) AS cy FROM cnt) t GROUP BY feature)")


@register("a15_mutual_info_binned", with_panel(
    f"SELECT feature, {R('mi', 9)} AS mi FROM mic", _mi_sql("panel", FEATS)))
def q_a15(spark, sf):
    return _rounded(SE.mutual_info_binned(_panel(spark, sf), FEATS, "y"), {"mi": 9})


_CUSTOMER_FEATS = ["acctbal", "nation", "n_orders", "mean_value"]

_CUSTOMER_SQL = """
SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS acctbal, CAST(c_nationkey AS DOUBLE) AS nation,
       CAST(n AS DOUBLE) AS n_orders, cents / n / 100e0 AS mean_value, cents / 100e0 AS y
FROM customer JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cents
                    FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"""


def _mi_knn_sql(k=3):
    """All pairs of rows, and digamma of a whole number as a harmonic sum."""
    long = _union([f"SELECT '{c}' AS feature, id, {c} AS x, y FROM cust" for c in _CUSTOMER_FEATS])

    def units(c):
        return (f"CASE WHEN s{c} = 0 THEN 0 ELSE CAST(round_even(({c} - round_even(m{c} / s{c}, 0) * s{c}) "
                f"* (68719476736e0 / s{c}), 0) AS BIGINT) END AS {c}")
    return f"""
WITH cust AS ({_CUSTOMER_SQL}),
u AS ({long}),
st AS (SELECT feature, count(*) AS n, avg(x) AS mx, avg(y) AS my,
              CAST(format('{{:.5e}}', stddev_pop(x)) AS DOUBLE) AS sx,
              CAST(format('{{:.5e}}', stddev_pop(y)) AS DOUBLE) AS sy FROM u GROUP BY feature),
v AS (SELECT feature, id, {units('x')}, {units('y')} FROM u JOIN st USING (feature)),
d AS (SELECT a.feature, a.id, any_value(a.x) AS x, any_value(a.y) AS y,
             min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k})[{k}] AS r
      FROM v a JOIN v b ON a.feature = b.feature AND a.id <> b.id GROUP BY a.feature, a.id),
c AS (SELECT a.feature, a.id, count(*) FILTER (abs(a.x - b.x) <= greatest(r - 1, 0)) AS nx,
             count(*) FILTER (abs(a.y - b.y) <= greatest(r - 1, 0)) AS ny
      FROM d a JOIN v b ON a.feature = b.feature GROUP BY a.feature, a.id),
h AS (SELECT i, coalesce(sum(1e0 / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             - 0.5772156649015329e0 AS psi FROM (SELECT row_number() OVER () AS i FROM customer) t)
SELECT feature, any_value(st.n) AS n, {R(f'greatest(0e0, any_value(hn.psi) + any_value(hk.psi) - avg(hx.psi + hy.psi))', 9)} AS mi
FROM c JOIN st USING (feature) JOIN h hx ON hx.i = nx JOIN h hy ON hy.i = ny JOIN h hn ON hn.i = st.n
JOIN h hk ON hk.i = {k} GROUP BY feature"""


@register("a15_mutual_info_knn", _mi_knn_sql())
def q_a15_knn(spark, sf):
    """Which traits of a customer tell the value of their orders; two of the traits are whole
    numbers that many customers share."""
    orders = (read_table(spark, sf, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("cents")))
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey"]).join(orders, F.col("c_custkey") == F.col("o_custkey"))
    d = cust.select(F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"),
                    F.col("n").cast("double").alias("n_orders"), (F.col("cents") / F.col("n") / 100).alias("mean_value"),
                    (F.col("cents") / 100).alias("y"))
    return _rounded(mutual_info_knn(d, _CUSTOMER_FEATS, "y"), {"mi": 9})


def _a16_sql():
    norm = []
    for m in ["abs_corr", "mi", "f_stat", "r2"]:
        norm.append(f"CASE WHEN max({m}) OVER () - min({m}) OVER () <> 0 THEN ({m} - min({m}) OVER ()) / "
                    f"(max({m}) OVER () - min({m}) OVER ()) END AS norm_{m}")
    return with_panel(f"""
SELECT feature, {R('composite', 9)} AS composite,
       CAST(row_number() OVER (ORDER BY composite DESC NULLS LAST, idx) AS BIGINT) AS rank FROM (
  SELECT feature, idx, (norm_abs_corr + norm_mi + norm_f_stat + norm_r2) / 4 AS composite FROM (
    SELECT sc.feature, sc.idx, {', '.join(norm)} FROM sc JOIN mic USING (feature)) a) b""",
                      _scores_sql("panel", FEATS) + ",\n" + _mi_sql("panel", FEATS))


@register("a16_composite_ranking", _a16_sql())
def q_a16(spark, sf):
    r = SE.composite_ranking(_panel(spark, sf), FEATS, "y")
    return _rounded(r.select("feature", "composite", "rank"), {"composite": 9})


# ----------------------------------------------------------------- A6 / K9 / K11

@register("a6_training_feature_stats", with_panel(_union([
    f"SELECT '{c}' AS feature, {R(f'avg({c})', _DSC[c])} AS mean, {R(f'stddev_samp({c})', _DSC[c])} AS std, "
    f"{R(f'CAST(min({c}) AS DOUBLE)', _DSC[c])} AS min, {R(f'CAST(max({c}) AS DOUBLE)', _DSC[c])} AS max "
    f"FROM panel WHERE period < {CUTOFF}" for c in COLS])))
def q_a6(spark, sf):
    """Mean, sample std, min and max per feature on the training block
    (kept with the model for the A22 drift check). One aggregate."""
    from ..operators import profile as PR
    st = PR.fit_feature_stats(_panel(spark, sf).where(F.col("period") < CUTOFF), COLS)
    return _rounded_by_feature(st, ["mean", "std", "min", "max"])


def _rounded_by_feature(d, stats):
    """Round each stat with the digits of the row's feature (long table)."""
    e = None
    for c in COLS:
        e = (F.when(F.col("feature") == c, F.lit(_DSC[c])) if e is None
             else e.when(F.col("feature") == c, F.lit(_DSC[c])))
    d = d.withColumn("_dg", e)
    out = {}
    for m in stats:
        sc = F.pow(F.lit(10.0), F.col("_dg"))
        out[m] = F.round(F.col(m).cast("double") * sc, 0) / sc + F.lit(0.0)
    return d.withColumns(out).drop("_dg")


K9_COLS, K9_WIN = ["ret_share", "y"], 6


def _k9_sql():
    w = f"(PARTITION BY series_id ORDER BY period ROWS BETWEEN {K9_WIN - 1} PRECEDING AND CURRENT ROW)"
    e = []
    for c in K9_COLS:
        m1, m2 = f"avg({c}) OVER {w}", f"avg({c} * {c}) OVER {w}"
        m3, m4 = f"avg({c} * {c} * {c}) OVER {w}", f"avg({c} * {c} * {c} * {c}) OVER {w}"
        v = f"({m2} - {m1} * {m1})"
        c3 = f"({m3} - 3 * {m1} * {m2} + 2 * {m1} * {m1} * {m1})"
        c4 = f"({m4} - 4 * {m1} * {m3} + 6 * {m1} * {m1} * {m2} - 3 * {m1} * {m1} * {m1} * {m1})"
        full = f"count({c}) OVER {w} = {K9_WIN}"
        e.append(R(f"CASE WHEN {full} THEN {c3} / power({v}, 1.5) END", 5) + f" AS {c}_roll_skew_{K9_WIN}")
        e.append(R(f"CASE WHEN {full} THEN {c4} / ({v} * {v}) - 3 END", 4) + f" AS {c}_roll_kurt_{K9_WIN}")
    return with_panel(f"SELECT series_id, period, {', '.join(e)} FROM panel")


@register("k9_rolling_moments", _k9_sql())
def q_k9(spark, sf):
    """K9: rolling population skewness and excess kurtosis over complete
    windows of 6 months per series (windowed ``skewness`` / ``kurtosis``).
    The oracle rebuilds them from raw moments, so they agree to about 5
    significant digits."""
    out = FE.rolling_moments(_panel(spark, sf), K9_COLS, K9_WIN, series="series_id", order="period")
    names = [f"{c}_roll_{m}_{K9_WIN}" for c in K9_COLS for m in ("skew", "kurt")]
    return _rounded(out.select("series_id", "period", *names),
                    {n: (5 if "_skew_" in n else 4) for n in names})


K11_COLS, K11_PERIODS = ["ret_share", "avg_qty"], (3, 12)


@register("k11_seasonal_features", with_panel("SELECT series_id, period, " + ", ".join(
    [f"{R(f'{c} - lag({c}, {p}) OVER (PARTITION BY series_id ORDER BY period)', _DSC[c])} AS {c}_sdiff_{p}"
     for p in K11_PERIODS for c in K11_COLS]
    + [f"{R(f'sin(2 * pi() / {p} * ((period % 100) % {p}))', 9)} AS sin_{p}, "
       f"{R(f'cos(2 * pi() / {p} * ((period % 100) % {p}))', 9)} AS cos_{p}" for p in K11_PERIODS])
    + " FROM panel"))
def q_k11(spark, sf):
    """Seasonal differences x - lag(x, p) per series and sin / cos of
    the month phase for p = 3 and 12."""
    p = _panel(spark, sf).withColumn("month", F.col("period") % 100)
    out = FE.seasonal_features(p, K11_COLS, K11_PERIODS, "month", series="series_id", order="period")
    names = [f"{c}_sdiff_{q}" for q in K11_PERIODS for c in K11_COLS]
    trig = [f"{f}_{q}" for q in K11_PERIODS for f in ("sin", "cos")]
    return _rounded(out.select("series_id", "period", *names, *trig),
                    {**{n: _DSC[n.split("_sdiff_")[0]] for n in names}, **{t: 9 for t in trig}})


@register("k6_isolation_forest_lineitem")
def q_k6(spark, sf):
    """K6: isolation-forest score of every lineitem row on quantity, price,
    discount and tax (100 trees of 256 sampled rows, hash-sampled, grown per
    tree in ``applyInPandas``, broadcast and scored in Arrow batches).
    Random trees have no SQL oracle; tests check a planted outlier."""
    from ..operators import iforest as IF
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = P.lineitem_frame(spark, sf).select("l_orderkey", "l_linenumber", *cols)
    model = IF.fit_isolation_forest(li, cols, n_trees=100, sample_size=256, seed=42,
                                    key=["l_orderkey", "l_linenumber"])
    return model.transform(li).select("l_orderkey", "l_linenumber", rnd("anomaly_score", 9)
                                      .alias("anomaly_score"), "is_outlier")


@register("g10_feature_top_lists")
def q_g10(spark, sf):
    """Top-10 lists by |correlation|, mutual information, F (p < 0.05
    only) and the composite. The p-value filter needs the F distribution,
    which the SQL oracle side lacks, so this is checked by rows only; each
    list's scores are checked by A13/A15/A16."""
    return _rounded(SE.top_lists(_panel(spark, sf), FEATS, "y", n=10), {"score": 9})


# ----------------------------------------------------------------- F9 / K12 / K7 / K1 (rows only)

@register("f9_correlation_guided_features")
def q_f9(spark, sf):
    """lags 1,2 of the T7 features, rolling mean 3,5 and rolling std 3 of
    the top 3, null rows dropped, then T1. The column set depends on the data,
    so there is no static SQL oracle."""
    p = _panel(spark, sf)
    top = SE.top_correlated(p, FEATS, "y")
    top3 = SE.top_correlated(p, FEATS, "y", n=3)
    f = W.add_lag_roll(p, top, (1, 2), (), series="series_id", order="period")
    f = W.add_lag_roll(f, top3, (), (3, 5), series="series_id", order="period", stats=("mean",))
    f = W.add_lag_roll(f, top3, (), (3,), series="series_id", order="period", stats=("std",))
    cand = [c for c in f.columns if c not in ("series_id", "period", "year", "y")]
    clean = f.dropna(subset=cand + ["y"])
    names, scores = SE.select_k_best(clean, cand, "y")
    return scores.where(F.col("feature").isin(names)).select("feature", "f_stat")


# Decimals of a feature's variance.
_VAR_DIGITS = {"n_orders": 4, "n_customers": 4, "avg_order_value": 0, "avg_qty": 6, "avg_tax": 12, "ret_share": 10}


def _k12_sql() -> str:
    rows = []
    for c in FEATS:
        most = ", ".join(f"abs(corr({c}, {d}))" for d in FEATS if d != c)
        rows.append(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS missing_share, "
                    f"{R(f'var_samp({c})', _VAR_DIGITS[c])} AS variance, greatest({most}) AS r, var_samp({c}) AS v FROM panel")
    return ("SELECT feature, CAST(missing_share AS DOUBLE) AS missing_share, variance, " + R("r", 9) + " AS max_abs_corr, "
            "missing_share > 0.1 AS too_many_missing, r > 0.95 AS too_correlated, v < 0.01 AS low_variance "
            "FROM (" + " UNION ALL ".join(rows) + ") t")


@register("k12_feature_checks", with_panel(_k12_sql()))
def q_k12(spark, sf):
    """Missing share, variance and largest correlation per feature against the thresholds."""
    out = SE.feature_checks(_panel(spark, sf), FEATS)
    var = F.coalesce(*[F.when(F.col("feature") == c, rnd("variance", d)) for c, d in _VAR_DIGITS.items()])
    return out.withColumn("variance", var).withColumn("max_abs_corr", rnd("max_abs_corr", 9))


@register("k7_polynomial_features", with_panel(
    "SELECT series_id, period, " + ", ".join(
        [f"{R(f'power(ret_share, 2.0)', 10)} AS ret_share_pow_2",
         f"{R(f'power(avg_tax, 2.0)', 12)} AS avg_tax_pow_2",
         f"{R('ret_share * avg_tax', 12)} AS ret_share_x_avg_tax"]) + " FROM panel"))
def q_k7(spark, sf):
    p = FE.polynomial_features(_panel(spark, sf), ["ret_share", "avg_tax"], 2)
    return _rounded(p.select("series_id", "period", "ret_share_pow_2", "avg_tax_pow_2",
                             "ret_share_x_avg_tax"),
                    {"ret_share_pow_2": 10, "avg_tax_pow_2": 12, "ret_share_x_avg_tax": 12})


def _k1_sql(n=20):
    """Place on the training months' quantile grid, linear between its points."""
    grid = ", ".join(f"quantile_cont({c}, [{', '.join(str(i / n) for i in range(n + 1))}]) AS g_{c}" for c in FEATS)

    def place(c):
        g = f"g_{c}"
        part = lambda i: f"CASE WHEN {g}[{i + 1}] = {g}[{i}] THEN 0 ELSE ({c} - {g}[{i}]) / ({g}[{i + 1}] - {g}[{i}]) END"
        return f"CASE WHEN {c} <= {g}[1] THEN 0 " + " ".join(
            f"WHEN {c} <= {g}[{i + 1}] THEN ({i - 1} + {part(i)}) / {n}.0" for i in range(1, n + 1)) + " ELSE 1 END"
    return with_panel(f"SELECT series_id, period, {', '.join(R(place(c), 8) + f' AS {c}' for c in FEATS)} FROM panel, grids",
                      f"grids AS (SELECT {grid} FROM panel WHERE period < {CUTOFF})")


@register("k1_quantile_scale", _k1_sql())
def q_k1(spark, sf):
    """K1: every feature's place on the exact 20-quantile grid of the training months."""
    p = _panel(spark, sf)
    scaler = FE.fit_quantile_scaler(p.where(F.col("period") < CUTOFF), FEATS)
    return _rounded(scaler.transform(p).select("series_id", "period", *FEATS), {c: 8 for c in FEATS})



@register("f2_mean_impute", with_panel(
    f"SELECT series_id, period, {R('coalesce(l1, (SELECT avg(l1) FROM lagged WHERE period < ' + str(CUTOFF) + '))', 8)} AS avg_qty_lag_1 "
    "FROM lagged",
    "lagged AS (SELECT series_id, period, lag(avg_qty, 1) OVER (PARTITION BY series_id ORDER BY period) AS l1 FROM panel)"))
def q_f2_mean(spark, sf):
    """F2 mean strategy: the training mean fills the gap that a lag leaves."""
    p = W.add_lag_roll(_panel(spark, sf), ["avg_qty"], (1,), (), series="series_id", order="period")
    imp = FE.fit_imputer(p.where(F.col("period") < CUTOFF), ["avg_qty_lag_1"], "mean")
    return _rounded(imp.transform(p).select("series_id", "period", "avg_qty_lag_1"), {"avg_qty_lag_1": 8})


@register("f2_forward_fill", with_panel(
    f"""SELECT series_id, period, {R("coalesce(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 8)} AS avg_qty
FROM gaps WINDOW w AS (PARTITION BY series_id ORDER BY period)""",
    "gaps AS (SELECT series_id, period, CASE WHEN period % 3 <> 0 THEN avg_qty END AS v FROM panel)"))
def q_f2_ffill(spark, sf):
    """F2 forward fill (leading gaps take the first value) of a column with gaps."""
    p = _panel(spark, sf).select("series_id", "period", F.when(F.col("period") % 3 != 0, F.col("avg_qty")).alias("avg_qty"))
    return _rounded(W.fill_forward_backward(p, ["avg_qty"], series="series_id", order="period"), {"avg_qty": 8})


@register("k6_zscore_outliers", """
SELECT l_orderkey, l_linenumber, abs(l_extendedprice - m) / s > 2.0 AS l_extendedprice_zoutlier
FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) t""")
def q_k6_z(spark, sf):
    """K6 z-score flags of every lineitem row."""
    li = P.lineitem_frame(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return FE.zscore_outliers(li, ["l_extendedprice"], 2.0).drop("l_extendedprice")
