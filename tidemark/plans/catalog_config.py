"""Catalog entries for configured pipelines and declared extras
(C1-C4, V7, T6, O8, K2-K4, K8, K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import features as FE
from ..operators import models as M
from ..sources.tables import read_table
from . import config as CF
from .catalog import FEATS, register
from .catalog_profile import CUTOFF, _panel
from .sqlparts import DIGITS, R, with_panel


def _p(spark, sf):
    return _panel(spark, sf).drop("year")


def _preset(name, **over):
    cfg = CF.custom_config(name, **{"time_series.series": ["series_id"], "time_series.time_unit": "yyyymm",
                                    "target_column": "y", **over})
    return cfg


def _run_preset(spark, sf, name):
    p = _p(spark, sf)
    pipe = CF.FeaturePipeline(_preset(name)).fit(p.where(F.col("period") < CUTOFF))
    return pipe.transform(p)


register("c2_preset_basic_timeseries")(lambda s, sf: _run_preset(s, sf, "basic_timeseries"))


def _minimal_sql() -> str:
    """Lag 1, rolling mean and std over 3; gaps take the training median of the engineered column."""
    w3 = "(PARTITION BY series_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    eng = {}
    for c in FEATS:
        eng[f"{c}_lag_1"] = (f"lag({c}, 1) OVER (PARTITION BY series_id ORDER BY period)", c)
        for stat, fn in (("mean", "avg"), ("std", "stddev_samp")):
            eng[f"{c}_roll_{stat}_3"] = (f"CASE WHEN count({c}) OVER {w3} = 3 THEN {fn}({c}) OVER {w3} END", c)
    made = ", ".join(f"{e} AS {n}" for n, (e, _) in eng.items())
    meds = ", ".join(f"median({n}) AS {n}" for n in eng)
    cols = [R(c, DIGITS[c]) + f" AS {c}" for c in FEATS] + [
        R(f"coalesce(e.{n}, m.{n})", DIGITS[c]) + f" AS {n}" for n, (_, c) in eng.items()]
    return with_panel(f"SELECT series_id, period, {R('y', 10)} AS y, {', '.join(cols)} FROM e, m",
                      f"e AS (SELECT *, {made} FROM panel), m AS (SELECT {meds} FROM e WHERE period < {CUTOFF})")


@register("c2_preset_minimal", _minimal_sql())
def q_c2_minimal(spark, sf):
    out = _run_preset(spark, sf, "minimal")
    base = {c: max((f for f in [*FEATS, "y"] if c == f or c.startswith(f + "_")), key=len, default=None) for c in out.columns}
    return out.withColumns({c: rnd(c, DIGITS[f]) for c, f in base.items() if f})


def _ml_pipeline(scaler: str):
    from pyspark.ml import Pipeline

    from ..operators import stages as ST
    keys, where = ["series_id", "period", "y", "year"], {"seriesCols": ["series_id"], "orderCols": ["period"]}
    return Pipeline(stages=[ST.CarryValues(inputCols=FEATS, **where),
                            ST.LagRoll(inputCols=FEATS, lags=[1], windows=[3], stats=["mean", "std"], **where),
                            ST.FillMissing(excludeCols=keys, requiredCol="y"), ST.ColumnScaler(excludeCols=keys, kind=scaler),
                            ST.BreakDummies(yearCol="year")])


def _saved_and_loaded(spark, sf, scaler):
    """Fit on the training months, save, load, transform all months."""
    import uuid

    from pyspark.ml import PipelineModel

    from ..session import ensure_checkpoint_dir
    p, path = _panel(spark, sf), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    _ml_pipeline(scaler).fit(p.where(F.col("period") < CUTOFF)).write().save(path)
    return PipelineModel.load(path).transform(p)


@register("f10_ml_pipeline_minimal", _minimal_sql())
def q_f10_minimal(spark, sf):
    """F10 / 2.17: the minimal preset as pyspark.ml stages, saved and loaded; same rows."""
    out = _saved_and_loaded(spark, sf, "none")
    made = [f"{c}_lag_1" for c in FEATS] + [f"{c}_roll_{s}_3" for c in FEATS for s in ("mean", "std")]
    of = {n: c for c in FEATS for n in (c, f"{c}_lag_1", f"{c}_roll_mean_3", f"{c}_roll_std_3")}
    return out.select("series_id", "period", rnd("y", 10).alias("y"), *[rnd(n, DIGITS[of[n]]).alias(n) for n in [*FEATS, *made]])


def _ml_robust_sql() -> str:
    names = [c for f in FEATS for c in (f, f"{f}_lag_1")]
    lag = ", ".join(f"lag({c}, 1) OVER (PARTITION BY series_id ORDER BY period) AS {c}_lag_1" for c in FEATS)
    med = ", ".join(f"median({c}) AS {c}" for c in names)
    qs = ", ".join(f"median({c}) AS {c}_c, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s" for c in names)
    filled = ", ".join(f"coalesce(e.{c}, m.{c}) AS {c}" for c in names)
    cols = ", ".join(f"{R(f'(f.{c} - {c}_c) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END', 6)} AS {c}" for c in names)
    return with_panel(f"""SELECT f.series_id, f.period, {cols}, CAST(CASE WHEN f.year BETWEEN 2008 AND 2009 THEN 1 ELSE 0 END AS INTEGER) AS crisis_2008,
       CAST(f.year - base AS BIGINT) AS trend
FROM f, q, (SELECT min(year) AS base FROM panel WHERE period < {CUTOFF}) b""", f"""
e AS (SELECT *, {lag} FROM panel), m AS (SELECT {med} FROM e WHERE period < {CUTOFF}),
f AS (SELECT e.series_id, e.period, e.year, {filled} FROM e, m), q AS (SELECT {qs} FROM f WHERE period < {CUTOFF})""")


@register("f10_ml_pipeline_robust", _ml_robust_sql())
def q_f10_robust(spark, sf):
    """F10 / 2.17: lags, imputer, robust scaler and break dummies as pyspark.ml stages, saved and loaded."""
    out = _saved_and_loaded(spark, sf, "robust")
    names = [c for f in FEATS for c in (f, f"{f}_lag_1")]
    return out.select("series_id", "period", *[rnd(c, 6).alias(c) for c in names], F.col(_FIRST_CRISIS).alias("crisis_2008"), "trend")


_FIRST_CRISIS = next(iter(FE.DEFAULT_PERIODS))


register("c2_preset_advanced_timeseries")(lambda s, sf: _run_preset(s, sf, "advanced_timeseries"))


@register("c1_pipeline_drift_report")
def q_c1(spark, sf):
    """C1/F10 validation step: drift of every engineered feature between
    the training months and the later months."""
    p = _p(spark, sf)
    pipe = CF.FeaturePipeline(_preset("basic_timeseries")).fit(p.where(F.col("period") < CUTOFF))
    pipe.transform(p.where(F.col("period") >= CUTOFF))
    return pipe.drift


@register("v7_experiment_tracker")
def q_v7(spark, sf):
    """Three configurations x forest on a hash hold-out (by
    month), metrics table, best by R^2."""
    p = _p(spark, sf)
    tr = CF.ExperimentTracker(spark)
    for name in ("minimal", "basic_timeseries"):
        tr.run(name, _preset(name), p, "period", params={"n_estimators": 50, "max_depth": 10})
    tr.run("minimal_linear", _preset("minimal"), p, "period",
           spec=M.ModelSpec("Linear Regression", "linear"))
    best = tr.best("r2").first()["experiment"]
    return tr.results().withColumn("is_best", F.col("experiment") == F.lit(best))


def _sel_frame(spark, sf):
    from ..operators import windows as W
    p = W.add_lag_roll(_p(spark, sf), FEATS, (1, 2), (3, 6), series="series_id", order="period")
    cand = [c for c in p.columns if c not in ("series_id", "period", "y")]
    return p.dropna(subset=cand + ["y"]).cache(), cand


@register("k2_rfe_selection")
def q_k2(spark, sf):
    d, cand = _sel_frame(spark, sf)
    names = CF.select_rfe(d, cand, "y", 10)
    d.unpersist()
    return spark.createDataFrame([(n,) for n in names], "feature string")


@register("k2_rfe_two_features", """
SELECT CASE WHEN abs((ry1 - r12 * ry2) / (1 - r12 * r12)) >= abs((ry2 - r12 * ry1) / (1 - r12 * r12))
            THEN 'l_quantity' ELSE 'l_discount' END AS feature
FROM (SELECT corr(l_extendedprice, l_quantity) AS ry1, corr(l_extendedprice, l_discount) AS ry2, corr(l_quantity, l_discount) AS r12 FROM lineitem) c""")
def q_k2_two(spark, sf):
    """K2 on every lineitem row: of two features the one with the larger standardised
    coefficient stays, which correlations give in closed form."""
    li = read_table(spark, sf, "lineitem", ["l_extendedprice", "l_quantity", "l_discount"])
    names = CF.select_rfe(li, ["l_quantity", "l_discount"], "l_extendedprice", 1)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@register("k3_lasso_selection")
def q_k3(spark, sf):
    """K3 on every lineitem row: price (thousands) on quantity, discount,
    tax and line number; lasso alpha 0.01 (the reference's default) on
    standardised features keeps the non-zero ones."""
    li = read_table(spark, sf, "lineitem", ["l_extendedprice", "l_quantity", "l_discount", "l_tax",
                                             "l_linenumber"])
    li = li.select((F.col("l_extendedprice") / 1000).alias("price_k"), "l_quantity", "l_discount",
                   "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber")).cache()
    keep = CF.select_lasso(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "price_k", 0.01)
    li.unpersist()
    return spark.createDataFrame([(n,) for n in keep], "feature string")


@register("k4_tree_importance_selection")
def q_k4(spark, sf):
    d, cand = _sel_frame(spark, sf)
    names = CF.select_tree_importance(d, cand, "y", 0.01)
    d.unpersist()
    return spark.createDataFrame([(n,) for n in names], "feature string")


_RSI_FRAME = "(PARTITION BY series_id ORDER BY period ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
_K8_SQL = with_panel(f"""
SELECT r.series_id, r.period, {R("CASE WHEN nd = 14 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END END", 6)}
           AS avg_order_value_rsi_14,
       {R("f - s", 4)} AS avg_order_value_macd, {R("g", 4)} AS avg_order_value_macd_signal
FROM (SELECT series_id, period, avg(greatest(d, 0.0)) OVER {_RSI_FRAME} AS gain, avg(greatest(-d, 0.0)) OVER {_RSI_FRAME} AS loss,
             count(d) OVER {_RSI_FRAME} AS nd FROM num) r
JOIN ema USING (series_id, period)""", """
num AS (SELECT series_id, period, avg_order_value AS x,
               avg_order_value - lag(avg_order_value) OVER (PARTITION BY series_id ORDER BY period) AS d,
               row_number() OVER (PARTITION BY series_id ORDER BY period) AS i FROM panel),
ema AS (SELECT series_id, period, i, x AS f, x AS s, CAST(0.0 AS DOUBLE) AS g FROM num WHERE i = 1
        UNION ALL
        SELECT n.series_id, n.period, n.i, n.x * 2 / 13 + e.f * 11 / 13, n.x * 2 / 27 + e.s * 25 / 27,
               ((n.x * 2 / 13 + e.f * 11 / 13) - (n.x * 2 / 27 + e.s * 25 / 27)) * 2 / 10 + e.g * 8 / 10
        FROM ema e JOIN num n ON n.series_id = e.series_id AND n.i = e.i + 1)""").replace("WITH", "WITH RECURSIVE", 1)


@register("k8_financial_features", _K8_SQL)
def q_k8(spark, sf):
    out = FE.financial_features(_p(spark, sf), "avg_order_value", series="series_id",
                                 order="period", bucket_rows=128).select("series_id", "period", "avg_order_value_rsi_14",
                                                        "avg_order_value_macd",
                                                        "avg_order_value_macd_signal")
    digits = {"avg_order_value_rsi_14": 6, "avg_order_value_macd": 4, "avg_order_value_macd_signal": 4}
    return out.withColumns({c: rnd(c, d) for c, d in digits.items()})


_TOKENS = r"""
WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\W+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 GROUP BY doc_id, term)"""


@register("k10_text_tfidf", _TOKENS + r"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf,
       (round(CASE WHEN count(*) >= 2 THEN ln((n.n + 1.0) / (count(*) + 1.0)) ELSE 0.0 END, 10) + CAST(0 AS DOUBLE)) AS idf
FROM tf, (SELECT count(*) AS n FROM documents) n GROUP BY term, n.n""")
def q_k10(spark, sf):
    """K10 vocabulary of every document's whole text: document frequency,
    occurrences and idf of every term; none merged by hashing, none cut."""
    return FE.term_weights(read_table(spark, sf, "documents", ["doc_id", "text"])).select(
        "term", "df", "tf", rnd("idf", 10).alias("idf"))


@register("k10_term_counts", _TOKENS + r"""
SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n_tokens, count(term) AS n_terms,
       CAST(coalesce(max(tf), 0) AS BIGINT) AS max_tf
FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id""")
def q_k10_counts(spark, sf):
    """K10 counts with an exact vocabulary, summed up per document."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    per = FE.text_counts(docs).groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"),
                                                     F.max("tf").alias("max_tf"))
    return docs.select("doc_id").join(per, "doc_id", "left").fillna(0)


@register("k10_tfidf_doc_summary", r"""
WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\W+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 GROUP BY doc_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.tf,
             CASE WHEN dfq.df >= 2 THEN ln((n.n + 1.0) / (dfq.df + 1.0)) ELSE 0.0 END AS idf
      FROM tf JOIN dfq USING (term), (SELECT count(*) AS n FROM documents) n),
s AS (SELECT doc_id, sum(tf) AS n_tokens, count(*) FILTER (WHERE idf > 0) AS n_terms,
             sqrt(sum(tf * idf * tf * idf)) AS tfidf_l2 FROM w GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n_tokens, 0) AS BIGINT) AS n_tokens,
       CAST(coalesce(s.n_terms, 0) AS BIGINT) AS n_terms,
       (round(CAST(coalesce(s.tfidf_l2, 0.0) AS DOUBLE), 8) + CAST(0 AS DOUBLE)) AS tfidf_l2
FROM documents d LEFT JOIN s USING (doc_id)""")
def q_k10_terms(spark, sf):
    """K10 tf-idf with an exact vocabulary as joins and aggregates over
    every document's whole text; per-document summary."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    out = FE.tfidf_doc_summary(docs)
    return out.withColumn("tfidf_l2", rnd("tfidf_l2", 8))


@register("k10_word2vec_documents")
def q_k10_w2v(spark, sf):
    """K10 word2vec: skip-gram vectors trained on all documents, averaged per document."""
    from pyspark.ml.functions import vector_to_array
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    model = FE.fit_word_vectors(docs, size=16)
    return model.transform(docs).select("doc_id", vector_to_array("vector").alias("vector"))
