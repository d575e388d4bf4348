"""Catalog entries for sources, sinks, the model registry and streaming
(S1-S4, S6, S10, J1, streaming scoring / lags / drift)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import models as M
from ..sources import ingest as IN
from ..sources import store as ST
from ..sources.tables import read_table
from ..streaming import scoring as SS
from ..streaming import windows as SW
from .catalog import FEATS, register
from .catalog_models import model_root
from .catalog_profile import CUTOFF, _panel, _rounded
from .sqlparts import R, with_panel


def _scratch(spark, what: str) -> str:
    return os.path.join(model_root(spark), f"{what}_{uuid.uuid4().hex[:12]}")


@register("s1_s4_csv_ingest_schema", with_panel(
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(10 AS BIGINT) AS n_cols, "
    "CAST(min(period) AS VARCHAR) AS first_period, CAST(max(period) AS VARCHAR) AS last_period FROM panel"))
def q_s1(spark, sf):
    """The panel written as a header CSV with a pandas-style index
    column, read back (schema overrides for the time and target columns),
    index column dropped by pattern, required columns checked, schema
    captured in one aggregate."""
    path = _scratch(spark, "panel_csv")
    p = _panel(spark, sf).withColumn("Unnamed: 0", F.monotonically_increasing_id())
    IN.write_scored(p, path, fmt="csv")
    df = IN.drop_unnamed(IN.read_csv(spark, path, infer=True,
                                     overrides={"period": "long", "y": "double"}))
    IN.require_columns(df, ["period", "y"])
    sch = IN.capture_schema(df, "period")
    return spark.createDataFrame([(sch["shape"][0], sch["shape"][1], *sch["date_range"])],
                                 "n_rows long, n_cols long, first_period string, last_period string")


@register("s10_model_registry")
def q_s10(spark, sf):
    """Save two model packages, then read every package's metadata in
    the shared model folder as one table."""
    from .training import TrainConfig, fit_single
    root = _scratch(spark, "registry")
    p = _panel(spark, sf).drop("year").where(F.col("period") < CUTOFF)
    for lags, wins in (([1], [3]), ([1, 2], [3, 6])):
        cfg = TrainConfig(target="y", time_col="period", series=["series_id"], features=list(FEATS),
                          lags=lags, windows=wins)
        pr = fit_single(p, cfg, M.ModelSpec("Linear Regression", "linear"))
        pr.save(os.path.join(root, f"best_model_l{max(lags)}_w{max(wins)}"))
    return ST.registry(spark, root)


@register("j1_column_concat", with_panel(
    "SELECT series_id, period, CAST(year >= 2000 AS INTEGER) AS post_2000, "
    "CAST(year - 1995 AS BIGINT) AS trend FROM panel"))
def q_j1(spark, sf):
    """Index-aligned concat of new columns is one projection of the same
    DataFrame, never a join."""
    p = _panel(spark, sf)
    return p.select("series_id", "period", (F.col("year") >= 2000).cast("int").alias("post_2000"),
                    (F.col("year") - 1995).cast("long").alias("trend"))


_EV_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@register("stream_event_lags", """
SELECT user_id, event_id, ts, value,
       lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2, false AS late
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_stream_lags(spark, sf):
    """W1 on a stream: the events file read as a stream, lags 1 and 2 of
    value per user carried across micro-batches in state, drained into a
    parquet sink in the shared folder and read back."""
    src = SS.read_stream(spark, sf, _EV_SCHEMA, glob="events.parquet")
    out = SS.stream_lags(src, "user_id", ["ts", "event_id"], "value", (1, 2))
    path = _scratch(spark, "stream_lags")
    SS.run_to_parquet(out, path, path + "_ckpt")
    return spark.read.parquet(path)


@register("stream_event_windows", f"""
SELECT user_id, event_id, ts, v, lag(v, 2) OVER w AS v_lag_2,
       CASE WHEN count(v) OVER r = 3 THEN {R('avg(v) OVER r', 8)} END AS v_roll_mean_3,
       CASE WHEN count(v) OVER r = 3 THEN {R('stddev_samp(v) OVER r', 6)} END AS v_roll_std_3,
       last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v_filled, false AS late
FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
       r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def q_stream_windows(spark, sf):
    """W1-W4 on a stream: lag, rolling mean and deviation and forward fill of every
    user's values (every fifth blanked), from value state."""
    src = SS.read_stream(spark, sf, _EV_SCHEMA, glob="events.parquet")
    src = src.withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    out = SW.stream_windows(src, "user_id", ["ts", "event_id"], "v", [2], [3], ["mean", "std"])
    path = _scratch(spark, "stream_windows")
    SS.run_to_parquet(out, path, path + "_ckpt")
    return spark.read.parquet(path).withColumns({"v_roll_mean_3": rnd("v_roll_mean_3", 8), "v_roll_std_3": rnd("v_roll_std_3", 6)})


@register("stream_lineitem_scoring", f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, {R('a + b * l_quantity', 4)} AS prediction, false AS batch_drift
FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem) f""")
def q_stream_score(spark, sf):
    """Stateless model scoring on a stream plus a per-micro-batch drift
    report (A22/O6 in ``foreachBatch``): OLS fitted on the batch table,
    every lineitem row scored as it streams in."""
    li = read_table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"])
    fm = M.fit_model(M.ModelSpec("Linear Regression", "linear"), li, ["l_quantity"], "l_extendedprice")
    means = li.agg(F.avg("l_quantity").alias("l_quantity")).first().asDict()
    schema = read_table(spark, sf, "lineitem").schema
    src = SS.read_stream(spark, sf, schema, glob="lineitem.parquet")
    scored = fm.transform(src.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    path = _scratch(spark, "stream_scored")
    SS.run_to_parquet(scored, path, path + "_ckpt")
    report = path + "_drift"
    q = (src.writeStream.foreachBatch(SS.drift_monitor(means, report))
         .option("checkpointLocation", report + "_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(path)
    drift = spark.read.parquet(report).where("feature = 'l_quantity'").agg(F.max("drift")).first()[0]
    return out.withColumn("prediction", rnd("prediction", 4)).withColumn("batch_drift", F.lit(bool(drift)))
