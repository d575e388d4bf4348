"""Query catalog: every registered query reads the driver tables (or data
Spark derives from them) and has, where SQL can express it, a DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import windows as W
from ..sources import panels as P
from .sqlparts import DIGITS, R, with_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


FEATS = P.PANEL_FEATURES
LAGS, WINS = (1, 2), (3, 6)


def _digits(name: str) -> int:
    base = name.split("_lag_")[0].split("_roll_")[0]
    return DIGITS[base]


def _round_all(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: rnd(c, _digits(c)) for c in cols})


# ---------------------------------------------------------------- panel / S*

def _panel_sql_cols(prefix: str = "") -> str:
    out = []
    for c in ["n_orders", "n_customers"]:
        out.append(f"{prefix}{c}")
    for c in ["avg_order_value", "avg_qty", "avg_tax", "ret_share", "y"]:
        out.append(f"{R(prefix + c, DIGITS[c])} AS {c}")
    return ", ".join(out)


@register("panel_month_segment", with_panel(
    f"SELECT series_id, period, year, {_panel_sql_cols()} FROM panel"))
def q_panel(spark, sf_dir):
    p = P.month_segment_panel(spark, sf_dir)
    return _round_all(p, ["avg_order_value", "avg_qty", "avg_tax", "ret_share", "y"])


# ---------------------------------------------------------------- windows W*

def _lag_roll_sql(stats=("mean",), lags=LAGS, wins=WINS, part="PARTITION BY series_id",
                  order="period", src="panel") -> str:
    w = f"({part} ORDER BY {order}"
    exprs = []
    for c in FEATS:
        for k in lags:
            e = f"lag({c}, {k}) OVER {w})"
            exprs.append(f"{R(e, DIGITS[c]) if c not in ('n_orders', 'n_customers') else e}"
                         f" AS {W.lag_name(c, k)}")
    for c in FEATS:
        for n in wins:
            fr = f"{w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            for s in stats:
                fn = "avg" if s == "mean" else "stddev_samp"
                e = f"CASE WHEN count({c}) OVER {fr} = {n} THEN {fn}({c}) OVER {fr} END"
                exprs.append(f"{R(e, DIGITS[c])} AS {W.roll_name(c, s, n)}")
    return ", ".join(exprs)


def _lag_roll_spark(df, stats=("mean",), **kw):
    out = W.add_lag_roll(df, FEATS, LAGS, WINS, series="series_id", order="period",
                         stats=stats, **kw)
    dbl = [c for c in out.columns if "_roll_" in c or
           ("_lag_" in c and not c.startswith(("n_orders", "n_customers")))]
    return _round_all(out.select("series_id", "period", *[c for c in out.columns
                                                          if "_lag_" in c or "_roll_" in c]),
                      dbl)


@register("w1_w2_lag_roll", with_panel(
    f"SELECT series_id, period, {_lag_roll_sql()} FROM panel"))
def q_w1_w2(spark, sf_dir):
    """W1 + W2 per series: lags 1,2 and complete rolling means 3,6 of every
    feature, one window pass."""
    return _lag_roll_spark(P.month_segment_panel(spark, sf_dir))


@register("w3_roll_std", with_panel(
    f"SELECT series_id, period, {_lag_roll_sql(stats=('mean', 'std'), lags=())} FROM panel"))
def q_w3(spark, sf_dir):
    p = P.month_segment_panel(spark, sf_dir)
    out = W.add_lag_roll(p, FEATS, (), WINS, series="series_id", order="period",
                         stats=("mean", "std"))
    roll = [c for c in out.columns if "_roll_" in c]
    return _round_all(out.select("series_id", "period", *roll), roll)


@register("w1_w2_halo_global", with_panel(
    f"SELECT series_id, period, {_lag_roll_sql(part='', order='period, series_id')} FROM panel"))
def q_w_global(spark, sf_dir):
    """Global-order windows (the reference's whole-frame shift, defect D5 kept
    as a parity mode) run through halo buckets instead of one partition."""
    p = P.month_segment_panel(spark, sf_dir)
    out = W.add_lag_roll(p, FEATS, LAGS, WINS, series=None, order=["period", "series_id"],
                         skew_safe=True, bucket_rows=64)
    dbl = [c for c in out.columns if "_roll_" in c or
           ("_lag_" in c and not c.startswith(("n_orders", "n_customers")))]
    return _round_all(out.select("series_id", "period", *[c for c in out.columns
                                                          if "_lag_" in c or "_roll_" in c]), dbl)


_STATUS_SQL = """
SELECT o_orderstatus, o_orderkey,
       {lag1} AS o_totalprice_lag_1, {lag2} AS o_totalprice_lag_2,
       {m3} AS o_totalprice_roll_mean_3, {m6} AS o_totalprice_roll_mean_6
FROM orders
""".format(
    lag1="lag(o_totalprice, 1) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)",
    lag2="lag(o_totalprice, 2) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)",
    m3=R("CASE WHEN count(o_totalprice) OVER w3 = 3 THEN avg(o_totalprice) OVER w3 END", 4),
    m6=R("CASE WHEN count(o_totalprice) OVER w6 = 6 THEN avg(o_totalprice) OVER w6 END", 4),
) + """WINDOW w3 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
                ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w6 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
                ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""


@register("w1_w2_hot_series_halo", _STATUS_SQL)
def q_w_hot(spark, sf_dir):
    """Lags and rolling means over every order, series = order status: three
    series, one holding about half of all rows (a hot key). Halo buckets
    split each series over many tasks."""
    o = P.order_sequence(spark, sf_dir, key="o_orderstatus")
    out = W.add_lag_roll(o, ["o_totalprice"], LAGS, WINS, series="o_orderstatus",
                         order=["o_orderdate", "o_orderkey"], skew_safe=True,
                         bucket_rows=4096)
    return out.select("o_orderstatus", "o_orderkey", "o_totalprice_lag_1", "o_totalprice_lag_2",
                      rnd("o_totalprice_roll_mean_3", 4).alias("o_totalprice_roll_mean_3"),
                      rnd("o_totalprice_roll_mean_6", 4).alias("o_totalprice_roll_mean_6"))
