"""Window operators W1-W5 and consecutive row positions.

Lag and rolling columns of one call share a single window specification, so
Spark plans one Exchange + one Sort + one Window for all of them.

Two execution modes:

* ``skew_safe=False`` — ``Window.partitionBy(series).orderBy(order)``. Right
  when every series is bounded (aggregated panels).
* ``skew_safe=True`` — halo buckets. Rows get a consecutive position in
  (series, order) order; bucket = position // ``bucket_rows``; the last
  H = max(lag, window-1) rows of each bucket are also sent to the next
  bucket; windows run per (series, bucket) and only home rows are kept.
  A series holding a third of all rows is then split over many tasks,
  and no window partition exceeds ``bucket_rows + H`` rows. With
  ``series=None`` the same scheme gives a global-order window (the
  reference's whole-frame ``shift``) without a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe, q
from ..session import materialize, shuffle_partitions


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def with_row_pos(df: DataFrame, order: Sequence[str], name: str = "row_pos",
                 partitions: int | None = None) -> DataFrame:
    """Consecutive 0-based position in ``order`` (ascending), computed without
    a single-partition window: range-partition and sort, then add each
    partition's offset from a per-partition count table (one row per
    partition, so broadcasting it is bounded). Include a unique tie-break in
    ``order`` for a deterministic result."""
    order = _cols(order)
    n = partitions or shuffle_partitions(df.sparkSession)
    d = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # Two evaluations of a range exchange may sample different bounds, so the
    # counted partitions and the numbered partitions must be the same data:
    # cut the lineage once with a reliable checkpoint (shared folder).
    d = materialize(d)
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"),
                                   F.min("_mid").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_m0",
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off"))


def lag_name(c: str, k: int) -> str:
    return f"{c}_lag_{k}"


def roll_name(c: str, stat: str, w: int) -> str:
    return f"{c}_roll_{stat}_{w}"


def _feature_exprs(cols, lags, windows, stats, part, order) -> list[Column]:
    """All lag / rolling expressions as SQL strings over one window spec
    (one JVM call per output column)."""
    over = (f"PARTITION BY {', '.join(q(p) for p in part)} " if part else "") + \
        f"ORDER BY {', '.join(q(o) for o in order)}"
    out = []
    for c in cols:
        for k in lags:
            out.append(F.expr(f"lag({q(c)}, {k}) OVER ({over})").alias(lag_name(c, k)))
    for c in cols:
        for w in windows:
            fr = f"({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            for stat in stats:
                fn = {"mean": "avg", "std": "stddev_samp"}.get(stat)
                if fn is None:
                    raise ValueError(f"unknown rolling statistic {stat!r}")
                # pandas semantics: a short window or any null inside gives null
                out.append(F.expr(f"CASE WHEN count({q(c)}) OVER {fr} = {w} "
                                  f"THEN {fn}({q(c)}) OVER {fr} END").alias(roll_name(c, stat, w)))
    return out


def add_lag_roll(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (),
                 windows: Sequence[int] = (), series=None, order=None,
                 stats: Sequence[str] = ("mean",), skew_safe: bool = False,
                 bucket_rows: int = 1 << 20) -> DataFrame:
    """W1 lags ``{c}_lag_{k}``, W2 rolling means ``{c}_roll_mean_{w}`` and W3
    rolling sample std ``{c}_roll_std_{w}`` (complete windows only; a null
    inside the window gives null), per series, in one window pass."""
    lags, windows = list(lags or []), list(windows or [])
    if not lags and not windows:
        return df
    series, order = _cols(series), _cols(order)
    if not order:
        raise ValueError("an explicit order column is required")
    if not skew_safe:
        return df.select("*", *_feature_exprs(cols, lags, windows, stats, series, order))
    halo = max([*lags, *[w - 1 for w in windows], 0])
    if bucket_rows <= halo:
        raise ValueError("bucket_rows must exceed the look-back")
    base = with_row_pos(df, [*series, *order], "_gpos")
    hb = F.floor(F.col("_gpos") / bucket_rows)
    shifts = F.when(F.col("_gpos") % bucket_rows >= bucket_rows - halo,
                    F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = (base.withColumn("_shift", F.explode(shifts))
         .withColumn("_hb", hb + F.col("_shift")))
    out = x.select("*", *_feature_exprs(cols, lags, windows, stats, [*series, "_hb"], ["_gpos"]))
    return out.where(F.col("_shift") == 0).drop("_gpos", "_shift", "_hb")


def fill_forward_backward(df: DataFrame, cols: Sequence[str], series=None, order=None,
                          skew_safe: bool = False, bucket_rows: int = 1 << 20) -> DataFrame:
    """Forward fill then backward fill within each series (columns keep
    their names). In skew-safe mode the unbounded look-back is done in two
    passes: fills inside (series, bucket), then the last / first non-null
    value of every bucket is carried across buckets on a small per-bucket
    table and joined back on (series, bucket)."""
    series, order = _cols(series), _cols(order)
    if not skew_safe:
        part = f"PARTITION BY {', '.join(q(p) for p in series)} " if series else ""
        over, upto = f"{part}ORDER BY {', '.join(q(o) for o in order)}", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        # the numbers keep ties in one order both ways
        d = df.select("*", F.expr(f"row_number() OVER ({over})").alias("__no"),
                      *[F.expr(f"last({q(c)}, true) OVER ({over} {upto})").alias(f"__ff_{c}") for c in cols])
        back = f"{part}ORDER BY __no DESC {upto}"
        return d.withColumns({c: F.expr(f"coalesce({q(f'__ff_{c}')}, last({q(c)}, true) OVER ({back}))") for c in cols}).select(*df.columns)
    base = (with_row_pos(df, [*series, *order], "_gpos")
            .withColumn("_hb", F.floor(F.col("_gpos") / bucket_rows)))
    spec = Window.partitionBy(*series, "_hb").orderBy("_gpos")
    back = spec.rowsBetween(Window.unboundedPreceding, 0)
    # with the last row first: Spark runs through frames that end with the partition anew for every row
    fwd = Window.partitionBy(*series, "_hb").orderBy(F.desc("_gpos")).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.last(F.col(c), True).over(back).alias(f"_ff_{c}") for c in cols],
                        *[F.last(F.col(c), True).over(fwd).alias(f"_bf_{c}") for c in cols])
    summ = base.groupBy(*series, "_hb").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_gpos"))).alias(f"_last_{c}")
          for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_gpos"))).alias(f"_first_{c}")
          for c in cols])
    before, after = (Window.partitionBy(*series).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_hb", F.desc("_hb")))
    summ = summ.select(
        *series, "_hb",
        *[F.last(F.col(f"_last_{c}"), True).over(before).alias(f"_prev_{c}") for c in cols],
        *[F.last(F.col(f"_first_{c}"), True).over(after).alias(f"_next_{c}") for c in cols])
    j = join_null_safe(local, summ, [*series, "_hb"])
    repl = {c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_prev_{c}"),
                          F.col(f"_bf_{c}"), F.col(f"_next_{c}")) for c in cols}
    keep = [c for c in df.columns]
    return j.withColumns(repl).select(*keep)


def fit_base_year(df: DataFrame, year_col: str = "year") -> int:
    """W5 fitted state: the training minimum year (one small aggregate)."""
    return int(df.agg(F.min(year_col)).first()[0])


def add_trend(df: DataFrame, base_year: int, year_col: str = "year",
              name: str = "trend") -> DataFrame:
    """``year - base_year`` with the base kept from training."""
    return df.withColumn(name, (F.col(year_col) - F.lit(base_year)).cast("long"))
