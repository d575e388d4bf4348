"""Panels built from the driver tables.

The reference's input is a yearly panel of scenario blocks. These builders
derive panels of the same shape from the TPC-H-style tables so every operator
runs on data whose size grows with the scale factor:

* ``month_segment_panel`` — one row per (market segment, order month):
  a few hundred rows, close to the reference's 398.
* ``scenario_panel`` — the month panel with what-if blocks after a cutoff
  (history repeated in every block, as in the reference's 8 x 69 layout).
* ``order_sequence`` — every order as a row of a series keyed by customer
  (many short series) or by order status (three hot series).
* ``lineitem_frame`` — row-level regression frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .tables import read_table

# Names of the month-panel columns.
PANEL_KEY = "series_id"
PANEL_TIME = "period"
PANEL_TARGET = "y"
PANEL_FEATURES = ["n_orders", "n_customers", "avg_order_value", "avg_qty",
                  "avg_tax", "ret_share"]


def month_segment_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, month) panel.

    Plan: lineitem is pre-aggregated per order (partial aggregation before the
    shuffle, and the result is already hash-partitioned on the order key, so
    the join with orders reuses it); the customer side is joined on its key
    (AQE turns it into a broadcast only when its measured size is small);
    the final group-by is a partial+final aggregate on (segment, month).
    The rows (segments times months, whatever the input) are stored once, so
    what is fitted on them in several passes reads the tables only here.
    """
    cents = lambda c, k=100: F.round(c * k).cast("long")
    li = (read_table(spark, sf_dir, "lineitem",
                     ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount",
                      "l_tax", "l_returnflag"])
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("lines"),
               F.sum(F.col("l_quantity").cast("long")).alias("qty"),
               F.sum(cents(F.col("l_extendedprice"))).alias("gross_c"),
               F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"), 10000)).alias("disc_e4"),
               F.sum(cents(F.col("l_tax"))).alias("tax_c"),
               F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("ret")))
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    j = (orders.join(li, orders.o_orderkey == li.l_orderkey)
         .join(cust, orders.o_custkey == cust.c_custkey))
    period = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    # Money is summed in integer cents: exact and order-independent, so the
    # panel is bit-identical whatever the partitioning.
    agg = (j.groupBy(F.col("c_mktsegment").alias(PANEL_KEY), period.alias(PANEL_TIME))
           .agg(F.count(F.lit(1)).alias("n_orders"),
                F.count_distinct("o_custkey").alias("n_customers"),
                F.sum(cents(F.col("o_totalprice"))).alias("value_c"),
                F.sum("lines").alias("lines"), F.sum("qty").alias("qty"),
                F.sum("tax_c").alias("tax_c"), F.sum("ret").alias("ret"),
                F.sum("disc_e4").alias("disc_e4"), F.sum("gross_c").alias("gross_c")))
    return materialize(agg.select(
        PANEL_KEY, PANEL_TIME,
        (F.col(PANEL_TIME) / 100).cast("long").alias("year"),
        "n_orders", "n_customers",
        (F.col("value_c") / F.col("n_orders") / 100).alias("avg_order_value"),
        (F.col("qty") / F.col("lines")).alias("avg_qty"),
        (F.col("tax_c") / F.col("lines") / 100).alias("avg_tax"),
        (F.col("ret") / F.col("lines")).alias("ret_share"),
        (F.col("disc_e4") / F.col("gross_c") / 100).alias(PANEL_TARGET)))


def scenario_panel(panel: DataFrame, cutoff: int, factors=(0.9, 1.0, 1.1),
                   features=None, time_col: str = PANEL_TIME) -> DataFrame:
    """Stack what-if blocks: rows before ``cutoff`` repeat unchanged in every
    block (like the reference's repeated history); later rows have their
    features scaled by the block's factor. The expansion is a bounded
    ``explode`` over a literal array, not a join."""
    features = features or PANEL_FEATURES
    fac = F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(float(f)).alias("factor"))
                    for i, f in enumerate(factors)])
    x = panel.withColumn("_s", F.explode(fac))
    fut = F.col(time_col) >= F.lit(cutoff)
    cols = []
    for c in panel.columns:
        if c in features:
            cols.append(F.when(fut, F.col(c) * F.col("_s.factor")).otherwise(
                F.col(c).cast("double")).alias(c))
        else:
            cols.append(F.col(c))
    return x.select(F.col("_s.scenario").cast("long").alias("scenario"), *cols)


def order_sequence(spark: SparkSession, sf_dir: str, key: str = "o_custkey") -> DataFrame:
    """Orders as series keyed by ``key`` and ordered by (date, order key)."""
    return read_table(spark, sf_dir, "orders",
                      ["o_orderkey", key, "o_orderdate", "o_totalprice"]
                      if key != "o_orderkey" else None)


def lineitem_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level regression frame: price on quantity, discount, tax."""
    return read_table(spark, sf_dir, "lineitem",
                      ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                       "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
