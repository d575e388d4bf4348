"""Windows on a stream against the batch windows, over several micro-batches."""

import datetime as dt
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.streaming import scoring as SS
from tidemark.streaming import windows as SW

SCHEMA = "k string, ts timestamp_ntz, id long, x double, late string"
BIG = 2**60


def rows(n, start):
    rng = np.random.default_rng(start)
    t0 = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=start)
    return [(k, t0 + dt.timedelta(minutes=i // 2), BIG + start + i, None if rng.random() < 0.2 else float(rng.normal()), "clash")
            for i in range(n) for k in ("a", "b", None)]


def write(spark, path, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(spark, path, out, ckpt, **kw):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    SS.run_to_parquet(SW.stream_windows(src, "k", ["ts", "id"], "x", **kw), out, ckpt)
    return spark.read.parquet(out)


def same(a, b):
    return a is None and b is None if a is None or b is None else a == b if not isinstance(a, float) else math.isclose(a, b, abs_tol=1e-12)


def test_three_batches_equal_the_batch_windows(spark, tmp_path):
    src, everything = str(tmp_path / "src"), []
    for start in (0, 100, 200):
        batch = rows(21, start)
        everything += batch
        write(spark, src, batch)
        time.sleep(0.02)
    got = drain(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), lags=[1, 3], windows=[2, 4], stats=["mean", "std"])
    whole = spark.createDataFrame(everything, SCHEMA).drop("late")
    want = W.add_lag_roll(whole, ["x"], [1, 3], [2, 4], "k", ["ts", "id"], ("mean", "std"))
    over = "(PARTITION BY k ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    want = want.withColumn("x_filled", F.expr(f"last(x, true) OVER {over}")).withColumn("late", F.lit(False))
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: (r["k"] or "", r["id"])
    a, b = (sorted(d.select(sorted(want.columns)).collect(), key=key) for d in (got, want))
    assert len(a) == len(everything)
    for r, s in zip(a, b):
        assert all(same(u, v) for u, v in zip(r, s)), (r, s)


def test_late_rows_beyond_double_precision(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    t = dt.datetime(2024, 1, 1)
    write(spark, src, [("a", t, BIG + 1, 1.0, "")])
    drain(spark, src, out, ckpt, lags=[1])
    write(spark, src, [("a", t, BIG, 5.0, ""), ("a", t, BIG + 2, 2.0, ""), ("a", None, 3, 2.0, "")])
    got = {r["id"] - BIG: (r["x_lag_1"], r["x_filled"], r["late"]) for r in drain(spark, src, out, ckpt, lags=[1]).collect()}
    assert got == {1: (None, 1.0, False), 0: (None, None, True), 2: (1.0, 2.0, False)}


def run_for(spark, path, out, ckpt, n, **kw):
    """A query with timers has no end: run it until n rows are out and timers had time, then stop it."""
    src = spark.readStream.schema(SCHEMA).parquet(path)
    q = (SW.stream_windows(src, "k", ["ts", "id"], "x", **kw).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(processingTime="200 milliseconds").start())
    end = time.time() + 40
    try:
        while time.time() < end and q.isActive:
            time.sleep(1)
            try:
                if spark.read.schema("k string, id long, x_lag_1 double").parquet(out).count() >= n:
                    break
            except Exception:       # no file yet
                continue
        time.sleep(3)
    finally:
        q.stop()
    return spark.read.parquet(out)


@pytest.mark.parametrize("idle_ms, lag", [(1, None), (10**9, 1.0)])
def test_idle_series_begins_anew(spark, tmp_path, idle_ms, lag):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    t = dt.datetime(2024, 1, 1)
    write(spark, src, [("a", t, 1, 1.0, ""), ("b", t, 1, 1.0, "")])
    run_for(spark, src, out, ckpt, 2, lags=[1], idle_ms=idle_ms)
    held = {r["k"] for r in spark.read.format("statestore").option("stateVarName", "series").load(ckpt).select("key.*").collect()}
    assert held == (set() if idle_ms == 1 else {"a", "b"})
    write(spark, src, [("a", t, 2, 2.0, "")])
    got = {(r["k"], r["id"]): r["x_lag_1"] for r in run_for(spark, src, out, ckpt, 3, lags=[1], idle_ms=idle_ms).collect()}
    assert got == {("a", 1): None, ("b", 1): None, ("a", 2): lag}


def test_unknown_statistic(spark):
    with pytest.raises(ValueError):
        SW.stream_windows(spark.createDataFrame([], SCHEMA), "k", ["ts"], "x", stats=["median"])
