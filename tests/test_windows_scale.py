"""Skew-safe forms agree with the plain ones on hot keys."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import profile as PR
from tidemark.operators import windows as W
from tidemark.sources import panels as P

from .conftest import SF_SMALL


def test_row_pos_is_consecutive(spark):
    o = P.order_sequence(spark, SF_SMALL, key="o_orderstatus")
    p = W.with_row_pos(o, ["o_orderstatus", "o_orderdate", "o_orderkey"], "rp", partitions=7)
    n = o.count()
    r = p.agg(F.min("rp"), F.max("rp"), F.count_distinct("rp")).first()
    assert tuple(r) == (0, n - 1, n)


def _cmp(a, b, key, cols):
    j = a.alias("a").join(b.alias("b"), key)
    cond = None
    for c in cols:
        e = ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        cond = e if cond is None else cond | e
    return j.where(cond).count()


def test_halo_lag_roll_equals_plain_on_hot_series(spark):
    o = P.order_sequence(spark, SF_SMALL, key="o_orderstatus")
    kw = dict(series="o_orderstatus", order=["o_orderdate", "o_orderkey"], stats=("mean", "std"))
    a = W.add_lag_roll(o, ["o_totalprice"], (1, 3), (2, 5), skew_safe=True, bucket_rows=50, **kw)
    b = W.add_lag_roll(o, ["o_totalprice"], (1, 3), (2, 5), **kw)
    cols = [c for c in a.columns if "_lag_" in c or "_roll_" in c]
    assert a.count() == b.count()
    assert _cmp(a, b, "o_orderkey", cols) == 0


def test_skew_safe_fill_equals_plain(spark):
    o = P.order_sequence(spark, SF_SMALL, key="o_orderstatus").withColumn(
        "v", F.when(F.col("o_orderkey") % 5 != 0, None).otherwise(F.col("o_totalprice")))
    kw = dict(series="o_orderstatus", order=["o_orderdate", "o_orderkey"])
    a = W.fill_forward_backward(o, ["v"], skew_safe=True, bucket_rows=40, **kw)
    b = W.fill_forward_backward(o, ["v"], **kw)
    assert _cmp(a, b, "o_orderkey", ["v"]) == 0


def test_quantiles_equal_percentile(spark):
    li = P.lineitem_frame(spark, SF_SMALL)
    probs = (0.1, 0.5, 0.75)
    want = li.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in ("l_extendedprice", "l_quantity")]).first()
    for r in PR.quantiles(li, ["l_extendedprice", "l_quantity"], probs).collect():
        for k, v in zip(("q0", "q1", "q2"), want[r["column"]]):
            assert abs(r[k] - v) < 1e-9 * max(1.0, abs(v))


def test_grouped_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(9)
    wild = [math.inf, -math.inf, 5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308, 2.0**-1022, math.nan, None]
    rows = [(g, h, wild[int(rng.integers(len(wild)))] if rng.random() < wildness else float(rng.normal() * 10.0 ** int(rng.integers(-300, 300))),
             int(rng.integers(0, 4)), None) for g, h, n, wildness in (("hot", 1, 3000, 0.1), ("hot", 2, 50, 0.5), (None, 1, 7, 0), ("one", 1, 1, 0))
            for _ in range(n)] + [("void", 1, None, None, None)]
    probs = (0.0, 0.25, 0.5, 0.77, 1.0)
    df = spark.createDataFrame(rows, "g string, h int, x double, i int, none double").repartition(6)
    got = {(r["g"], r["h"], r["column"]): [r[f"q{j}"] for j in range(len(probs))] for r in PR.quantiles(df, ["x", "i", "none"], probs, by=["g", "h"]).collect()}
    want = {}
    for g, h in {r[:2] for r in rows}:
        for k, c in ((2, "x"), (3, "i")):
            v = sorted(r[k] for r in rows if r[:2] == (g, h) and r[k] is not None and not math.isnan(r[k]))
            if v:
                at = [(p * (len(v) - 1), p) for p in probs]
                want[g, h, c] = [v[int(a)] if v[int(a)] == v[math.ceil(a)] else v[int(a)] + (v[math.ceil(a)] - v[int(a)]) * (a - int(a)) for a, _ in at]
    assert set(got) == set(want)
    for key, w in want.items():
        np.testing.assert_allclose(np.array(got[key], float), w, rtol=1e-12)


def test_selection_takes_few_passes(spark, monkeypatch):
    from tidemark.operators import quantile
    passes = []
    cell = quantile._cell
    monkeypatch.setattr(quantile, "_cell", lambda *a: passes.append(a) or cell(*a))
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=4000), np.nextafter(1.0, 2.0) + np.arange(4000) * 2.0**-52, 10.0 ** rng.uniform(-300, 300, 4000)])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    assert quantile.column_quantiles(df, ["x"], (0.5,))["x"][0] == np.median(v)
    assert len(passes) <= 2 * 8
