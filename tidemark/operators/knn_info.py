"""Mutual information by nearest neighbours (A15, the estimator of Kraskov, Stoegbauer and
Grassberger 2004): psi(n) + psi(k) - <psi(n_x) + psi(n_y)>, where a row's radius is the distance
to its k-th nearest other row in max(|dx|, |dy|) and n_x, n_y count the rows (itself included)
that are nearer than the radius in x, in y alone; at the same place where the radius is zero.

No pair of rows is formed outside a neighbourhood:

1. Equal (x, y) become one point with a weight, so a value that a third of all rows share is one
   point.
2. Points sorted by (x, y) are cut into slabs of about 8 sqrt(k n) points. A slab is then a few
   radii wide, and one sweep along the axis on which its points lie farther apart finds the k
   nearest of each of its points.
3. Only a point whose radius reaches over another slab's bounding box is sent there, with its
   radius; the k smallest distances of all slabs are merged.
4. n_x and n_y are differences of running counts over the sorted axis, in buckets (``prefix_sums``).

Values are taken in whole units of 2^-36 standard deviations (of the deviation and mean rounded to
six digits), so distances compare exactly and a result does not hang on the order of a sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q
from ..functions.stats import digamma_sql
from ..session import materialize
from .buckets import bucketed, prefix_sums
from .windows import with_row_pos

#: Fewest points of a slab, and more than any distance of two values.
MIN_SLAB, FAR = 512, 1 << 62
#: Points that still search after the sweep grew thin are compared with all of a slab.
FEW = 64
UNIT = 2.0 ** 36


def _digits(v: float) -> float:
    return float(f"{v:.5e}")


def _nearest(px, py, pw, qx, qy, top, own: bool) -> np.ndarray:
    """The k smallest Chebyshev distances from every query to the weighted points, merged into
    ``top`` (rows ascending). ``own``: query i is point i, which counts one less."""
    k = top.shape[1]
    gap = min(max(k, 1), max(len(px) - 1, 0))
    xs, ys = np.sort(px), np.sort(py)
    along_x = np.median(xs[gap:] - xs[:len(xs) - gap]) > np.median(ys[gap:] - ys[:len(ys) - gap])
    a, b, u, v = (px, py, qx, qy) if along_x else (py, px, qy, qx)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], pw[order]
    top = top.copy()

    def take(at: np.ndarray, point: np.ndarray, dist: np.ndarray) -> None:
        """Put the points' distances, as often as they weigh, into the rows ``at``."""
        near = dist < top[at, -1]
        at, dist, many = at[near], dist[near], np.minimum(w[point[near]], k)
        if len(at):
            copies = np.where(np.arange(k) < many[:, None], dist[:, None], FAR)
            top[at] = np.sort(np.concatenate([top[at], copies], axis=1), axis=1)[:, :k]

    if own:
        copies = np.where(np.arange(k) < (pw - 1)[:, None], 0, FAR)
        top = np.sort(np.concatenate([top, copies], axis=1), axis=1)[:, :k]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        right, left = place + 1, place - 1
    else:
        place = None
        right = np.searchsorted(a, u)
        left = right - 1
    for start, step in ((right, 1), (left, -1)):
        live, at = np.arange(len(u)), start.copy()
        while True:
            ok = (at >= 0) & (at < len(a))
            live, at = live[ok], at[ok]
            da = np.abs(a[at] - u[live])
            ok = da < top[live, -1]                    # the sweep only moves away
            live, at, da = live[ok], at[ok], da[ok]
            if len(live) <= FEW:
                break
            take(live, at, np.maximum(da, np.abs(b[at] - v[live])))
            at = at + step
        for i, first in zip(live, at):                 # the rest of the side at once
            side = slice(first, None) if step > 0 else slice(0, first + 1)
            d = np.maximum(np.abs(a[side] - u[i]), np.abs(b[side] - v[i]))
            some = np.argpartition(d, k)[:k] if len(d) > k else np.arange(len(d))
            all_d = np.concatenate([top[i], np.repeat(d[some], np.minimum(w[side][some], k))])
            top[i] = np.sort(all_d)[:k]
    return top


def _slab_rows(n: int, k: int, slab_rows: int | None) -> int:
    return slab_rows or max(MIN_SLAB, math.ceil(8 * math.sqrt(k * max(n, 1))))


def _points(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame | None, dict[int, int]]:
    """(f, x, y, w): distinct whole-unit points of each feature, and the features' numbers of rows."""
    def clean(c: str) -> Column:
        v = F.col(q(c)).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    d = df.select(clean(target).alias("y"), *[clean(c).alias(f"x{i}") for i, c in enumerate(features)]).where("y IS NOT NULL")
    both = [(f"x{i}", F.when(F.col(f"x{i}").isNotNull(), F.col("y"))) for i in range(len(features))]
    s = d.agg(*[e for i, (x, y) in enumerate(both) for e in (
        F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mx{i}"), F.stddev_pop(x).alias(f"sx{i}"),
        F.avg(y).alias(f"my{i}"), F.stddev_pop(y).alias(f"sy{i}"))]).first()
    counts = {i: s[f"n{i}"] for i in range(len(features))}

    def units(c: str, mean: float, std: float) -> Column:
        std = _digits(std)
        if not std:
            return F.lit(0).cast("long")
        middle = round(mean / std) * std
        return F.rint((F.col(c) - F.lit(middle)) * F.lit(UNIT / std)).cast("long")

    some = [i for i, n in counts.items() if n]
    if not some:
        return None, counts
    long = d.select(F.explode(F.array(*[F.when(F.col(f"x{i}").isNotNull(), F.struct(
        F.lit(i).alias("f"), units(f"x{i}", s[f"mx{i}"], s[f"sx{i}"]).alias("x"),
        units("y", s[f"my{i}"], s[f"sy{i}"]).alias("y"))) for i in some])).alias("p")).where("p IS NOT NULL")
    return long.select("p.*").groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("w")), counts


def _radii(points: DataFrame, k: int, slab_rows: int | None) -> DataFrame:
    """(f, x, y, w, r): the distance of each point's k-th nearest other row."""
    placed = with_row_pos(points, ["f", "x", "y"], "pos")
    per = {r["f"]: (r["n"], r["p0"]) for r in placed.groupBy("f").agg(F.count("*").alias("n"), F.min("pos").alias("p0")).collect()}
    rows = {f: _slab_rows(n, k, slab_rows) for f, (n, _) in per.items()}
    slab = F.coalesce(*[F.when(F.col("f") == f, F.floor((F.col("pos") - p0) / rows[f])) for f, (_, p0) in per.items()])
    placed = placed.select("f", "x", "y", "w", slab.cast("int").alias("slab"))
    # about sqrt(n / k) / 8 rows a feature
    boxes = {f: g.sort_values("slab")[["x0", "x1", "y0", "y1"]].to_numpy().T for f, g in placed.groupBy("f", "slab").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).toPandas().groupby("f")}
    shared = placed.sparkSession.sparkContext.broadcast(boxes)

    def own(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        f, mine = key
        x, y, w = (g[c].to_numpy() for c in "xyw")
        top = _nearest(x, y, w, x, y, np.full((len(x), k), FAR, dtype=np.int64), True)
        x0, x1, y0, y1 = shared.value[f]
        r = top[:, -1]
        lo, hi = np.searchsorted(x1, x - r, side="right"), np.searchsorted(x0, x + r)   # boxes nearer than r in x
        reach = [None] * len(x)
        for i in np.flatnonzero(hi - lo > 1):
            s = np.arange(lo[i], hi[i])
            s = s[(s != mine) & (y0[s] < y[i] + r[i]) & (y1[s] > y[i] - r[i])]
            reach[i] = s.tolist() if len(s) else None
        return pd.DataFrame({"f": f, "x": x, "y": y, "w": w, "top": list(top), "reach": reach})

    found = materialize(placed.groupBy("f", "slab").applyInPandas(
        own, "f int, x long, y long, w long, top array<long>, reach array<int>"))
    asked = found.where("reach IS NOT NULL").select("f", "x", "y", F.element_at("top", k).alias("r"), F.explode("reach").alias("slab"))
    # a slab that many points reach is searched in several groups
    load = materialize(asked.groupBy("f", "slab").agg(F.count("*").alias("asked"))
            .join(placed.groupBy("f", "slab").agg(F.count("*").alias("held")), ["f", "slab"])
            .select("f", "slab", F.ceil(F.col("asked") / (4 * F.col("held"))).cast("int").alias("parts")))
    asked = asked.join(F.broadcast(load), ["f", "slab"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int"))
    again = load.withColumnRenamed("parts", "copies")
    held = placed.join(F.broadcast(again), ["f", "slab"]).withColumn("part", F.explode(F.expr("sequence(0, copies - 1)")))

    def foreign(asks: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        x, y, r = (asks[c].to_numpy() for c in "xyr")
        if len(x) and len(pts):
            top = _nearest(*(pts[c].to_numpy() for c in "xyw"), x, y, np.repeat(r[:, None], k, axis=1), False)
        else:
            top = np.repeat(r[:, None], k, axis=1)
        return pd.DataFrame({"f": asks["f"].to_numpy(), "x": x, "y": y, "top": list(top)})

    more = (asked.groupBy("f", "slab", "part").cogroup(held.groupBy("f", "slab", "part"))
            .applyInPandas(foreign, "f int, x long, y long, top array<long>"))
    kth = F.element_at(F.sort_array(F.flatten(F.collect_list("top"))), k).alias("r")
    wide = (found.where("reach IS NOT NULL").select("f", "x", "y", "w", "top")
            .unionByName(more.select("f", "x", "y", F.lit(None).cast("long").alias("w"), "top"))
            .groupBy("f", "x", "y").agg(F.max("w").alias("w"), kth))
    return found.where("reach IS NULL").select("f", "x", "y", "w", F.element_at("top", k).alias("r")).unionByName(wide)


def mutual_info_knn(df: DataFrame, features: Sequence[str], target: str, k: int = 3,
                    slab_rows: int | None = None, bucket_rows: int = 1 << 18) -> DataFrame:
    """``feature``, ``n`` (rows where both are finite) and ``mi`` in nats, never under zero.
    Null, NaN and infinite values take no part; ``mi`` is null where no more than ``k`` rows are
    left. A constant feature or target gives 0. Any column type that casts to double goes."""
    if k < 1:
        raise ValueError("k must be at least 1")
    features = list(features)
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "f int, feature string")
    points, counts = _points(df, features, target)
    enough = [i for i, n in counts.items() if n > k]
    sizes = spark.createDataFrame([(i, n) for i, n in counts.items()], "f int, n long")
    if points is None or not enough:
        return names.join(sizes, "f").select("feature", "n", F.lit(None).cast("double").alias("mi"))
    r = materialize(_radii(points.where(F.col("f").isin(enough)), k, slab_rows))

    # one event per end of a row's interval [v - reach, v + reach] on either axis, and one per point
    reach = F.greatest(F.col("r") - 1, F.lit(0))
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("v")) for a, c in enumerate("xy")]))
    on = r.select("f", "x", "y", "w", reach.alias("m"), axes.alias("s")).select("f", "x", "y", "w", "m", "s.axis", "s.v")
    none = F.lit(None).cast("long")
    marks = on.groupBy("f", "axis", "v").agg(F.sum("w").alias("w")).select(
        "f", "axis", "v", F.lit(1).alias("kind"), "w", none.alias("x"), none.alias("y"))
    ends = on.select("f", "axis", "x", "y", F.explode(F.array(
        F.struct((F.col("v") - F.col("m")).alias("v"), F.lit(0).alias("kind")),
        F.struct((F.col("v") + F.col("m")).alias("v"), F.lit(2).alias("kind")))).alias("e")).select(
        "f", "axis", "e.v", "e.kind", F.lit(0).cast("long").alias("w"), "x", "y")
    base = bucketed(marks.unionByName(ends), ["f", "axis"], ["v", "kind", "x", "y"], bucket_rows)
    run = prefix_sums(base, {"upto": F.col("w")}, ["f", "axis"]).where("kind <> 1")
    near = run.groupBy("f", "axis", "x", "y").agg(F.sum((F.col("kind") - 1) * F.col("upto")).alias("c"))
    total = (near.join(r.select("f", "x", "y", "w"), ["f", "x", "y"])
             .groupBy("f").agg(F.sum(F.col("w") * F.expr(digamma_sql("c"))).alias("psi")))
    out = names.join(sizes, "f").join(F.broadcast(total), "f", "left")
    mi = F.expr(f"{digamma_sql('CAST(n AS DOUBLE)')} + {digamma_sql(f'{k}.0D')} - psi / n")
    return out.select("feature", "n", F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))).alias("mi"))
