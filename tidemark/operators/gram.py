"""Expanding-window cross-validation of linear models from Gram sums.

One aggregate, grouped by the row blocks between fold edges, gathers counts,
sums and products of the features and the label (centred by the overall means,
so large offsets cost no digits). Sums of blocks make every training set and
every test set; each fit and each fold's error is then a small solve, whatever
the number of folds, models and grid points. The data is read twice.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit, q
from .models import _cd_enet

#: Model kinds whose fit and error depend on the data only through Gram sums.
LINEAR_KINDS = ("linear", "ridge", "lasso", "enet")


class FoldGram:
    """Gram sums of complete rows per block between the edges of ``folds``."""

    def __init__(self, data: DataFrame, features: list, label: str, folds: list, pos: str = "row_pos"):
        cols = [*features, label]
        self.p = len(features)
        d = data.dropna(subset=cols)
        means = d.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        self.center = np.array([means[f"m{i}"] or 0.0 for i in range(len(cols))])
        self.edges = sorted({0, *(e for f in folds for e in (f.train_end, f.test_start, f.test_end))})
        block = " + ".join(f"CAST({q(pos)} >= {e} AS int)" for e in self.edges)
        z = [f"({q(c)} - {dlit(means[f'm{i}'] or 0.0)})" for i, c in enumerate(cols)]
        sums = [f"sum({a}) AS s{i}" for i, a in enumerate(z)]
        sums += [f"sum({a} * {z[j]}) AS g{i}_{j}" for i, a in enumerate(z) for j in range(i, len(z))]
        k, n = len(self.edges), len(cols)
        self.count, self.sum, self.gram = np.zeros(k + 1), np.zeros((k + 1, n)), np.zeros((k + 1, n, n))
        for r in d.withColumn("_block", F.expr(block)).groupBy("_block").agg(
                F.count(F.lit(1)).alias("n"), *map(F.expr, sums)).collect():        # a row per block
            b = r["_block"]
            self.count[b] = r["n"]
            for i in range(n):
                self.sum[b, i] = r[f"s{i}"]
                for j in range(i, n):
                    self.gram[b, i, j] = self.gram[b, j, i] = r[f"g{i}_{j}"]

    def _range(self, low: int, high: int) -> tuple[float, np.ndarray, np.ndarray]:
        at = slice(self.edges.index(low) + 1, self.edges.index(high) + 1)
        return self.count[at].sum(), self.sum[at].sum(axis=0), self.gram[at].sum(axis=0)

    def coefficients(self, kind: str, params: dict, low: int, high: int) -> tuple[float, np.ndarray]:
        """Intercept and slopes on the centred columns, fitted on rows [low, high)."""
        n, s, g = self._range(low, high)
        if n == 0:
            raise ValueError("no complete row to fit on")
        m = s / n
        c = g - n * np.outer(m, m)
        xx, xy = c[:-1, :-1], c[:-1, -1]
        if kind == "linear":
            b = np.linalg.lstsq(xx, xy, rcond=None)[0]
        elif kind == "ridge":
            b = np.linalg.solve(xx + params["alpha"] * np.eye(self.p), xy)
        else:
            share = 1.0 if kind == "lasso" else params.get("l1_ratio", 0.5)
            b = _cd_enet(xx / n, xy / n, params.get("alpha", 1.0), share, np.zeros(self.p), iters=10_000)
        return float(m[-1] - b @ m[:-1]), b

    def mse(self, kind: str, params: dict, fold) -> float:
        """Mean squared error on the fold's test rows of the fit on its training rows."""
        a, b = self.coefficients(kind, params, 0, fold.train_end)
        n, s, g = self._range(fold.test_start, fold.test_end)
        if n == 0:
            return float("nan")
        w = np.append(-b, 1.0)                     # residual = w . z - a
        return float(max(0.0, (w @ g @ w - 2 * a * (w @ s)) / n + a * a))


def linear_grid(df: DataFrame, features: list, label: str, kind: str, grid: list[dict]) -> list[tuple[dict, float, list[float]]]:
    """(params, intercept, slopes) of a linear kind at every grid point, fitted on
    all complete rows from one set of Gram sums: the data is read twice, however
    many points and iterations there are."""
    everything = SimpleNamespace(train_end=1, test_start=0, test_end=1)
    gram = FoldGram(df.withColumn("_pos", F.lit(0)), features, label, [everything], "_pos")
    out = []
    for params in grid:
        a, b = gram.coefficients(kind, params, 0, 1)
        out.append((params, float(a + gram.center[-1] - b @ gram.center[:-1]), [float(x) for x in b]))
    return out


def _sweep(a: np.ndarray, k: int) -> None:
    """Sweep the symmetric matrix on row and column k, in place; twice undoes it."""
    d = a[k, k]
    row = a[k] / d
    a -= np.outer(a[:, k], row)
    a[k] = a[:, k] = row
    a[k, k] = -1.0 / d


#: A feature of which less than this share is left beside the others adds nothing to a fit.
_COLLINEAR = 1e-10


def eliminate(df: DataFrame, features: list, label: str, k: int, step: float = 0.1) -> list:
    """K2: recursive elimination with least squares on standardised features: the
    ceil(step * p) weakest |coefficient| go, until k remain (of equal ones the later).

    One correlation matrix of the complete rows serves all steps. Sweeping it on every
    feature gives the full fit; sweeping once more on a feature takes it out again, so a
    step costs O(p^2) a feature on the driver, and neither a pass over the data nor a new
    fit. A feature that the others make up (or without spread) has coefficient 0 and goes
    first; those it kept out of the fit come in then."""
    cols = [*features, label]
    plain = [f"c{i}" for i in range(len(cols))]                # the assembler takes no odd names
    d = df.dropna(subset=cols).select(*[F.col(q(c)).cast("double").alias(n) for c, n in zip(cols, plain)])
    if len(d.take(2)) < 2:
        raise ValueError("no two complete rows to fit on")
    a = np.nan_to_num(Correlation.corr(VectorAssembler(inputCols=plain, outputCol="v").transform(d), "v").first()[0].toArray())
    np.fill_diagonal(a, (np.abs(a).sum(axis=0) > 1).astype(float))      # 0 for a column without spread
    kept, within, p = list(range(len(features))), set(), len(features)
    while True:
        for j in kept:
            if j not in within and a[j, j] > _COLLINEAR:
                _sweep(a, j)
                within.add(j)
        if len(kept) <= k:
            return [features[j] for j in kept]
        size = {j: abs(a[j, p]) if j in within else 0.0 for j in kept}
        order = sorted(kept, key=lambda j: (-size[j], j))
        for j in order[len(order) - min(len(kept) - k, max(1, math.ceil(step * len(kept)))):]:
            if j in within:
                _sweep(a, j)
                within.discard(j)
            kept.remove(j)
